"""Views that give the driver's tables the shapes the operators expect; the SQL runs in both engines."""

VIEWS = {
    "fx_pg": """
select page_id, url, page_id % 12 as listing_id, cast(floor(page_id / 12.0) as int) + 1 as page_no,
  concat(html, '<img src="/i/', cast(page_id % 40 as string), '.jpg"><img data-src="pic', cast(page_id % 7 as string), '.PNG?x=1">',
  '<img src="data:image/png;base64,AA"><source type="image/webp" srcset="/s/', cast(page_id as string), '.webp 1x, /s/', cast(page_id as string), 'b.webp 2x">',
  '<a href="/list?p=', cast(page_id % 5 + 1 as string), '">n</a><a href="/photos-index-aid-', cast(page_id % 9 as string), '.html">', url, '</a>',
  '<script>var d={"images":["/j/', cast(page_id % 9 as string), '.gif"]}</script>') as html
from pages
""",
    "fx_term": """
select p_partkey as term_id, p_name as zh, p_type as vi, p_size % 3 <> 0 as enabled, p_brand as source,
  1704067200 + p_partkey as created_s, case when p_size % 2 = 0 then 1704067200 + p_partkey + p_size end as updated_s,
  concat('宗', p_name) as zh_han, p_partkey % 40 as series_id from part
""",
    "fx_term_line": """
select series_id, term_id as line_no, case when term_id % 11 = 0 then '# comment' when term_id % 7 = 0 then concat('@note: ', vi)
  when term_id % 13 = 0 then vi else concat(zh_han, ' => ', vi, case when term_id % 10 = 0 then ' @keep' else '' end) end as line from fx_term
""",
    "fx_conv": """
select conv_id as page_id, turn as seg_no, text as src, case turn % 4 when 0 then lower(text) when 1 then text when 2 then '' else concat(text, ' đã xong') end as trans from conversations
""",
    "fx_att": """
select cast(user_id % 10 as bigint) as run_id, concat('https://h', cast(user_id % 7 as string), '.example.com/i/', cast(event_id % 500 as string), case when event_id % 3 = 0 then '.jpg' else '' end) as url,
  event_id % 500 as idx, case when event_id % 4 = 0 then '' else concat('f', cast(event_id % 6 as string)) end as folder, case when event_id % 5 = 0 then '' else 'https://ref.example.com/' end as referer,
  row_number() over (partition by user_id % 10, user_id % 7, event_id % 500, event_id % 3 = 0 order by event_id) - 1 as attempt_no,
  case when event_id % 13 = 0 then null when event_type = 'error' then 503 when event_type = 'signup' then 404 when event_type = 'view' then 429 else 200 end as http_status,
  case when event_id % 13 = 0 then concat('timed out after ', cast(event_id % 40 as string), ' s') end as error,
  case when event_id % 5 = 0 then 'text/html' else 'image/jpeg' end as content_type, ts from events
""",
    "fx_ev": """
select user_id as run_id, event_id as seq, ts, case event_type when 'click' then 'progress' when 'error' then 'error' when 'purchase' then 'done' else 'log' end as type,
  event_type as state, cast(floor(value) as bigint) as amount from events
""",
    "fx_box": """
select l_orderkey as page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as region_id,
  cast(l_partkey % 800 as int) as x1, cast(l_suppkey * 7 % 1100 as int) as y1, cast(l_partkey % 800 + 20 + cast(l_quantity as int) * 3 as int) as x2,
  cast(l_suppkey * 7 % 1100 + 16 + l_linenumber * 5 as int) as y2, l_returnflag = 'A' as is_container, l_discount * 10 as conf,
  concat(l_returnflag, l_linestatus, repeat('x', cast(l_linenumber as int))) as text from lineitem
""",
    "fx_file": """
select o_orderkey as file_id, concat('/data/s', cast(o_custkey % 40 as string), '/original/chap', cast(o_orderkey % 12 as string)) as folder,
  concat('p', cast(o_orderkey % 97 as string), case o_orderkey % 6 when 0 then '.jpg' when 1 then '.png' when 2 then '.webp' when 3 then '.JPEG' when 4 then '.bmp' else '.txt' end) as name,
  cast(floor(o_totalprice) as bigint) as length, o_orderdate as mtime from orders
""",
    "fx_seg": """
select cast(floor(p_partkey / 8) as bigint) as page_id, p_partkey % 8 as seg_no, p_partkey as seg_id, p_partkey % 40 as series_id,
  case p_partkey % 24
    when 0 then concat('结母', p_name) when 1 then concat('非常好oooo那', p_name) when 2 then concat(p_name, '.com')
    when 3 then upper(p_name) when 4 then concat('www.', p_brand, '说了别这样里面！！')
    when 5 then concat('第', cast(p_size as string), '章 ', p_name) when 6 then '于逆星之下举起义旗'
    when 7 then concat('他拿起手中的剑', p_name, '朝我') when 8 then concat('妈妈给我零花钱', p_name)
    when 9 then '宝贝我爱你。' when 10 then '老师同学吧' when 11 then '筑基丹与结丹初期的修士在这里'
    when 12 then 'ドキドキさん' when 13 then concat('哈哈哈，', p_name) when 14 then '' when 15 then '   '
    when 16 then 'PIX1V:fh8di' when 17 then '狂风卷着细碎的灵晶飞过来' when 18 then '细碎的灵晶全部落下来了吧'
    when 19 then concat('「', p_name, '」') when 20 then concat('(', p_name, '】') when 21 then '金丹修士 oo'
    when 22 then concat('oo夫人吧oo', p_name) else p_type end as src,
  case p_partkey % 22
    when 0 then concat('[thought] ', p_name, ' đã xong') when 1 then concat('"', p_name, ' chưa xong')
    when 2 then concat('「', p_name, ' thế à!」') when 3 then '[cont] ' when 4 then concat('[cont] tiếp ', p_name)
    when 5 then '[SFX] ầm' when 6 then concat('<think>x', chr(10), 'y</think>', p_name, ' và chu don')
    when 7 then concat('tôi và em ', p_name) when 8 then 'cầu xin anh hãy tha cho con nhé'
    when 9 then concat('Trúc Cơ ', p_name, ' ở đây') when 10 then concat('the ', p_name, ' is here') when 11 then '哈哈 được'
    when 12 then '' when 13 then '【】' when 14 then concat(p_name, chr(10), 'ab', chr(10), 'www.x.com')
    when 15 then concat('[title] ', p_name) when 16 then '[title]' when 17 then '12345'
    when 18 then concat('xin chào |', p_name, '|</s>') when 19 then concat('một', chr(92), 'nhai/nba ', p_name)
    when 20 then concat('1. một 2.5 ', p_name, ' 2. hai 10:30') else concat('"', p_name, '" đây"') end as trans,
  case p_partkey % 9 when 0 then 'speech' when 1 then 'thought' when 2 then 'moan' when 3 then 'shout'
    when 4 then 'narration' when 5 then 'sfx' when 6 then 'fear' when 7 then 'anger' end as kind,
  case p_size % 5 when 0 then 'rect' when 1 then 'cloud' when 2 then 'burst' when 3 then 'oval' end as shape,
  p_size % 2 = 0 as on_bubble, p_name as name, p_type as type, p_brand as brand
from part
""",
    "fx_reply": """
select conv_id * 1000 + turn as reply_id, cast(turn % 3 + 1 as int) as n_expected, 1100 as w, 1300 as h,
  case (conv_id + turn) % 6
    when 0 then concat('skip this <|1|>', text, chr(10), '<|2>[thought] ', role)
    when 1 then concat('Boxes: [{"bbox":[', cast(turn * 10 as string), ',20,2000,"', cast(conv_id % 90 as string), '"],"text":" ', role,
      ' "},{"bbox":[1,2],"text":"x"},{"bbox":[5,5,6,6],"text":"tiny"},{"bbox":[9,9,60,70],"text":"', cast(conv_id as string), '"}] done')
    when 2 then concat('["', replace(replace(text, chr(10), ' '), '"', ''), '", {"note":"z","translation":"', role, ' chu"}]')
    when 3 then concat('1: YES', chr(10), '2. no', chr(10), '  3) Yes', chr(10), '2: YES', chr(10), cast(turn + 4 as string), ' - YES')
    when 4 then concat('1. 青云宗 => ', role, chr(10), '- 李雷 → Lý Lôi', chr(10), '剑：kiếm', chr(10), '青云宗: hai ', cast(conv_id as string), chr(10), text)
    else text end as raw
from conversations
""",
    "fx_region": """
select p_partkey as region_no, concat('img', cast(p_partkey % 400 as string), '.jpg') as image,
  case when p_partkey % 400 % 3 = 0 then 'replace' when p_partkey % 400 % 3 = 1 then 'merge' else 'other' end as mode,
  cast(p_partkey % 400 % 14 - 1 as int) as mask_dilate,
  p_partkey % 97 / 80.0e0 - 0.1e0 as x, p_partkey % 89 / 80.0e0 as y, p_partkey % 31 / 100.0e0 as w, p_partkey % 29 / 90.0e0 as h,
  case when p_partkey % 4 = 0 then concat(' ', p_name, ' ') else '' end as text,
  p_partkey % 5 = 0 as inpaint_only, p_partkey % 6 = 0 as erase_flat, p_partkey % 7 = 0 as erase_box,
  case p_partkey % 3 when 0 then '#A0b1C2' when 1 then 'zz' end as flat_color,
  case p_partkey % 4 when 0 then 'FFEEDD' end as text_color,
  case p_partkey % 3 when 0 then 'dir/Comic.TTF' when 1 then 'x.exe' end as font,
  cast(p_size * 5 as int) as font_size, cast(p_size % 14 as int) as own_dilate, cast(p_size as double) * 9.03e0 - 200e0 as rotate
from part
""",
    "fx_ctx": """
select conv_id % 12 as series_id, conv_id * 1024 + turn as seg_id, conv_id as page_id, turn as seg_no, text as src,
  case (conv_id + turn) % 5 when 0 then '  ' when 1 then concat('Em ', text, ' mẹ') when 2 then concat(text, ' tôi đi') else text end as trans
from conversations
""",
}
VIEWS["fx_pair"] = """
select p_partkey as pos, concat('宗', p_name, ' ', cast(p_size as string)) as zh, p_type as vi, p_brand as source,
  p_size % 3 <> 0 as enabled, p_partkey % 40 as series_id from part
"""
VIEWS["fx_store"] = """
select pos as term_id, zh, vi, enabled, source, 1704067200 + pos as created_s,
  case when pos % 2 = 0 then 1704067200 + pos * 2 end as updated_s
from (select *, row_number() over (partition by zh order by pos) as rn from fx_pair where pos % 3 = 0) where rn = 1
"""
VIEWS["fx_site"] = """
select page_id, url, listing_id, page_no, concat(html,
  '<h1 class="big post-title">Chap <b>', cast(page_id as string), '</b></h1><article class="post-content"><p><img data-src="/c/', cast(page_id as string),
  '-1.jpg" src="data:x"><img src=c2.webp><img src="/c/', cast(page_id as string), '-1.jpg"></p></article>',
  '<article class="post-item x"><h2 class="entry-title"><a href="/art/', cast(page_id % 13 as string), '.html" title=" ">Series A <i>', cast(page_id % 13 as string), '</i></a></h2></article>',
  '<article class="x post-item"><h2 class="entry-title"><a title="Series B" href="/art/', cast(page_id % 5 as string), '.html">other</a></h2></article>',
  '<a href="/page/', cast(page_id % 4 + 1 as string), '">more</a><a href="/photos-index-aid-', cast(page_id % 9 as string), '.html"><img src="t.svg"> A longer title for the gallery: no ', cast(page_id as string), '?</a>',
  '<a href="/photos-index-aid-77.html"></a><a href="/photos-index-aid-77.html">short</a>') as html
from fx_pg
"""
VIEWS["fx_list"] = """
select listing_id, concat('https://site.example.com/l', cast(listing_id as string)) as url from (select distinct listing_id from fx_pg)
"""
VIEWS["fx_list_page"] = """
select case when page_no = 1 then concat('https://site.example.com/l', cast(listing_id as string))
   else concat('https://site.example.com/l', cast(listing_id as string), '?p=', cast(page_no as string)) end as url,
 listing_id, page_no, concat('<a href="?p=', cast(page_id % 5 + 1 as string), '">n</a><a href="/photos-index-aid-', cast(page_id as string), '.html">[team] Story ',
  cast(listing_id as string), ' - part ', cast(page_no as string), '</a><a href="/photos-index-aid-', cast(100000 + page_id as string), '.html">[team] Story ', cast(listing_id as string), ' - extra</a>') as html
from fx_pg
"""
VIEWS["fx_art_page"] = """
select case when page_no = 1 then concat('https://site.example.com/l', cast(listing_id as string))
   else concat('https://site.example.com/l', cast(listing_id as string), '/page/', cast(page_no as string)) end as url,
 listing_id, page_no, concat('<a href="/page/', cast(page_id % 5 + 1 as string), '">n</a><article class="post-item"><h2 class="entry-title"><a href="/a', cast(page_id % 30 as string), '.html">Tale ',
  cast(listing_id as string), ' 1', cast(page_id % 30 as string), '</a></h2></article>') as html
from fx_pg
"""
