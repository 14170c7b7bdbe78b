"""WARC archives with Zstandard: writing, with revisit records for repeated payloads, and reading back.

An archive starts with a skippable frame that holds a dictionary, then has one Zstandard frame per record. Each task writes its own
rows to archives of a bounded size, with a dictionary trained on the first records of the archive (at most ``TRAIN_BYTES``), under
names no other attempt uses; the list of archives, written by Spark as a table, names those of the attempts that counted, so a task
that runs twice leaves no record twice. Archives lie below the session's shared folder and are reached through ``pyarrow.fs`` by URI.

The reader takes the dictionary from the leading skippable frame, decodes frame by frame in bounded memory, and checks for each record:
version line, mandatory headers, content length against the block, the closing blank lines, that the frame ends with the record, the
HTTP head of the payload, and payload length and digest of responses. What is wrong with a record is told in ``problem``; a broken frame
ends its archive with a row that says so.

Payloads of at least ``MIN_REVISIT`` bytes that are equal have one response, the record with the smallest id; the others are revisits.
Defined cases: a null payload is empty; a null id is written without one and reads back null, it is never referred to while another
record has the payload; rows that repeat the smallest id are responses all; a null URL is left out; line breaks and other
controls in URLs are percent-encoded; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, shared_path, staged

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES, TRAIN_RECORDS, DICTIONARY_BYTES = 2 << 20, 400, 32 << 10
#: fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVE_FIELDS = "archive string, records long, bytes long"
RECORD_FIELDS = ("archive string, position long, record_id long, url string, record_type string, refers_to long, payload_digest string, "
                 "payload_bytes long, payload binary, problem string")
_CHUNK = 1 << 16


# -- records ------------------------------------------------------------------------------------------------------------------

def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <urn:page:{record_id}>" if record_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {DATE}", f"Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return b"\r\n".join([VERSION, *(h.encode("utf-8", "surrogatepass") for h in head), b"", b""]) + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _page(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """The fields of one decoded frame; ``problem`` tells the first thing that is wrong."""
    out = dict.fromkeys(("record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return out | {"problem": "no WARC header"}
    fields = _headers(lines[1:])
    if missing := [x for x in NEEDED if not fields.get(x)]:
        return out | {"problem": f"without {missing[0]}"}
    digest = fields.get("warc-payload-digest", "")
    target = fields.get("warc-target-uri")
    out |= {"record_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")),
            "url": re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), target) if target is not None else None,
            "payload_digest": digest.removeprefix("sha256:") or None}
    if not fields["content-length"].isdigit() or len(rest) != (length := int(fields["content-length"])) + 4:
        return out | {"problem": "content length differs from the block"}
    if rest[length:] != b"\r\n\r\n":
        return out | {"problem": "record does not end with two line breaks"}
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    first, *http_lines = http.split(b"\r\n")
    told = _headers(http_lines).get("content-length", "")
    if not gap or not first.startswith(b"HTTP/") or not told.isdigit():
        return out | {"problem": "no HTTP head"}
    out["payload_bytes"] = int(told)
    if fields["warc-type"] == "revisit":
        return out | {"problem": "revisit with a payload" if payload else None if fields.get("warc-refers-to") else "revisit of nothing"}
    out["payload"] = payload
    if len(payload) != int(told):
        return out | {"problem": "payload length differs"}
    if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        return out | {"problem": "payload digest differs"}
    return out


# -- writing ------------------------------------------------------------------------------------------------------------------

def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Archive:
    """One archive being written; records wait until there are enough to train the dictionary."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting, self.waiting_bytes, self.records, self.bytes, self.out, self.packer = [], 0, 0, 0, None, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is not None:
            return self._put(self.packer.compress(record))
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= TRAIN_BYTES or len(self.waiting) >= TRAIN_RECORDS:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, k=200, d=8, level=3)
        except (zstandard.ZstdError, ValueError):
            # too few or too small records to train on: their start serves as content-only dictionary
            trained = zstandard.ZstdCompressionDict(b"".join(self.waiting)[:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        store, path = _opened(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)  # the name would have it compressed again
        content = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        self._put(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self._put(self.packer.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._start()
        self.out.close()
        return self.uri, self.records, self.bytes


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for batch in batches:
        for record_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("record_id", "url", "payload", "digest", "refers_to")), strict=True):
            archive = archive or _Archive(folder)
            archive.add(record_bytes(record_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
            if archive.bytes >= limit:
                done.append(archive.close())
                archive = None
    if archive:
        done.append(archive.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])


def with_revisits(rows: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Add refers_to to (record_id, url, payload, digest): the smallest id of an equal payload, null for responses. Only payloads that
    occur more than once are joined."""
    light = rows.filter(F.length("payload") >= min_bytes).select("digest", "record_id")
    repeated = staged(light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))
                      .filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select(F.col("digest").alias("d"), "first_id"))
    joined = rows.join(repeated, (F.col("digest") == F.col("d")) & (F.length("payload") >= min_bytes), "left")
    return joined.select("record_id", "url", "payload", "digest",
                         F.when(~F.col("first_id").eqNullSafe(F.col("record_id")), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str | Column = "html",
                   min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows below ``folder``; the written list of archives (archive, records, bytes)."""
    body = F.coalesce((quoted(payload) if isinstance(payload, str) else payload).cast("binary"), F.lit(b""))
    rows = pages.select(quoted(page_id).cast("long").alias("record_id"), quoted(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    return staged(with_revisits(rows, min_bytes).mapInArrow(lambda batches: _write(batches, folder, archive_bytes), ARCHIVE_FIELDS))


# -- reading ------------------------------------------------------------------------------------------------------------------

def frames(stream) -> Iterator[bytes]:
    """Decoded frames of an archive one after the other. Raises ValueError where the archive is broken."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    content = stream.read(size)
    if len(content) != size:
        raise ValueError("dictionary frame is cut")
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 30)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    rest = b""
    while data := rest or stream.read(_CHUNK):
        frame, parts = reader.decompressobj(), []
        while data:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as error:
                raise ValueError(f"broken frame: {error}") from error
            if frame.eof:
                break
            data = stream.read(_CHUNK)
        if not frame.eof:
            raise ValueError("last frame is cut")
        rest = frame.unused_data
        yield b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    kinds = dict(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    for given in batches:
        for uri in given.column("archive").to_pylist():
            rows, held, position = [], 0, 0
            store, path = _opened(uri)
            with store.open_input_stream(path, compression=None) as stream:
                parts = frames(stream)
                while True:
                    try:
                        data = next(parts)
                    except StopIteration:
                        break
                    except ValueError as error:
                        rows.append(dict.fromkeys(names) | {"archive": uri, "position": position, "problem": str(error)})
                        break
                    row = parse_record(data) | {"archive": uri, "position": position}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    position, held = position + 1, held + len(row["payload"] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives (column archive: URIs). Archives are dealt out to as many tasks as there are archives: they are large and
    their addresses small, so a number left to Spark would follow the addresses. Each archive is read as a stream."""
    # numbered, the list is one partition, whose rows are dealt out one by one; several partitions would each start anywhere, and some tasks get none
    listed = archives.select("archive", F.row_number().over(Window.orderBy("archive")).alias("number"))
    return listed.repartition(max(1, archives.count())).mapInArrow(lambda batches: _read(batches, payloads), RECORD_FIELDS)


def archive_folder(spark: SparkSession) -> str:
    return shared_path(spark)
