"""Token ids of documents in flat binary files with an index of 64-bit offsets, and the reader that maps them.

A file ``<name>.bin`` holds nothing but unsigned little-endian ids, two bytes each where all ids fit, else four. Its index
``<name>.idx`` has a header (magic, version, bytes per id, documents, tokens), the offsets of the documents in tokens (one more than
there are documents, from 0), their ids and a byte per document that tells whether it has an id, all as 64-bit little-endian but for
that last part. Documents come in ascending order of id within a file and from file to file; a file's place among all tokens (its base)
is the sum of the tokens of the files before it, so no task waits for another.

Documents are laid out by range of (id, text hash, input position), so that rows that share an id, or have none, spread over files. Each task
encodes its sorted rows as a stream, a stretch of texts at a time, and writes under a name no other attempt uses; only the
files in the list that Spark writes afterwards count. Long texts are cut at blanks for encoding, in memory of a bounded size.

With ``by_word`` (for tokenizers that lower-case, drop white space, never join over it, and give a run of ASCII letters to the model as
one piece) each distinct word between ASCII blanks is encoded once per worker and its ids are looked up; the result is that of the whole text. Without it whole texts are encoded.

Defined cases: a null text is empty, an empty one has only the end id; rows without an id come first, rows that share one are ordered by
text hash and text; repeated rows are documents each; an empty table gives no files and no rows; other columns are not read. Ids
are integers. Files live below the session's shared folder and are reached through ``pyarrow.fs`` by URI; local ones are memory-mapped.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, shared_path, staged

MAGIC, VERSION = b"TOKENIDX", 1
HEADER = struct.Struct("<8sIIqq")
#: Characters encoded together, words whose ids a worker keeps, new words encoded in one go.
STRETCH, KEPT_WORDS, JOINED = 4 << 20, 1_600_000, 4096
#: After a word of more bytes the kept words are dropped.
LONG_WORD = 1 << 16
#: Bytes of text behind one file, at least and at most; between them there are three files per core.
LEAST_BYTES, MOST_BYTES = 16 << 20, 256 << 20
FILE_FIELDS = "part int, file string, documents long, tokens long"
DIGEST_FIELDS = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"
READ_TOKENS = 1 << 20
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# -- encoding -----------------------------------------------------------------------------------------------------------------

class Encoder:
    """Ids of texts with the end id after each document; ids of known words lie in one array."""

    def __init__(self, model: str, end_id: int, by_word: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.by_word, self.end_id = Tokenizer.from_str(model), by_word, end_id
        self.dtype = np.dtype("<u2" if max(end_id, self.tokenizer.get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        # an added token that is cut out before anything else is done can stand between words that are encoded in one go
        self.gap = next(((i, t.content) for i, t in added.items() if not (t.normalized or t.single_word or t.lstrip or t.rstrip)), None)
        # runs of lower-case ASCII letters go straight to the model: there is nothing to normalise or to cut
        self.letters = Tokenizer.from_str(model)
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        # place 0 is the end of a document
        self.places: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.array([self.end_id], self.dtype), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _ids(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, tokenizer, words: list[str], joined: bool) -> None:
        """Encode new words and keep their ids."""
        if joined:
            number, token = self.gap
            flat = [self._ids(tokenizer, [token.join([*words[at:at + JOINED], ""])])[0] for at in range(0, len(words), JOINED)]
            ids = np.concatenate(flat)
            ends = np.flatnonzero(ids == number)
            lengths = np.diff(ends, prepend=-1) - 1
            ids = ids[ids != number]
        else:
            lists = self._ids(tokenizer, words)
            ids, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
        self.places.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)])
        self.lengths, self.flat = np.concatenate([self.lengths, lengths.astype(np.int32)]), np.concatenate([self.flat, ids])

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the ids of distinct words are; new ones are encoded and kept."""
        if len(self.places) + len(words) > KEPT_WORDS:
            self._forget()
        kinds: tuple[list[str], ...] = ([], [], [])
        for word in words:
            if word not in self.places:
                kinds[0 if self.gap is None or any(t in word for t in self.added) else 1 if word.isascii() and word.isalpha() else 2].append(word)
        for new, tokenizer, joined in zip(kinds, (self.tokenizer, self.letters, self.tokenizer), (False, True, True), strict=True):
            if new:
                self._learn(tokenizer, new, joined)
        return np.fromiter(map(self.places.__getitem__, words), np.int32, len(words))

    def encode(self, pieces: list[str], ends: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has; a piece that ends its document gets the end id."""
        if not self.by_word:
            lists = [np.append(ids, self.end_id).astype(self.dtype) if end else ids for ids, end in zip(self._ids(self.tokenizer, pieces), ends, strict=True)]
            return np.concatenate([np.zeros(0, self.dtype), *lists]), np.array([len(ids) for ids in lists], np.int64)
        words = pc.ascii_split_whitespace(pa.array(pieces, pa.large_string()))
        each = words.flatten()
        seen = pc.if_else(pc.string_is_ascii(each), pc.ascii_lower(each), each).dictionary_encode()
        place = self._places(seen.dictionary.to_pylist())
        bounds = words.offsets.to_numpy()
        bounds, ending = bounds - bounds[0], np.array(ends, bool)
        used = np.insert(place[seen.indices.to_numpy()], bounds[1:][ending], 0)
        lengths = self.lengths[used]
        stops = np.cumsum(lengths, dtype=np.int32)
        ids = self.flat[np.arange(stops[-1] if len(stops) else 0, dtype=np.int32) + np.repeat(self.starts[used] - stops + lengths, lengths)]
        upto = np.concatenate([[0], stops]).astype(np.int64)[bounds + np.concatenate([[0], np.cumsum(ending)])]
        if len(seen) and pc.max(pc.binary_length(seen.dictionary)).as_py() > LONG_WORD:
            self._forget()  # not to hold texts without blanks
        return ids, np.diff(upto)


#: The encoder of a Python worker, kept from task to task with the words it knows.
_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(model: str, end_id: int, by_word: bool) -> Encoder:
    key = (hashlib.sha256(model.encode()).digest(), end_id, by_word)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, end_id, by_word)
    return _ENCODERS[key]


def pieces_of(text: str, limit: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that end before a blank; a run without blanks stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(b, at + 1, at + limit) for b in " \t\n\x0b\x0c\r")
        if cut < 0:
            found = _BLANK.search(text, at + limit)
            if found is None:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


# -- writing ------------------------------------------------------------------------------------------------------------------

def _write(batches: Iterator[pa.RecordBatch], folder: str, model: Broadcast, end_id: int, by_word: bool) -> Iterator[pa.RecordBatch]:
    encoder, out, name = None, None, f"{folder}/{uuid.uuid4().hex}"
    documents, counts, tokens = [], [], 0
    waiting: list[tuple[str, bool]] = []
    held, part_of_document = 0, 0

    def put() -> None:
        nonlocal held, tokens, part_of_document
        ids, lengths = encoder.encode([t for t, _ in waiting], [e for _, e in waiting])
        out.write(ids.tobytes())
        tokens += len(ids)
        for length, (_, end) in zip(lengths.tolist(), waiting, strict=True):
            part_of_document += length
            if end:
                counts.append(part_of_document)
                part_of_document = 0
        waiting.clear()
        held = 0
        pa.default_memory_pool().release_unused()

    for batch in batches:
        if encoder is None and batch.num_rows:
            encoder = encoder_of(model.value, end_id, by_word)
            store, path = _opened(name + ".bin")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            out = store.open_output_stream(path, compression=None)
        # a copy, as the column would keep the whole batch in memory
        documents.append(pa.array(batch.column("doc_id").to_pylist(), pa.int64()))
        for text in batch.column("text"):
            parts = list(pieces_of(text.as_py() or "")) if by_word else [text.as_py() or ""]
            for i, piece in enumerate(parts):
                waiting.append((piece, i == len(parts) - 1))
                held += len(piece)
                if held >= STRETCH:
                    put()
    if encoder is None:
        return
    put()
    out.close()
    ids = pa.chunked_array(documents, pa.int64())
    offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    store, path = _opened(name + ".idx")
    with store.open_output_stream(path, compression=None) as index:
        index.write(HEADER.pack(MAGIC, VERSION, encoder.dtype.itemsize, len(ids), tokens))
        index.write(offsets.astype("<i8").tobytes())
        index.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
        index.write(ids.is_valid().to_numpy().astype("u1").tobytes())
    yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "documents": [len(ids)],
                                      "tokens": [tokens]})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = False, doc_id: str = "doc_id", text: str = "text",
                      folder: str | None = None) -> DataFrame:
    """Write the files; returns their list: part, file (URI without ending), documents, tokens, base."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    parts = min(max(math.ceil(total / MOST_BYTES), 3 * spark.sparkContext.defaultParallelism), math.ceil(total / LEAST_BYTES)) or 1
    order = ["doc_id", "hash"]
    laid = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(
        parts, *order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")
    target = folder or shared_path(spark)
    files = staged(laid.mapInArrow(lambda batches: _write(batches, target, model, end_id, by_word), FILE_FIELDS))
    # one row per file: prefix sums over the list give each file its base
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


# -- reading ------------------------------------------------------------------------------------------------------------------

class TokenFile:
    """One file with its index; ids are read where they lie, mapped if the file is local."""

    def __init__(self, name: str):
        store, path = _opened(name + ".idx")
        with store.open_input_stream(path, compression=None) as f:
            raw = f.read()
        magic, version, width, n, self.tokens = HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION or width not in (2, 4):
            raise ValueError(f"{name}: no index of this format")
        if len(raw) != HEADER.size + 8 * (2 * n + 1) + n:
            raise ValueError(f"{name}: the index is cut off")
        self.dtype, at = np.dtype(f"<u{width}"), HEADER.size
        self.offsets = np.frombuffer(raw, "<i8", n + 1, at)
        self.ids = np.frombuffer(raw, "<i8", n, at + 8 * (n + 1))
        self.known = np.frombuffer(raw, "u1", n, at + 8 * (2 * n + 1)).astype(bool)
        store, path = _opened(name + ".bin")
        self.file = pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)
        if self.file.size() != self.tokens * width or self.offsets[0] != 0 or self.offsets[-1] != self.tokens or (np.diff(self.offsets) < 0).any():
            raise ValueError(f"{name}: ids and offsets differ")

    def tokens_of(self, document: int) -> Iterator[np.ndarray]:
        """Ids of a document of the file, in parts of bounded size."""
        start, stop = int(self.offsets[document]), int(self.offsets[document + 1])
        for at in range(start, stop, READ_TOKENS):
            self.file.seek(at * self.dtype.itemsize)
            yield np.frombuffer(self.file.read_buffer((min(stop, at + READ_TOKENS) - at) * self.dtype.itemsize), self.dtype)


def _digests(batches: Iterator[pa.RecordBatch], tokens: bool) -> Iterator[pa.RecordBatch]:
    for given in batches:
        for part, name, base in zip(*(given.column(c).to_pylist() for c in ("part", "file", "base")), strict=True):
            file = TokenFile(name)
            rows, at, held = len(file.ids), 0, 0
            sums, lists = [], []
            for i in range(rows):
                crc, own = 0, []
                for ids in file.tokens_of(i):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    if tokens:
                        own.append(ids.astype("<u4"))
                        held += len(ids)
                sums.append(crc)
                if tokens:
                    lists.append(np.concatenate(own) if own else np.zeros(0, "<u4"))
                if i + 1 == rows or len(sums) == 20_000 or held >= READ_TOKENS:
                    some = slice(at, i + 1)
                    columns = {"doc_id": pa.array(file.ids[some], mask=~file.known[some]), "part": pa.array([part] * len(sums), pa.int32()),
                               "start": pa.array(base + file.offsets[some]), "n_tokens": pa.array(np.diff(file.offsets[at:i + 2])),
                               "ids_crc32": pa.array(sums, pa.int64())}
                    if tokens:
                        columns["tokens"] = pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)
                    sums, lists, at, held = [], [], i + 1, 0


def read_token_files(files: DataFrame, tokens: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, part, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as 32-bit little-endian), with ``tokens`` the ids too. Files are dealt to as many tasks as there are files."""
    named = files.select("part", "file", "base")
    fields = DIGEST_FIELDS + (", tokens array<long>" if tokens else "")
    return named.repartition(max(1, files.count())).mapInArrow(lambda batches: _digests(batches, tokens), fields)
