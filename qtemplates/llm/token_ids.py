"""Token ids as binary blocks: one zstandard frame per document, one dictionary.

A file set is two Parquet tables under one path, so that any store Spark
writes to can hold it:

* ``dictionary``: one row, the shared zstandard dictionary and its sha256,
  trained on serialized ids of a bounded sample of short documents
  (``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters, in hash
  order).  It only affects size, never content.
* ``blocks``: ``part``, ``seq`` (their order is the order of documents, by
  ascending doc_id, null first), ``first_id``, ``last_id``, ``n_docs``,
  ``n_ids`` and ``payload``.

A payload is ``MAGIC``, the sha256 of the dictionary, the width of an id in
bytes and the number of documents, then the index - ids known (1 byte each),
doc_id (8), ids of the document (4) and ends of the frames (8) - then the
frames, each compressing one document alone.  A reader of one document needs
the index and one frame.

Ids are exactly the tokenizer's for the whole text: byte-level BPE never merges
across a space that is followed by something else, so texts are cut there and
equal pieces are encoded once (a bounded memory per worker).

Cases: null and empty texts are documents of the end id alone; repeated rows
and equal ids are kept, ordered by text hash; null ids come first; texts of any
length make one frame; an empty table gives no blocks; only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qtemplates.llm.common import hashed_sample, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"IDZ1"
DICTIONARY_BYTES = 1 << 16
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 1 << 15
LEVEL = 3
#: Bytes of frames, or documents, after which a block is closed.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 8192
#: Pieces remembered in a worker (as many again of those before), their
#: longest, characters handled at once.
_PIECES, _LONG, _CHUNK = 600_000, 100, 1 << 19
_HEAD = struct.Struct("<4s32sBI")
_CUT = re.compile(r"(?= \S)")
#: Words of Latin letters with marks after them, on one line or more: the
#: byte-level pattern cuts them into just these words, runs of marks and newlines.
_LETTERS, _MARKS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+", r"[!-&(-/:-@\[-`{-~]+"
_SIMPLE = re.compile(rf"( ?{_LETTERS})({_MARKS})?((?:\n{_LETTERS}(?:{_MARKS})?)*)")
_PARTS = re.compile(rf"{_LETTERS}|{_MARKS}|\n")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class _Doubtful(Exception):
    """A space before white space or the end: no place to cut at."""


class _Pieces(dict):
    """Serialized ids by piece, encoded when first asked for.  A key ``x``
    stands for `` x``, a key `` x`` for ``x`` without a space before it."""

    def __init__(self, encode, before: dict[str, bytes]):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= _LONG:
            self[key] = ids
        return ids


class Encoder:
    """Serialized ids of texts, remembering pieces between spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers
        self.tokenizer = tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their names in a text are text
        self.dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        # pieces met lately, and those of the time before: what is met again moves over
        self.known = _Pieces(self._encode, {})
        # words may go to the model itself if nothing but the byte-level pattern comes before it
        self.model, cut = tok.model, tok.pre_tokenizer
        self.direct = (isinstance(self.model, models.BPE) and not self.model.dropout and tok.normalizer is None
                       and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
                       and all(t.special for t in tok.get_added_tokens_decoder().values()))
        self.serial = [i.to_bytes(self.dtype.itemsize, "little") for i in range(tok.get_vocab_size())]
        # bytes as byte-level pieces write them: printable ones as they are, others from U+0100 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(0x100, 0x200))
        self.shown = [chr(b if b in shown else next(hidden)) for b in range(256)]

    def _word(self, key: str) -> bytes:
        """Ids of the word that ``key`` stands for."""
        word = key[1:] if key[0] == " " else " " + key
        word = word.replace(" ", "Ġ") if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        return b"".join([self.serial[t.id] for t in self.model.tokenize(word)])

    def _encode(self, key: str) -> bytes:
        """Ids of the piece that ``key`` stands for."""
        if not key or (key[0] != " " and key[0].isspace()):
            raise _Doubtful
        simple = _SIMPLE.fullmatch(key) if self.direct and len(key) <= _LONG else None
        if simple is None:
            text = key[1:] if key[0] == " " else " " + key
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        word, marks, lines = simple.groups()
        if lines:
            return self.known[word] + b"".join([self.known[" " + p] for p in _PARTS.findall(key, len(word))])
        return self.known[word] + self.known[" " + marks] if marks else self._word(word)

    def serialize(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``dtype``."""
        if len(self.known) > _PIECES:
            self.known.before = {}
            self.known = _Pieces(self._encode, self.known)
        out, piece = [], self.known.__getitem__
        for text in texts:
            first, *more = text.split(" ")
            try:
                out.append(piece(" " + first) + b"".join(map(piece, more)))
            except _Doubtful:
                first, *more = _CUT.split(text)
                out.append(piece(" " + first) + b"".join([piece(p[1:]) for p in more]))
        return out


_LOADED: dict = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _grouped(texts: list[str]):
    """Ranges of texts of about ``_CHUNK`` characters."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= _CHUNK):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def train_dictionary(documents: DataFrame, tokenizer: str | None = None) -> bytes:
    """A dictionary for serialized ids; empty if the sample is too small."""
    path = tokenizer or default_tokenizer()
    short = documents.select(text_or_empty().alias("text"), "doc_id").filter(F.length("text").between(1, SAMPLE_CHARS))
    sample = hashed_sample(short, ["doc_id"], SAMPLE_DOCS, ["text"]).select("text")

    def run(batches):
        import zstandard
        from qtemplates.llm import token_ids as own
        encoder, samples = own._encoder(path), []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _grouped(texts):
                samples += encoder.serialize(texts[i:j])
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too short
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["d"])

    rows = sample.coalesce(1).mapInArrow(run, "d binary").collect()  # one row
    return bytes(rows[0]["d"]) if rows else b""


def _zstd(dictionary: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack(docs: list[tuple], dtype: np.dtype, digest: bytes) -> bytes:
    """A payload of (doc_id or None, ids, frame)."""
    known = bytes(d is not None for d, _, _ in docs)
    ids = np.array([d or 0 for d, _, _ in docs], "<i8").tobytes()
    counts = np.array([n for _, n, _ in docs], "<u4").tobytes()
    ends = np.cumsum([len(f) for _, _, f in docs], dtype="<u8").tobytes()
    return b"".join([_HEAD.pack(MAGIC, digest, dtype.itemsize, len(docs)), known, ids, counts, ends, *(f for _, _, f in docs)])


class Payload:
    """Index of a payload; frames are read one at a time."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, width, n = _HEAD.unpack_from(data)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a block of token ids, or written with another dictionary")
        import zstandard
        at = _HEAD.size
        self.known = np.frombuffer(data, "u1", n, at).astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", n, at + n)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.ends = np.frombuffer(data, "<u8", n, at + 13 * n)
        self.frames, self.dtype, self.n = memoryview(data)[at + 21 * n:], np.dtype(f"<u{width}"), n
        self.reader = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """All ids of the k-th document, the end id included."""
        start = int(self.ends[k - 1]) if k else 0
        return np.frombuffer(self.reader.decompress(self.frames[start:int(self.ends[k])]), self.dtype)


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``text`` of every row and write the file set under ``path``."""
    spark, model = documents.sparkSession, tokenizer or default_tokenizer()
    dictionary = train_dictionary(documents, model)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        from qtemplates.llm import token_ids as own
        encoder = own._encoder(model)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, seq, docs, held = TaskContext.get().partitionId(), 0, [], 0

        def block():
            known = [d for d, _, _ in docs if d is not None]
            row = (part, seq, min(known, default=None), max(known, default=None), len(docs), sum(n for _, n, _ in docs), pack(docs, encoder.dtype, digest))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)],
                                              names=["part", "seq", "first_id", "last_id", "n_docs", "n_ids", "payload"])
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in _grouped(texts):
                for key, ids in zip(keys[i:j], encoder.serialize(texts[i:j]), strict=True):
                    frame = press.compress(ids + end)
                    docs.append((key, len(ids) // encoder.dtype.itemsize + 1, frame))
                    held += len(frame)
                    if held >= BLOCK_BYTES or len(docs) >= BLOCK_DOCS:
                        yield block()
                        seq, docs, held = seq + 1, [], 0
        if docs:
            yield block()

    ordered.mapInArrow(run, "part int, seq int, first_id long, last_id long, n_docs long, n_ids long, payload binary").write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()  # one row of bounded size
    if hashlib.sha256(bytes(row["dictionary"])).hexdigest() != row["sha256"]:
        raise ValueError("damaged dictionary")
    return bytes(row["dictionary"])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    frame_bytes and, if asked for, ids of every document."""
    dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # ids before each block: sums by part (one row a part) and within parts
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    ahead = spark.createDataFrame(before, "part int, part_start long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part")).join(ahead, "part")
              .select("part", "seq", (F.col("in_part") + F.col("part_start")).alias("block_start")))

    def run(batches):
        names = ["part", "seq", "doc_id", "ahead", "n_tokens", "ids_crc32", "frame_bytes"] + ["ids"] * with_ids
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload")), strict=True):
                p = Payload(data, dictionary)
                crc, ids = [], []
                for k in range(p.n):
                    own = p.ids(k)
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int32))
                counts = p.counts.astype(np.int64)
                sizes = np.diff(p.ends.astype(np.int64), prepend=0)
                cols = [pa.array(np.full(p.n, part, np.int32)), pa.array(np.full(p.n, seq, np.int32)), pa.array(p.doc_ids, pa.int64(), mask=~p.known),
                        pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    kind = "part int, seq int, doc_id long, ahead long, n_tokens long, ids_crc32 long, frame_bytes long" + ", ids array<int>" * with_ids
    docs = blocks.select("part", "seq", "payload").mapInArrow(run, kind).join(starts, ["part", "seq"])
    return docs.select("doc_id", (F.col("block_start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", "frame_bytes", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents: only blocks that may hold them are
    read, and of those only the documents' frames are decompressed."""
    dictionary, wanted = _dictionary(spark, path), sorted(set(doc_ids))
    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("first_id") <= d) & (F.col("last_id") >= d))

    def run(batches):
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                p = Payload(data, dictionary)
                hits = np.flatnonzero(np.isin(p.doc_ids, wanted) & p.known)
                yield pa.RecordBatch.from_arrays([pa.array(p.doc_ids[hits]), pa.array([p.ids(int(k)).astype(np.int32) for k in hits], pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])
    return spark.read.parquet(f"{path}/blocks").filter(near).select("payload").mapInArrow(run, "doc_id long, ids array<int>")
