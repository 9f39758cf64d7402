"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Forced-boundary splitting. The vocabulary is read once for the pairs of bytes
that stand side by side inside any of its tokens. A pair that stands in none is a
certain cut: no token can span it. Texts are cut there, the fragments are encoded
independently, and their ids are concatenated. A cut is taken only where the
splitting pattern of the tokenizer is sure to act alike on both sides: after a
character that is no white space (its look-ahead concerns white space alone) and
before one that is no apostrophe (which could open a contraction). Of the certain
cuts those are taken that leave fragments of ``FRAGMENT`` characters at least.

A text is read by one task. From ``SPREAD`` characters on its pieces, made by the same cuts,
become rows that are dealt out to all tasks, and their ids are put together again.

Defined results: a null or an empty text gives an empty list. Strings that look
like special tokens are ordinary text. Texts are never shortened.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermaloom.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; a file beyond this is refused.
MOST_BYTES = 64 << 20
#: Fragments shorter than this many characters are left joined: any subset of the certain cuts is right.
FRAGMENT = 128
#: From this many characters on the pieces of a text go to several tasks, each of this many at least.
SPREAD = 1 << 20

_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_APOSTROPHE = 39


class Encoder:
    """Encodes texts; made once for each Python worker."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) }
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            codes = np.frombuffer(token, dtype=np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        self.space = np.zeros(0x110000, dtype=bool)
        self.space[_SPACES] = True
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def cuts(self, text: str) -> np.ndarray:
        """Positions (in characters) before which the text may be cut."""
        if len(text) < 2:
            return np.zeros(0, dtype=np.int64)
        if text.isascii():
            cp = np.frombuffer(text.encode(), dtype=np.uint8)
            before, first = cp[:-1], cp[1:]
        else:
            cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            before = np.where(cp < 0x80, cp, 0x80 | (cp & 0x3F))[:-1]
            first = np.where(cp < 0x80, cp, np.where(cp < 0x800, 0xC0 | (cp >> 6), np.where(cp < 0x10000, 0xE0 | (cp >> 12), 0xF0 | (cp >> 18))))[1:]
        sure = ~self.inside[before, first] & (cp[1:] != _APOSTROPHE) & ~self.space[cp[:-1]]
        return np.flatnonzero(sure) + 1

    def fragments(self, text: str, least: int = FRAGMENT) -> list[str]:
        if len(text) <= least:
            return [text]
        cuts = self.cuts(text)
        at, out = 0, []
        while (i := int(np.searchsorted(cuts, at + least))) < len(cuts):
            out.append(text[at : cuts[i]])
            at = int(cuts[i])
        out.append(text[at:])
        return out

    def encode(self, text: str | None, least: int = FRAGMENT) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        encode = self.encoding.encode_ordinary
        return np.concatenate([np.array(encode(part), dtype=np.int32) for part in self.fragments(text, least)])


_ENCODERS: dict[int, Encoder] = {}


def encoder_source(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[], Encoder]:
    """A function for executors that gives the encoder; the file is read here and broadcast, its size being checked."""
    with open(vocabulary, "rb") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has more than {MOST_BYTES} bytes")
    shared = spark.sparkContext.broadcast(content)

    def get() -> Encoder:
        key = hash(shared.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(shared.value)
        return _ENCODERS[key]

    return get


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _encoded(rows: DataFrame, text: str, get: Callable[[], Encoder]) -> DataFrame:
    """The other columns of ``rows`` and ``ids`` of the text column, which is put last."""
    keep = [c for c in rows.columns if c != text]
    thin = rows.select(*keep, F.col(text).cast("string"))
    out = T.StructType([*thin.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids = [encoder.encode(t.as_py()) for t in part.column(len(keep))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*keep, "ids"])

    return thin.mapInArrow(run, out)


def _pieces(rows: DataFrame, text: str, get: Callable[[], Encoder], least: int) -> DataFrame:
    """``row_no, seq, piece`` of each text; ``row_no`` is a number of its row."""
    schema = pa.schema([("row_no", pa.int64()), ("seq", pa.int32()), ("piece", pa.large_string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        pieces = ((number.as_py(), i, x) for batch in batches for number, t in zip(*batch.columns) for i, x in enumerate(encoder.fragments(t.as_py(), least)))
        yield from _batches(pieces, schema.set(2, pa.field("piece", pa.string())), 4)

    return rows.select("row_no", F.col(text).cast("string")).mapInArrow(run, "row_no bigint, seq int, piece string")


def token_ids(docs: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, spread: int = SPREAD) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return encoded(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), spark, ["doc_id"], "text", vocabulary, spread)


def encoded(docs: DataFrame, spark: SparkSession, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, spread: int = SPREAD, measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """The columns ``keep`` of every document and its ``ids``, or ``measure`` of them."""
    get = encoder_source(spark, vocabulary)
    of = measure or (lambda ids: ids)
    thin = docs.select(*keep, F.col(text).alias("_text"))
    long = F.coalesce(F.length("_text"), F.lit(0)) >= spread
    short = _encoded(thin.where(~long), "_text", get).select(*keep, of(F.col("ids")).alias("ids"))
    numbered = materialize(thin.where(long).withColumn("row_no", F.monotonically_increasing_id()), "long")  # a number once given stays
    parts = _encoded(_pieces(numbered, "_text", get, spread).repartition("row_no", "seq"), "piece", get).select("row_no", F.struct("seq", of(F.col("ids")).alias("ids")).alias("x"))
    whole = parts.groupBy("row_no").agg(F.array_sort(F.collect_list("x"))["ids"].alias("xs"))
    put = F.flatten("xs") if measure is None else F.aggregate("xs", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return short.unionByName(numbered.join(whole, "row_no").select(*keep, put.alias("ids")))


def token_counts(docs: DataFrame, spark: SparkSession, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, spread: int = SPREAD) -> DataFrame:
    """The columns ``keep`` of every document, and ``n_tokens``."""
    return encoded(docs, spark, keep, text, vocabulary, spread, lambda ids: F.size(ids).cast("bigint")).withColumnRenamed("ids", "n_tokens")
