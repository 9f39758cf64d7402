"""Applying a change feed of inserts, updates and deletes.

Per-key ordered replay. Operations are partitioned by key and block of sequence
numbers, sorted by sequence within the partition, and read once by a state
machine that applies partial-column updates and skips sequences it has already
applied. What a block does to its key is a small summary; the summaries of a key
are replayed in the same way, in block order. So a key that holds a large part
of the feed is spread over as many tasks as it has blocks, and no task holds
more than one key's state.

Verbs
* ``add`` sets the state anew; the generation is 0, or one more than the last.
* ``replace`` sets the fields it carries, ``move`` only the position fields.
* ``delete`` removes. All but ``add`` do nothing to a key that is not live.

Defined results
* Rows without key or sequence do nothing. A repeated sequence of a key is
  applied once, the first copy in (sequence, verb) order.
* A null field is not carried. Unknown verbs do nothing.
* An update takes effect if it carries a field it may set, known here or not.
* An empty feed gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BlockState:
    """The effect of a run of operations on one key, before and after its first ``add``."""

    __slots__ = ("adds", "live", "seq", "values", "pre_deleted", "pre_seq", "pre", "done")

    def __init__(self, width: int) -> None:
        self.adds, self.live, self.seq, self.values = 0, False, None, [None] * width
        self.pre_deleted, self.pre_seq, self.pre = False, None, [None] * width
        self.done = None

    def apply(self, seq: int, verb: str, carries: bool, values: list, position: Sequence[int]) -> None:
        if self.done is not None and seq <= self.done:
            return
        self.done = seq
        if verb == "add":
            self.adds += 1
            self.live, self.seq, self.values = True, seq, list(values)
            return
        if self.adds:
            if not self.live:
                return
            if verb == "delete":
                self.live = False
            elif carries and verb in ("replace", "move"):
                _lay(self.values, values, position if verb == "move" else range(len(values)))
                self.seq = seq
        elif not self.pre_deleted:
            if verb == "delete":
                self.pre_deleted = True
            elif carries and verb in ("replace", "move"):
                _lay(self.pre, values, position if verb == "move" else range(len(values)))
                self.pre_seq = seq


class KeyState:
    """State of one key over its blocks."""

    __slots__ = ("generation", "live", "seq", "values")

    def __init__(self, width: int) -> None:
        self.generation, self.live, self.seq, self.values = -1, False, None, [None] * width

    def apply(self, adds: int, live: bool, seq, values: list, pre_deleted: bool, pre_seq, pre: list) -> None:
        if self.live:
            _lay(self.values, pre, range(len(pre)))
            self.seq = self.seq if pre_seq is None else pre_seq
            self.live = not pre_deleted
        if adds:
            self.generation += adds
            self.live, self.seq, self.values = live, seq, list(values)


def _lay(state: list, values: list, which: Iterable[int]) -> None:
    for i in which:
        if values[i] is not None:
            state[i] = values[i]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def replay(feed: DataFrame, keys: Sequence[str], sequence: str, verb: str, carries: str, fields: Sequence[str], position: Sequence[str], block: int = 16384) -> DataFrame:
    """Live keys with ``generation``, ``last_sequence`` and ``fields`` (doubles).

    ``carries`` names a boolean column: the operation carries a field it may set.
    """
    n, at = len(fields), [list(fields).index(p) for p in position]
    nk = len(keys)
    key_ddl = ", ".join(f"`k{i}` string" for i in range(nk))
    key_pa = [(f"k{i}", pa.string()) for i in range(nk)]
    part_ddl = f"{key_ddl}, block bigint, adds bigint, live boolean, seq bigint, pre_deleted boolean, pre_seq bigint, " + ", ".join([f"v{i} double" for i in range(n)] + [f"p{i} double" for i in range(n)])
    part_pa = pa.schema([*key_pa, ("block", pa.int64()), ("adds", pa.int64()), ("live", pa.bool_()), ("seq", pa.int64()), ("pre_deleted", pa.bool_()), ("pre_seq", pa.int64()), *((f"v{i}", pa.float64()) for i in range(n)), *((f"p{i}", pa.float64()) for i in range(n))])
    out_ddl = f"{key_ddl}, generation int, last_sequence bigint, " + ", ".join(f"v{i} double" for i in range(n))
    out_pa = pa.schema([*key_pa, ("generation", pa.int32()), ("last_sequence", pa.int64()), *((f"v{i}", pa.float64()) for i in range(n))])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, state = None, BlockState(n)
            for row in _rows(batches):
                key = row[: nk + 1]
                if key != now:
                    if now is not None:
                        yield (*now, state.adds, state.live, state.seq, state.pre_deleted, state.pre_seq, *state.values, *state.pre)
                    now, state = key, BlockState(n)
                state.apply(row[nk + 1], row[nk + 2], row[nk + 3], list(row[nk + 4 :]), at)
            if now is not None:
                yield (*now, state.adds, state.live, state.seq, state.pre_deleted, state.pre_seq, *state.values, *state.pre)

        return _batched(rows(), part_pa)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, state = None, KeyState(n)
            for row in _rows(batches):
                key = row[:nk]
                if key != now:
                    if now is not None and state.live:
                        yield (*now, state.generation, state.seq, *state.values)
                    now, state = key, KeyState(n)
                _, adds, live, seq, pre_deleted, pre_seq, *values = row[nk:]
                state.apply(adds, live, seq, values[:n], pre_deleted, pre_seq, values[n:])
            if now is not None and state.live:
                yield (*now, state.generation, state.seq, *state.values)

        return _batched(rows(), out_pa)

    kcols = [f"k{i}" for i in range(nk)]
    ops = feed.select(
        *(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)),
        F.floor(F.col(sequence) / F.lit(block)).cast("bigint").alias("block"),
        F.col(sequence).cast("bigint").alias("s"), F.lower(F.col(verb)).alias("verb"), F.coalesce(F.col(carries), F.lit(False)).alias("carries"),
        *(F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(fields)),
    ).where(F.col("s").isNotNull() & F.col("verb").isin("add", "replace", "move", "delete"))
    for k in kcols:
        ops = ops.where(F.col(k).isNotNull() & (F.col(k) != ""))
    by_block = ops.repartition(*kcols, "block").sortWithinPartitions(*kcols, "block", "s", "verb").mapInArrow(blocks, part_ddl)
    by_key = by_block.repartition(*kcols).sortWithinPartitions(*kcols, "block").mapInArrow(whole, out_ddl)
    return by_key.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "generation", "last_sequence", *(F.col(f"v{i}").alias(f) for i, f in enumerate(fields)))
