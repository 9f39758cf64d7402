"""Percentiles of very large numeric columns, by deterministic buffer collapsing.

A sketch of a group is a set of buffers of ``k`` sorted values; a buffer of level
l stands for ``2**l`` readings a value. Two buffers of one level collapse into
one of the next by taking every second value of their merge, from the first or
the second in turn. Buffers merge like the digits of a binary counter, so the
tree is balanced, and each level adds at most n / (2 k) to the error of a rank.

Error bound. A collapse into level l moves the rank of any value by at most
``2**(l-1)``. The sum over all collapses is kept with the sketch, so every answer
comes with a bound that holds for its data: the reported value is the value at a
rank that differs from the wanted one by at most ``rank_error``. Below k values
nothing collapses and the answer is exact. n values cost about n log2(n/k) / (2k).

Sketches of partitions, days or files are rows of the same form, one for each
buffer, and any union of them merges again. Nothing is random.

Every task collapses what it reads, so what is shuffled grows with groups, tasks and
log(n), not with n (a task that has fewer than k values of a group passes them on as they are). The rows of a group are merged in two
levels, first by ``part``, one of ``PARTS`` numbers dealt out by task, then by group: a group of
any size is spread over so many tasks, and the last one sees at most PARTS sketches of it.

Defined results: null and NaN do not count, every other value does, repeats and
infinities included; the p-percentile is the value at rank ceil(p n), at least 1;
null is a group of its own; a group without values gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2048
#: Into so many parts the sketches of a group are dealt for the first level of merging.
PARTS = 32


class Sketch:
    """Buffers by level; ``rest`` holds fewer than k single values."""

    __slots__ = ("k", "levels", "rest", "held", "n", "error", "turn")

    def __init__(self, k: int = K) -> None:
        self.k = k
        self.levels: dict[int, np.ndarray] = {}
        self.rest: list[np.ndarray] = []
        self.held = self.n = self.error = 0
        self.turn = 0

    def add(self, values: np.ndarray) -> None:
        """Single values, in any order."""
        self.n += len(values)
        self.rest.append(values)
        self.held += len(values)
        if self.held >= self.k:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.k * self.k
            for part in flat[:whole].reshape(-1, self.k):
                self._carry(0, np.sort(part))
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def add_buffer(self, level: int, values: np.ndarray, error: int = 0) -> None:
        """A buffer of another sketch, and its share of the error made so far."""
        self.error += error
        if level == 0 and len(values) < self.k:
            self.add(values)
        else:
            self.n += len(values) << level
            self._carry(level, values)

    def _carry(self, level: int, values: np.ndarray) -> None:
        while level in self.levels:
            both = np.concatenate([self.levels.pop(level), values])
            both.sort(kind="stable")
            values = both[self.turn :: 2]
            self.turn ^= 1
            self.error += 1 << level
            level += 1
        self.levels[level] = values

    def buffers(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """(level, values, error); the whole error goes with the first."""
        error = self.error
        if self.held:
            yield 0, np.concatenate(self.rest), error
            error = 0
        for level, values in sorted(self.levels.items()):
            yield level, values, error
            error = 0

    def quantiles(self, ps: Sequence[float]) -> list[float]:
        parts = [(v, 1 << level) for level, v, _ in self.buffers()]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w, dtype=np.int64) for v, w in parts])
        order = np.argsort(values, kind="stable")
        reach = np.cumsum(weights[order])
        ranks = [max(1, -int(-(p * self.n) // 1)) for p in ps]
        at = np.minimum(np.searchsorted(reach, ranks), len(values) - 1)
        return [float(x) for x in values[order][at]]


def _sketch_schema(keys: int) -> tuple[str, pa.Schema]:
    ddl = ", ".join([f"k{i} string" for i in range(keys)] + ["part int", "level int", "buffer array<double>", "error bigint"])
    return ddl, pa.schema([*((f"k{i}", pa.string()) for i in range(keys)), ("part", pa.int32()), ("level", pa.int32()), ("buffer", pa.list_(pa.float64())), ("error", pa.int64())])


def _emit(sketches: Iterable[tuple[tuple, Sketch]], part: int | None, schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows of sketches by key; without a ``part`` it is the last of the key."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for key, sketch in sketches:
        for level, values, error in sketch.buffers():
            rows.append((*key, *(() if part is None else (part,)), level, values, error))
            if len(rows) >= most:
                yield batch()
                rows = []
    if rows:
        yield batch()


def sketch(df: DataFrame, value: Column, keys: Sequence[Column], k: int = K, held: int = 1 << 21) -> DataFrame:
    """Sketch buffers of each group, made within the input's partitions, without a shuffle.

    Rows ``k0.., part, level, buffer, error``. A task that holds more than ``held``
    values lets its sketches go and begins anew, so its memory is bounded for any
    number of groups.
    """
    nk = len(keys)
    ddl, schema = _sketch_schema(nk)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple, Sketch] = {}
        count, part_no = 0, TaskContext.get().partitionId() % PARTS
        for batch in batches:
            pdf = batch.to_pandas()
            codes, uniques = pd.factorize(pd.MultiIndex.from_frame(pdf.iloc[:, :nk]) if nk > 1 else pdf.iloc[:, 0], use_na_sentinel=False)
            v = pdf["v"].to_numpy()
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(uniques)))
            for u, part in zip(uniques, np.split(v[order], ends[:-1])):
                key = tuple(None if x is None or x != x else x for x in (u if nk > 1 else (u,)))
                now.setdefault(key, Sketch(k)).add(part)
            count += len(v)
            if count >= held:
                yield from _emit(now.items(), part_no, schema)
                now, count = {}, 0
        yield from _emit(now.items(), part_no, schema)

    v = value.cast("double")
    return (
        df.select(*(c.cast("string").alias(f"k{i}") for i, c in enumerate(keys)), v.alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v")).mapInArrow(run, ddl)
    )


def merge(sketches: DataFrame, keep: Sequence[str], k: int = K) -> DataFrame:
    """Merge sketches into those of the keys ``keep`` (some of k0, k1, ..., renamed in this order), in each part by itself."""
    ddl, schema = _sketch_schema(len(keep))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(_merged(batches, len(keep) + 1, k), None, schema)

    return _gathered(sketches, keep, ["part"]).mapInArrow(run, ddl)


def _gathered(sketches: DataFrame, keep: Sequence[str], more: Sequence[str]) -> DataFrame:
    names = [f"k{i}" for i in range(len(keep))]
    renamed = sketches.select(*(F.col(x).alias(n) for x, n in zip(keep, names)), *more, "level", "buffer", "error")
    return renamed.repartition(*names, *more).sortWithinPartitions(*names, *more, "level", F.xxhash64("buffer"))


def _merged(batches: Iterable[pa.RecordBatch], keep: int, k: int) -> Iterator[tuple[tuple, Sketch]]:
    now, state = None, Sketch(k)
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(keep)]
        levels, buffers, errors = batch.column(keep).to_pylist(), batch.column(keep + 1), batch.column(keep + 2).to_pylist()
        for i in range(batch.num_rows):
            key = tuple(c[i] for c in columns)
            if key != now:
                if now is not None:
                    yield now, state
                now, state = key, Sketch(k)
            state.add_buffer(levels[i], buffers[i].values.to_numpy(), errors[i])
    if now is not None:
        yield now, state


def percentiles(sketches: DataFrame, keep: Sequence[str], ps: Sequence[float], k: int = K) -> DataFrame:
    """``k0.., n, q0.., rank_error`` for the keys ``keep`` of sketches, merged in two levels."""
    names = [f"k{i}" for i in range(len(keep))]
    ddl = ", ".join([f"{x} string" for x in names] + ["n bigint"] + [f"q{i} double" for i in range(len(ps))] + ["rank_error bigint"])
    schema = pa.schema([*((x, pa.string()) for x in names), ("n", pa.int64()), *((f"q{i}", pa.float64()) for i in range(len(ps))), ("rank_error", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, s.n, *s.quantiles(ps), s.error) for key, s in _merged(batches, len(keep), k)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return _gathered(merge(sketches, keep, k), names, []).mapInArrow(run, ddl)
