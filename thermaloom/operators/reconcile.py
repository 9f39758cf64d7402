"""Differences between two copies of a dataset.

Both copies go into one relation that is range-partitioned by key, so the two
sides share their split points. Each partition is sorted by key and side and
read once by a streaming two-pointer merge, which holds two rows at most and
emits keys that one side lacks and fields that differ.

Defined results
* A key that occurs on one side only gives one row, ``missing_left`` or
  ``missing_right``, with an empty field name.
* Null equals only null. NaN equals NaN.
* Repeated rows of a side count once; if rows of one key and side disagree, the
  one that sorts first (nulls first) stands for them.
* A null key is a key like any other. Empty copies give an empty result or only
  missing keys. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaloom.operators.arrow_stream import null_safe_equal, same_as_next
from thermaloom.session import materialize

DIFF_SCHEMA = "record_id string, rep int, field string, diff string"
_ARROW = pa.schema([("record_id", pa.string()), ("rep", pa.int32()), ("field", pa.string()), ("diff", pa.string())])


def digest_bytes(column: Column) -> Column:
    """The 256 bits a digest denotes, however written, as binary; null if null.

    Case, blanks, separators, a leading ``sha256`` or ``0x`` do not matter. What
    does not denote 256 bits is compared as its trimmed text.
    """
    plain = F.lower(F.regexp_replace(column, r"[\s:_-]", ""))
    hexa = F.regexp_replace(plain, "^(sha256|0x)", "")
    return F.when(hexa.rlike("^[0-9a-f]{64}$"), F.unhex(hexa)).otherwise(F.encode(F.trim(column), "UTF-8"))


def _drop_repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeats within a batch before the shuffle, so a key repeated very often reaches its reducer as a few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table.group_by(table.column_names, use_threads=False).aggregate([])
        yield from kept.select(table.column_names).combine_chunks().to_batches()


def _merge_sides(fields: Sequence[str]):
    def emit(t: pa.Table) -> pa.Table:
        """t: whole keys in order, at most one row for each key and side."""
        n = len(t)
        left = np.asarray(t["side"].to_numpy()) == 0
        pair = np.zeros(n, dtype=bool)  # the row and the next are the two sides of one key
        if n > 1:
            pair[:-1] = same_as_next(t["record_id"]) & same_as_next(t["rep"])
        second = np.concatenate([[False], pair[:-1]])
        out = []
        for rows, diff in ((left & ~pair, "missing_right"), (~left & ~second, "missing_left")):
            part = t.filter(pa.array(rows))
            out.append(pa.table({"record_id": part["record_id"], "rep": part["rep"], "field": pa.array([""] * len(part), pa.string()), "diff": pa.array([diff] * len(part), pa.string())}))
        first = np.flatnonzero(pair)
        a, b = t.take(pa.array(first)), t.take(pa.array(first + 1))
        for name in fields:
            differs = pa.array(~null_safe_equal(a[name], b[name]))
            part = a.filter(differs)
            out.append(pa.table({"record_id": part["record_id"], "rep": part["rep"], "field": pa.array([name] * len(part), pa.string()), "diff": pa.array(["differs"] * len(part), pa.string())}))
        return pa.concat_tables([x.cast(_ARROW) for x in out])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if carry is not None:
                t = pa.concat_tables([carry, t])
            if not len(t):
                continue
            same = same_as_next(t["record_id"]) & same_as_next(t["rep"])
            repeat = np.concatenate([[False], same & same_as_next(t["side"])])
            key_start = np.concatenate([[True], ~same])
            last = int(np.flatnonzero(key_start)[-1])  # the last key may go on in the next batch
            keep = ~repeat
            carry = t.slice(last).filter(pa.array(keep[last:]))
            done = t.slice(0, last).filter(pa.array(keep[:last]))
            if len(done):
                yield from emit(done).combine_chunks().to_batches()
        if carry is not None and len(carry):
            yield from emit(carry).combine_chunks().to_batches()

    return run


def reconcile(left: DataFrame, right: DataFrame, record_id: Column | str, rep: Column | str | None, fields: dict[str, Column]) -> DataFrame:
    """Rows ``record_id, rep, field, diff`` for two copies of one dataset.

    ``fields`` maps a field's name to the expression to compare, in terms of the
    columns of either copy.
    """
    rid = F.col(record_id) if isinstance(record_id, str) else record_id
    second = F.lit(0) if rep is None else (F.col(rep) if isinstance(rep, str) else rep)

    def side(df: DataFrame, mark: int) -> DataFrame:
        return df.select(rid.cast("string").alias("record_id"), second.cast("int").alias("rep"), F.lit(mark).cast("tinyint").alias("side"), *(e.alias(name) for name, e in fields.items()))

    both = side(left, 0).unionByName(side(right, 1))
    return merge_sides(both, list(fields))


def merge_sides(both: DataFrame, fields: Sequence[str], by: Sequence[str] = ("record_id", "rep")) -> DataFrame:
    """The merge itself over rows ``record_id, rep, side, fields...``."""
    thin = materialize(both.mapInArrow(_drop_repeats, both.schema), "sides")  # split points are sampled from it first
    ranged = thin.repartitionByRange(*by).sortWithinPartitions(*by, "side", *fields)
    return ranged.mapInArrow(_merge_sides(fields), DIFF_SCHEMA)
