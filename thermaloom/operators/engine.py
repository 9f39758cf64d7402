"""Incremental engine and control plane as relations: coverage, composition, propagation, scheduling, guards, recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameters of the model that may be overridden, with their bounds.
MODEL_PARAMETERS = {
    "albedo_b": (0.0, 1.0), "albedo_g": (0.0, 1.0), "ewall": (0.0, 1.0), "eground": (0.0, 1.0), "absK": (0.0, 1.0), "absL": (0.0, 1.0), "Fside": (0.0, 1.0), "Fup": (0.0, 1.0), "Fcyl": (0.0, 1.0),
    "transVeg": (0.0, 1.0), "height": (0.0, 10.0), "leaf_start": (0.0, 366.0), "leaf_end": (0.0, 366.0), "elvis": (-1.0, 1.0),
}


def compose(base: DataFrame, versions: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The base with each later version put over it where it covers a key: one aggregation, no join.

    ``base``: keys, value; ``versions``: keys, order, value. Keys that only versions have are kept.
    """
    layered = base.select(*keys, F.lit(None).cast("bigint").alias("o"), F.col(value)).unionByName(versions.select(*keys, F.col(order).cast("bigint").alias("o"), F.col(value)))
    return layered.groupBy(*keys).agg(F.max_by(value, F.coalesce("o", F.lit(-(1 << 62)))).alias(value), F.max("o").alias(order))


def coverage(entries: DataFrame, invalidations: DataFrame, keys: Sequence[str], at: str, order: str) -> DataFrame:
    """Steps whose newest entry is not older than the newest invalidation of it: ``keys, at, revision, fresh``."""
    both = entries.select(*keys, at, F.col(order).alias("e"), F.lit(None).cast("bigint").alias("i")).unionByName(invalidations.select(*keys, at, F.lit(None).cast("bigint").alias("e"), F.col(order).alias("i")))
    g = both.groupBy(*keys, at).agg(F.max("e").alias("revision"), F.max("i").alias("cut"))
    return g.select(*keys, at, "revision", (F.col("revision").isNotNull() & (F.col("cut").isNull() | (F.col("revision") >= F.col("cut")))).alias("fresh"))


def gaps(covered: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """First and last step of each run of steps that no entry covers, between the first and the last that one does."""
    w = Window.partitionBy(*keys).orderBy(at)  # steps of one node and day, 96 at most
    nxt = F.lead(at).over(w)
    return covered.select(*keys, at).distinct().select(*keys, (F.col(at) + 1).alias("first"), (nxt - 1).alias("last")).where("last >= first")


def ranked(rows: DataFrame, keys: list[str], span: str, order: list[str]) -> DataFrame:
    """Rank within large groups: the rows of earlier spans are counted first, so that only the rows of one span are sorted together.

    ``span`` must not decrease in the order. Adds ``position`` (from 1) and ``queue``, the size of the group.
    """
    per = rows.groupBy(*keys, span).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    before = per.select(*keys, span, (F.sum("n").over(w.orderBy(span).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("queue"))
    inside = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, span).orderBy(*order)))
    return inside.join(before, [*keys, span]).withColumn("position", F.col("before") + F.col("place")).drop("before", "place")


def running(rows: DataFrame, keys: Sequence[str], span: str, order: Sequence[str], column: str, how: str) -> DataFrame:
    """Largest (``max``) or last known (``last``) value of each key up to and with each row, as ``running``.

    Large groups are split by ``span``, which must not be null nor fall in the order: what a span ends with is found first, so
    only the rows of one span are sorted together, and one row a span follows the whole group.
    """
    value, at = F.col(column), F.struct(*order)
    end = F.max(value) if how == "max" else F.max_by(value, F.when(value.isNotNull(), at))
    per = rows.groupBy(*keys, span).agg(end.alias("_end"))
    through = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, span, (F.max("_end") if how == "max" else F.last("_end", ignorenulls=True)).over(through).alias("_before"))
    within = Window.partitionBy(*keys, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_inside", F.max(value).over(within) if how == "max" else F.last(value, ignorenulls=True).over(within))
    both = F.greatest("_inside", "_before") if how == "max" else F.coalesce("_inside", "_before")
    met = [inside[k].eqNullSafe(before[k]) for k in keys] + [inside[span] == before[span]]
    joined = inside.join(before, met[0] if len(met) == 1 else _all(met), "left")
    return joined.select(*(inside[c] for c in rows.columns), both.alias("running"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], names: Sequence[str], width: float) -> DataFrame:
    """Discrete quantiles (the value at rank ceil(p n)) of large groups: ``keys, n`` and ``names``.

    Equal values are counted before the shuffle, counts are summed over spans of ``width`` of the value, and no task holds a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k")).withColumn("_span", F.floor(F.col(value) / width))
    per = counts.groupBy(*keys, "_span").agg(F.sum("_k").alias("_s"))
    w = Window.partitionBy(*keys)
    before = per.select(*keys, "_span", (F.sum("_s").over(w.orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_b"), F.sum("_s").over(w).alias("n"))
    reach = F.sum("_k").over(Window.partitionBy(*keys, "_span").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    inside = counts.withColumn("_reach", reach)
    joined = inside.join(before, _all([*(inside[k].eqNullSafe(before[k]) for k in keys), inside["_span"] == before["_span"]]))
    high = F.col("_b") + F.col("_reach")
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))
    pick = [F.max(F.when((high >= rank(p)) & (high - F.col("_k") < rank(p)), F.col(value))).alias(name) for p, name in zip(ps, names)]
    return joined.groupBy(*(inside[k] for k in keys)).agg(F.max("n").alias("n"), *pick, F.max(value).alias("worst"))


def contiguous(rows: DataFrame, keys: Sequence[str], span: str, order: Sequence[str], base: Column) -> DataFrame:
    """Sequence numbers without gaps from ``base`` on, large groups being ranked by span: see ``ranked``."""
    return ranked(rows, list(keys), span, list(order)).withColumn("sequence", base + F.col("position"))


def open_cell(cells: DataFrame, row: float, col: float) -> DataFrame:
    """The ground cell without trees nearest to a place; ties go to the lower row, then column. One row comes back, which is the operator's purpose."""
    d = (F.col("r") - row) ** 2 + (F.col("c") - col) ** 2
    return cells.where("dsm - dem < 2.0 and trees <= 0").select("r", "c", d.alias("distance2")).orderBy("distance2", "r", "c").limit(1)


def unhealed(records: DataFrame, keys: Sequence[str], order: str, partial: Column) -> DataFrame:
    """Keys whose newest complete record is older than a partial one, which must not be composed: ``keys, cut, healed``."""
    g = records.groupBy(*keys).agg(F.max(F.when(partial, F.col(order))).alias("cut"), F.max(F.when(~partial, F.col(order))).alias("healed"))
    return g.where("cut is not null and (healed is null or healed < cut)")


def budget(rows: DataFrame, keys: Sequence[str], at: str, seconds: int, most: int) -> DataFrame:
    """Rows of each key and fixed window, those admitted (``most`` at most) and refused."""
    window = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    g = rows.groupBy(*keys, window.alias("window")).agg(F.count("*").alias("asked"))
    return g.select(*keys, "window", "asked", F.least("asked", F.lit(most)).alias("admitted"), F.greatest(F.col("asked") - most, F.lit(0)).alias("refused"))


def padded(series: DataFrame, at: str, days: int = 1) -> Column:
    """Condition that keeps rows from ``days`` before ``start`` to ``days`` after ``stop``."""
    return F.col(at).between(F.col("start") - F.expr(f"interval {days} day"), F.col("stop") + F.expr(f"interval {days} day"))


def with_overrides(parameters: dict[str, float], overrides: dict[str, float]) -> dict[str, float]:
    """Parameters with overrides; unknown names and values out of bounds are refused."""
    unknown = sorted(set(overrides) - set(MODEL_PARAMETERS))
    if unknown:
        raise ValueError(f"unknown parameters: {unknown}")
    for name, value in overrides.items():
        low, high = MODEL_PARAMETERS[name]
        if not low <= value <= high:
            raise ValueError(f"{name} must lie in {low}..{high}")
    return {**parameters, **overrides}


def patch_shaded_below(sun_altitude: Column, sun_azimuth: Column, patch_azimuth: Column, asvf: Column) -> Column:
    """Altitude (degrees) below which a patch of building in this direction lies in shade."""
    turned = 2 * F.cos(F.radians(F.abs(sun_azimuth - patch_azimuth))) * F.tan(F.radians(sun_altitude))
    return F.degrees(F.atan(F.tan(asvf) + F.least(turned, F.lit(0.0))))
