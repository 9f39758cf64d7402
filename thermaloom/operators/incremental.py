"""Incremental recomputation: dependency closure, dirty windows, versioned coverage, bit sets, comparison."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Nodes by kind and edges (producer, consumer) of the dependency graph.
NODES = {
    "source": ("dem", "building_dsm", "vegetation_dsm", "landcover", "meteorology", "selected_date_time", "wind_coefficients", "model_parameters"),
    "view": ("output_selection",),
    "derived": ("relative_geometry", "walls", "wall_aspect", "building_visibility", "vegetation_visibility", "svf", "solar_atmospheric_state", "time_shadow", "radiation"),
    "stateful": ("surface_thermal_state",),
    "output": ("tmrt", "utci", "wbgt"),
}
EDGES = (
    ("dem", "relative_geometry"), ("building_dsm", "relative_geometry"), ("vegetation_dsm", "relative_geometry"), ("building_dsm", "walls"), ("building_dsm", "wall_aspect"), ("building_dsm", "building_visibility"),
    ("dem", "vegetation_visibility"), ("relative_geometry", "vegetation_visibility"), ("vegetation_dsm", "vegetation_visibility"), ("building_visibility", "svf"), ("vegetation_visibility", "svf"),
    ("meteorology", "solar_atmospheric_state"), ("selected_date_time", "solar_atmospheric_state"), ("solar_atmospheric_state", "time_shadow"), ("building_visibility", "time_shadow"), ("vegetation_visibility", "time_shadow"),
    ("walls", "time_shadow"), ("wall_aspect", "time_shadow"), ("svf", "radiation"), ("time_shadow", "radiation"), ("landcover", "radiation"), ("meteorology", "radiation"), ("model_parameters", "radiation"),
    ("landcover", "surface_thermal_state"), ("meteorology", "surface_thermal_state"), ("radiation", "surface_thermal_state"), ("radiation", "tmrt"), ("surface_thermal_state", "tmrt"), ("meteorology", "tmrt"),
    ("tmrt", "utci"), ("meteorology", "utci"), ("wind_coefficients", "utci"), ("tmrt", "wbgt"), ("meteorology", "wbgt"), ("wind_coefficients", "wbgt"), ("time_shadow", "wbgt"),
)
#: Elevation floors (degrees) of sky and sun, longest shadow and margin (m), block (cells), share from which all is recomputed.
SKY_FLOOR, SUN_FLOOR, LONGEST_SHADOW, MARGIN, BLOCK, FULL_SHARE = 6.0, 5.0, 300.0, 6.0, 16, 0.30


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "src string, dst string")


def closure(spark: SparkSession) -> DataFrame:
    """Everything downstream of every node: (source, node), by a recursive query; the graph has no cycle, so it ends."""
    return spark.sql(
        "with recursive reach(source, node) as (select src, dst from {edge} union all select r.source, e.dst from reach r join {edge} e on e.src = r.node) select distinct source, node from reach",
        edge=edges(spark),
    )


def topological_order(pairs: Iterable[tuple[str, str]] = EDGES) -> list[str]:
    """Nodes by the length of the longest path that leads to them, then by name; so each follows its producers."""
    pairs = list(pairs)
    nodes = {n for names in NODES.values() for n in names}
    depth, left = {}, set(nodes)
    while left:
        held = {b for a, b in pairs if a in left}
        level = left - held
        if not level:
            raise ValueError("the graph has a cycle")
        depth |= {n: len(set(depth.values())) for n in level}
        left -= level
    return sorted(nodes, key=lambda n: (depth[n], n))


def influence_reach(height: Column, radius: Column) -> Column:
    """How far (m) a tree can change the result: crown, the longer of the sky disc and the longest shadow, margin."""
    shadow = F.least(height / F.lit(0.08748866352592401), F.lit(LONGEST_SHADOW))  # tangent of the sun floor
    disc = F.least(height / F.lit(0.10510423526567646), F.lit(LONGEST_SHADOW))  # tangent of the sky floor
    return radius + F.greatest(shadow, disc) + MARGIN


def dirty_window(x0: Column, x1: Column, y0: Column, y1: Column, pixel: float, rows: int, cols: int, block: int = BLOCK) -> dict[str, Column]:
    """Half-open window of cells touched by world bounds, aligned outward to blocks and clamped to the grid."""
    down = lambda v: F.greatest(F.floor(F.floor(v / pixel) / block) * block, F.lit(0)).cast("int")
    up = lambda v, most: F.least(F.ceil(F.ceil(v / pixel) / block) * block, F.lit(most)).cast("int")
    return {"r0": down(y0), "r1": F.greatest(up(y1, rows), F.lit(0)), "c0": down(x0), "c1": F.greatest(up(x1, cols), F.lit(0))}


def recompute_mode(area: Column, total: int, share: float = FULL_SHARE) -> Column:
    return F.when(area / total >= share, "full").otherwise("local")


def merge_windows(windows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Windows (r0, r1, c0, c1) of each group merged while they overlap or lie within ``gap``; groups are single epochs."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rects = sorted(map(tuple, pdf[["r0", "r1", "c0", "c1"]].itertuples(index=False)))
        merged = True
        while merged:
            merged = False
            out: list[tuple] = []
            for a in rects:
                for i, b in enumerate(out):
                    if a[0] <= b[1] + gap and b[0] <= a[1] + gap and a[2] <= b[3] + gap and b[2] <= a[3] + gap:
                        out[i] = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                        merged = True
                        break
                else:
                    out.append(a)
            rects = sorted(set(out))
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), *r) for r in rects], columns=[*keys, "r0", "r1", "c0", "c1"])

    schema = windows.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1"))).schema
    return windows.groupBy(*keys).applyInPandas(merge, schema)


def cell_latest(patches: DataFrame, keys: list[str], version: str, value: str) -> DataFrame:
    """Latest value of each cell of half-open windows (r0, r1, c0, c1), by exploding to cells and ``max_by``."""
    cells = patches.withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    return cells.groupBy(*keys, "r", "c").agg(F.max_by(value, version).alias(value), F.max(version).alias(version), F.count("*").alias("writes"))


def islands(rows: DataFrame, keys: list[str], at: str, same: list[str]) -> DataFrame:
    """Maximal runs of successive integers ``at`` with equal values ``same``: keys, same, start, stop."""
    w = Window.partitionBy(*keys).orderBy(at)
    goes_on = F.lag(at).over(w) == F.col(at) - 1
    for s in same:
        goes_on = goes_on & F.lag(s).over(w).eqNullSafe(F.col(s))
    marked = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island", *same).agg(F.min(at).alias("start"), F.max(at).alias("stop")).drop("island")


def pack_bits(rows: DataFrame, keys: list[str], at: str, flag: Column) -> DataFrame:
    """Flags at positions 0..62 of each group as the bits of one number."""
    return rows.groupBy(*keys).agg(F.bit_or(F.when(flag, F.expr(f"shiftleft(1L, {at})")).otherwise(F.lit(0).cast("bigint"))).alias("bits"))


def compare(rows: DataFrame, by: list[str], reference: str, candidate: str, tolerance: float) -> DataFrame:
    """Mean, 99th percentile and largest absolute difference, and share beyond a tolerance, of each group."""
    d = F.abs(F.col(reference) - F.col(candidate))
    return rows.withColumn("d", d).where("d is not null").groupBy(*by).agg(
        F.avg("d").alias("mae"), F.expr("percentile_disc(0.99) within group (order by d)").alias("p99"), F.max("d").alias("max_abs"), F.avg(F.when(F.col("d") > tolerance, 1.0).otherwise(0.0)).alias("mismatch"), F.count("*").alias("n")
    )
