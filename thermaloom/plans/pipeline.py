"""From terrain, trees, land cover and forcing to mean radiant temperature, UTCI and WBGT of every cell and step.

The formulas of a step (sun, sky, clearness, humidity) and of comfort are expressions;
the march, the carried surface temperature and the fluxes of a zone are one kernel
(``operators/solve.py``). A cell is shuffled once for its sky view and once for each zone
near it; what comes out is aggregated or written without another shuffle of cells and steps.
``thermal_summary`` folds the steps of a series in the kernel, so that cells times steps rows never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.functions import comfort, radiation, sky
from thermaloom.functions.formula import Step, apply
from thermaloom.operators import march, raster, solve
from thermaloom.plans.bindings import cells, met
from thermaloom.session import materialize

#: The table of steps is broadcast if it has at most so many rows, and joined as any other beyond.
MOST_STEPS = 100_000
OUTPUTS = ("tmrt", "utci", "wbgt", "lit", "k_down", "l_up")
#: Cells around a zone that may cast shadows into it; a zone's steps are dealt to so many tasks.
OVERLAP, PARTS = 60, 1

#: What depends on the step alone.
STEP_FORCING: list[Step] = [
    *sky.LOCAL_SUN, ("cos_alt", "cos(asin(least(1.0, greatest(-1.0, sin_alt))))"), *sky.DAY_LENGTH, *sky.CLEARNESS, *sky.diffuse_fraction(), *sky.PEREZ_STEPS, *radiation.CLEAR_SKY,
    ("day", "altitude > 0"), ("altmax", "90.0 - abs(latitude - dec_deg)"), ("psi", "case when doy > 97 and doy < 300 then 0.03 else 0.5 end"),
    ("ci_used", "least(coalesce(ci, 1.0), 1.0)"), *radiation.CLEAR_GLOBAL, ("ci_surface", radiation.CI_SURFACE),
    ("beam", "coalesce(direct, 0.0)"), ("scatter", "coalesce(diffuse, 0.0)"),
    ("tg_wall", "case when day then greatest((0.58 * altmax - 3.41) * sin((hour - sunrise) / (15.0 - sunrise) * pi() / 2.0) * ci_surface, 0.0) else 0.0 end"),
    ("va", "greatest(wind, 0.15)"),
    ("t_k", "ta + 273.15"), ("p_pa", "coalesce(p_kpa, 101.3) * 1000.0"), ("rh_part", "rh / 100.0"), ("e_pa", f"rh_part * ({comfort.saturation_pressure('t_k')})"), ("q", comfort.specific_humidity("p_pa", "e_pa")),
    *comfort.dew_point(), *comfort.wet_bulb(5), ("tw_c", "tw_k - 273.15"),
]

#: What depends on the step and on tmrt.
COMFORT: list[Step] = [*comfort.UTCI, *comfort.GLOBE, ("wbgt", comfort.wbgt())]
#: The part of it that depends on the step alone.
AIR: list[Step] = [x for x in (*comfort.UTCI, *comfort.GLOBE) if x[0] in ("tk", "pa", "hc", "bg_a")]

_FORCING = ("t", "hour", "doy", "latitude", "ta", "rh", "radg", "wind", "p_kpa")


def around(cells: DataFrame, zones: DataFrame, overlap: int, keep: Sequence[str], bucket: int = 64) -> DataFrame:
    """``zone, own`` and the columns ``keep`` of the cells of each zone's extent and of ``overlap`` cells about it; ``own`` tells those of the zone itself.

    ``zones``: zone, r, c of the cells that make up the zones. An equi-join on buckets of the plane, by which no cell meets a zone that is far off.
    """
    e = zones.groupBy("zone").agg(*(f(x).alias(f"{n}{x}") for x in "rc" for n, f in (("lo_", F.min), ("hi_", F.max))))
    span = lambda x: F.sequence(F.floor((F.col(f"lo_{x}") - overlap) / bucket), F.floor((F.col(f"hi_{x}") + overlap) / bucket))
    near = e.withColumn("br", F.explode(span("r"))).withColumn("bc", F.explode(span("c")))
    own = cells.select(*keep, F.col("zone").alias("home"), F.floor(F.col("r") / bucket).alias("br"), F.floor(F.col("c") / bucket).alias("bc"))
    inside = [F.col(x).between(F.col(f"lo_{x}") - overlap, F.col(f"hi_{x}") + overlap) for x in "rc"]
    return own.join(near, ["br", "bc"]).where(inside[0] & inside[1]).select("zone", (F.col("home") == F.col("zone")).alias("own"), *keep)


def thermal_comfort(city: DataFrame, forcing: DataFrame, top: float, outputs: Sequence[str] = ("tmrt", "utci"), scale: float = 1.0, block: int = 512, ground_only: bool = False, keys: Sequence[str] = (), overlap: int = OVERLAP, parts: int = PARTS, isotropic: bool = False) -> DataFrame:
    """``zone, keys, t, r, c`` and ``outputs`` for each cell and step of its zone; null in buildings, which ``ground_only`` leaves out.

    ``city``: zone (or none), r, c, dem, dsm, trees, lc. ``forcing``: zone, keys, t, hour, doy, latitude, ta, rh, radg, wind, p_kpa, one row a step;
    ``keys`` tell apart series of steps (days), between which nothing is carried. A zone is solved by ``parts`` tasks, a series by one;
    it should hold some 1,000 by 1,000 cells at most, as it is one array. Steps without a latitude or a measure give no rows.

    The sky is anisotropic, summed over 153 patches, unless ``isotropic``.

    Filter by place or step on the inputs, or on zone, keys, t, r, c: a filter on an output
    would make the optimizer write out its whole formula for the condition.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    city, steps = _zoned(city, forcing, keys)
    at = ["zone", *keys, "t"]

    def rows(sky_: pa.Table, series: Sequence, m: int, ground: np.ndarray, r: np.ndarray, c: np.ndarray, found: Iterator[tuple[np.ndarray, ...]]) -> pa.Table:
        n = sky_.num_rows
        planes = {o: np.zeros((n, m)) for o in solve.OUT}
        for i, step in enumerate(found):
            for o, v in zip(solve.OUT, step):
                planes[o][i] = v
        out = sky_.select(at).take(pa.array(np.repeat(np.arange(n), m), pa.int64()))
        for name, v in (("r", np.tile(r, n)), ("c", np.tile(c, n)), ("ground", np.tile(ground, n)), *((o, planes[o].ravel()) for o in solve.OUT)):
            out = out.append_column(name, pa.array(v, pa.int32() if name in "rc" else pa.float64()))
        return out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.select(*at).schema)
    solved = _solved(city, steps, keys, solve.STEP, rows, f"{types}, r int, c int, ground double, " + ", ".join(f"{o} double" for o in solve.OUT), top, scale, block, ground_only, overlap, parts, isotropic)
    air = [c for c in steps.columns if c not in (*at, *solve.OUT)]
    few = steps.limit(MOST_STEPS + 1).count() <= MOST_STEPS
    joined = solved.join(F.broadcast(steps.select(*at, *air)) if few else steps.select(*at, *air), at)
    # null goes through the formulas: as a condition around them it would keep Spark from compiling them in pieces
    out = apply(joined.withColumns({o: F.when(F.col("ground") == 1, F.col(o)) for o in solve.OUT}), COMFORT)
    return out.select("zone", *keys, "t", "r", "c", *outputs)


def thermal_summary(city: DataFrame, forcing: DataFrame, top: float, keys: Sequence[str] = (), which: DataFrame | None = None, scale: float = 1.0, block: int = 512, overlap: int = OVERLAP, parts: int = PARTS, isotropic: bool = False) -> DataFrame:
    """``zone, keys, r, c, hours`` and mean and largest tmrt, UTCI and WBGT of each ground cell over the steps of each series; the arguments are those of ``thermal_comfort``.

    What ``thermal_comfort`` gives, grouped by cell and series: ``hours`` counts steps, what is null in a step is left out of mean and maximum.
    ``which``: zone and another column by which the forcing goes instead of the zone, where zones share it. A series is in one task whole, so its steps are folded there. Nothing is shuffled behind, and steps meet cells by zone and not in a join.
    """
    if which is None:
        city, steps = _zoned(city, forcing, keys)
    else:
        shared = next(x for x in which.columns if x != "zone")
        steps = _zoned(city, forcing.withColumnRenamed(shared, "zone"), keys)[1].withColumnRenamed("zone", shared)
    steps = apply(steps, AIR).select(*(["zone"] if which is None else [shared]), *keys, "t", *solve.STEP, *solve.AIR)
    steps = steps if which is None else which.join(steps, shared).drop(shared)
    at = ["zone", *keys]
    out = [f"{n}_{x}" for x in solve.FELT for n in ("mean", "max")]

    def rows(sky_: pa.Table, series: Sequence, m: int, ground: np.ndarray, r: np.ndarray, c: np.ndarray, found: Iterator[tuple[np.ndarray, ...]]) -> pa.Table:
        first, hours, parts_ = [], [], {o: [] for o in out}
        wanted = sky_.select([*solve.STEP, *solve.AIR]).to_pylist() if m else []
        for begin, n, felt in solve.fold(found, wanted, series, m):
            first.append(begin)
            hours.append(n)
            for o in out:
                parts_[o].append(pa.nulls(m, pa.float64()) if felt[o] is None else pa.array(felt[o]))
        k = len(first)
        table = sky_.select(at).take(pa.array(np.repeat(np.array(first, np.int64), m), pa.int64()))
        for name, v in (("r", pa.array(np.tile(r, k), pa.int32())), ("c", pa.array(np.tile(c, k), pa.int32())), ("hours", pa.array(np.repeat(np.array(hours, np.int64), m), pa.int64())), *((o, pa.chunked_array(parts_[o], pa.float64())) for o in out)):
            table = table.append_column(name, v)
        return table

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.select(*at).schema)
    return _solved(city, steps, keys, (*solve.STEP, *solve.AIR), rows, f"{types}, r int, c int, hours bigint, " + ", ".join(f"{o} double" for o in out), top, scale, block, True, overlap, parts, isotropic)


def _zoned(city: DataFrame, forcing: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The city in zones, and what depends on the step alone."""
    if "zone" not in city.columns:  # one zone
        city, forcing = city.withColumn("zone", F.lit(0)), forcing.withColumn("zone", F.lit(0))
    needed = ("hour", "doy", "latitude", "ta", "rh", "radg", "wind")
    return city, apply(forcing.dropna(subset=list(needed)).select("zone", *keys, *_FORCING), STEP_FORCING)


def _solved(city: DataFrame, steps: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: Callable[..., pa.Table], ddl: str, top: float, scale: float, block: int, ground_only: bool, overlap: int, parts: int, isotropic: bool) -> DataFrame:
    """What ``rows`` makes of each zone's steps, cells and what ``solve.each`` finds for them."""
    layered = raster.layers(city)
    # what a cell sees travels as bits, and its cover as a class: view factors and properties are worked out where a zone is solved
    number = lambda c: F.col(c).cast("double").alias(c)
    known = layered.select("zone", "r", "c", "ground", *(number(x) for x in ("dsm", "vegdsm", "vegdsm2")), raster.clean_land_cover(F.col("lc")).cast("int").alias("lc"))
    height = {x: F.col(x).alias(f"{x}_") for x in ("dsm", "vegdsm", "vegdsm2")}  # as planes the march takes null for 0
    seen = march.sky_bits_blocks(known.select("*", *height.values()), top, block, scale, carry=["zone", "ground", "lc", *(f"{x}_" for x in height)])
    packed = seen.select("zone", "r", "c", *(F.col(f"{x}_").alias(x) for x in height), F.concat(F.array("ground", "lc"), "bits").alias("fixed"))
    near = around(packed, city.select("zone", "r", "c"), overlap, ["r", "c", "dsm", "vegdsm", "vegdsm2", "fixed"])
    # cells around a zone only cast shadows: they go without what is known of them
    dealt = near.select("zone", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "own", "r", "c", "dsm", "vegdsm", "vegdsm2", F.when(F.col("own"), F.col("fixed")).alias("fixed"))
    suns = steps.select("zone", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(parts)).cast("int").alias("part"), *keys, "t", *(number(x) for x in columns))

    fixed = ("ground", "lc", *march.SEEN)

    def static(known: np.ndarray, trunk: np.ndarray) -> dict[str, np.ndarray]:
        of = dict(zip(fixed, known.T))
        cover = np.array(raster.LAND_COVER)
        at = np.searchsorted(cover[:, 0], of["lc"])
        props = dict(zip(("albedo", "emissivity", "tgk", "tstart", "tmax_h"), cover[at, 1:].T))
        return of | props | march.sky_of(of, trunk == 0)

    def zone(t: pa.Table, sky_: pa.Table) -> pa.Table:
        own = t["own"].to_numpy(zero_copy_only=False).astype(bool) if len(t) else np.zeros(0, bool)
        known = np.zeros((0, len(fixed)), np.int64)
        if own.any():
            known = t["fixed"].filter(pa.array(own)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(fixed))
            if ground_only:
                keep = known[:, 0] == 1
                own[np.flatnonzero(own)[~keep]] = False
                known = known[keep]
        trunk = np.nan_to_num(t["vegdsm2"].to_numpy(zero_copy_only=False))[own] if len(t) else np.zeros(0)
        of = static(known, trunk)
        n, m = sky_.num_rows, int(own.sum())
        r, c = (t[x].to_numpy() if len(t) else np.zeros(0, np.int32) for x in "rc")
        sky_ = sky_.sort_by([(x, "ascending") for x in (*keys, "t")]) if n else sky_
        series = list(zip(*(sky_[k].to_pylist() for k in keys))) if keys else [()] * n
        found = iter(())
        if m and n:
            r0, c0 = r.min(), c.min()
            planes = []
            for p in ("dsm", "vegdsm", "vegdsm2"):
                g = np.zeros((int(r.max() - r0 + 1), int(c.max() - c0 + 1)))
                g[r - r0, c - c0] = np.nan_to_num(t[p].to_numpy())
                planes.append(g)
            found = solve.each(planes, (r[own] - r0, c[own] - c0), of, sky_.select(list(solve.STEP)).to_pylist(), series, top, scale, None if isotropic else of)
        return rows(sky_, series, m, of["ground"], r[own], c[own], found)

    by = ["zone", "part"]
    return dealt.groupBy(*by).cogroup(suns.groupBy(*by)).applyInArrow(zone, ddl)


# -- queries ------------------------------------------------------------------------------------------
#: Rows of the city that make a zone.
ZONE_ROWS = 32


def _mean_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean day of each month in each tile, hour by hour, over all plausible readings of the tile's stations."""
    m = met(spark, sf_dir).where("ta between -60 and 60 and rh between 1 and 100 and radg between 0 and 1300 and wind between 0 and 60 and latitude is not null")
    mean = [F.avg(c).alias(c) for c in ("ta", "rh", "radg", "wind", "p_kpa")]
    return m.groupBy("tile", F.month("obs_time").alias("month"), F.col("it").cast("int").alias("t")).agg(*mean, F.round(F.avg("doy")).alias("doy"), F.min("latitude").alias("latitude")).withColumn("hour", F.col("t") + 0.5)


def _zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The city in zones, the mean days of tiles, and the tile whose forcing each zone has: the tiles with stations, in turn."""
    days = materialize(_mean_days(spark, sf_dir), "days")  # a few rows a tile, of which all readings are the input: made once
    tiles = sorted(r.tile for r in days.select("tile").distinct().collect())  # the grid has 48
    city = cells(spark, sf_dir).withColumn("zone", F.floor(F.col("r") / ZONE_ROWS).cast("int"))
    which = city.select("zone").distinct().withColumn("tile", F.element_at(F.array(*map(F.lit, tiles)), (F.col("zone") % len(tiles) + 1).cast("int"))) if tiles else city.select("zone", F.lit(None).cast("string").alias("tile")).limit(0)
    return city, days, which


def comfort_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest mean radiant temperature, UTCI and WBGT of every ground cell over the hours of each month's mean day."""
    city, days, which = _zones(spark, sf_dir)
    out = thermal_summary(city, days, 26.0, keys=("month",), which=which)
    return out.select("r", "c", "month", "hours", *(F.round(f"{n}_{x}", 3).alias(f"{n}_{x}") for x in ("tmrt", "utci", "wbgt") for n in ("mean", "max")))


def comfort_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ground cells are in each heat-stress class in each hour of each month's mean day."""
    city, days, which = _zones(spark, sf_dir)
    out = thermal_comfort(city, which.join(days, "tile"), 26.0, ("utci", "tmrt"), ground_only=True, keys=("month",))
    return out.withColumn("stress", F.expr(comfort.utci_class())).groupBy("month", "t", "stress").agg(F.count("*").alias("cells"), F.round(F.avg("utci"), 3).alias("mean_utci"), F.round(F.max("tmrt"), 3).alias("max_tmrt")).orderBy("month", "t", "stress")


QUERIES = {"comfort_cells": comfort_cells, "comfort_by_hour": comfort_by_hour}
SQL: dict[str, str] = {}
