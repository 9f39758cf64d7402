"""Forcing ETL: alignment, daily diagnostics, night profiles, gap filling, tile means, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaloom.operators import engine

#: Density times heat capacity of air, by which radiation is scaled for the heat-island amplitude.
RHO_CP = 1.225 * 1005.0
#: Fixed value: radiation up to this (W/m2) is night for the heat-island profile.
NIGHT_RADIATION = 5.0


def align_accumulated(instant: DataFrame, accumulated: DataFrame, keys: list[str]) -> DataFrame:
    """Instantaneous and hourly accumulated (J/m2) fields on their exact common times; W/m2 from joules."""
    return instant.join(accumulated, keys).withColumn("shortwave", F.col("ssrd") / 3600.0).drop("ssrd")


def daily_amplitude(met: DataFrame) -> DataFrame:
    """Per station and local day: mean radiation and wind, temperature range, and the heat-island amplitude
    (S * range**3 / wind)**(1/4), with S the scaled radiation and a wind of 1 m/s at least."""
    day = met.groupBy("station", F.to_date("obs_time").alias("day")).agg(
        F.avg("radg").alias("sw"), F.avg("wind").alias("ws"), F.max("ta").alias("tmax"), F.min("ta").alias("tmin"), F.count("*").alias("n")
    )
    strength = F.greatest(F.coalesce(F.col("sw") / RHO_CP * F.pow(F.col("tmax") - F.col("tmin"), 3), F.lit(0.0)), F.lit(0.0))
    return day.withColumn("amplitude", F.pow(strength / F.when(F.col("ws") > 1.0, F.col("ws")).otherwise(1.0), 0.25))


def night_profile(met: DataFrame, daily: DataFrame) -> DataFrame:
    """Half-sine heat-island profile over each night (a run of rows with radiation up to 5 W/m2), scaled by the night's mean amplitude.

    Nights of one row and nights without amplitude give 0, as does the day.
    """
    rows = met.select("reading_id", "station", "obs_time", "radg").withColumn("day", F.to_date("obs_time")).join(daily.select("station", "day", "amplitude"), ["station", "day"])
    order = Window.partitionBy("station").orderBy("obs_time", "reading_id")
    night = F.coalesce(F.col("radg") <= NIGHT_RADIATION, F.lit(False))
    rows = rows.withColumn("night", night).withColumn("island", F.sum(F.when(F.col("night") & F.lag("night", 1, False).over(order), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy("station", "island")
    i, n = F.row_number().over(per.orderBy("obs_time", "reading_id")) - 1, F.count("*").over(per)
    mean = F.avg("amplitude").over(per)
    uhi = F.when(F.col("night") & (n >= 2) & (mean > 0), mean * F.greatest(F.sin(F.lit(3.141592653589793) * i / (n - 1)), F.lit(0.0))).otherwise(0.0)
    return rows.select("reading_id", "station", "night", uhi.alias("uhi"))


def forward_fill(met: DataFrame, column: str) -> DataFrame:
    """The last known value of the station at each row's time; a station is split by day."""
    day = F.coalesce(F.datediff(F.to_date("obs_time"), F.lit("1970-01-01")), F.lit(-(1 << 31)))  # rows without a time come first
    rows = met.select("reading_id", "station", "obs_time", column).withColumn("_day", day)
    return engine.running(rows, ["station"], "_day", ["obs_time", "reading_id"], column, "last").select("reading_id", "station", F.col("running").alias(f"{column}_filled"))


def tile_means(met: DataFrame, grid: DataFrame) -> DataFrame:
    """Hourly means of each tile over its stations; an hour without a value takes the sentinel -999 as written to met files."""
    means = met.groupBy("tile", F.date_trunc("hour", "obs_time").alias("hour_ts")).agg(F.avg("ta").alias("ta"), F.avg("rh").alias("rh"), F.avg("wind").alias("wind"), F.count("*").alias("n"))
    return means.join(grid.select("tile"), "tile", "left_semi").withColumns({c: F.coalesce(c, F.lit(-999.0)) for c in ("ta", "rh", "wind")})


def circular_direction(met: DataFrame) -> DataFrame:
    """Hourly wind direction of each tile: the plain mean, and the circular mean that does not break at north."""
    rad = F.radians("wd")
    g = met.where("wd is not null").groupBy("tile", F.date_trunc("hour", "obs_time").alias("hour_ts")).agg(F.avg("wd").alias("plain"), F.sum(F.sin(rad)).alias("s"), F.sum(F.cos(rad)).alias("c"))
    return g.select("tile", "hour_ts", "plain", F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0)).alias("circular"), F.sqrt(F.col("s") ** 2 + F.col("c") ** 2).alias("resultant"))


def fan_out(series: DataFrame, grid: DataFrame) -> DataFrame:
    """One series copied to every tile; the tiles travel as one array (the grid is a small fixed dimension)."""
    tiles = grid.agg(F.array_sort(F.collect_set("tile")).alias("tiles"))
    return series.join(tiles, F.lit(True)).withColumn("to_tile", F.explode("tiles")).drop("tiles")


def _nearest_within(probes: DataFrame, grid: DataFrame, reach: float) -> DataFrame:
    at = grid.select("tile", "origin_x", "origin_y", F.floor(F.col("origin_x") / reach).alias("bx"), F.floor(F.col("origin_y") / reach).alias("by"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probe = probes.select(F.col("tile").alias("a"), F.col("origin_x").alias("ax"), F.col("origin_y").alias("ay")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    probe = probe.withColumn("bx", F.floor(F.col("ax") / reach) + F.col("dx")).withColumn("by", F.floor(F.col("ay") / reach) + F.col("dy"))
    d = F.sqrt((F.col("ax") - F.col("origin_x")) ** 2 + (F.col("ay") - F.col("origin_y")) ** 2)
    pairs = probe.join(at, ["bx", "by"]).where("a <> tile").withColumn("distance", d).where(F.col("distance") <= reach)
    return pairs.groupBy(F.col("a").alias("tile")).agg(F.min_by("tile", F.struct("distance", "tile")).alias("nearest"), F.min("distance").alias("distance"))


def nearest_tile(grid: DataFrame, reach: float) -> DataFrame:
    """The nearest other tile (by origin), by equi-join on squares of side ``reach`` and their neighbours; ties by name.

    What has none within reach is sought again within twice as much, until all have one or the grid is crossed.
    """
    from thermaloom.session import materialize

    e = grid.agg(F.min("origin_x"), F.max("origin_x"), F.min("origin_y"), F.max("origin_y")).first()
    across = 0.0 if e[0] is None else (e[1] - e[0]) + (e[3] - e[2])
    left, found = grid.select("tile", "origin_x", "origin_y"), None
    while True:
        here = materialize(_nearest_within(left, grid, reach), "nearest")
        found = here if found is None else found.unionByName(here)
        left = left.join(here.select("tile"), "tile", "left_anti")
        if reach > across or left.isEmpty():
            return found
        reach *= 2


def as_of_daily(met: DataFrame, daily: DataFrame) -> DataFrame:
    """Each row with the latest daily amplitude at or before its day: carried along the days, one row each, then joined."""
    rows = met.select("station", F.to_date("obs_time").alias("day"), "reading_id")
    days = rows.select("station", "day").distinct().join(daily.where("amplitude > 0").select("station", "day", "amplitude"), ["station", "day"], "full")
    w = Window.partitionBy("station").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(days.select("station", "day", F.last("amplitude", ignorenulls=True).over(w).alias("as_of")), ["station", "day"], "left").select("reading_id", "as_of")
