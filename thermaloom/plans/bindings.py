"""Base relations of the queries: DataFrames over the tables, and the same as SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.session import table

MEASURES = ("ta", "rh", "radg", "radd", "radi", "p", "twater", "wind", "wd", "rain")


def known(name: str) -> F.Column:
    """The measured value; the sentinel -999 and NaN are null inside the engine."""
    c = F.col(name)
    return F.when(~F.isnan(c) & (c != -999.0), c)


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing rows, each reading once: sentinel values null, local solar hour, latitude and pixel of the tile."""
    raw = table(spark, sf_dir, "met_inputs")
    plain = ("station", "tile", "obs_time", "t", "iy", "id", "it", "imin")
    once = raw.groupBy("reading_id").agg(*(F.min(c).alias(c) for c in plain), *(F.min(known(c)).alias(c) for c in MEASURES))
    grid = table(spark, sf_dir, "grid_tiles").select("tile", "latitude")
    return (
        once.withColumnRenamed("id", "doy").withColumn("hour", F.col("it") + F.col("imin") / 60.0)
        .withColumn("p_kpa", F.col("p") / 10.0).join(grid, "tile", "left")
    )


_M = ", ".join(f"min(case when isnan({c}) or {c} = -999 then null else {c} end) as {c}" for c in MEASURES)
MET_SQL = f"""select m.*, m.it + m.imin / 60.0e0 as hour, m.p / 10.0e0 as p_kpa, g.latitude from (
  select reading_id, min(station) as station, min(tile) as tile, min(obs_time) as obs_time, min(t) as t, min(iy) as iy, min(id) as doy, min(it) as it, min(imin) as imin, {_M}
  from met_inputs group by reading_id) m left join grid_tiles g on m.tile = g.tile"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic city of one cell for each order, 120 columns wide: terrain, surface, trees, land cover."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 120).cast("int").alias("r"), (F.col("o_orderkey") % 120).cast("int").alias("c"), F.col("o_custkey").alias("k"))
    br, bc = F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)
    built = (br + bc) % 3 == 0
    dem = (F.lit(2.0) + (F.col("k") % 7) * 0.25).cast("double")
    return o.select(
        "r", "c", dem.alias("dem"),
        (dem + F.when(built, F.lit(6) + (br * 7 + bc * 3) % 15).otherwise(0)).cast("double").alias("dsm"),
        F.when(~built & (F.col("k") % 11 == 0), 4 + F.col("k") % 9).otherwise(0).cast("double").alias("trees"),
        F.when(F.col("k") % 4 == 0, 1).when(F.col("k") % 4 == 1, 2).when(F.col("k") % 4 == 2, 5).otherwise(6).alias("lc"),
    )


CELLS_SQL = """select r, c, cast(dem as double) as dem,
  cast(dem + case when (br + bc) % 3 = 0 then 6 + (br * 7 + bc * 3) % 15 else 0 end as double) as dsm,
  cast(case when (br + bc) % 3 <> 0 and k % 11 = 0 then 4 + k % 9 else 0 end as double) as trees,
  case cast(k % 4 as int) when 0 then 1 when 1 then 2 when 2 then 5 else 6 end as lc
from (select r, c, k, cast(floor(r / 8) as int) br, cast(floor(c / 8) as int) bc, 2 + (k % 7) * 0.25e0 dem
  from (select cast(floor(o_orderkey / 120) as int) r, cast(o_orderkey % 120 as int) c, o_custkey k from orders))"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log, each operation once: the copy with the lowest delivery of each sequence of a workspace."""
    log = table(spark, sf_dir, "operation_log")
    cols = [c for c in log.columns if c not in ("workspace_id", "server_sequence")]
    best = F.min_by(F.struct(*cols), "delivery_id").alias("x")
    return log.groupBy("workspace_id", "server_sequence").agg(best).select("workspace_id", "server_sequence", "x.*")


OPS_SQL = "select * from operation_log qualify row_number() over (partition by workspace_id, server_sequence order by delivery_id) = 1"
