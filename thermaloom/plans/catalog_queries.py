"""Further operators of the inventory: places, distances, joins by extent and direction, digests, scopes, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermaloom.operators import collab, incremental, raster
from thermaloom.operators.engine import exact_quantiles, ranked
from thermaloom.plans.bindings import CELLS_SQL, MET_SQL, OPS_SQL, cells, met, ops
from thermaloom.session import table

OP, MET, CELL = f"with op as ({OPS_SQL}) ", f"with met as ({MET_SQL}) ", f"with cell as ({CELLS_SQL}) "
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- places and distances ----------------------------------------------------------------------
@query("select tile, latitude, (origin_x - 400000) / 1000e0 as longitude, cast(case when latitude >= 0 then 32600 else 32700 end + floor(((origin_x - 400000) / 1000e0 + 180) / 6) + 1 as int) as utm from grid_tiles")
def utm_epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM reference system of each tile from its place."""
    g = table(spark, sf_dir, "grid_tiles").select("tile", "latitude", ((F.col("origin_x") - 400000) / 1000.0).alias("longitude"))
    return g.withColumn("utm", (F.when(F.col("latitude") >= 0, 32600).otherwise(32700) + F.floor((F.col("longitude") + 180) / 6) + 1).cast("int"))


_HAV = "2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d}) / 2), 2))))"


@query("with s as (select distinct station, tile from met_inputs where tile is not null and station is not null), p as (select s.station, s.tile, g.latitude, (g.origin_x - 400000) / 1000e0 lon from s join grid_tiles g on g.tile = s.tile), n as (select station, latitude, lon, lead(latitude) over w la, lead(lon) over w lo from p window w as (order by station, tile)) select station, round(" + _HAV.format(a="latitude", b="la", d="lo - lon") + ", 3) + 0e0 as metres from n where la is not null")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance from each station's tile to that of the next station by name."""
    s = table(spark, sf_dir, "met_inputs").select("station", "tile").where("tile is not null and station is not null").distinct()
    p = s.join(table(spark, sf_dir, "grid_tiles").select("tile", "latitude", ((F.col("origin_x") - 400000) / 1000.0).alias("lon")), "tile")
    w = Window.orderBy("station", "tile")  # one row a station
    n = p.withColumn("la", F.lead("latitude").over(w)).withColumn("lo", F.lead("lon").over(w)).where("la is not null")
    return n.select("station", (F.round(F.expr(_HAV.format(a="latitude", b="la", d="lo - lon").replace("1e0", "1D")), 3) + F.lit(0.0)).alias("metres"))


@query("with t as (select p_partkey k, (p_partkey * 37 % 4000) / 4e0 x, (p_partkey * 91 % 4000) / 4e0 y from part) select k, cast(floor(x / 2e0) as int) as c, cast(floor((1000e0 - y) / 2e0) as int) as r, (floor(x / 2e0) + 0.5e0) * 2e0 as back_x, 1000e0 - (floor((1000e0 - y) / 2e0) + 0.5e0) * 2e0 as back_y from t")
def world_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World coordinates to cells of a north-up grid and back to the cell's centre."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("k"), ((k * 37 % 4000) / 4.0).alias("x"), ((k * 91 % 4000) / 4.0).alias("y"))
    c, r = F.floor(F.col("x") / 2.0), F.floor((1000.0 - F.col("y")) / 2.0)
    return t.select("k", c.cast("int").alias("c"), r.cast("int").alias("r"), ((c + 0.5) * 2.0).alias("back_x"), (1000.0 - (r + 0.5) * 2.0).alias("back_y"))


@query("with t as (select p_partkey k, 412000 + (p_partkey * 3701 % 400000) / 50e0 x, 5280000 + (p_partkey * 9103 % 400000) / 100e0 y from part) select t.k, g.tile from t join grid_tiles g on t.x >= g.origin_x and t.x < g.origin_x + g.n_cols * g.pixel and t.y <= g.origin_y and t.y > g.origin_y - g.n_rows * g.pixel")
def points_in_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the tiles whose extent holds them: an equi-join on kilometre squares, then the exact test."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("k"), (F.lit(412000.0) + (k * 3701 % 400000) / 50.0).alias("x"), (F.lit(5280000.0) + (k * 9103 % 400000) / 100.0).alias("y"))
    g = table(spark, sf_dir, "grid_tiles").select("tile", F.col("origin_x").alias("x0"), (F.col("origin_x") + F.col("n_cols") * F.col("pixel")).alias("x1"), F.col("origin_y").alias("y1"), (F.col("origin_y") - F.col("n_rows") * F.col("pixel")).alias("y0"))
    square = lambda v: F.floor(v / 1000).cast("int")
    g = g.withColumn("kx", F.explode(F.sequence(square(F.col("x0")), square(F.col("x1"))))).withColumn("ky", F.explode(F.sequence(square(F.col("y0")), square(F.col("y1")))))
    t = t.withColumn("kx", square(F.col("x"))).withColumn("ky", square(F.col("y")))
    return t.join(g, ["kx", "ky"]).where("x >= x0 and x < x1 and y <= y1 and y > y0").select("k", "tile")


@query(MET + ", d as (select r * 30 as dir_bin, 0.4e0 + r * 0.05e0 as coeff from range(0, 9) t(r)) select m.reading_id, round(greatest(coalesce(d.coeff, 1e0) * m.wind, 0.15e0), 6) + 0e0 as va from (select *, case when wd >= 0 then (cast(floor((wd - 360e0 * floor(wd / 360e0) + 15e0) / 30e0) * 30 as int)) % 360 end b from met where wind is not null) m left join d on d.dir_bin = m.b")
def directional_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind under the coefficient of its direction; directions without one keep the reference wind."""
    d = spark.range(9).select((F.col("id") * 30).cast("int").alias("dir_bin"), (0.4 + F.col("id") * 0.05).alias("coeff"))
    b = F.when(F.col("wd") >= 0, (F.floor((F.pmod(F.col("wd"), F.lit(360.0)) + 15.0) / 30.0) * 30).cast("int") % 360)
    m = met(spark, sf_dir).where("wind is not null").withColumn("dir_bin", b)
    return m.join(d, "dir_bin", "left").select("reading_id", (F.round(F.greatest(F.coalesce("coeff", F.lit(1.0)) * F.col("wind"), F.lit(0.15)), 6) + F.lit(0.0)).alias("va"))


@query(MET + ", s as (select station, obs_time, ta from met where imin = 0 and ta is not null qualify row_number() over (partition by station, obs_time order by reading_id) = 1), a as (select m.reading_id, m.obs_time t, p.obs_time pt, p.ta pv from met m asof left join s p on p.station = m.station and m.obs_time >= p.obs_time), b as (select m.reading_id, n.obs_time nt, n.ta nv from met m asof left join s n on n.station = m.station and m.obs_time <= n.obs_time) select a.reading_id, case when pt is null then nv when nt is null then pv when epoch_us(nt) - epoch_us(t) < epoch_us(t) - epoch_us(pt) then nv else pv end as nearest_ta from a join b on a.reading_id = b.reading_id")
def nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading with the nearest full-hour temperature of its station; the earlier one on ties."""
    m = met(spark, sf_dir)
    full = (F.col("imin") == 0) & F.col("ta").isNotNull()
    x = F.when(full, F.struct("obs_time", "ta"))
    w = Window.partitionBy("station").orderBy("obs_time")
    # peers of a time share the frame, so several readings of one time see the same neighbours
    p = F.last(x, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    n = F.first(x, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    j = m.select("reading_id", "obs_time", p.alias("p"), n.alias("n"))
    nearer = us(F.col("n.obs_time")) - us(F.col("obs_time")) < us(F.col("obs_time")) - us(F.col("p.obs_time"))
    return j.select("reading_id", F.when(F.col("p").isNull(), F.col("n.ta")).when(F.col("n").isNull(), F.col("p.ta")).when(nearer, F.col("n.ta")).otherwise(F.col("p.ta")).alias("nearest_ta"))


# -- statistics ------------------------------------------------------------------------------------
@query("select mode, count(x) as n, round(quantile_cont(x, 0.8) + 1e-9, 6) + 0e0 as p80 from (select mode, case when isnan(timings_s.total_s) then null else timings_s.total_s end x from raw_runs) q group by 1")
def solve_time_p80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eightieth percentile of the solve time of each mode, as an estimate for the queue."""
    x = F.when(~F.isnan("timings_s.total_s"), F.col("timings_s.total_s"))
    return table(spark, sf_dir, "raw_runs").select("mode", x.alias("x")).groupBy("mode").agg(F.count("x").alias("n"), (F.round(F.percentile("x", 0.8) + 1e-9, 6) + F.lit(0.0)).alias("p80"))


@query(OP + ", l as (select workspace_id, (epoch_us(accepted_at) - epoch_us(received_at)) / 1e3 ms from op where accepted_at is not null and received_at is not null) select workspace_id, count(*) as n, quantile_disc(ms, 0.5) as p50, quantile_disc(ms, 0.95) as p95, quantile_disc(ms, 0.99) as p99, max(ms) as worst from l group by 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency from receipt to acceptance of each workspace."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    o = ops(spark, sf_dir).where("accepted_at is not null and received_at is not null").select("workspace_id", ((us("accepted_at") - us("received_at")) / 1e3).alias("ms"))
    return exact_quantiles(o, ["workspace_id"], "ms", (0.5, 0.95, 0.99), ("p50", "p95", "p99"), 10.0)


@query(MET + "select tile, count(ta) as n, round(avg(case when ta > 30 then 1e0 else 0e0 end) + 1e-9, 6) + 0e0 as share_hot, round(regr_slope(ta, radg) + 1e-9, 6) + 0e0 as slope from met where ta between -60 and 60 and radg between 0 and 1500 group by 1 having var_pop(radg) > 1")
def share_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hot readings of each tile, and the slope of temperature over radiation."""
    m = met(spark, sf_dir).where("ta between -60 and 60 and radg between 0 and 1500")
    g = m.groupBy("tile").agg(F.count("ta").alias("n"), F.avg(F.when(F.col("ta") > 30, 1.0).otherwise(0.0)).alias("s"), F.regr_slope("ta", "radg").alias("b"), F.var_pop("radg").alias("v")).where("v > 1")
    return g.select("tile", "n", (F.round(F.col("s") + 1e-9, 6) + F.lit(0.0)).alias("share_hot"), (F.round(F.col("b") + 1e-9, 6) + F.lit(0.0)).alias("slope"))


# -- digests -------------------------------------------------------------------------------------------
@query(CELL + "select r // 64 as kr, c // 64 as kc, count(*) as cells, sha256(string_agg(cast(r as varchar) || ',' || cast(c as varchar) || ',' || cast(cast(dsm * 100 as bigint) as varchar), ';' order by r, c)) as digest from cell group by 1, 2")
def chunk_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each chunk of 64 cells, by which unchanged chunks are shared between versions."""
    one = F.concat_ws(",", "r", "c", (F.col("dsm") * 100).cast("bigint"))
    g = cells(spark, sf_dir).groupBy(F.floor(F.col("r") / 64).alias("kr"), F.floor(F.col("c") / 64).alias("kc")).agg(F.count("*").alias("cells"), F.array_sort(F.collect_list(F.struct("r", "c", one.alias("x")))).alias("xs"))
    return g.select("kr", "kc", "cells", F.sha2(F.array_join(F.transform("xs", lambda x: x["x"]), ";"), 256).alias("digest"))


@query("select delivery_id, sha256(concat_ws('|', coalesce(workspace_id, ''), coalesce(cast(server_sequence as varchar), ''), coalesce(verb, ''), coalesce(entity_id, ''), coalesce(actor_id, ''))) as fingerprint from operation_log")
def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of what a request asks for, however it is written."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("workspace_id", "server_sequence", "verb", "entity_id", "actor_id")]
    return table(spark, sf_dir, "operation_log").select("delivery_id", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


# -- scopes -------------------------------------------------------------------------------------------------
_A, _B = raster.step_table(140.0, 38.0, 26.0, 100000, 100000), raster.step_table(155.0, 45.0, 26.0, 100000, 100000)
_VALUES = lambda steps, name: "(values " + ", ".join(f"({i}, {a}, {b}, {z!r}e0)" for i, a, b, z in steps) + f") {name}(i, dr, dc, drop_)"
_SHADE = "select t.r, t.c, case when greatest(coalesce(max(x.dsm - s.drop_), 0e0), 0e0) > any_value(t.dsm) then 0 else 1 end as sh from cell t, {} left join cell x on x.r = t.r + s.dr and x.c = t.c + s.dc group by 1, 2"


@query(CELL + f", a as ({_SHADE.format(_VALUES(_A, 's'))}), b as ({_SHADE.format(_VALUES(_B, 's'))}) select a.r, a.c, case when a.sh = 0 then 'lightened' else 'darkened' end as change from a join b on a.r = b.r and a.c = b.c where a.sh <> b.sh")
def shadow_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose shadow changes between two places of the sun."""
    c = cells(spark, sf_dir)
    a, b = raster.building_shadow(c, _A), raster.building_shadow(c, _B).withColumnRenamed("sh", "later")
    return a.join(b, ["r", "c"]).where("sh <> later").select("r", "c", F.when(F.col("sh") == 0, "lightened").otherwise("darkened").alias("change"))


def closure(c: DataFrame, edited: DataFrame) -> DataFrame:
    """Cells of ``c`` that edits of its cells ``edited`` can shade: the edited cells and those down-sun along the steps."""
    steps = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc")), *(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for _, a, b, _ in _A)))
    touched = c.join(edited, ["r", "c"], "left_semi").withColumn("s", steps).select((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c")).distinct()
    return c.join(touched, ["r", "c"], "left_semi")


@query(OP + f", cell as ({CELLS_SQL}), p as (select cast(json_extract(payload, '$.class') as int) k, cast(json_extract(payload, '$.window.row_start') as int) r0, cast(json_extract(payload, '$.window.row_stop') as int) r1, cast(json_extract(payload, '$.window.col_start') as int) c0, cast(json_extract(payload, '$.window.col_stop') as int) c1 from op where source_family = 'landcover_surface' and verb = 'paint'), e as (select distinct cell.r, cell.c from cell join p on cell.r >= p.r0 and cell.r < p.r1 and cell.c >= p.c0 and cell.c < p.c1 where p.k is not null), t as (select r, c from e union select e.r - s.dr, e.c - s.dc from e, {_VALUES(_A, 's')}) select cell.r, cell.c from cell join t on cell.r = t.r and cell.c = t.c")
def corridor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the edits in the log can shade: all cells painted in any workspace and those down-sun of them."""
    return closure(cells(spark, sf_dir).select("r", "c"), collab.painted_cells(ops(spark, sf_dir)).select("r", "c").distinct())


_FAMILY = {"vegetation_geometry": "vegetation_dsm", "building_geometry": "building_dsm", "landcover_surface": "landcover", "meteorological_forcing": "meteorology", "model_receptor_parameters": "model_parameters", "selected_date_time": "selected_date_time", "output_view": "output_selection"}
_FAMILY_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _FAMILY.items()) + ") f(source_family, source)"
_EDGE_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in incremental.EDGES) + ") e(src, dst)"


@query("with recursive reach(source, node) as (select src, dst from " + _EDGE_SQL + " union select r.source, e.dst from reach r join " + _EDGE_SQL + " on e.src = r.node), op as (" + OPS_SQL + "), d as (select distinct source, node from reach union select source, source from " + _FAMILY_SQL + ") select workspace_id, d.node, count(*) as version, max(server_sequence) as last_sequence from op join " + _FAMILY_SQL + " on f.source_family = op.source_family join d on d.source = f.source group by 1, 2")
def version_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version of every node of each workspace: one more for each operation upstream."""
    f = spark.createDataFrame(list(_FAMILY.items()), "source_family string, source string")
    down = incremental.closure(spark).unionByName(f.select("source", F.col("source").alias("node")).distinct())
    per = ops(spark, sf_dir).groupBy("workspace_id", "source_family").agg(F.count("*").alias("n"), F.max("server_sequence").alias("s"))
    return per.join(f, "source_family").join(down, "source").groupBy("workspace_id", "node").agg(F.sum("n").alias("version"), F.max("s").alias("last_sequence"))


@query(OP + "select workspace_id, server_sequence, row_number() over (partition by source_family order by received_at, workspace_id, server_sequence) as position, count(*) over (partition by source_family) as queue from op where received_at is not null")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each operation in the queue of its family."""
    rows = ops(spark, sf_dir).where("received_at is not null").withColumn("span", F.date_trunc("hour", "received_at"))
    return ranked(rows, ["source_family"], "span", ["received_at", "workspace_id", "server_sequence"]).select("workspace_id", "server_sequence", "position", "queue")


@query(OP + ", b as (select workspace_id, source_family, server_sequence, cast(json_extract(payload, '$.time_start') as int) t0, cast(json_extract(payload, '$.time_stop') as int) t1 from op) select workspace_id, server_sequence, case when source_family in ('vegetation_geometry', 'building_geometry', 'landcover_surface') then 'ALL' when t0 is null then 'ALL' when t0 = t1 then 'ONE' when source_family = 'meteorological_forcing' then 'REPLAY' else 'RANGE' end as scope, coalesce(case when source_family = 'meteorological_forcing' then 23 else t1 end, 23) - coalesce(t0, 0) + 1 as steps from b")
def temporal_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that an operation makes stale: one, a range, all after it, or all."""
    b = F.from_json("payload", "time_start int, time_stop int")
    o = ops(spark, sf_dir).withColumn("b", b).select("workspace_id", "server_sequence", "source_family", F.col("b.time_start").alias("t0"), F.col("b.time_stop").alias("t1"))
    scope = F.when(F.col("source_family").isin("vegetation_geometry", "building_geometry", "landcover_surface") | F.col("t0").isNull(), "ALL").when(F.col("t0") == F.col("t1"), "ONE").when(F.col("source_family") == "meteorological_forcing", "REPLAY").otherwise("RANGE")
    last = F.when(F.col("source_family") == "meteorological_forcing", 23).otherwise(F.col("t1"))
    return o.select("workspace_id", "server_sequence", scope.alias("scope"), (F.coalesce(last, F.lit(23)) - F.coalesce("t0", F.lit(0)) + 1).alias("steps"))


@query(OP + """, p as (select workspace_id, server_sequence, cast(json_extract(payload, '$.window.row_start') as int) r0, cast(json_extract(payload, '$.window.row_stop') as int) r1, cast(json_extract(payload, '$.window.col_start') as int) c0, cast(json_extract(payload, '$.window.col_stop') as int) c1 from op where source_family = 'landcover_surface' and verb = 'paint' and json_extract(payload, '$.class') is not null),
 x as (select q.*, unnest(range(c0, c1)) c from (select p.*, unnest(range(r0, r1)) r from p where r1 > r0 and c1 > c0) q), y as (select *, max(server_sequence) over (partition by workspace_id, r, c) top from x)
 select workspace_id, server_sequence, count(*) as cells, count(*) filter (where server_sequence = top) as current, count(*) filter (where server_sequence < top) as superseded from y group by 1, 2""")
def publish_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each painted patch that are still current, and those that later patches superseded."""
    p = collab.paints(ops(spark, sf_dir)).select("workspace_id", "server_sequence", "r0", "r1", "c0", "c1")
    x = p.withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    g = x.groupBy("workspace_id", "r", "c").agg(F.sort_array(F.collect_list("server_sequence"), asc=False).alias("all"))  # the patches over one cell
    e = g.select("workspace_id", F.posexplode("all").alias("age", "server_sequence"))
    return e.groupBy("workspace_id", "server_sequence").agg(F.count("*").alias("cells"), F.count_if(F.col("age") == 0).alias("current"), F.count_if(F.col("age") > 0).alias("superseded"))


@query(MET + "select station, cast(timezone('Europe/Berlin', timezone('UTC', obs_time)) as date) as local_day, count(*) as n, min(obs_time) as first_utc, max(obs_time) as last_utc, count(*) filter (where ta is not null) as known from met group by 1, 2")
def met_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by local day, the stored times taken as UTC."""
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.col("obs_time")))
    return met(spark, sf_dir).groupBy("station", local.alias("local_day")).agg(F.count("*").alias("n"), F.min("obs_time").alias("first_utc"), F.max("obs_time").alias("last_utc"), F.count("ta").alias("known"))
