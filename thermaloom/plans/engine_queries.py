"""Queries of the engine and its control plane, and of grid rules that stand by themselves, each with SQL written apart from the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermaloom.operators import collab, engine, raster
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


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# -- grid rules ---------------------------------------------------------------------------------
@query(CELL + "select r, c, dem + (case when dsm > dem then dsm - dem else 0 end) as surface, case when dsm > dem then 0e0 else trees end as trees from cell")
def trees_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface as terrain and buildings; no trees under buildings."""
    high = F.greatest(F.col("dsm") - F.col("dem"), F.lit(0.0))
    return cells(spark, sf_dir).select("r", "c", (F.col("dem") + high).alias("surface"), F.when(high > 0, 0.0).otherwise(F.col("trees")).alias("trees"))


@query(MET + "select reading_id, round(wd - 360 * floor((wd + 180) / 360), 6) + 0e0 as longitude from met where wd is not null")
def longitude_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes given as 0..360 brought to -180..180."""
    return met(spark, sf_dir).where("wd is not null").select("reading_id", (F.round(F.pmod(F.col("wd") + 180.0, F.lit(360.0)) - 180.0, 6) + F.lit(0.0)).alias("longitude"))


@query(MET + "select m.reading_id, round(d.mean_ta + 1e-9, 6) + 0e0 as water_c from met m join (select station, cast(obs_time as date) as dt, avg(ta) mean_ta from met where ta between -60 and 60 group by 1, 2) d on d.station = m.station and d.dt = cast(m.obs_time as date)")
def water_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature of water at each reading: the day's mean air temperature at the station."""
    m = met(spark, sf_dir).withColumn("date", F.to_date("obs_time"))
    mean = m.where("ta between -60 and 60").groupBy("station", "date").agg(F.avg("ta").alias("w"))
    return m.join(mean, ["station", "date"]).select("reading_id", (F.round(F.col("w") + 1e-9, 6) + F.lit(0.0)).alias("water_c"))


_ALT = "degrees(asin(greatest(-1, least(1, sin(radians(latitude)) * sin(x) + cos(radians(latitude)) * cos(x) * cos(radians(15 * (hour - 12)))))))"
_DECL = "radians(23.45) * sin(2 * pi() * (284 + doy) / 365.0)"


@query(MET + f", a as (select station, t, obs_time, doy, {_ALT.replace('x)', _DECL + ')')} alt from met where latitude is not null), d as (select station, cast(obs_time as date) as day, min(t) first_t, min(t) filter (where alt > 1) rise_t from a group by 1, 2) select station, day, first_t, rise_t, rise_t - first_t as wait from d where rise_t is not null")
def next_daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step of each station's day, and the first of its steps with the sun above one degree."""
    decl = F.radians(F.lit(23.45)) * F.sin(2 * F.pi() * (284 + F.col("doy")) / 365.0)
    lat = F.radians("latitude")
    height = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(F.radians(15 * (F.col("hour") - 12)))
    a = met(spark, sf_dir).where("latitude is not null").withColumn("alt", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), height)))))
    d = a.groupBy("station", F.to_date("obs_time").alias("day")).agg(F.min("t").alias("first_t"), F.min(F.when(F.col("alt") > 1, F.col("t"))).alias("rise_t"))
    return d.where("rise_t is not null").withColumn("wait", F.col("rise_t") - F.col("first_t"))


@query("with s as (select station, list_sort(list(distinct obs_time)) xs from met_inputs where obs_time is not null group by 1), g as (select station, xs[2] - xs[1] as step from s where len(xs) >= 2) select reading_id, min(epoch_us(obs_time) - epoch_us(step) // 2) as solar_us from met_inputs m join g on g.station = m.station where obs_time is not null group by 1")
def half_step_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time at the middle of each reading's step, the step being that between the first two times of the station."""
    raw = table(spark, sf_dir, "met_inputs").where("obs_time is not null").select("reading_id", "station", micros("obs_time").alias("us"))
    first = raw.groupBy("station").agg(F.min("us").alias("a"))
    second = raw.join(first, "station").where("us > a").groupBy("station").agg((F.min("us") - F.first("a")).alias("step"))
    return raw.join(second, "station").groupBy("reading_id").agg(F.min(F.col("us") - F.floor(F.col("step") / 2)).alias("solar_us"))


_STEPS = raster.step_table(140.0, 38.0, 26.0, 100000, 100000)


@query("select i, dr, dc, drop_ as dz, coalesce((select s2.drop_ from " + "(values " + ", ".join(f"({i}, {a}, {b}, {z!r}e0)" for i, a, b, z in _STEPS) + ") s2(i, dr, dc, drop_) where s2.i = s.i - 1), 0e0) as dz_before from (values " + ", ".join(f"({i}, {a}, {b}, {z!r}e0)" for i, a, b, z in _STEPS) + ") s(i, dr, dc, drop_)")
def step_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a ray with the height it loses, and that of the step before."""
    s = spark.createDataFrame([(i, a, b, z) for i, a, b, z in _STEPS], "i int, dr int, dc int, dz double")
    before = s.select((F.col("i") + 1).alias("i"), F.col("dz").alias("b"))
    return s.join(before, "i", "left").select("i", "dr", "dc", "dz", F.coalesce("b", F.lit(0.0)).alias("dz_before"))


@query("select tile, row_number() over (order by cast(split_part(tile, '_', 2) as int), cast(split_part(tile, '_', 3) as int)) as place from grid_tiles")
def tile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by the numbers in their keys, not by their text."""
    part = F.split("tile", "_")
    w = Window.orderBy(part[1].cast("int"), part[2].cast("int"))  # the grid has 48
    return table(spark, sf_dir, "grid_tiles").select("tile", F.row_number().over(w).alias("place"))


@query(CELL + ", m as (select (min(r) + max(r)) / 2e0 mr, (min(c) + max(c)) / 2e0 mc from cell) select r, c, (r - mr) * (r - mr) + (c - mc) * (c - mc) as distance2 from cell, m where dsm - dem < 2 and trees <= 0 order by distance2, r, c limit 1")
def open_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open cell nearest to the middle of the city."""
    c = cells(spark, sf_dir)
    r0, r1, c0, c1 = c.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return engine.open_cell(c, ((r0 or 0) + (r1 or 0)) / 2, ((c0 or 0) + (c1 or 0)) / 2)


@query(CELL + ", s as (select r, c, 30 + (r * 7 + c * 3) % 50 as sun_alt, (r * 11 + c * 5) % 360 as sun_azi, 0.1 + ((r + c) % 12) / 10e0 as asvf from cell), p as (select 6 + 12 * (i // 8) as alt, 45 * (i % 8) as azi from range(56) t(i)) select r, c, count(*) filter (where degrees(atan(tan(asvf) + least(2 * cos(radians(abs(sun_azi - azi))) * tan(radians(sun_alt)), 0))) < alt - 1e-7) as sunlit, count(*) filter (where degrees(atan(tan(asvf) + least(2 * cos(radians(abs(sun_azi - azi))) * tan(radians(sun_alt)), 0))) > alt + 1e-7) as shaded from s, p group by 1, 2")
def patches_sunlit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of building around each cell that the sun lights, and those in shade, for one sun a cell."""
    r, c = F.col("r"), F.col("c")
    s = cells(spark, sf_dir).select("r", "c", (30 + (r * 7 + c * 3) % 50).alias("sun_alt"), ((r * 11 + c * 5) % 360).alias("sun_azi"), (0.1 + ((r + c) % 12) / 10.0).alias("asvf"))
    lit = dark = F.lit(0)
    for alt in range(6, 90, 12):
        for azi in range(0, 360, 45):  # a sum of 56 terms in place of 56 rows a cell
            below = engine.patch_shaded_below(F.col("sun_alt"), F.col("sun_azi"), F.lit(azi), F.col("asvf"))
            lit, dark = lit + (below < alt - 1e-7).cast("int"), dark + (below > alt + 1e-7).cast("int")
    return s.select("r", "c", lit.cast("bigint").alias("sunlit"), dark.cast("bigint").alias("shaded"))


@query(MET + ", z as (select station, min(obs_time) + interval 3 day as start, max(obs_time) - interval 3 day as stop from met group by 1), p as (select m.station, m.obs_time, m.ta from met m join z on z.station = m.station where m.obs_time between z.start - interval 1 day and z.stop + interval 1 day), r as (select station, obs_time, avg(ta) over (partition by station order by obs_time range between interval 1 day preceding and interval 1 day following) a from p) select r.station, cast(r.obs_time as date) as day, count(*) as n, round(avg(a) + 1e-9, 5) + 0e0 as smooth_ta from r join z on z.station = r.station where r.obs_time between z.start and z.stop and a is not null group by 1, 2")
def padded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-day mean over a span of time: read with a day more on either side, computed, and trimmed back."""
    m = met(spark, sf_dir).select("station", "obs_time", "ta")
    z = m.groupBy("station").agg((F.min("obs_time") + F.expr("interval 3 day")).alias("start"), (F.max("obs_time") - F.expr("interval 3 day")).alias("stop"))
    p = m.join(z, "station").where(engine.padded(m, "obs_time"))
    day = 86_400_000_000
    # the hot station is split by day: each day sees its neighbours, no window spans more
    mine = F.floor(micros("obs_time") / day)
    dealt = p.withColumn("us", micros("obs_time")).withColumn("own", mine).withColumn("d", F.explode(F.array(mine - 1, mine, mine + 1)))
    w = Window.partitionBy("station", "d").orderBy("us").rangeBetween(-day, day)
    r = dealt.withColumn("a", F.avg("ta").over(w)).where("own = d and obs_time between start and stop and a is not null")
    return r.groupBy("station", F.to_date("obs_time").alias("day")).agg(F.count("*").alias("n"), (F.round(F.avg("a") + 1e-9, 5) + F.lit(0.0)).alias("smooth_ta"))


@query(MET + "select tile, cast(obs_time as date) as day, cast(it as int) as hour, count(*) as n, round(avg(ta) + 273.15 + 1e-9, 4) + 0e0 as t2m, round(avg(radg) * 3600 + 1e-7, 2) + 0e0 as ssrd, round(avg(p) * 100 + 1e-7, 2) + 0e0 as sp from met where ta between -60 and 60 and radg between 0 and 1500 and p is not null group by 1, 2, 3")
def forcing_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing in the units of reanalysis: kelvin, joules an hour, pascal; hourly by tile."""
    m = met(spark, sf_dir).where("ta between -60 and 60 and radg between 0 and 1500 and p is not null")
    r = lambda c, d, e: (F.round(c + e, d) + F.lit(0.0))
    return m.groupBy("tile", F.to_date("obs_time").alias("day"), F.col("it").cast("int").alias("hour")).agg(F.count("*").alias("n"), r(F.avg("ta") + 273.15, 4, 1e-9).alias("t2m"), r(F.avg("radg") * 3600, 2, 1e-7).alias("ssrd"), r(F.avg("p") * 100, 2, 1e-7).alias("sp"))


# -- coverage, composition, scopes --------------------------------------------------------------
_RANGES = ", w as (select workspace_id, source_family, server_sequence, cast(json_extract(payload, '$.time_start') as int) t0, cast(json_extract(payload, '$.time_stop') as int) t1 from op where source_family in ('meteorological_forcing', 'model_receptor_parameters', 'selected_date_time'))"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.from_json("payload", "time_start int, time_stop int")
    o = ops(spark, sf_dir).where("source_family in ('meteorological_forcing', 'model_receptor_parameters', 'selected_date_time')").withColumn("b", b)
    return o.select("workspace_id", "source_family", "server_sequence", F.col("b.time_start").alias("t0"), F.col("b.time_stop").alias("t1")).where("t0 is not null and t1 is not null")


def _steps(rows: DataFrame) -> DataFrame:
    return rows.where("t1 >= t0").withColumn("t", F.explode(F.sequence("t0", "t1")))


@query(OP + _RANGES + ", d as (select workspace_id, unnest(range(t0, t1 + 1)) t from w where source_family = 'meteorological_forcing' and t1 >= t0), q as (select workspace_id, unnest(range(t0, t1 + 1)) t from w where source_family = 'selected_date_time' and t1 >= t0) select workspace_id, t, max(a) as dirty, max(b) as requested from (select workspace_id, t, 1 a, 0 b from d union all select workspace_id, t, 0, 1 from q) u group by 1, 2")
def times_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that are stale or asked for, each once."""
    s = _steps(_ranges(spark, sf_dir).where("source_family <> 'model_receptor_parameters'"))
    flag = lambda f: F.max((F.col("source_family") == f).cast("int"))
    return s.groupBy("workspace_id", "t").agg(flag("meteorological_forcing").alias("dirty"), flag("selected_date_time").alias("requested"))


@query(OP + _RANGES + ", e as (select workspace_id, t, max(server_sequence) s from (select workspace_id, server_sequence, unnest(range(t0, t1 + 1)) t from w where source_family = 'model_receptor_parameters' and t1 >= t0) x group by 1, 2), i as (select workspace_id, t, max(server_sequence) s from (select workspace_id, server_sequence, unnest(range(t0, t1 + 1)) t from w where source_family = 'meteorological_forcing' and t1 >= t0) x group by 1, 2) select coalesce(e.workspace_id, i.workspace_id) as workspace_id, coalesce(e.t, i.t) as t, e.s as revision, e.s is not null and (i.s is null or e.s >= i.s) as fresh from e full join i on e.workspace_id = i.workspace_id and e.t = i.t")
def entries_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest entry of each step, and whether no later write made it stale."""
    w = _ranges(spark, sf_dir)
    part = lambda f: _steps(w.where(F.col("source_family") == f))
    return engine.coverage(part("model_receptor_parameters"), part("meteorological_forcing"), ["workspace_id"], "t", "server_sequence")


@query(OP + _RANGES + ", s as (select distinct workspace_id, unnest(range(t0, t1 + 1)) t from w where server_sequence % 1 = 0 and source_family = 'selected_date_time' and t1 >= t0), n as (select workspace_id, t + 1 a, lead(t) over (partition by workspace_id order by t) - 1 b from s) select workspace_id, a as first, b as last from n where b >= a".replace("server_sequence % 1 = 0 and ", ""))
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of steps that nobody selected, between those that somebody did."""
    return engine.gaps(_steps(_ranges(spark, sf_dir).where("source_family = 'selected_date_time'")), ["workspace_id"], "t")


_PAINT = ", p as (select workspace_id, server_sequence, cast(json_extract(payload, '$.class') as int) k, cast(json_extract(payload, '$.window.row_start') as int) r0, cast(json_extract(payload, '$.window.row_stop') as int) r1, cast(json_extract(payload, '$.window.col_start') as int) c0, cast(json_extract(payload, '$.window.col_stop') as int) c1 from op where source_family = 'landcover_surface' and verb = 'paint')"


@query(OP + _PAINT + f", cell as ({CELLS_SQL}), x as (select p.workspace_id, p.server_sequence, p.k, cell.r, cell.c from cell join p on cell.r >= p.r0 and cell.r < p.r1 and cell.c >= p.c0 and cell.c < p.c1 where p.k is not null), l as (select r, c, arg_max(k, (workspace_id, server_sequence)) k, count(*) n from x group by 1, 2) select cell.r, cell.c, coalesce(l.k, cell.lc) as lc, coalesce(l.n, 0) as versions from cell left join l on l.r = cell.r and l.c = cell.c")
def composed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover of the city with every painted version put over the base, the last of the last workspace on top."""
    base = cells(spark, sf_dir).select("r", "c", "lc")
    p = collab.paints(ops(spark, sf_dir)).select("workspace_id", "server_sequence", F.col("class").alias("lc"), "r0", "r1", "c0", "c1")
    end = base.agg(F.max("r"), F.max("c")).first()
    inside = p.withColumn("r1", F.least("r1", F.lit((end[0] or 0) + 1))).withColumn("c1", F.least("c1", F.lit((end[1] or 0) + 1))).where("r1 > r0 and c1 > c0")
    x = inside.withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    place = F.coalesce(F.struct("workspace_id", "server_sequence"), F.struct(F.lit("").alias("workspace_id"), F.lit(-1).cast("bigint").alias("server_sequence")))
    layers = base.withColumns({"workspace_id": F.lit(None).cast("string"), "server_sequence": F.lit(None).cast("bigint"), "own": F.lit(1)}).unionByName(x.select("r", "c", "lc", "workspace_id", "server_sequence").withColumn("own", F.lit(0)))
    g = layers.groupBy("r", "c").agg(F.max_by("lc", F.when(F.col("own") == 0, place)).alias("top"), F.max(F.when(F.col("own") == 1, F.col("lc"))).alias("base"), F.count_if(F.col("own") == 0).alias("versions"), F.max("own").alias("own"))
    return g.where("own = 1").select("r", "c", F.coalesce("top", "base").alias("lc"), "versions")


@query(OP + ", f as (select workspace_id, epoch_id, max(case when source_family in ('meteorological_forcing', 'model_receptor_parameters') then 1 else 0 end) full_, count(*) filter (where source_family = 'landcover_surface') windows, max(server_sequence) last_ from op where epoch_id is not null group by 1, 2) select workspace_id, epoch_id, case when full_ = 1 then 'FULL' when windows > 0 then 'WINDOWS' else 'NONE' end as scope, case when full_ = 1 then 0 else windows end as windows, last_ as last_sequence from f")
def scope_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial scope that an epoch hands down: everything if any of its edits concerns everything, else its windows."""
    o = ops(spark, sf_dir).where("epoch_id is not null")
    wide = F.max(F.col("source_family").isin("meteorological_forcing", "model_receptor_parameters").cast("int"))
    g = o.groupBy("workspace_id", "epoch_id").agg(wide.alias("wide"), F.count_if(F.col("source_family") == "landcover_surface").alias("w"), F.max("server_sequence").alias("last_sequence"))
    return g.select("workspace_id", "epoch_id", F.when(F.col("wide") == 1, "FULL").when(F.col("w") > 0, "WINDOWS").otherwise("NONE").alias("scope"), F.when(F.col("wide") == 1, 0).otherwise(F.col("w")).alias("windows"), "last_sequence")


@query("select run_id, rep, case when n < 30 then 'FULL' when x > m then 'FULL' else 'LOCAL' end as route from (select run_id, rep, count(*) over (partition by case_id) n, timings_s.total_s x, q.p m from (select distinct run_id, rep, case_id, timings_s from raw_runs where timings_s.total_s is not null and not isnan(timings_s.total_s)) r cross join (select quantile_disc(timings_s.total_s, 0.9) p from (select distinct run_id, rep, case_id, timings_s from raw_runs) z where timings_s.total_s is not null and not isnan(timings_s.total_s)) q) y".replace("count(*) over (partition by case_id)", "(select count(*) from (select distinct run_id, rep, case_id, timings_s from raw_runs) k where k.timings_s.total_s is not null and not isnan(k.timings_s.total_s) and k.case_id is not distinct from r.case_id)"))
def fallback_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of each run by measured cost: a full solve where a case is little known, or the local one took longer than nine in ten."""
    r = table(spark, sf_dir, "raw_runs").select("run_id", "rep", "case_id", "timings_s").distinct().select("run_id", "rep", "case_id", F.col("timings_s.total_s").alias("x")).where("x is not null and not isnan(x)")
    known = r.groupBy("case_id").agg(F.count("*").alias("n")).withColumnRenamed("case_id", "k")
    top = engine.exact_quantiles(r.withColumn("all", F.lit(0)), ["all"], "x", (0.9,), ("m",), 1.0).first()
    joined = r.join(known, F.col("case_id").eqNullSafe(F.col("k"))).withColumn("m", F.lit(top.m if top else None).cast("double"))
    return joined.select("run_id", "rep", F.when(F.col("n") < 30, "FULL").when(F.col("x") > F.col("m"), "FULL").otherwise("LOCAL").alias("route"))


# -- control plane -----------------------------------------------------------------------------
@query(OP + "select o.workspace_id, o.server_sequence, row_number() over (partition by o.workspace_id order by received_at, server_sequence) + 1000 as sequence from op o where received_at is not null and workspace_id is not null")
def sequence_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers without gaps from 1001 on for each workspace, in order of arrival."""
    rows = ops(spark, sf_dir).where("received_at is not null and workspace_id is not null").withColumn("span", F.date_trunc("hour", "received_at"))
    return engine.contiguous(rows, ["workspace_id"], "span", ["received_at", "server_sequence"], F.lit(1000)).select("workspace_id", "server_sequence", "sequence")


@query(OP + ", w as (select distinct workspace_id from op where verb = 'delete' and source_family = 'building_geometry') select workspace_id, count(*) as operations, count(distinct actor_id) as actors from op where workspace_id in (select workspace_id from w) group by 1")
def workspaces_with_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the workspaces in which a building was ever deleted."""
    o = ops(spark, sf_dir)
    w = o.where("verb = 'delete' and source_family = 'building_geometry'").select("workspace_id").distinct()
    return o.join(w, "workspace_id", "left_semi").groupBy("workspace_id").agg(F.count("*").alias("operations"), F.countDistinct("actor_id").alias("actors"))


@query(OP + ", r as (select workspace_id, entity_id, server_sequence, verb in ('move', 'replace') partial_ from op where source_family = 'building_geometry' and entity_id is not null and verb <> 'delete') select workspace_id, entity_id, max(server_sequence) filter (where partial_) as cut, max(server_sequence) filter (where not partial_) as healed from r group by 1, 2 having cut is not null and (healed is null or healed < cut)")
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that must not be composed: a partial record came after the last complete one."""
    r = ops(spark, sf_dir).where("source_family = 'building_geometry' and entity_id is not null and verb <> 'delete'")
    return engine.unhealed(r, ["workspace_id", "entity_id"], "server_sequence", F.col("verb").isin("move", "replace"))


@query(OP + ", g as (select workspace_id, actor_id, epoch_us(received_at) // 60000000 as window_, count(*) n from op where received_at is not null group by 1, 2, 3) select workspace_id, actor_id, window_ as \"window\", n as asked, least(n, 3) as admitted, greatest(n - 3, 0) as refused from g")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each actor and minute against a limit of three."""
    return engine.budget(ops(spark, sf_dir).where("received_at is not null"), ["workspace_id", "actor_id"], "received_at", 60, 3)


@query(OP + ", e as (select workspace_id, epoch_id, min(base_revision) lo, max(base_revision) hi, count(*) n from op where epoch_id is not null and base_revision is not null group by 1, 2), h as (select *, max(hi) over (partition by workspace_id order by epoch_id rows between unbounded preceding and 1 preceding) before from e) select workspace_id, epoch_id, n as operations, lo as base_revision, case when before is null or lo >= before then 'committed' when before - lo <= 3 then 'retried' else 'refused' end as outcome from h")
def optimistic_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit of each epoch against what was committed before it: a baseline older by up to three is tried again, an older one refused."""
    e = ops(spark, sf_dir).where("epoch_id is not null and base_revision is not null").groupBy("workspace_id", "epoch_id").agg(F.min("base_revision").alias("lo"), F.max("base_revision").alias("hi"), F.count("*").alias("operations"))
    return _running(e, "hi").select("workspace_id", "epoch_id", "operations", F.col("lo").alias("base_revision"), F.when(F.col("before").isNull() | (F.col("lo") >= F.col("before")), "committed").when(F.col("before") - F.col("lo") <= 3, "retried").otherwise("refused").alias("outcome"))


def _running(e: DataFrame, value: str, span: int = 1000) -> DataFrame:
    """Largest ``value`` of the epochs before each, as ``before``: by spans of epochs first, so no window holds a whole workspace."""
    s = e.withColumn("span", F.floor(F.col("epoch_id") / span))
    per = s.groupBy("workspace_id", "span").agg(F.max(value).alias("m"))
    earlier = F.max("m").over(Window.partitionBy("workspace_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))  # one row a span
    inside = F.max(value).over(Window.partitionBy("workspace_id", "span").orderBy("epoch_id").rowsBetween(Window.unboundedPreceding, -1))
    joined = s.withColumn("inside", inside).join(per.withColumn("earlier", earlier).drop("m"), ["workspace_id", "span"])
    return joined.withColumn("before", F.greatest("inside", "earlier"))  # nulls do not count


@query(OP + ", e as (select workspace_id, epoch_id, count(*) n, count(base_revision) a, min(received_at) opened from op where epoch_id is not null group by 1, 2) select workspace_id, epoch_id, n - a as owed, opened, row_number() over (partition by workspace_id order by epoch_id) as turn from e where a < n")
def recovery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs with operations that name no base revision, in the order in which they are driven again."""
    e = ops(spark, sf_dir).where("epoch_id is not null").groupBy("workspace_id", "epoch_id").agg(F.count("*").alias("n"), F.count("base_revision").alias("a"), F.min("received_at").alias("opened")).where("a < n")
    r = engine.ranked(e.withColumn("span", F.floor(F.col("epoch_id") / 1000)), ["workspace_id"], "span", ["epoch_id"])
    return r.select("workspace_id", "epoch_id", (F.col("n") - F.col("a")).alias("owed"), "opened", F.col("position").alias("turn"))


@query(OP + ", r as (select workspace_id, server_sequence, actor_id, row_number() over (partition by workspace_id order by server_sequence desc) back from op where server_sequence is not null and workspace_id is not null), q as (select workspace_id, count(*) n, max(server_sequence) last_ from r group by 1) select q.workspace_id, q.n as events, least(q.n, 256) as held, greatest(q.n - 256, 0) as missed, (select min(server_sequence) from r where r.workspace_id = q.workspace_id and back <= 256) as oldest_held, last_ as newest from q")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a slow subscriber with a queue of 256 still holds of each workspace's events, the oldest being dropped."""
    o = ops(spark, sf_dir).where("server_sequence is not null and workspace_id is not null").select("workspace_id", "server_sequence")
    # newest first within spans of sequence numbers; only the spans at the end matter, and no group is held whole
    back = engine.ranked(o.withColumn("minus", -F.col("server_sequence")).withColumn("span", F.floor(-F.col("server_sequence") / 4096)), ["workspace_id"], "span", ["minus"])
    return back.groupBy("workspace_id").agg(F.count("*").alias("events"), F.count_if(F.col("position") <= 256).alias("held"), F.count_if(F.col("position") > 256).alias("missed"), F.min(F.when(F.col("position") <= 256, F.col("server_sequence"))).alias("oldest_held"), F.max("server_sequence").alias("newest"))


@query(OP + ", l as (select workspace_id, server_sequence, source_family, (epoch_us(accepted_at) - epoch_us(received_at)) / 1000e0 ms from op where accepted_at is not null and received_at is not null) select workspace_id, server_sequence, case when source_family in ('output_view', 'selected_date_time') then 'fast' else 'canonical' end as lane, case when ms <= 50 then 'exact' when ms <= 550 then 'grace' when ms <= 1000 then 'late' else 'expired' end as class from l")
def lane_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane of each operation, and the class of its result by how long it took against the deadlines of 50, 550 and 1,000 ms."""
    ms = (micros("accepted_at") - micros("received_at")) / 1000.0
    o = ops(spark, sf_dir).where("accepted_at is not null and received_at is not null").withColumn("ms", ms)
    rung = F.when(F.col("ms") <= 50, "exact").when(F.col("ms") <= 550, "grace").when(F.col("ms") <= 1000, "late").otherwise("expired")
    return o.select("workspace_id", "server_sequence", F.when(F.col("source_family").isin("output_view", "selected_date_time"), "fast").otherwise("canonical").alias("lane"), rung.alias("class"))


@query(OP + ", p as (select workspace_id, server_sequence, cast(json_extract(payload, '$.time_start') as int) t0, cast(json_extract(payload, '$.time_stop') as int) t1, unnest(json_keys(payload, '$.values')) as field, payload from op where source_family = 'model_receptor_parameters') select workspace_id, server_sequence, field, cast(json_extract(payload, '$.values.\"' || field || '\"') as double) as value, case when field not in ('albedo_b', 'albedo_g', 'ewall', 'eground', 'absK', 'absL', 'Fside', 'Fup', 'Fcyl', 'transVeg', 'height', 'leaf_start', 'leaf_end', 'elvis') then 'unknown' when t0 is null or t1 is null or t1 < t0 then 'no range' when field in ('albedo_b', 'albedo_g', 'ewall', 'eground', 'absK', 'absL', 'Fside', 'Fup', 'Fcyl', 'transVeg') and cast(json_extract(payload, '$.values.\"' || field || '\"') as double) not between 0 and 1 then 'out of bounds' when field = 'height' and cast(json_extract(payload, '$.values.\"' || field || '\"') as double) not between 0 and 10 then 'out of bounds' when field in ('leaf_start', 'leaf_end') and cast(json_extract(payload, '$.values.\"' || field || '\"') as double) not between 0 and 366 then 'out of bounds' when field = 'elvis' and cast(json_extract(payload, '$.values.\"' || field || '\"') as double) not between -1 and 1 then 'out of bounds' else 'ok' end as verdict from p")
def parameter_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of model parameters in the log, and what is wrong with each."""
    b = F.from_json("payload", "time_start int, time_stop int, values map<string, double>")
    o = ops(spark, sf_dir).where("source_family = 'model_receptor_parameters'").withColumn("b", b)
    x = o.select("workspace_id", "server_sequence", F.col("b.time_start").alias("t0"), F.col("b.time_stop").alias("t1"), F.explode("b.values").alias("field", "value"))
    outside = F.lit(False)
    for name, (low, high) in engine.MODEL_PARAMETERS.items():
        outside = outside | ((F.col("field") == name) & ~F.col("value").between(low, high))
    verdict = F.when(~F.col("field").isin(*engine.MODEL_PARAMETERS), "unknown").when(F.col("t0").isNull() | F.col("t1").isNull() | (F.col("t1") < F.col("t0")), "no range").when(outside, "out of bounds").otherwise("ok")
    return x.select("workspace_id", "server_sequence", "field", "value", verdict.alias("verdict"))


@query(OP + ", s as (select workspace_id, epoch_id, sha256(string_agg(cast(server_sequence as varchar) || ':' || coalesce(verb, ''), ',' order by server_sequence)) as digest, count(*) n from op where epoch_id is not null group by 1, 2) select workspace_id, epoch_id, n as operations, digest, digest = sha256(digest) as torn from s")
def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest by which a restored epoch is known to be the one that was saved."""
    one = F.concat_ws(":", F.col("server_sequence").cast("string"), F.coalesce("verb", F.lit("")))
    g = ops(spark, sf_dir).where("epoch_id is not null").groupBy("workspace_id", "epoch_id").agg(F.array_sort(F.collect_list(F.when(F.col("server_sequence").isNotNull(), F.struct("server_sequence", one.alias("x"))))).alias("xs"), F.count("*").alias("operations"))
    digest = F.sha2(F.array_join(F.transform("xs", lambda x: x["x"]), ","), 256)
    return g.select("workspace_id", "epoch_id", "operations", digest.alias("digest")).withColumn("torn", F.col("digest") == F.sha2("digest", 256))


@query(CELL + "select r // 32 as kr, c // 32 as kc, count(*) as cells, min(dsm) as low, max(dsm) as high, round(avg(dsm) + 1e-9, 6) + 0e0 as mean, count(*) * 4 as bytes, sha256(string_agg(cast(cast(round(dsm * 100) as bigint) as varchar), ',' order by r, c)) as digest from cell group by 1, 2")
def patch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload of each patch of 32 by 32 cells in row order: size, statistics and digest, by which a load is checked."""
    g = cells(spark, sf_dir).groupBy(F.floor(F.col("r") / 32).alias("kr"), F.floor(F.col("c") / 32).alias("kc")).agg(
        F.count("*").alias("cells"), F.min("dsm").alias("low"), F.max("dsm").alias("high"), F.avg("dsm").alias("m"), F.array_sort(F.collect_list(F.struct("r", "c", F.round(F.col("dsm") * 100).cast("bigint").cast("string").alias("x")))).alias("xs"))  # 1,024 cells at most
    return g.select("kr", "kc", "cells", "low", "high", (F.round(F.col("m") + 1e-9, 6) + F.lit(0.0)).alias("mean"), (F.col("cells") * 4).alias("bytes"), F.sha2(F.array_join(F.transform("xs", lambda x: x["x"]), ","), 256).alias("digest"))
