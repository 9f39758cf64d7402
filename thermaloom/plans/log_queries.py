"""Queries of incremental recomputation, collaboration and validation, with independent SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermaloom.functions import radiation, sky
from thermaloom.functions.formula import apply, real
from thermaloom.operators import collab, engine, incremental
from thermaloom.operators.replay import replay
from thermaloom.plans.bindings import MET_SQL, OPS_SQL, met, ops
from thermaloom.plans.datasets import SQL as DATASET_SQL
from thermaloom.plans.datasets import p6_found, replay_feed
from thermaloom.session import table

P6_SQL = DATASET_SQL["p6_found"]
OP = f"with op as ({OPS_SQL}) "
MET = f"with met as ({MET_SQL}) "
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: str, digits: int = 6) -> F.Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


_EDGES = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in incremental.EDGES) + ") e(src, dst)"


@query(f"with recursive reach(source, node) as (select src, dst from {_EDGES} union select r.source, e.dst from reach r join {_EDGES} on e.src = r.node) select distinct source, node from reach")
def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that each node's change invalidates."""
    return incremental.closure(spark)


_NODES = "(values " + ", ".join(f"('{n}')" for names in incremental.NODES.values() for n in names) + ") n(node)"


@query(f"with recursive p(node, d) as (select node, 0 from {_NODES} union select e.dst, p.d + 1 from p join {_EDGES} on e.src = p.node) select row_number() over (order by max(d), node) - 1 as position, node from p group by node")
def graph_topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological order of the dependency graph."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(incremental.topological_order())], "position int, node string")


@query(OP + """, e as (select workspace_id, entity_id, epoch_id // 20 as span, arg_min(verb, server_sequence) first_verb, arg_max(verb, server_sequence) last_verb, min(server_sequence) first_seq, max(server_sequence) last_seq, count(*) n
 from op where source_family = 'vegetation_geometry' and entity_id is not null group by 1, 2, 3) select *, not (first_verb = 'add' and last_verb = 'delete') as kept from e""")
def coalesce_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of one object within twenty epochs as one: first and last operation; an object added and deleted is no edit."""
    o = ops(spark, sf_dir).where("source_family = 'vegetation_geometry' and entity_id is not null")
    g = o.groupBy("workspace_id", "entity_id", F.floor(F.col("epoch_id") / 20).alias("span"))
    e = g.agg(F.min_by("verb", "server_sequence").alias("first_verb"), F.max_by("verb", "server_sequence").alias("last_verb"), F.min("server_sequence").alias("first_seq"), F.max("server_sequence").alias("last_seq"), F.count("*").alias("n"))
    return e.withColumn("kept", ~((F.col("first_verb") == "add") & (F.col("last_verb") == "delete")))


_ADDS = """, b as (select workspace_id, entity_id, server_sequence, epoch_id, case when json_type(payload, '$.values') = 'OBJECT' then json_extract(payload, '$.values') else payload::json end v from op where source_family = 'vegetation_geometry' and verb = 'add' and entity_id is not null),
 t as (select workspace_id, entity_id, server_sequence, epoch_id, cast(json_extract_string(v, '$.x_m') as double) x, cast(json_extract_string(v, '$.y_m') as double) y, cast(json_extract_string(v, '$.height_m') as double) h, cast(json_extract_string(v, '$.canopy_radius_m') as double) r from b),
 i as (select *, r + greatest(least(h / 0.08748866352592401e0, 300e0), least(h / 0.10510423526567646e0, 300e0)) + 6e0 reach from t where x is not null and y is not null and h is not null and r is not null),
 j as (select *, lag(x) over w px, lag(y) over w py, lag(reach) over w pr from i window w as (partition by workspace_id, entity_id order by server_sequence)),
 k as (select workspace_id, entity_id, server_sequence, epoch_id, least(x - reach, px - pr) x0, greatest(x + reach, px + pr) x1, least(y - reach, py - pr) y0, greatest(y + reach, py + pr) y1 from j),
 w as (select workspace_id, entity_id, server_sequence, epoch_id, cast(greatest(floor(floor(y0 / 2e0) / 16) * 16, 0) as int) r0, cast(greatest(least(ceil(ceil(y1 / 2e0) / 16) * 16, 500), 0) as int) r1, cast(greatest(floor(floor(x0 / 2e0) / 16) * 16, 0) as int) c0, cast(greatest(least(ceil(ceil(x1 / 2e0) / 16) * 16, 500), 0) as int) c1 from k) """


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = replay_feed(ops(spark, sf_dir), extra=("epoch_id",)).where("verb = 'add' and entity_id is not null and x_m is not null and y_m is not null and height_m is not null and canopy_radius_m is not null")
    feed = feed.withColumn("reach", incremental.influence_reach(F.col("height_m"), F.col("canopy_radius_m")))
    w = Window.partitionBy("workspace_id", "entity_id").orderBy("server_sequence")
    lo = lambda a: F.least(F.col(a) - F.col("reach"), F.lag(F.col(a) - F.col("reach")).over(w))
    hi = lambda a: F.greatest(F.col(a) + F.col("reach"), F.lag(F.col(a) + F.col("reach")).over(w))
    b = feed.select("workspace_id", "entity_id", "server_sequence", "epoch_id", lo("x_m").alias("x0"), hi("x_m").alias("x1"), lo("y_m").alias("y0"), hi("y_m").alias("y1"))
    return b.select("workspace_id", "entity_id", "server_sequence", "epoch_id", *(v.alias(k) for k, v in incremental.dirty_window(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 2.0, 500, 500).items()))


@query(OP + _ADDS + "select * from w")
def dirty_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that each planted tree can change: the union of old and new influence, in blocks of 16."""
    return _windows(spark, sf_dir)


@query(OP + _ADDS + "select *, (r1 - r0) * (c1 - c0) as area, case when (r1 - r0) * (c1 - c0) / 250000e0 >= 0.3e0 then 'full' else 'local' end as mode from w")
def recompute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local or full recomputation by the share of the domain."""
    w = _windows(spark, sf_dir).withColumn("area", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))
    return w.withColumn("mode", incremental.recompute_mode(F.col("area"), 250000))


_WEIGHTS = {"relative_geometry": 0.2, "vegetation_visibility": 6.0, "svf": 4.0, "time_shadow": 3.0, "radiation": 5.0, "surface_thermal_state": 1.0, "tmrt": 1.0, "utci": 1.5, "wbgt": 1.0}
_WEIGHT_SQL = "(values " + ", ".join(f"('{k}', {v}e0)" for k, v in _WEIGHTS.items()) + ") g(node, weight)"


@query(OP + _ADDS + f"select workspace_id, g.node, count(*) as edits, round(sum(g.weight * (r1 - r0) * (c1 - c0) * 24 / 1e5), 4) + 0e0 as cost from w, {_WEIGHT_SQL} group by 1, 2")
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of recomputing what each node has dirty: weight by cells by steps, over the nodes downstream of the vegetation."""
    g = spark.createDataFrame(list(_WEIGHTS.items()), "node string, weight double")
    down = incremental.closure(spark).where("source = 'vegetation_dsm'").select("node").join(g, "node")
    area = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    per = _windows(spark, sf_dir).groupBy("workspace_id").agg(F.sum(area).alias("area"), F.count("*").alias("edits"))
    nodes = down.agg(F.collect_list(F.struct("node", "weight")).alias("g"))  # the graph's nodes, a fixed number
    return per.join(nodes, F.lit(True)).withColumn("n", F.explode("g")).select("workspace_id", "n.node", "edits", F.round(F.col("n.weight") * F.col("area") * 24 / 1e5, 4).alias("cost"))


@query()
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty windows of ten epochs merged while they touch."""
    w = _windows(spark, sf_dir).withColumn("span", F.floor(F.col("epoch_id") / 10))
    return incremental.merge_windows(w, ["workspace_id", "span"], gap=8)


_PAINT = """, b as (select workspace_id, server_sequence, epoch_id, actor_id, cast(json_extract(payload, '$.class') as int) as class, cast(json_extract(payload, '$.window.row_start') as int) r0, cast(json_extract(payload, '$.window.row_stop') as int) r1, cast(json_extract(payload, '$.window.col_start') as int) c0, cast(json_extract(payload, '$.window.col_stop') as int) c1 from op where source_family = 'landcover_surface' and verb = 'paint'),
 p as (select * from b where class is not null and r1 > r0 and c1 > c0),
 x as (select q.*, unnest(range(c0, c1)) c from (select p.*, unnest(range(r0, r1)) r from p) q) """


@query(OP + _PAINT + "select workspace_id, cast(r as int) as r, cast(c as int) as c, arg_max(class, server_sequence) as class, max(server_sequence) as server_sequence, count(*) as writes from x group by 1, 2, 3")
def paint_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present class of every painted cell, last write wins."""
    return collab.painted_cells(ops(spark, sf_dir))


@query(OP + _PAINT + "select workspace_id, r // 64 as kr, c // 64 as kc, count(distinct r * 100000 + c) as covered, round(count(distinct r * 100000 + c) / 4096e0, 6) + 0e0 as share, case when count(distinct r * 100000 + c) = 4096 then 'FULL' else 'PARTIAL' end as coverage from x group by 1, 2, 3")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered share of each chunk of 64 cells."""
    p = collab.painted_cells(ops(spark, sf_dir))
    g = p.groupBy("workspace_id", F.floor(F.col("r") / 64).alias("kr"), F.floor(F.col("c") / 64).alias("kc")).agg(F.count("*").alias("covered"))
    return g.withColumn("share", F.round(F.col("covered") / 4096.0, 6)).withColumn("coverage", F.when(F.col("covered") == 4096, "FULL").otherwise("PARTIAL"))


@query(OP + _PAINT + ", k as (select distinct workspace_id, r, c from x), n as (select workspace_id, r, c, c - row_number() over (partition by workspace_id, r order by c) i from k) select workspace_id, cast(r as int) as r, cast(min(c) as int) as start, cast(max(c) as int) as stop from n group by workspace_id, r, i")
def window_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted cells as maximal runs of columns in each row."""
    p = collab.painted_cells(ops(spark, sf_dir)).select("workspace_id", "r", "c")
    return incremental.islands(p, ["workspace_id", "r"], "c", [])


@query(OP + _PAINT + ", y as (select distinct workspace_id, epoch_id // 200 as span, unnest(range(r0 // 64, (r1 - 1) // 64 + 1)) kr, c0, c1, actor_id, server_sequence from p), z as (select workspace_id, span, kr, unnest(range(c0 // 64, (c1 - 1) // 64 + 1)) kc, actor_id, server_sequence from y) select workspace_id, span, kr, kc, count(distinct actor_id) as actors, count(*) as paints, max(server_sequence) as winner from z group by 1, 2, 3, 4 having count(distinct actor_id) >= 2")
def conflicts_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that several actors painted within two hundred epochs."""
    return collab.chunk_conflicts(ops(spark, sf_dir), 200)


_RANGES = """, b as (select workspace_id, source_family, server_sequence, actor_id, cast(json_extract(payload, '$.time_start') as int) t0, cast(json_extract(payload, '$.time_stop') as int) t1, json_extract(payload, '$.values') v from op where source_family in ('meteorological_forcing', 'model_receptor_parameters') and verb = 'set'),
 f as (select *, unnest(json_keys(v)) field from b where t0 is not null and t1 >= t0), w as (select *, cast(json_extract_string(v, '$.' || field) as double) as value from f),
 s as (select workspace_id, source_family, field, t, arg_max(value, server_sequence) as value from (select *, unnest(range(t0, t1 + 1)) t from w) q group by 1, 2, 3, 4),
 g as (select *, case when lag(t) over o = t - 1 and lag(value) over o is not distinct from value then 0 else 1 end n from s window o as (partition by workspace_id, source_family, field order by t)),
 h as (select *, sum(n) over (partition by workspace_id, source_family, field order by t) i from g) """


@query(OP + _RANGES + "select workspace_id, source_family, field, any_value(value) as value, cast(min(t) as int) as start, cast(max(t) as int) as stop from h group by workspace_id, source_family, field, i")
def segment_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical time segments of every forcing and parameter field."""
    return collab.segments(ops(spark, sf_dir)).select("workspace_id", "source_family", "field", "value", "start", "stop")


@query(OP + _RANGES + ", d as (select distinct workspace_id, source_family, field from s), a as (select d.*, unnest(range(0, 24)) t from d), m as (select a.* from a anti join s using (workspace_id, source_family, field, t)), k as (select *, t - row_number() over (partition by workspace_id, source_family, field order by t) i from m) select workspace_id, source_family, field, cast(min(t) as int) as start, cast(max(t) as int) as stop from k group by workspace_id, source_family, field, i")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the day that no write covers, as runs."""
    keys = ["workspace_id", "source_family", "field"]
    have = collab.range_writes(ops(spark, sf_dir)).withColumn("t", F.explode(F.sequence("t0", "t1"))).select(*keys, "t").distinct()
    every = have.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return incremental.islands(every.join(have, [*keys, "t"], "left_anti"), keys, "t", [])


@query(OP + _RANGES + """, o as (select t, avg(value) v, count(*) n from s where field = 'ta' group by 1) select m.reading_id, m.it as hour_step, round(coalesce(o.v, m.ta) + 1e-9, 6) + 0e0 as ta_overlaid, o.v is not null as edited from (""" + MET_SQL + ") m left join o on o.t = m.it")
def met_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forcing under the edits of the log: the mean edited air temperature of a step of the day replaces the reading's."""
    keys = ["workspace_id", "source_family", "field"]
    s = collab.range_writes(ops(spark, sf_dir)).withColumn("it", F.explode(F.sequence("t0", "t1"))).groupBy(*keys, "it").agg(F.max_by("value", "server_sequence").alias("value"))
    o = s.where("field = 'ta'").groupBy("it").agg(F.avg("value").alias("v"))
    m = met(spark, sf_dir).join(o, "it", "left")
    return m.select("reading_id", F.col("it").alias("hour_step"), F.round(F.coalesce("v", "ta") + 1e-9, 6).alias("ta_overlaid"), F.col("v").isNotNull().alias("edited"))


@query(OP + """, v as (select workspace_id, case when json_extract_string(payload, '$.scope') = 'user' then actor_id else '' end as owner, json_extract_string(payload, '$.values.variable') variable, server_sequence from op where source_family = 'output_view')
 select workspace_id, owner, arg_max(variable, server_sequence) as variable, max(server_sequence) as server_sequence, count(*) as selections from v group by 1, 2""")
def view_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable in view of every workspace and actor."""
    return collab.views(ops(spark, sf_dir))


@query(OP + """, b as (select workspace_id, entity_id, verb, actor_id, server_sequence, epoch_id // 50 as span, case when json_type(payload, '$.values') = 'OBJECT' then json_extract(payload, '$.values') else payload::json end v from op where source_family = 'vegetation_geometry' and verb in ('add', 'replace', 'move') and entity_id is not null),
 f as (select *, unnest(['x_m', 'y_m', 'height_m', 'canopy_radius_m']) field from b), g as (select * from f where json_extract_string(v, '$.' || field) is not null and (verb <> 'move' or field in ('x_m', 'y_m')))
 select workspace_id, entity_id, field, span, count(distinct actor_id) as actors, max(server_sequence) as winner, cast(count(*) - 1 as int) as losers from g group by 1, 2, 3, 4 having count(distinct actor_id) >= 2""")
def conflicts_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree fields that several actors wrote within fifty epochs."""
    return collab.field_conflicts(ops(spark, sf_dir), 50)


@query(OP + """, o as (select workspace_id, entity_id, server_sequence, verb from op where source_family = 'vegetation_geometry' and entity_id is not null and entity_id <> ''),
 s as (select *, max(case when verb = 'add' then server_sequence end) over w la, max(case when verb = 'delete' then server_sequence end) over w ld from o window w as (partition by workspace_id, entity_id order by server_sequence rows between unbounded preceding and 1 preceding))
 select workspace_id, entity_id, server_sequence, verb, case when la is null then 'unknown' else 'tombstone' end as reason from s where verb in ('move', 'replace') and (la is null or coalesce(ld, 0) > la)""")
def tombstone_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of trees that do not exist, or no longer."""
    o = ops(spark, sf_dir).where("source_family = 'vegetation_geometry' and entity_id is not null and entity_id <> ''")
    w = Window.partitionBy("workspace_id", "entity_id").orderBy("server_sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda verb: F.max(F.when(F.col("verb") == verb, F.col("server_sequence"))).over(w)
    s = o.select("workspace_id", "entity_id", "server_sequence", "verb", last("add").alias("la"), last("delete").alias("ld"))
    return s.where("verb in ('move', 'replace') and (la is null or coalesce(ld, 0) > la)").select("workspace_id", "entity_id", "server_sequence", "verb", F.when(F.col("la").isNull(), "unknown").otherwise("tombstone").alias("reason"))


_P6_AT = lambda rows: P6_SQL.replace("from operation_log", f"from {rows}")


@query("with mid as (select workspace_id w, floor(max(server_sequence) / 2) m from operation_log group by 1), early as (select o.* from operation_log o join mid on mid.w = o.workspace_id where o.server_sequence <= mid.m), a as (" + _P6_AT("early") + "), b as (" + P6_SQL + ") select coalesce(a.workspace_id, b.workspace_id) as workspace_id, coalesce(a.entity_id, b.entity_id) as entity_id, case when a.entity_id is null then 'added' when b.entity_id is null then 'deleted' else 'changed' end as change from a full join b on a.workspace_id = b.workspace_id and a.entity_id = b.entity_id where a.entity_id is null or b.entity_id is null or (a.x_cm, a.y_cm, a.height_cm, a.radius_cm) is distinct from (b.x_cm, b.y_cm, b.height_cm, b.radius_cm)")
def epoch_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net change of the trees between the middle of each workspace's log and its end: added, deleted, changed."""
    o = ops(spark, sf_dir)
    middle = o.groupBy("workspace_id").agg(F.floor(F.max("server_sequence") / 2).alias("middle"))
    keys, fields, position = ("workspace_id", "entity_id"), ("x_m", "y_m", "height_m", "canopy_radius_m"), ("x_m", "y_m")
    feed = replay_feed(o)
    state = lambda f: replay(f, keys, "server_sequence", "verb", "carries", fields, position)
    a = state(feed.join(middle, "workspace_id").where("server_sequence <= middle")).select(*keys, F.struct(*fields).alias("old"))
    b = state(feed).select(*keys, F.struct(*fields).alias("new"))
    j = a.join(b, list(keys), "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.withColumn("change", change).where("change is not null").select(*keys, "change")


@query(OP.replace("with ", "with recursive ") + ", o as (select workspace_id, server_sequence, epoch_us(received_at) t from op where received_at is not null), s(w, began, n) as (select workspace_id, min(t), 0 from o group by 1 union all select s.w, min(o.t), s.n + 1 from s join o on o.workspace_id = s.w and o.t >= s.began + 100000 group by s.w, s.n), f as (select w, began, n, lead(began) over (partition by w order by began) nxt from s) select o.workspace_id, o.server_sequence, cast(f.n as bigint) as epoch from o join f on f.w = o.workspace_id and o.t >= f.began and (f.nxt is null or o.t < f.nxt)")
def epoch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity-opened epochs of 100 ms."""
    return collab.micro_epochs(ops(spark, sf_dir))


@query(OP + "select workspace_id, epoch_id, source_family, count(*) as n, min(server_sequence) as first_seq, max(server_sequence) as last_seq, count(distinct actor_id) as actors from op group by 1, 2, 3")
def epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each epoch by family."""
    return ops(spark, sf_dir).groupBy("workspace_id", "epoch_id", "source_family").agg(F.count("*").alias("n"), F.min("server_sequence").alias("first_seq"), F.max("server_sequence").alias("last_seq"), F.countDistinct("actor_id").alias("actors"))


@query(OP + ", s as (select *, case when received_at - lag(received_at) over w < interval 30 seconds then 0 else 1 end n from op window w as (partition by workspace_id, actor_id order by received_at)), t as (select *, sum(n) over (partition by workspace_id, actor_id order by received_at, n desc rows unbounded preceding) i from s where received_at is not null) select workspace_id, actor_id, min(received_at) as started, max(received_at) as ended, count(*) as n from t group by workspace_id, actor_id, i")
def debounce_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of an actor's operations, ended by pauses of thirty seconds."""
    return collab.sessions(ops(spark, sf_dir).where("received_at is not null"), ["workspace_id", "actor_id"], "received_at", 30)


@query(OP + "select workspace_id, server_sequence, count(*) over (partition by workspace_id order by epoch_us(received_at) range between 60000000 preceding and current row) as load from op where received_at is not null")
def admission_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load of the last minute at each operation."""
    return collab.sliding_load(ops(spark, sf_dir).where("received_at is not null"), ["workspace_id"], "received_at", 60).select("workspace_id", "server_sequence", "load")


@query(OP + "select workspace_id, server_sequence, max(base_revision) over w as known_revision, server_sequence - row_number() over (partition by workspace_id order by server_sequence) as missing_before from op window w as (partition by workspace_id order by server_sequence rows unbounded preceding)")
def revision_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest revision seen so far, and how many sequences are missing before each operation."""
    o = ops(spark, sf_dir).select("workspace_id", "server_sequence", "base_revision").withColumn("span", F.coalesce(F.floor(F.col("server_sequence") / 4096), F.lit(-1)))
    known = engine.running(o, ["workspace_id"], "span", ["server_sequence"], "base_revision", "max")
    placed = engine.ranked(known, ["workspace_id"], "span", ["server_sequence"])
    return placed.select("workspace_id", "server_sequence", F.col("running").alias("known_revision"), (F.col("server_sequence") - F.col("position")).alias("missing_before"))


@query(OP + ", m as (select workspace_id, max(server_sequence) * 9 // 10 as acked from op group by 1) select op.workspace_id, op.server_sequence, op.operation_id, op.verb from op join m on m.workspace_id = op.workspace_id where op.server_sequence > m.acked")
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations after the acknowledged sequence of each workspace."""
    o = ops(spark, sf_dir)
    acked = o.groupBy("workspace_id").agg(F.floor(F.max("server_sequence") * 9 / 10).alias("acked"))
    return o.join(acked, "workspace_id").where("server_sequence > acked").select("workspace_id", "server_sequence", "operation_id", "verb")


@query(OP + ", m as (select workspace_id, max(accepted_at) - interval 24 hours as since, max(server_sequence) - 1000 as tail from op group by 1) select op.workspace_id, count(*) as kept, min(op.server_sequence) as first_kept from op join m on m.workspace_id = op.workspace_id where op.accepted_at >= m.since or op.server_sequence > m.tail group by 1")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sweep leaves: the last day, and the last thousand sequences."""
    o = ops(spark, sf_dir)
    cut = o.groupBy("workspace_id").agg((F.max("accepted_at") - F.expr("interval 24 hours")).alias("since"), (F.max("server_sequence") - 1000).alias("tail"))
    return o.join(cut, "workspace_id").where("accepted_at >= since or server_sequence > tail").groupBy("workspace_id").agg(F.count("*").alias("kept"), F.min("server_sequence").alias("first_kept"))


@query(OP + "select workspace_id, source_family, coalesce(entity_id, '') as entity, max(server_sequence) as current, count(*) - 1 as superseded, arg_max(verb, server_sequence) as verb from op group by 1, 2, 3")
def job_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation that stands for each target, and how many it supersedes."""
    o = ops(spark, sf_dir).withColumn("entity", F.coalesce("entity_id", F.lit("")))
    return o.groupBy("workspace_id", "source_family", "entity").agg(F.max("server_sequence").alias("current"), (F.count("*") - 1).alias("superseded"), F.max_by("verb", "server_sequence").alias("verb"))


@query("""with d as (select workspace_id, server_sequence, count(*) copies, count(distinct verb) verbs, count(distinct coalesce(entity_id, '')) entities, count(distinct actor_id) actors from operation_log group by 1, 2)
 select workspace_id, server_sequence, copies, case when verbs > 1 or entities > 1 or actors > 1 then 'conflict' else 'replay' end as outcome from d where copies > 1""")
def op_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated appends: replays if the content agrees, conflicts if it does not."""
    g = table(spark, sf_dir, "operation_log").groupBy("workspace_id", "server_sequence").agg(F.count("*").alias("copies"), F.countDistinct("verb").alias("verbs"), F.countDistinct(F.coalesce("entity_id", F.lit(""))).alias("entities"), F.countDistinct("actor_id").alias("actors"))
    outcome = F.when((F.col("verbs") > 1) | (F.col("entities") > 1) | (F.col("actors") > 1), "conflict").otherwise("replay")
    return g.where("copies > 1").select("workspace_id", "server_sequence", "copies", outcome.alias("outcome"))


@query(MET + "select station, cast(obs_time as date) as day, variable, count(v) as n, min(v) as low, max(v) as high, round(avg(v) + 1e-9, 6) + 0e0 as mean from (select station, obs_time, unnest(['ta', 'rh', 'radg']) variable, unnest([ta, rh, radg]) v from met) q group by 1, 2, 3")
def plane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, bounds and mean of each variable, station and day."""
    m = met(spark, sf_dir).unpivot(["station", "obs_time"], ["ta", "rh", "radg"], "variable", "v")
    return m.groupBy("station", F.to_date("obs_time").alias("day"), "variable").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v") + 1e-9, 6).alias("mean"))


@query(MET + ", b as (select station, cast(obs_time as date) as day, bit_or(case when radg > 5 then cast(1 as bigint) << it else cast(0 as bigint) end) bits from met group by 1, 2) select station, day, bits, cast(bit_count(bits) as int) as lit_hours, (bits >> 12) & 1 = 1 as lit_at_noon from b")
def packed_bits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with sun as a bit set of each station and day, and what is read back from it."""
    b = incremental.pack_bits(met(spark, sf_dir).withColumn("day", F.to_date("obs_time")), ["station", "day"], "it", F.col("radg") > 5)
    return b.select("station", "day", "bits", F.bit_count("bits").alias("lit_hours"), (F.getbit("bits", F.lit(12)) == 1).alias("lit_at_noon"))


@query(MET + ", b as (select station, cast(obs_time as date) as day, bit_or(case when radg > 5 then cast(1 as bigint) << it else cast(0 as bigint) end) bits from met group by 1, 2), k as (select b.*, unnest(range(0, 24)) h from b) select station, day, round(sum(case when (bits >> h) & 1 = 1 then sin(pi() * (h + 0.5e0) / 24) else 0e0 end), 6) + 0e0 as weighted from k group by 1, 2")
def packed_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum over the bits of a set."""
    b = incremental.pack_bits(met(spark, sf_dir).withColumn("day", F.to_date("obs_time")), ["station", "day"], "it", F.col("radg") > 5)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(0.0), lambda acc, h: acc + F.when(F.getbit("bits", h) == 1, F.sin(F.lit(3.141592653589793) * (h + 0.5) / 24)).otherwise(0.0))
    return b.select("station", "day", F.round(total, 6).alias("weighted"))


@query(MET + """, n as (select *, lead(ta) over (partition by station order by obs_time, reading_id) candidate from met), d as (select case when it < 6 then 'night' when it < 12 then 'morning' when it < 18 then 'afternoon' else 'evening' end as band, abs(ta - candidate) d from n)
 select band, round(avg(d) + 1e-9, 6) + 0e0 as mae, quantile_disc(d, 0.99) as p99, max(d) as max_abs, round(avg(case when d > 0.25e0 then 1e0 else 0e0 end), 6) + 0e0 as mismatch, count(*) as n from d where d is not null group by 1""")
def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of successive readings by part of the day."""
    m = met(spark, sf_dir).withColumn("candidate", F.lead("ta").over(Window.partitionBy("station").orderBy("obs_time", "reading_id")))
    band = F.when(F.col("it") < 6, "night").when(F.col("it") < 12, "morning").when(F.col("it") < 18, "afternoon").otherwise("evening")
    c = incremental.compare(m.withColumn("band", band), ["band"], "ta", "candidate", 0.25)
    return c.select("band", (F.round(F.col("mae") + 1e-9, 6) + F.lit(0.0)).alias("mae"), "p99", "max_abs", r6("mismatch"), "n")


# -- folds over time -------------------------------------------------------------------------------
@query(MET + """, d as (select station, cast(obs_time as date) as day, it, avg(ta + 0.02e0 * coalesce(radg, 0)) t0 from met where it between 6 and 18 and ta is not null group by 1, 2, 3),
 o as (select station, day, list(t0 order by it) xs from d group by 1, 2)
 select station, day, round(list_reduce(xs, lambda p, x: x * (1 - exp(-33.27e0 / 24e0)) + p * exp(-33.27e0 / 24e0)), 5) + 0e0 as carried, len(xs) as steps from o""")
def ts_wave_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface temperature carried over a day's hours: each step keeps the weight exp(-33.27 dt) of the one before."""
    m = met(spark, sf_dir).where("it between 6 and 18 and ta is not null")
    d = m.groupBy("station", F.to_date("obs_time").alias("day"), "it").agg(F.avg(F.col("ta") + 0.02 * F.coalesce("radg", F.lit(0.0))).alias("t0"))
    o = d.groupBy("station", "day").agg(F.array_sort(F.collect_list(F.struct("it", "t0"))).alias("xs"))
    keep = F.exp(F.lit(-33.27 / 24))
    carried = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.element_at("xs", 1)["t0"], lambda p, x: x["t0"] * (1 - keep) + p * keep)
    return o.select("station", "day", F.round(carried, 5).alias("carried"), F.size("xs").cast("bigint").alias("steps"))


_NOON = real("select station, cast(obs_time as date) as day, max(doy) as doy, max(latitude) as latitude, avg(radd) as diffuse, avg(radi) as direct from met where it = 12 and radd > 0 and radi >= 0 and radd < 1000 and radi < 1500 and latitude is not null group by 1, 2")


def _noon(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = met(spark, sf_dir).where("it = 12 and radd > 0 and radi >= 0 and radd < 1000 and radi < 1500 and latitude is not null")
    return m.groupBy("station", F.to_date("obs_time").alias("day")).agg(F.max("doy").alias("doy"), F.max("latitude").alias("latitude"), F.avg("radd").alias("diffuse"), F.avg("radi").alias("direct"))


_SKY_STEPS = [("hour", "12.5 + 0.0 * latitude"), *sky.LOCAL_SUN, *sky.PEREZ_STEPS]


def _luminance_sql() -> str:
    from thermaloom.functions.formula import chain_sql

    noon = chain_sql(_NOON, _SKY_STEPS)
    cross = f"select n.*, b.band_alt as patch_alt, b.azi_0 + k * 360e0 / b.n_patches as patch_azi, b.band, k from ({noon}) n, ({sky.bands_sql()}) b, range(0, 70) t(k) where k < n_patches and altitude > 3 and px_bright is not null"
    lum = chain_sql(cross, sky.PATCH_LUMINANCE)
    return MET + f"select station, day, band, round(sum(luminance) / any_value(total), 6) + 0e0 as share from (select *, sum(luminance) over (partition by station, day) total from ({lum}) l) z where total > 1e-6 group by 1, 2, 3"


@query(_luminance_sql())
def perez_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each sky band in the diffuse light at noon, over 153 patches."""
    n = apply(_noon(spark, sf_dir), _SKY_STEPS).where("altitude > 3 and px_bright is not null")
    patch = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(a).alias("patch_alt"), F.lit(z + k * 360.0 / c).alias("patch_azi")) for b, a, z, c, _, _ in sky.bands() for k in range(c))))
    lum = apply(n.withColumn("x", patch).select("*", "x.*"), sky.PATCH_LUMINANCE)
    g = lum.groupBy("station", "day", "band").agg(F.sum("luminance").alias("l"))
    total = F.sum("l").over(Window.partitionBy("station", "day"))
    return g.withColumn("total", total).where("total > 1e-6").select("station", "day", "band", F.round(F.col("l") / F.col("total"), 6).alias("share"))


def band_shares(readings: DataFrame) -> DataFrame:
    """``reading_id, band, share`` of each reading (hour, doy, latitude, diffuse, direct) with the sun up: bands' shares in the diffuse light over 153 patches.

    As in the reference a sum below 0, which the polynomial gives under some low suns, divides like any other.
    """
    n = apply(readings, [*sky.LOCAL_SUN, *sky.PEREZ_STEPS]).where("altitude > 0 and px_bright is not null")
    n = n.select("reading_id", "sin_alt", F.expr("cos(asin(sin_alt))").alias("cos_alt"), F.radians("azimuth").alias("sun"), "px_a", "px_b", "px_c", "px_d", "px_e")
    # sky.PATCH_LUMINANCE with what depends on the band alone taken out of the patches
    up = lambda a: math.sin(math.radians(a))
    vault = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(up(a)).alias("sin_p"), F.lit(up(90.0 - a)).alias("cos_p"), F.array(*(F.lit(math.radians(z + k * 360.0 / c)) for k in range(c))).alias("azis")) for b, a, z, c, _, _ in sky.bands()))
    by_band = n.withColumn("x", F.explode(vault)).select("reading_id", "px_c", "px_d", "px_e", "sun", F.col("x.band").alias("band"), (F.col("x.sin_p") * F.col("sin_alt")).alias("high"), (F.col("x.cos_p") * F.col("cos_alt")).alias("wide"), F.expr(real("1.0 + px_a * exp(px_b / greatest(x.sin_p, 1e-9))")).alias("grade"), F.col("x.azis").alias("azis"))
    near = by_band.withColumn("azi", F.explode("azis")).withColumn("pl_cos", F.expr("high + wide * cos(azi - sun)"))
    lum = near.select("reading_id", "band", F.expr(real("grade * (1.0 + px_c * exp(px_d * acos(least(1.0, greatest(-1.0, pl_cos)))) + px_e * pl_cos * pl_cos)")).alias("luminance"))
    bands = [b for b, *_ in sky.bands()]
    g = lum.groupBy("reading_id").agg(F.sum("luminance").alias("total"), *(F.sum(F.when(F.col("band") == b, F.col("luminance"))).alias(f"l_{b}") for b in bands)).where("total <> 0")
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.round(F.col(f"l_{b}") / F.col("total"), 6).alias("share")) for b in bands)))
    return g.select("reading_id", each.alias("x")).select("reading_id", "x.*")


def perez_luminance_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each sky band in the diffuse light of every reading with the sun up, at its own hour."""
    m = met(spark, sf_dir).where("radd > 0 and radi >= 0 and radd < 1000 and radi < 1500 and latitude is not null")
    return band_shares(m.select("reading_id", "hour", "doy", "latitude", F.col("radd").alias("diffuse"), F.col("radi").alias("direct")))


QUERIES["perez_luminance_readings"] = perez_luminance_readings


def _emissivity_sql() -> str:
    from thermaloom.functions.formula import chain_sql

    air = "select station, cast(obs_time as date) as day, avg(ta) as ta, avg(case when rh between 0 and 100 then rh end) as rh from met where ta between -60 and 60 group by 1, 2"
    es = chain_sql(air, radiation.CLEAR_SKY)
    cross = f"select n.*, b.band, b.band_alt from ({es}) n, ({sky.bands_sql()}) b where esky is not null"
    return MET + f"select station, day, band, round(emissivity_1, 6) + 0e0 as emissivity_1, round(emissivity_2, 6) + 0e0 as emissivity_2, round(emissivity_3, 6) + 0e0 as emissivity_3 from ({chain_sql(cross, sky.BAND_EMISSIVITY)}) q"


@query(_emissivity_sql())
def band_emissivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissivity of the sky bands of each day by three models."""
    m = met(spark, sf_dir).where("ta between -60 and 60").groupBy("station", F.to_date("obs_time").alias("day")).agg(F.avg("ta").alias("ta"), F.avg(F.when(F.col("rh").between(0, 100), F.col("rh"))).alias("rh"))
    band = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(a).alias("band_alt")) for b, a, *_ in sky.bands())))
    e = apply(apply(m, radiation.CLEAR_SKY).where("esky is not null").withColumn("x", band).select("*", "x.*"), sky.BAND_EMISSIVITY)
    return e.select("station", "day", "band", r6("emissivity_1"), r6("emissivity_2"), r6("emissivity_3"))


@query(MET + ", d as (select station, cast(obs_time as date) as day, max(doy) doy, max(latitude) latitude from met where latitude is not null group by 1, 2), q as (select d.*, unnest(range(41, 96)) k from d), s as (select *, " + real("0.006918 - 0.399912 * cos(a) + 0.070257 * sin(a) - 0.006758 * cos(2.0 * a) + 0.000907 * sin(2.0 * a) - 0.002697 * cos(3.0 * a) + 0.00148 * sin(3.0 * a)") + " decl from (select *, 2e0 * pi() * (doy - 1e0) / 365e0 a from q) z), h as (select *, round(degrees(asin(sin(radians(latitude)) * sin(decl) + cos(radians(latitude)) * cos(decl) * cos(radians(15e0 * (k / 4e0 - 12e0))))), 7) alt from s), l as (select *, lead(alt) over (partition by station, day order by k) nxt from h) select station, day, cast(min(k) as int) as quarter, arg_min(round(alt, 5) + 0e0, k) as altmax from l where nxt < alt or nxt is null group by 1, 2")
def altmax_first_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest sun altitude of the day by quarter hours from 10:15 on: the first that the next one does not exceed."""
    d = met(spark, sf_dir).where("latitude is not null").groupBy("station", F.to_date("obs_time").alias("day")).agg(F.max("doy").alias("doy"), F.max("latitude").alias("latitude"))
    q = d.withColumn("k", F.explode(F.sequence(F.lit(41), F.lit(95)))).withColumn("hour", F.col("k") / 4.0)
    h = apply(q, sky.LOCAL_SUN).withColumn("alt", F.round("altitude", 7)).withColumn("nxt", F.lead(F.round("altitude", 7)).over(Window.partitionBy("station", "day").orderBy("k")))
    peak = h.where("nxt < alt or nxt is null").groupBy("station", "day").agg(F.min("k").alias("quarter"), F.min_by(F.round("alt", 5), "k").alias("altmax"))
    return peak.select("station", "day", "quarter", "altmax")


@query("select workspace_id, entity_id, generation, last_sequence from (" + P6_SQL + ") q")
def object_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live trees with generation and last sequence."""
    return p6_found(spark, sf_dir).select("workspace_id", "entity_id", "generation", "last_sequence")
