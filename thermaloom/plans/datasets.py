"""Queries of the data-operation problems over the project's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.operators import drift
from thermaloom.operators.dedup import MessageStore, ingest_in_batches
from thermaloom.operators.reconcile import digest_bytes, reconcile
from thermaloom.operators.replay import replay
from thermaloom.operators.spikes import implausible
from thermaloom.session import scratch_path, table

PLANES = ("tmrt", "utci", "shadow")
#: The operation log comes to the message store in so many spans of batches.
SPANS = 4


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that their station cannot have measured, by field."""
    return implausible(table(spark, sf_dir, "met_inputs"), table(spark, sf_dir, "grid_tiles").select("tile", "latitude"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a file's schema against the producer's file before."""
    return drift.changes(table(spark, sf_dir, "artifact_records"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable records under the producers' lasting field names."""
    return drift.consistent_table(table(spark, sf_dir, "artifact_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing rows and differing fields between the two systems' copies."""
    runs = reconcile(
        table(spark, sf_dir, "raw_runs"), table(spark, sf_dir, "raw_runs_mirror"), "run_id", "rep",
        {p: digest_bytes(F.col(f"plane_sha256.{p}")) for p in PLANES},
    )
    parity = reconcile(
        table(spark, sf_dir, "parity_summary"), table(spark, sf_dir, "parity_mirror"), "parity_id", None,
        {"mismatch_count": F.col("mismatch_count")},
    )
    cols = ("record_id", "rep", "field", "diff")
    return runs.select(F.lit("raw_runs").alias("dataset"), *cols).unionByName(parity.select(F.lit("parity_summary").alias("dataset"), *cols))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to drop, the log having gone into a message store in four spans of batches."""
    store = MessageStore(spark, scratch_path(spark, "messages"))
    return ingest_in_batches(table(spark, sf_dir, "operation_log"), store, "batch_id", SPANS).dropped()


_P5_SQL = """
with o as (select delivery_id, workspace_id, actor_id, client_sequence,
  lower(regexp_replace(regexp_replace(operation_id, '[\\s{}-]', '', 'g'), '^(urn:uuid:|URN:UUID:)', '')) u from operation_log),
r as (select *, case when u is null and client_sequence is not null then coalesce(max(u) over (partition by workspace_id, actor_id, client_sequence),
  concat_ws('|', workspace_id, actor_id, client_sequence)) else u end ident from o)
select delivery_id from (select delivery_id, ident, min(delivery_id) over (partition by ident) first from r) where ident is not null and delivery_id > first
"""

#: Fields of a tree and those that a move may set.
TREE_FIELDS = ("x_m", "y_m", "height_m", "canopy_radius_m")
POSITION = ("x_m", "y_m")


def replay_feed(log: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Operations on trees with the fields they carry, from under ``values`` or else from the payload's top level."""
    log = log.where("source_family = 'vegetation_geometry'")
    known = ", ".join(f"{f} double" for f in TREE_FIELDS)
    body = F.from_json("payload", f"values struct<{known.replace(' double', ': double')}>, {known}")
    base = ["workspace_id", "entity_id", "server_sequence", "verb", *extra]
    feed = log.select(*base, "payload", body.alias("b"))
    values = F.col("b.values")
    feed = feed.select(
        *base,
        *(F.when(values.isNotNull(), values[f]).otherwise(F.col(f"b.{f}")).alias(f) for f in TREE_FIELDS),
        F.when(F.col("verb") == "move", F.lit(False)).otherwise(_carries_other()).alias("other"),
    )
    has = lambda names: F.greatest(*(F.col(f).isNotNull() for f in names))
    return feed.withColumn("carries", F.when(F.col("verb") == "move", has(POSITION)).otherwise(has(TREE_FIELDS) | F.col("other")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present trees of each workspace, by replaying the operation log."""
    feed = replay_feed(table(spark, sf_dir, "operation_log"))
    live = replay(feed, ("workspace_id", "entity_id"), "server_sequence", "verb", "carries", TREE_FIELDS, POSITION)
    cm = {"x_cm": "x_m", "y_cm": "y_m", "height_cm": "height_m", "radius_cm": "canopy_radius_m"}
    return live.select("workspace_id", "entity_id", "generation", "last_sequence", *(F.round(F.col(m) * 100).cast("bigint").alias(c) for c, m in cm.items()))


def _carries_other() -> Column:
    """Does the payload carry a tree field beyond those of the result?"""
    inner, outer = F.get_json_object("payload", "$.values"), F.col("payload")
    return F.coalesce(F.coalesce(inner, outer).rlike('"(transmissivity|trunk_ratio)"'), F.lit(False))


_P6_SQL = """
with recursive o as (select workspace_id, entity_id, server_sequence s, any_value(verb) verb, any_value(payload) payload from operation_log
   where source_family = 'vegetation_geometry' and entity_id is not null and entity_id <> '' group by 1, 2, 3),
f as (select workspace_id, entity_id, s, verb, case when json_type(payload, '$.values') = 'OBJECT' then json_extract(payload, '$.values') else payload::json end b from o),
p as (select workspace_id, entity_id, s, verb, row_number() over (partition by workspace_id, entity_id order by s) n,
   cast(json_extract_string(b, '$.x_m') as double) x, cast(json_extract_string(b, '$.y_m') as double) y,
   cast(json_extract_string(b, '$.height_m') as double) h, cast(json_extract_string(b, '$.canopy_radius_m') as double) r,
   json_type(b, '$.transmissivity') is not null or json_type(b, '$.trunk_ratio') is not null other from f),
a as (select workspace_id, entity_id, max(s) filter (where verb = 'add') last_add, count(*) filter (where verb = 'add') - 1 generation from p group by 1, 2),
e as (select p.*, a.generation from p join a using (workspace_id, entity_id) where s >= last_add),
alive as (select workspace_id, entity_id from e group by 1, 2 having count(*) filter (where verb = 'delete') = 0)
select workspace_id, entity_id, cast(any_value(generation) as int) as generation,
  max(s) filter (where verb = 'add' or (verb = 'move' and (x is not null or y is not null)) or (verb = 'replace' and (x is not null or y is not null or h is not null or r is not null or other))) as last_sequence,
  cast(round(100 * arg_max(x, s) filter (where x is not null)) as bigint) as x_cm,
  cast(round(100 * arg_max(y, s) filter (where y is not null)) as bigint) as y_cm,
  cast(round(100 * arg_max(h, s) filter (where h is not null and verb <> 'move')) as bigint) as height_cm,
  cast(round(100 * arg_max(r, s) filter (where r is not null and verb <> 'move')) as bigint) as radius_cm
from e semi join alive using (workspace_id, entity_id) group by 1, 2
""".replace("with recursive", "with")

_DIGEST_SQL = "regexp_replace(lower(regexp_replace({0}, '[\\s:_-]', '', 'g')), '^(sha256|0x)', '')"


def _p4_sql() -> str:
    d = {p: _DIGEST_SQL.format(f"plane_sha256.{p}") for p in PLANES}
    side = "select distinct run_id, rep, " + ", ".join(f"{e} as {p}" for p, e in d.items()) + " from {0}"
    joined = f"with l as ({side.format('raw_runs')}), r as ({side.format('raw_runs_mirror')}), pl as (select distinct parity_id, mismatch_count from parity_summary), pr as (select distinct parity_id, mismatch_count from parity_mirror), j as (select coalesce(l.run_id, r.run_id) record_id, coalesce(l.rep, r.rep) rep, l.run_id lid, r.run_id rid, " + ", ".join(f"l.{p} l_{p}, r.{p} r_{p}" for p in PLANES) + " from l full join r on l.run_id = r.run_id and l.rep = r.rep), pj as (select coalesce(pl.parity_id, pr.parity_id) record_id, 0 rep, pl.parity_id lid, pr.parity_id rid, pl.mismatch_count lm, pr.mismatch_count rm from pl full join pr on pl.parity_id = pr.parity_id) "
    parts = []
    for dataset, rel in (("raw_runs", "j"), ("parity_summary", "pj")):
        parts.append(f"select '{dataset}' as dataset, record_id, cast(rep as int) as rep, '' as field, 'missing_left' as diff from {rel} where lid is null")
        parts.append(f"select '{dataset}', record_id, cast(rep as int), '', 'missing_right' from {rel} where rid is null")
    parts += [f"select 'raw_runs', record_id, cast(rep as int), '{p}', 'differs' from j where lid is not null and rid is not null and l_{p} is distinct from r_{p}" for p in PLANES]
    parts.append("select 'parity_summary', record_id, cast(rep as int), 'mismatch_count', 'differs' from pj where lid is not null and rid is not null and lm is distinct from rm")
    return joined + " union all ".join(parts)


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_table": p3_table, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}
SQL = {"p4_found": _p4_sql(), "p5_found": _P5_SQL, "p6_found": _P6_SQL}
