"""The registered queries against their SQL on the smallest tables, incremental rules, streaming, and the driver's contract."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from thermaloom.operators import collab, incremental
from thermaloom.plans import registry
from thermaloom.streaming import pipelines

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SLOW = {"svf_total"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).columns


@needs_data
def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_graph():
    order = incremental.topological_order()
    assert len(order) == 22 and all(order.index(a) < order.index(b) for a, b in incremental.EDGES)
    with pytest.raises(ValueError):
        incremental.topological_order([*incremental.EDGES, ("utci", "dem")])


def test_merge_windows(spark):
    w = spark.createDataFrame([("k", 0, 4, 0, 4), ("k", 3, 8, 3, 8), ("k", 20, 24, 0, 4), ("k", 9, 12, 9, 12), ("j", 0, 1, 0, 1)], "k string, r0 int, r1 int, c0 int, c1 int")
    got = lambda gap: sorted(tuple(r) for r in incremental.merge_windows(w, ["k"], gap).collect())
    assert got(0) == [("j", 0, 1, 0, 1), ("k", 0, 8, 0, 8), ("k", 9, 12, 9, 12), ("k", 20, 24, 0, 4)]
    assert got(1) == [("j", 0, 1, 0, 1), ("k", 0, 12, 0, 12), ("k", 20, 24, 0, 4)]


def test_dirty_window_is_aligned_and_clamped(spark):
    df = spark.createDataFrame([(33.0, 65.0, -10.0, 5000.0)], "x0 double, x1 double, y0 double, y1 double")
    w = df.select(*(v.alias(k) for k, v in incremental.dirty_window(*(F.col(c) for c in ("x0", "x1", "y0", "y1")), 2.0, 500, 500).items())).first()
    assert tuple(w) == (0, 500, 16, 48)


def op(seq, family, verb, payload, actor="a", ws="w", entity=None, epoch=0, at=0.0):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1) + timedelta(seconds=at)
    return (ws, seq, epoch, f"id{seq}", actor, family, entity, verb, payload, t, t)


OPS = "workspace_id string, server_sequence bigint, epoch_id bigint, operation_id string, actor_id string, source_family string, entity_id string, verb string, payload string, received_at timestamp, accepted_at timestamp"


def test_paints_and_segments(spark):
    paint = '{"class": %d, "window": {"row_start": %d, "row_stop": %d, "col_start": 0, "col_stop": 2}}'
    rng = '{"time_start": %d, "time_stop": %d, "values": {"ta": %s}}'
    f = "meteorological_forcing"
    rows = [
        op(1, "landcover_surface", "paint", paint % (5, 0, 2)), op(2, "landcover_surface", "paint", paint % (6, 1, 3), "b"), op(3, "landcover_surface", "paint", "{}"), op(4, "landcover_surface", "paint", None),
        op(5, f, "set", rng % (0, 9, "1.0")), op(6, f, "set", rng % (3, 4, "2.0")), op(7, f, "set", rng % (10, 12, "1.0")), op(8, f, "set", rng % (5, 2, "9.0")), op(9, f, "set", None),
    ]
    log = spark.createDataFrame(rows, OPS)
    cells = {(r.r, r.c): r["class"] for r in collab.painted_cells(log).collect()}
    assert cells == {(0, 0): 5, (0, 1): 5, (1, 0): 6, (1, 1): 6, (2, 0): 6, (2, 1): 6}
    assert sorted((r.start, r.stop, r.value) for r in collab.segments(log).collect()) == [(0, 2, 1.0), (3, 4, 2.0), (5, 12, 1.0)]
    assert [tuple(r) for r in collab.chunk_conflicts(log, 10).select("actors", "paints", "winner").collect()] == [(2, 2, 2)]
    assert collab.segments(log.limit(0)).count() == 0


def test_micro_epochs_open_with_activity(spark):
    rows = [op(i + 1, "output_view", "select", None, at=t) for i, t in enumerate((0.0, 0.05, 0.099, 0.1, 0.19, 0.21, 5.0))] + [op(1, "output_view", "select", None, ws="v", at=3.0)]
    got = sorted((r.workspace_id, r.server_sequence, r.epoch) for r in collab.micro_epochs(spark.createDataFrame(rows, OPS)).collect())
    assert got == [("v", 1, 0), ("w", 1, 0), ("w", 2, 0), ("w", 3, 0), ("w", 4, 1), ("w", 5, 1), ("w", 6, 2), ("w", 7, 3)]


def test_stream_in_small_batches_equals_one(spark, tmp_path):
    """Keyed state over several micro-batches, with late operations, ends as one batch does."""
    rows = [("w", f"e{i % 3}", s, ["add", "move", "delete", "add", "replace"][s % 5], True, float(s), None, None, None) for i, s in enumerate([5, 3, 9, 1, 0, 8, 2, 2, 7, 4, 6, 10, 12, 11])]
    schema = "workspace_id string, entity_id string, s bigint, verb string, carries boolean, x double, y double, h double, r double"
    df = spark.createDataFrame(rows, schema)
    results = []
    for parts in (1, 5):
        path = str(tmp_path / f"p{parts}")
        for i in range(parts):
            df.where(F.abs(F.xxhash64("s", "entity_id")) % parts == i).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = pipelines.with_rocksdb(spark, lambda: pipelines.run_to_table(pipelines.tree_states(stream), "t", "update"))  # noqa: B023
        last = out.groupBy("entity_id").agg(F.max_by(F.struct("generation", "live", "last_sequence"), "applied").alias("x"))
        results.append(sorted((r.entity_id, *r.x) for r in last.collect()))
    assert results[0] == results[1] and len(results[0]) == 3


def batch_counts(log):
    g = log.where("accepted_at is not null").groupBy("workspace_id", "source_family", F.window(F.col("accepted_at").cast("timestamp"), "10 minutes").start.alias("opened"))
    return sorted(map(str, g.agg(F.count("*").alias("n"), F.max("server_sequence").alias("last_seq")).collect()))


@needs_data
@pytest.mark.parametrize("files", [1, 12])
def test_epoch_stream_counts_every_row(spark, tmp_path, files):
    """However the log is cut into files: late rows and the last windows are counted as in a batch."""
    log = spark.read.parquet(f"{DATA}/operation_log.parquet")
    path = tmp_path / "operation_log.parquet"
    for i in range(files):
        log.where(F.abs(F.xxhash64("operation_id", "server_sequence")) % files == i).coalesce(1).write.mode("append").parquet(str(path))
    got = registry.queries()["epoch_stream"](spark, str(tmp_path))
    assert sorted(map(str, got.select("workspace_id", "source_family", "opened", "n", "last_seq").collect())) == batch_counts(log)


@needs_data
def test_luminance_of_every_reading(spark):
    """Every reading with light and the sun up has all bands, low suns and other hours than noon too; at 12.5 hours they are the noon query's."""
    from thermaloom.functions import sky
    from thermaloom.functions.formula import apply
    from thermaloom.plans import log_queries
    from thermaloom.plans.bindings import met

    got = registry.queries()["perez_luminance_readings"](spark, DATA)
    up = apply(met(spark, DATA).where("radd > 0 and radi >= 0 and radd < 1000 and radi < 1500 and latitude is not null"), sky.LOCAL_SUN).where("altitude > 0")
    per = got.groupBy("reading_id").agg(F.count("*").alias("n"), F.sum("share").alias("s"))
    assert per.where("n <> 8 or abs(s - 1) > 1e-5").count() == 0
    assert per.count() == up.count() and up.where("it <> 12").count() > 0 and up.where("altitude < 3").count() > 0
    noon = log_queries._noon(spark, DATA).withColumn("hour", F.lit(12.5)).withColumn("reading_id", F.struct("station", "day"))
    want = registry.queries()["perez_luminance"](spark, DATA).select(F.struct("station", "day").alias("reading_id"), "band", "share")
    same = want.join(log_queries.band_shares(noon).withColumnRenamed("share", "again"), ["reading_id", "band"])
    assert same.count() == want.count() > 0 and same.where("abs(share - again) > 2e-6").count() == 0


@needs_data
def test_closure_of_all_painted_cells(spark):
    from thermaloom.plans import catalog_queries
    from thermaloom.plans.bindings import cells, ops

    there = {(x.r, x.c) for x in cells(spark, DATA).select("r", "c").collect()}
    painted = {(x.r, x.c) for x in collab.painted_cells(ops(spark, DATA)).select("r", "c").collect()}
    want = {(r - dr, c - dc) for r, c in there & painted for dr, dc in [(0, 0), *((a, b) for _, a, b, _ in catalog_queries._A)]} & there
    got = [(x.r, x.c) for x in registry.queries()["corridor_closure"](spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
