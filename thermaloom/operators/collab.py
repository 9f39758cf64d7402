"""Folding an operation log into canonical state, without row-at-a-time code where order is a maximum.

Last write wins by server sequence: paints by cell, ranges by time step, views by
scope. Object families need an ordered replay, see ``replay.py``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaloom.operators.incremental import cell_latest, islands

CHUNK = 64


def paints(ops: DataFrame) -> DataFrame:
    """Land-cover paints with their half-open window and class; malformed payloads are left out."""
    body = F.from_json("payload", "class int, window struct<row_start: int, row_stop: int, col_start: int, col_stop: int>")
    w = F.col("b.window")
    return (
        ops.where("source_family = 'landcover_surface' and verb = 'paint'").withColumn("b", body)
        .select("workspace_id", "server_sequence", "epoch_id", "actor_id", F.col("b.class").alias("class"), w["row_start"].alias("r0"), w["row_stop"].alias("r1"), w["col_start"].alias("c0"), w["col_stop"].alias("c1"))
        .where("class is not null and r1 > r0 and c1 > c0")
    )


def painted_cells(ops: DataFrame) -> DataFrame:
    """Class of each painted cell: the latest paint that covers it."""
    return cell_latest(paints(ops), ["workspace_id"], "server_sequence", "class")


def chunk_conflicts(ops: DataFrame, span: int) -> DataFrame:
    """Chunks of 64 cells that two actors or more painted within ``span`` epochs; the last sequence wins."""
    low = lambda a: F.floor(F.col(a) / CHUNK)
    high = lambda a: F.floor((F.col(a) - 1) / CHUNK)
    chunks = paints(ops).withColumn("kr", F.explode(F.sequence(low("r0"), high("r1")))).withColumn("kc", F.explode(F.sequence(low("c0"), high("c1"))))
    g = chunks.groupBy("workspace_id", F.floor(F.col("epoch_id") / span).alias("span"), "kr", "kc")
    return g.agg(F.countDistinct("actor_id").alias("actors"), F.count("*").alias("paints"), F.max("server_sequence").alias("winner")).where("actors >= 2")


def range_writes(ops: DataFrame) -> DataFrame:
    """Writes of fields over closed ranges of time steps: one row for each field of the payload's values."""
    body = F.from_json("payload", "time_start int, time_stop int, values map<string, double>")
    return (
        ops.where("source_family in ('meteorological_forcing', 'model_receptor_parameters') and verb = 'set'").withColumn("b", body)
        .select("workspace_id", "source_family", "server_sequence", "actor_id", F.col("b.time_start").alias("t0"), F.col("b.time_stop").alias("t1"), F.explode("b.values").alias("field", "value"))
        .where("t0 is not null and t1 >= t0")
    )


def segments(ops: DataFrame) -> DataFrame:
    """Canonical segments of each field: the latest value of each step, equal neighbours merged."""
    keys = ["workspace_id", "source_family", "field"]
    steps = range_writes(ops).withColumn("t", F.explode(F.sequence("t0", "t1"))).groupBy(*keys, "t").agg(F.max_by("value", "server_sequence").alias("value"))
    return islands(steps, keys, "t", ["value"])


def views(ops: DataFrame) -> DataFrame:
    """The variable in view: the latest of the workspace, and the latest of each actor for views of their own."""
    body = F.from_json("payload", "scope string, values map<string, string>")
    v = ops.where("source_family = 'output_view'").withColumn("b", body)
    own = F.when(F.col("b.scope") == "user", F.col("actor_id")).otherwise(F.lit(""))
    return v.groupBy("workspace_id", own.alias("owner")).agg(F.max_by(F.col("b.values")["variable"], "server_sequence").alias("variable"), F.max("server_sequence").alias("server_sequence"), F.count("*").alias("selections"))


def field_conflicts(ops: DataFrame, span: int) -> DataFrame:
    """Tree fields that two actors or more wrote within ``span`` epochs: winner by sequence and the losers in order."""
    names = ("x_m", "y_m", "height_m", "canopy_radius_m")
    known = ", ".join(f"{f}: double" for f in names)
    body = F.from_json("payload", f"values struct<{known}>, " + known.replace(": double", " double"))
    w = ops.where("source_family = 'vegetation_geometry' and verb in ('add', 'replace', 'move') and entity_id is not null").withColumn("b", body)
    present = F.array(*(F.when((F.when(F.col("b.values").isNotNull(), F.col("b.values")[f]).otherwise(F.col(f"b.{f}"))).isNotNull() & (F.lit(f in ("x_m", "y_m")) | (F.col("verb") != "move")), F.lit(f)) for f in names))
    e = w.withColumn("field", F.explode(F.array_compact(present)))
    g = e.groupBy("workspace_id", "entity_id", "field", F.floor(F.col("epoch_id") / span).alias("span")).agg(F.countDistinct("actor_id").alias("actors"), F.max("server_sequence").alias("winner"), F.array_sort(F.collect_list("server_sequence")).alias("all"))
    return g.where("actors >= 2").select("workspace_id", "entity_id", "field", "span", "actors", "winner", (F.size("all") - 1).alias("losers"))


def micro_epochs(ops: DataFrame, window_ms: int = 100) -> DataFrame:
    """Activity-opened epochs: an operation opens one if none is open, and joins it while its age is below the window.

    One pass in order of arrival for each workspace; ``epoch`` counts from 0.
    """
    schema = pa.schema([("workspace_id", pa.string()), ("server_sequence", pa.int64()), ("epoch", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, epoch = None, None, -1
        for batch in batches:
            out = []
            for ws, micros, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if ws != now:
                    now, opened, epoch = ws, None, -1
                if opened is None or micros - opened >= window_ms * 1000:
                    opened, epoch = micros, epoch + 1
                out.append((ws, seq, epoch))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    rows = ops.where("received_at is not null").select("workspace_id", F.unix_micros(F.col("received_at").cast("timestamp")).alias("micros"), "server_sequence")
    return rows.repartition("workspace_id").sortWithinPartitions("workspace_id", "micros", "server_sequence").mapInArrow(run, "workspace_id string, server_sequence bigint, epoch bigint")


def sessions(rows: DataFrame, keys: list[str], at: str, gap_s: int) -> DataFrame:
    """Runs of activity with pauses of ``gap_s`` seconds at most: start, end, count."""
    s = F.session_window(at, f"{gap_s} seconds")
    return rows.groupBy(*keys, s).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("session_window")


def sliding_load(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Operations of the key within the seconds before each row, itself included.

    A row is dealt to its own stretch of so many seconds and to the next, so no window holds more of a key than two stretches.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(us / (seconds * 1_000_000))
    dealt = rows.withColumn("_us", us).withColumn("_own", own).withColumn("_b", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn("load", F.count("*").over(w)).where("_own = _b").drop("_us", "_own", "_b")


def latest(rows: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("x")).select(*keys, "x.*")
