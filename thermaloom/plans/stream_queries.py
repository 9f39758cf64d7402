"""Streaming pipelines run over the operation log, with the batch results that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.plans.datasets import SQL as DATASET_SQL
from thermaloom.plans.datasets import replay_feed
from thermaloom.streaming import pipelines


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each operation, deduplicated as a stream."""
    log = pipelines.read_log(spark, sf_dir)
    return pipelines.run_to_table(pipelines.deduplicated(log).select("workspace_id", "server_sequence", "verb"), "dedup")


def epoch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of all operations with a time of acceptance: the last count of each window, late rows included."""
    return pipelines.last_counts(pipelines.run_to_table(pipelines.windowed_counts(pipelines.read_log(spark, sf_dir)), "epochs", "update"))


def stateful_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live trees by keyed state over the stream: the state after the last batch that touched a tree."""

    def run() -> DataFrame:
        feed = replay_feed(pipelines.read_log(spark, sf_dir)).where("entity_id is not null and entity_id <> ''")
        feed = feed.select("workspace_id", "entity_id", F.col("server_sequence").alias("s"), "verb", "carries", F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.col("height_m").alias("h"), F.col("canopy_radius_m").alias("r"))
        return pipelines.run_to_table(pipelines.tree_states(feed), "trees", "update")

    rows = pipelines.with_rocksdb(spark, run)
    last = rows.groupBy("workspace_id", "entity_id").agg(F.max_by(F.struct("generation", "live", "last_sequence"), "applied").alias("x"))
    return last.where("x.live").select("workspace_id", "entity_id", "x.generation", "x.last_sequence")


QUERIES = {"dedup_stream": dedup_stream, "epoch_stream": epoch_stream, "stateful_reduce": stateful_reduce}
SQL = {
    "epoch_stream": "select workspace_id, source_family, cast(time_bucket(interval 10 minute, accepted_at) as timestamp) as opened, count(*) as n, max(server_sequence) as last_seq from operation_log where accepted_at is not null group by 1, 2, 3",
    "dedup_stream": "select distinct workspace_id, server_sequence, verb from operation_log where server_sequence is not null and accepted_at is not null",
    "stateful_reduce": "select workspace_id, entity_id, generation, last_sequence from (" + DATASET_SQL["p6_found"] + ") q",
}
