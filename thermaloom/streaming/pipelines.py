"""The collaborative plane as Structured Streaming: deduplication, epochs, keyed state.

Each pipeline reads the operation log as a stream of files, runs until the files
present are consumed (``availableNow``), and writes Parquet with a checkpoint in
the shared folder, so a restart goes on where it stopped and no batch counts
twice. The functions that define a pipeline take and give DataFrames and can be
attached to any source and sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from thermaloom.session import scratch_path

#: Files of the log come in any order, so lateness covers a log of a quarter of a year; what is older than that is let go of state.
LATE = "90 days"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log(spark: SparkSession, sf_dir: str, name: str = "operation_log", files_per_batch: int = 4) -> DataFrame:
    """A table's files as a stream; the path may be a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parquet*")
    stamps = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # watermarks need an instant
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else stream


def run_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read the result."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, purpose), scratch_path(spark, f"{purpose}-checkpoint")
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    # update mode: each batch's rows with its number; the reader keeps the last of a key

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch writes the same folder again

    stream.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def deduplicated(log: DataFrame, late: str = LATE) -> DataFrame:
    """One row of each operation: the first to arrive within the watermark on the time of acceptance."""
    return log.where("server_sequence is not null and accepted_at is not null").withWatermark("accepted_at", late).dropDuplicatesWithinWatermark(["workspace_id", "server_sequence"])


def windowed_counts(log: DataFrame, window: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Operations of each family in tumbling windows of acceptance, for update mode: a window touched in a batch comes
    with its count so far, and rows within the watermark still count, however late."""
    return log.where("accepted_at is not null").withWatermark("accepted_at", late).groupBy(F.window("accepted_at", window), "workspace_id", "source_family").agg(F.count("*").alias("n"), F.max("server_sequence").alias("last_seq")).select("workspace_id", "source_family", F.col("window.start").alias("opened"), "n", "last_seq")


def last_counts(updates: DataFrame) -> DataFrame:
    """The last count of each window; counts and sequence numbers of a window only grow."""
    return updates.groupBy("workspace_id", "source_family", "opened").agg(F.max("n").alias("n"), F.max("last_seq").alias("last_seq"))


class TreeState(StatefulProcessor):
    """Keyed state of one tree, the same whatever the order of arrival.

    An ``add`` sets a tree anew, so what matters of all before the latest one is how many there were. A tree lives if no
    ``delete`` comes after its latest add, and then every update after it took effect. Hence three
    largest sequence numbers and the set of adds (each counts once) are the whole state; an
    operation costs one look-up, however long the history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.adds = handle.getMapState("adds", "s bigint", "seen boolean")
        self.top = handle.getValueState("top", "generation int, added bigint, deleted bigint, updated bigint, applied bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, added, deleted, updated, applied = self.top.get() if self.top.exists() else (-1, -1, -1, -1, 0)
        for pdf in rows:
            applied += len(pdf)
            for s in pdf.loc[pdf["verb"] == "add", "s"].drop_duplicates().astype(int):
                if not self.adds.containsKey((s,)):
                    self.adds.updateValue((s,), (True,))
                    generation, added = generation + 1, max(added, s)
            carrying = pdf["verb"].isin(["replace", "move"]) & pdf["carries"].fillna(False).astype(bool)
            deleted = max(deleted, *pdf.loc[pdf["verb"] == "delete", "s"].astype(int), -1)
            updated = max(updated, *pdf.loc[carrying, "s"].astype(int), -1)
        self.top.update((generation, added, deleted, updated, applied))
        live = added > deleted
        yield pd.DataFrame({"workspace_id": [key[0]], "entity_id": [key[1]], "generation": [generation], "live": [live], "last_sequence": [max(added, updated) if live else -1], "applied": [applied]})

    def close(self) -> None:
        pass


def tree_states(feed: DataFrame) -> DataFrame:
    """Stateful reduction of a feed ``workspace_id, entity_id, s, verb, carries, x, y, h, r``: a row for each tree touched in a batch."""
    return feed.groupBy("workspace_id", "entity_id").transformWithStateInPandas(
        statefulProcessor=TreeState(), outputStructType="workspace_id string, entity_id string, generation int, live boolean, last_sequence bigint, applied bigint", outputMode="Update", timeMode="None"
    )


def with_rocksdb(spark: SparkSession, f: Callable[[], DataFrame]) -> DataFrame:
    """Run with the RocksDB state store and put the session's setting back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        return f()
    finally:
        spark.conf.set(name, before)
