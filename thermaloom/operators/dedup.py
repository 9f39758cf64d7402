"""Messages delivered more than once: keep exactly one copy of each.

The store holds whole messages in partitions, one for each batch that came in, and
beside them an identifier index: for each identifier the lowest delivery id and
the partition that holds it. An incoming batch is matched with the index alone;
that names the single winner of every identity in the batch and the historical
partitions whose copy now loses. Only those partitions are read, combined with what
won, and written anew; what lost goes to a list of dropped deliveries. A manifest
names the files that are valid; publishing its next version is the one atomic
step, so a reader sees the state before or after a batch, and a batch that dies
half-way leaves no trace.

Identity of a message
* Its UUID, however written.
* Without a UUID, the UUID of the messages with the same counter key (workspace,
  actor, client sequence), or the counter key itself if none has one.
* Different UUIDs are different messages, whatever their counters say.
* With neither a UUID nor a whole counter key a message is a copy of nothing.

Defined results: the lowest delivery id of each identity stays; an empty batch
changes nothing; text that is no UUID counts as none.

Whole messages are never shuffled. Identifiers are, after (UUID, counter key) minima that
combine before the shuffle, so a message repeated very often costs one row for each
map task. Losers are found by anti-joins on the delivery id, which is unique.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTER = ("workspace_id", "actor_id", "client_sequence")


def canonical_uuid(column: Column) -> Column:
    """32 lower-case hex digits of a UUID, whatever its braces, case, hyphens or prefix; null if it is none."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(column, r"[\s{}-]", ""), "(?i)^urn:uuid:", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def identified(messages: DataFrame) -> DataFrame:
    """``delivery_id``, the UUID ``u`` and the counter key ``c`` (null if incomplete)."""
    u = canonical_uuid(F.col("operation_id"))
    whole = F.col("workspace_id").isNotNull() & F.col("actor_id").isNotNull() & F.col("client_sequence").isNotNull()
    key = F.sha2(F.to_json(F.struct(*COUNTER)), 256)
    return messages.select(F.col("delivery_id").cast("bigint").alias("delivery_id"), F.unhex(u).alias("u"), F.when(whole, F.substring(F.unhex(key), 1, 16)).alias("c"))


def associations(ids: DataFrame) -> DataFrame:
    """The lowest delivery id ``d`` of each pair of UUID and counter key; messages without identity are left out."""
    return ids.where(F.col("u").isNotNull() | F.col("c").isNotNull()).groupBy("u", "c").agg(F.min("delivery_id").alias("d"))


#: Delivery ids to take out of a partition are broadcast up to this number, and joined as any table beyond.
FEW = 4_000_000


class MessageStore:
    """Deduplicated messages in partitions, an identifier index, a list of dropped deliveries, and a manifest.

    Files lie under ``root``, in the folder shared by all executors; each version adds its own
    folders ``messages-<v>/p=<p>``, ``index-<v>`` and ``dropped-<v>`` and touches no other.
    """

    _INDEX = "u binary, c binary, d bigint, p int"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- manifest ---------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The state last published."""
        fs = self._fs()
        names = [str(s.getPath().getName()) for s in fs.listStatus(self._path("manifest"))] if fs.exists(self._path("manifest")) else []
        versions = sorted(int(n) for n in names if n.isdigit())
        if not versions:
            return {"version": 0, "parts": {}, "index": [], "dropped": []}
        stream = fs.open(self._path("manifest", str(versions[-1])))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Rename a finished file to the name of the next version, which must not exist: of two writers one fails."""
        jvm, fs = self.spark._jvm, self._fs()
        fs.mkdirs(self._path("manifest"))
        tmp, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", str(manifest["version"]))
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, options)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {manifest['version']} was published by another writer") from e

    # -- reading ----------------------------------------------------------
    def _read(self, folders: list[str], schema: str | T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def messages(self) -> DataFrame:
        """The one copy of each message."""
        m = self.manifest()
        return self._read([f"{folder}/p={p}" for p, folder in m["parts"].items()], T.StructType.fromJson(m["schema"]))

    def dropped(self) -> DataFrame:
        """``delivery_id`` of all that came in and is not kept, each once."""
        return self._read(self.manifest()["dropped"], "delivery_id bigint")

    # -- writing ----------------------------------------------------------
    def ingest(self, messages: DataFrame, partition: int) -> list[int]:
        """Take in a batch, whose winners go to ``partition``, a number not used before. Returns the partitions written anew."""
        from thermaloom.session import materialize

        m = self.manifest()
        if str(partition) in m["parts"]:
            raise ValueError(f"partition {partition} exists")
        ids = identified(messages)
        incoming = materialize(associations(ids).select("u", "c", "d"), "incoming")
        index = self._read(m["index"], self._INDEX)
        lost = self._read(m["dropped"], "delivery_id bigint")

        # the UUID behind a counter key, wanted for messages without one
        every = index.select("u", "c", "d", "p", F.lit(False).alias("fresh")).unionByName(incoming.select("u", "c", "d", F.lit(None).cast("int").alias("p"), F.lit(True).alias("fresh")))
        nameless = every.where("u is null")
        behind = every.where("u is not null and c is not null").select("u", "c").join(nameless.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.max("u").alias("v"))
        rest = ["d", "p", "fresh"]
        found = materialize(nameless.join(behind, "c", "left").select(F.coalesce("v", "c").alias("identity"), *rest), "nameless")
        known = every.where("u is not null").select(F.col("u").alias("identity"), *rest).unionByName(found)
        held = F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "d")))  # one, but where a counter key joins two that were apart
        best = materialize(
            known.groupBy("identity").agg(F.min(F.struct("d", "fresh")).alias("best"), F.max("fresh").alias("met"), held.alias("held")).where("met").select("best", "held"), "winners",
        )
        winners = best.where("best.fresh").select(F.col("best.d").alias("delivery_id"))
        losers = best.select("best.d", F.explode("held").alias("h")).where("h.d > d").select(F.col("h.p").alias("p"), F.col("h.d").alias("delivery_id"))
        losers = losers.join(lost, "delivery_id", "left_anti").select("p", "delivery_id").distinct()

        v = f"{m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        repeats = ids.where(F.col("u").isNotNull() | F.col("c").isNotNull()).select("delivery_id").join(winners, "delivery_id", "left_anti")
        placed = F.when(F.col("w").isNotNull(), F.lit(partition)).alias("p")
        incoming.join(winners.select(F.col("delivery_id").alias("d"), F.lit(1).alias("w")), "d", "left").select("u", "c", "d", placed).write.parquet(f"{self.root}/index-{v}")
        repeats.select(F.lit(partition).alias("p"), "delivery_id").unionByName(losers).write.partitionBy("p").parquet(f"{self.root}/dropped-{v}")
        gone = self.spark.read.schema("delivery_id bigint, p int").option("basePath", f"{self.root}/dropped-{v}").parquet(f"{self.root}/dropped-{v}")
        counts = {r.p: r.n for r in gone.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row a partition
        touched = sorted(p for p in counts if p != partition)

        def without(rows: DataFrame, p: int) -> DataFrame:
            n, out = counts.get(p, 0), gone.where(F.col("p") == p).select("delivery_id")
            return rows.join(F.broadcast(out) if n <= FEW else out, "delivery_id", "left_anti").select(*rows.columns) if n else rows

        parts = dict(m["parts"])
        for p in touched:
            rows = self._read([f"{parts[str(p)]}/p={p}"], T.StructType.fromJson(m["schema"]))
            without(rows, p).write.parquet(f"{self.root}/messages-{v}/p={p}")
            parts[str(p)] = f"{self.root}/messages-{v}"
        without(messages, partition).write.parquet(f"{self.root}/messages-{v}/p={partition}")
        parts[str(partition)] = f"{self.root}/messages-{v}"
        schema = m.get("schema") or json.loads(messages.schema.json())
        self._publish({"version": m["version"] + 1, "parts": parts, "index": [*m["index"], f"{self.root}/index-{v}"], "dropped": [*m["dropped"], *(f"{self.root}/dropped-{v}/p={p}" for p in counts)], "schema": schema})
        return touched


def ingest_in_batches(messages: DataFrame, store: MessageStore, batch: str, rounds: int) -> MessageStore:
    """Feed a log to the store in ``rounds`` spans of its batch numbers, oldest first.

    The log is read once and laid out by span. Rows whose batch number is null come with the first span.
    """
    lo, hi = messages.agg(F.min(batch), F.max(batch)).first()
    if lo is None:
        store.ingest(messages, 0)
        return store
    span = (hi - lo) // rounds + 1
    number = F.coalesce(F.floor((F.col(batch) - F.lit(lo)) / F.lit(span)), F.lit(0)).cast("int")
    spans = f"{store.root}/spans"
    messages.withColumn("_span", number).write.partitionBy("_span").parquet(spans)
    laid = store.spark.read.schema(T.StructType([*messages.schema.fields, T.StructField("_span", T.IntegerType())])).parquet(spans)
    for i in range(rounds):
        store.ingest(laid.where(F.col("_span") == i).drop("_span"), i)
    return store
