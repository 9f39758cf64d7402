"""Queries of the operators for training data, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.llm import abuse, packing, quantiles, tokenize

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _percentiles(sketches: DataFrame, names: dict[str, str]) -> DataFrame:
    found = quantiles.percentiles(sketches, list(names), PERCENTILES)
    return found.select(
        *(F.col(f"k{i}").alias(name) for i, name in enumerate(names.values())), "n",
        *(F.col(f"q{i}").alias(f"p{round(100 * p):02d}") for i, p in enumerate(PERCENTILES)),
        "rank_error", (F.col("rank_error") / F.col("n")).alias("relative_rank_error"),
    )


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of total_s for each mode and case, from sketches of the parts of the table, with their bound on the error of the rank."""
    runs = _read(spark, sf_dir, "raw_runs")
    return _percentiles(quantiles.sketch(runs, F.col("timings_s.total_s"), [F.col("mode"), F.col("case_id")]), {"k0": "mode", "k1": "case_id"})


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each day and mode; the sketches of days are rows that merge into those of any longer time."""
    runs = _read(spark, sf_dir, "raw_runs")
    daily = quantiles.sketch(runs, F.col("timings_s.total_s"), [F.col("mode"), F.to_date("recorded_at")])
    return _percentiles(daily, {"k1": "day", "k0": "mode"}).withColumn("day", F.to_date("day"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.token_ids(_read(spark, sf_dir, "documents"), spark)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every document that has tokens, in containers of 2,048 tokens."""
    counts = tokenize.token_counts(_read(spark, sf_dir, "documents"), spark, ["doc_id", "source"])
    return packing.pack(counts.withColumnRenamed("n_tokens", "size"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers keep the proportions of the sources."""
    return packing.mixture(p8_packed(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = abuse.fit(_read(spark, sf_dir, "review_labels"), docs)
    return abuse.score(docs, model, spark, ["doc_id", "source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scored(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return _scored(spark, sf_dir).select("doc_id", "source", *(F.round(c, 6).alias(c) for c in ("abusive", "hateful", "sexual", "score")))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and their rate for each source."""
    flagged = (F.col("score") >= abuse.THRESHOLD).cast("bigint")
    kinds = [F.avg((F.col(c) >= abuse.THRESHOLD).cast("int")).alias(f"{c}_rate") for c in ("abusive", "hateful", "sexual")]
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(flagged).alias("n_flagged"), F.avg(flagged).alias("rate"), *kinds)


QUERIES = {"p2_percentiles": p2_percentiles, "p2_daily": p2_daily, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_mixture": p8_mixture, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}


def _p2_sql(keys: str) -> str:
    """Exact percentiles: what the sketches give where no group has ``quantiles.K`` values or more."""
    at = ", ".join(f"xs[greatest(1, ceil({p}e0 * n))::bigint] as p{round(100 * p):02d}" for p in PERCENTILES)
    return f"""select {keys.replace("recorded_at::date", "day")}, n, {at}, 0::bigint as rank_error, 0.0e0 as relative_rank_error from (
      select {keys.replace("recorded_at::date", "recorded_at::date as day")}, count(*) n, list_sort(list(timings_s.total_s)) xs from raw_runs where timings_s.total_s is not null and not isnan(timings_s.total_s) group by {keys})"""


SQL: dict[str, str] = {"p2_percentiles": _p2_sql("mode, case_id"), "p2_daily": _p2_sql("recorded_at::date, mode")}
