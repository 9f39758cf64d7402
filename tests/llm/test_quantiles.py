import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermaloom.llm import quantiles as q

PS = (0.01, 0.25, 0.5, 0.9, 0.99)


def rank_miss(values, got, p):
    """Distance from the wanted rank to the ranks at which the answer stands."""
    v = np.sort(values)
    lo, hi = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    want = max(1, math.ceil(p * len(v)))
    assert lo <= hi, "the answer is one of the values"
    return max(lo - want, want - hi, 0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 9), st.sampled_from([8, 64]), st.integers(1, 5))
def test_bound_holds_and_merges(n, seed, k, parts):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(size=n), 2)
    whole = q.Sketch(k)
    for part in np.array_split(values, parts):
        s = q.Sketch(k)
        s.add(part)
        for level, buffer, error in s.buffers():
            whole.add_buffer(level, buffer, error)
    assert whole.n == n
    for p, got in zip(PS, whole.quantiles(PS)):
        assert rank_miss(values, got, p) <= whole.error
    if n < k:
        assert whole.error == 0


def test_table_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", None, float(x), i % 5) for i, x in enumerate(rng.exponential(size=6000).round(2))]
    rows += [("few", "E1", 3.0, 0), ("few", "E1", 3.0, 1), ("few", "E1", float("nan"), 1), ("few", "E1", None, 1), ("none", "E2", None, 0)]
    df = spark.createDataFrame(rows, "mode string, case_id string, v double, day int").repartition(6)
    parts = q.sketch(df, F.col("v"), [F.col("mode"), F.col("case_id"), F.col("day")], k=64)
    direct = {r.k0: r for r in q.percentiles(parts, ["k0", "k1"], PS, k=64).collect()}
    by_day = {r.k0: r for r in q.percentiles(q.merge(parts, ["k0", "k1", "k2"], k=64), ["k0", "k1"], PS, k=64).collect()}
    assert set(direct) == {"hot", "few"} and direct["few"].n == 2 and direct["few"].q2 == 3.0 and direct["few"].rank_error == 0
    hot = np.array([r[2] for r in rows if r[0] == "hot"])
    for found in (direct, by_day):
        assert found["hot"].n == 6000 and found["hot"].k1 is None
        for i, p in enumerate(PS):
            assert rank_miss(hot, found["hot"][f"q{i}"], p) <= found["hot"].rank_error < 600
    assert q.percentiles(q.sketch(df.limit(0), F.col("v"), [F.col("mode")]), ["k0"], PS).count() == 0


@pytest.mark.parametrize("held", [1, 100])
def test_bounded_memory_gives_the_same_counts(spark, held):
    df = spark.range(500).selectExpr("cast(id % 50 as string) g", "cast(id as double) v")
    got = q.percentiles(q.sketch(df, F.col("v"), [F.col("g")], held=held), ["k0"], (0.5,)).collect()
    assert len(got) == 50 and all(r.n == 10 and r.q0 == float(r.k0) + 200 for r in got)


def test_what_is_shuffled_does_not_grow_with_the_rows(spark):
    """A hot group leaves each task as some buffers, whatever its size, and is merged in parts."""
    sizes = []
    for n in (20_000, 200_000):
        df = spark.range(0, n, 1, 4).selectExpr("'hot' g", "cast(hash(id) as double) v")
        parts = q.sketch(df, F.col("v"), [F.col("g")], k=64)
        rows = parts.select("part", F.size("buffer").alias("s")).collect()
        assert {r.part for r in rows} == {0, 1, 2, 3}
        sizes.append(sum(r.s for r in rows))
        found = q.percentiles(parts, ["k0"], PS, k=64).first()
        values = np.array([r.v for r in df.select("v").collect()])
        assert found.n == n
        for i, p in enumerate(PS):
            assert rank_miss(values, found[f"q{i}"], p) <= found.rank_error < 0.1 * n
    assert sizes[1] < 2 * sizes[0] < 4 * 64 * 16 * 2


def test_days_recombine_within_the_bound(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 30, float(x)) for i, x in enumerate(rng.gamma(2.0, size=30_000))]
    daily = q.merge(q.sketch(spark.createDataFrame(rows, "day int, v double").repartition(5), F.col("v"), [F.col("day")], k=128), ["k0"], k=128)
    kept = spark.createDataFrame(daily.toPandas(), daily.schema)  # stored, and read another day
    weeks = q.percentiles(kept.withColumn("k0", F.floor(F.col("k0").cast("int") / 7).cast("string")), ["k0"], PS, k=128).collect()
    assert sum(r.n for r in weeks) == 30_000
    for r in weeks:
        values = np.array([v for d, v in rows if d // 7 == int(r.k0)])
        assert all(rank_miss(values, r[f"q{i}"], p) <= r.rank_error < 0.1 * r.n for i, p in enumerate(PS))
