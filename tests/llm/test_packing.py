from collections import Counter, defaultdict

import numpy as np

from thermaloom.llm.packing import Queues, mixture, pack, pack_queues


def containers(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.container].append(r)
    return out


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, size int")


def test_every_item_once_and_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], int(s)) for i, s in enumerate(rng.integers(1, 150, size=400))]
    rows += [(1000, "a", 250), (1001, "b", 100), (1002, "b", 0), (1003, "b", None), (1004, "b", -4), (7, "a", 33)]
    out = containers(pack(make(spark, rows), capacity=100, task=40))
    got = Counter()
    for c in out.values():
        assert sum(r.size for r in c) <= 100 and sorted(r.place for r in c) == list(range(len(c)))
        for r in c:
            got[r.doc_id, r.source] += r.size
    want = Counter()
    for d, s, n in rows:
        if n and n > 0:
            want[d, s] += n
    assert got == want
    pieces = sorted((r.start, r.size) for c in out.values() for r in c if r.doc_id == 1000)
    assert pieces == [(0, 100), (100, 100), (200, 50)]
    unsplit = Counter(r.doc_id for c in out.values() for r in c)
    assert all(unsplit[d] == 1 for d, _, n in rows if n and 0 < n <= 100 and d != 7)
    assert len(out) <= -(-sum(want.values()) // 100) * 1.06 + 1


def test_same_again_and_empty(spark):
    df = make(spark, [(i, "s", i % 90 + 1) for i in range(200)])
    a = sorted(map(tuple, pack(df, capacity=100, task=30).collect()))
    assert a == sorted(map(tuple, pack(df.repartition(7), capacity=100, task=30).collect()))
    assert pack(df.limit(0), capacity=100, task=30).count() == 0


def test_windows_keep_the_mixture():
    q = Queues(1000)
    for i in range(3000):
        q.put("big", 10, (i, 0, 0))
        if i % 3 == 0:
            q.put("small", 10, (i, 0, 0))
    shares, deficits = {"big": 0.75, "small": 0.25}, {}
    mix = [Counter({s: 0 for s in shares}) + Counter(s for s, _, _ in got) for got in pack_queues(q, shares, deficits)]
    assert len(mix) == 40
    assert all(abs(m["small"] - 25) <= 1 for m in mix)
    assert all(abs(d) <= 1000 for d in deficits.values())


def test_deficit_is_carried_on():
    q = Queues(10)
    for i in range(4):
        q.put("a", 10, (i, 0, 0))
        q.put("b", 10, (i, 0, 0))
    order = [got[0][0] for got in pack_queues(q, {"a": 0.5, "b": 0.5}, {"b": 7.0})]
    assert order[0] == "b" and Counter(order) == {"a": 4, "b": 4} and order[:4].count("a") == 2


def test_sizes_that_do_not_fit_together_end_in_many_tasks(spark):
    """No two of these fit one container: nothing is ever full, and yet no task sees more than its share."""
    rows = [(i, f"s{i % 3}", 1100 + i % 800) for i in range(400)]
    got = pack(make(spark, rows), task=20).collect()
    out = Counter(r.container for r in got)
    assert len(out) == 400 and set(out.values()) == {1}
    tasks = Counter((r.container >> 32) & 0xFFFFFF for r in got)
    assert len(tasks) > 5 and max(tasks.values()) < 80


def test_settings_of_the_cluster_do_not_matter(spark):
    df = make(spark, [(i, "ab"[i % 2], i % 90 + 1) for i in range(300)])
    a = sorted(map(tuple, pack(df, capacity=100, task=30).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert a == sorted(map(tuple, pack(df, capacity=100, task=30).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_target_mixture(spark):
    """Half and half is kept for as long as the rarer source lasts, and every item is placed all the same."""
    df = make(spark, [(i, "big" if i % 4 else "small", 10) for i in range(4000)])
    target = {"big": 0.5, "small": 0.5}
    packed = pack(df, capacity=1000, target=target)
    assert packed.count() == 4000
    mix = [Counter(r.source for r in c) for c in containers(packed).values()]
    even = [m for m in mix if abs(m["small"] - 50) <= 1]
    assert len(even) >= 19 and sum(m["small"] == 0 for m in mix) >= 19
    own = {r.source: r for r in mixture(pack(df, capacity=1000)).collect()}
    assert own["small"].target == own["small"].share == 0.25 and own["small"].off < 0.02 and own["big"].off < 0.02
    asked = {r.source: r for r in mixture(packed, target).collect()}
    assert asked["small"].target == 0.5 and 0.2 < asked["small"].off < 0.3
