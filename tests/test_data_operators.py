"""Small cases of the five data operators of the core, with nulls, ties, repeats, empty tables and clashing names."""

import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaloom.operators import drift, spikes
from thermaloom.operators.dedup import MessageStore, associations, identified, ingest_in_batches
from thermaloom.operators.reconcile import digest_bytes, reconcile
from thermaloom.operators.replay import replay
from thermaloom.session import scratch_path


# -- reconcile -------------------------------------------------------------------------------
def diffs(df):
    return sorted((r.record_id or "", r.rep if r.rep is not None else -1, r.field, r.diff) for r in df.collect())


def test_reconcile_cases(spark):
    schema = "id string, rep int, v bigint, side string, record_id string"
    left = spark.createDataFrame([("a", 1, 5, "x", "z"), ("a", 1, 5, "x", "z"), ("b", 1, None, "x", "z"), ("c", 2, None, "x", "z"), ("d", 1, 7, "x", "z"), (None, 3, 1, "x", "z")], schema)
    right = spark.createDataFrame([("a", 1, 6, "x", "z"), ("b", 1, None, "x", "z"), ("c", 2, 3, "x", "z"), ("e", None, 1, "x", "z"), (None, 3, 1, "x", "z")], schema)
    got = diffs(reconcile(left, right, "id", "rep", {"v": F.col("v")}))
    assert got == [("a", 1, "v", "differs"), ("c", 2, "v", "differs"), ("d", 1, "", "missing_right"), ("e", -1, "", "missing_left")]
    assert diffs(reconcile(left.limit(0), right.limit(0), "id", "rep", {"v": F.col("v")})) == []
    assert len(diffs(reconcile(left.limit(0), right, "id", None, {"v": F.col("v")}))) == 5


def test_reconcile_against_brute_force_over_many_batches(spark):
    rng = random.Random(4)
    mk = lambda: {(f"k{rng.randrange(3000)}", rng.randrange(2)): (rng.choice([None, 1, 2]), rng.choice(["x", "y", None])) for _ in range(4000)}
    a, b = mk(), mk()
    rows = lambda d: [(*k, *v) for k, v in d.items() for _ in range(1 + (hash(k) % 3 == 0))]
    schema = "id string, rep int, p bigint, q string"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = diffs(reconcile(spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema).repartition(5), "id", "rep", {"p": F.col("p"), "q": F.col("q")}))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [(*k, "", "missing_right") for k in a.keys() - b.keys()] + [(*k, "", "missing_left") for k in b.keys() - a.keys()]
    want += [(*k, f, "differs") for k in a.keys() & b.keys() for i, f in enumerate("pq") if a[k][i] != b[k][i]]
    assert got == sorted(want)


def test_digests_denote_the_same_bits(spark):
    h = "AB" * 32
    forms = [h, h.lower(), f"sha256:{h}", f" SHA256-{h.lower()}\t", f"0x{h}", ":".join(["ab"] * 32)]
    df = spark.createDataFrame([(x,) for x in [*forms, None, "n/a"]], "d string").select(digest_bytes(F.col("d")).alias("b"))
    got = [None if r.b is None else bytes(r.b) for r in df.collect()]
    assert set(got[:6]) == {b"\xab" * 32} and got[6] is None and got[7] == b"n/a"


# -- messages -----------------------------------------------------------------------------------
MESSAGE = "delivery_id bigint, batch_id bigint, workspace_id string, actor_id string, client_sequence bigint, operation_id string, u string, d string"


def brute_repeats(rows):
    def uid(x):
        y = (x or "").lower().strip().replace("urn:uuid:", "").strip("{}").replace("-", "")
        return y if len(y) == 32 else None

    by_counter = {}
    for _, _, w, a, c, o, *_ in rows:
        if uid(o) and None not in (w, a, c):
            by_counter[w, a, c] = max(by_counter.get((w, a, c), ""), uid(o))
    first, ident = {}, {}
    for d, _, w, a, c, o, *_ in rows:
        i = uid(o) or (None if None in (w, a, c) else by_counter.get((w, a, c), (w, a, c)))
        ident[d] = i
        if i is not None:
            first[i] = min(first.get(i, d), d)
    return sorted(d for d, i in ident.items() if i is not None and first[i] != d)


def messages(n, seed):
    rng = random.Random(seed)
    hexes = [f"{rng.getrandbits(128):032x}" for _ in range(n // 4)]
    counter = {h: ("w%d" % (i % 3), "a%d" % (i % 5), i // 2) for i, h in enumerate(hexes)}  # some counters start again
    unique = {}
    for h, c in counter.items():
        unique.setdefault(c, []).append(h)
    rows = []
    for d in range(1, n + 1):
        h = hexes[0] if rng.random() < 0.3 else rng.choice(hexes)
        w, a, c = counter[h]
        dashed = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        o = rng.choice([dashed, h, h.upper(), "{%s}" % dashed, "urn:uuid:" + dashed, f" {dashed} "])
        if len(unique[w, a, c]) == 1 and rng.random() < 0.2:
            o = None
        elif rng.random() < 0.1:
            c = None
        rows.append((d, rng.randrange(9) if d % 7 else d % 9, w, a, c, o, "x", "y"))
    rows += [(n + 1, None, "w9", "a9", 1, None, "x", "y"), (n + 2, 3, "w9", "a9", 1, None, "x", "y"), (n + 3, 3, None, "a9", 1, None, "x", "y"), (n + 4, 3, "w", "a", None, "odd", "x", "y"), (n + 5, 3, "w", "a", None, "odd", "x", "y")]
    return rows


@pytest.mark.parametrize("rounds", [1, 4])
def test_store_keeps_one_copy(spark, rounds):
    rows = messages(400, 7)
    log = spark.createDataFrame(rows, MESSAGE).repartition(4)
    store = ingest_in_batches(log, MessageStore(spark, scratch_path(spark, "t")), "batch_id", rounds)
    dropped = sorted(r.delivery_id for r in store.dropped().collect())
    assert dropped == brute_repeats(rows)
    kept = sorted(map(tuple, store.messages().select(*log.columns).collect()))
    assert kept == sorted(r for r in rows if r[0] not in set(dropped))  # whole messages


def test_broadcast_has_another_way(spark, monkeypatch):
    from thermaloom.operators import dedup

    monkeypatch.setattr(dedup, "FEW", 0)
    rows = messages(120, 3)
    store = ingest_in_batches(spark.createDataFrame(rows, MESSAGE), MessageStore(spark, scratch_path(spark, "t")), "batch_id", 3)
    assert sorted(r.delivery_id for r in store.dropped().collect()) == brute_repeats(rows)
    assert store.messages().count() == len(rows) - len(brute_repeats(rows))


def _bytes(folder):
    root = folder.removeprefix("file://")
    return {name: open(os.path.join(root, name), "rb").read() for name in sorted(os.listdir(root))}


def test_only_affected_partitions_are_rewritten(spark):
    mk = lambda d, o: (d, 0, "w", "a", d, o, None, None)
    a, b, c = ("%032x" % i for i in (1, 2, 3))
    store = MessageStore(spark, scratch_path(spark, "t"))
    store.ingest(spark.createDataFrame([mk(10, a)], MESSAGE), 0)
    store.ingest(spark.createDataFrame([mk(20, b)], MESSAGE), 1)
    before = store.manifest()
    files = _bytes(before["parts"]["0"] + "/p=0")
    assert store.ingest(spark.createDataFrame([mk(5, b.upper()), mk(30, c)], MESSAGE), 2) == [1]
    after = store.manifest()
    assert after["parts"]["0"] == before["parts"]["0"] and after["parts"]["1"] != before["parts"]["1"] and "2" in after["parts"]
    assert files == _bytes(after["parts"]["0"] + "/p=0")
    assert sorted(r.delivery_id for r in store.messages().collect()) == [5, 10, 30] and [r.delivery_id for r in store.dropped().collect()] == [20]
    store.ingest(spark.createDataFrame([], MESSAGE), 3)
    assert sorted(r.delivery_id for r in store.messages().collect()) == [5, 10, 30]
    with pytest.raises(RuntimeError):
        store._publish({"version": 1, "parts": {}})
    with pytest.raises(ValueError):
        store.ingest(spark.createDataFrame([], MESSAGE), 0)


def test_counter_key_joins_what_was_apart(spark):
    """A row without a UUID and a UUID are kept side by side until a row with both ties them together."""
    u = "%032x" % 7
    store = MessageStore(spark, scratch_path(spark, "t"))
    store.ingest(spark.createDataFrame([(4, 0, "w", "a", 1, None, None, None)], MESSAGE), 0)
    store.ingest(spark.createDataFrame([(3, 0, "w", "a", None, u, None, None)], MESSAGE), 1)
    assert store.messages().count() == 2 and store.dropped().count() == 0
    assert store.ingest(spark.createDataFrame([(9, 0, "w", "a", 1, u, None, None)], MESSAGE), 2) == [0]
    assert [r.delivery_id for r in store.messages().collect()] == [3]
    assert sorted(r.delivery_id for r in store.dropped().collect()) == [4, 9]


def test_empty_log(spark):
    log = spark.createDataFrame([], MESSAGE)
    store = ingest_in_batches(log, MessageStore(spark, scratch_path(spark, "t")), "batch_id", 3)
    assert store.dropped().count() == 0 and store.messages().count() == 0 and associations(identified(log)).count() == 0


# -- change feed -------------------------------------------------------------------------------------
def brute_replay(rows):
    state, done = {}, set()
    for w, e, s, verb, carries, x, h in sorted((r for r in rows if r[0] and r[1] and r[2] is not None), key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        if (w, e, s) in done:
            continue
        if verb not in ("add", "replace", "move", "delete"):
            continue
        done.add((w, e, s))
        k = state.get((w, e))
        if verb == "add":
            state[w, e] = {"g": k["g"] + 1 if k else 0, "live": True, "s": s, "x": x, "h": h}
        elif k and k["live"]:
            if verb == "delete":
                k["live"] = False
            elif carries:
                k["s"] = s
                k["x"] = x if x is not None else k["x"]
                if verb == "replace":
                    k["h"] = h if h is not None else k["h"]
    return sorted((w, e, k["g"], k["s"], k["x"], k["h"]) for (w, e), k in state.items() if k["live"])


@pytest.mark.parametrize("block", [3, 1000])
def test_replay_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for _ in range(900):
        r = (rng.choice(["w1", "w2", None]), rng.choice(["hot", "hot", "e1", "e2", "e3", "", None]), rng.choice([None, *range(60)]), rng.choice(["add", "replace", "move", "delete", "odd"]), rng.choice([True, True, False, None]), rng.choice([None, 1.0, 2.5]), rng.choice([None, 7.0, 8.0]))
        rows.append(r)
    # a sequence of a key is one operation, however often delivered
    first = {}
    rows = [first.setdefault(r[:3], r) for r in rows]
    df = spark.createDataFrame(rows, "ws string, e string, seq bigint, verb string, carries boolean, x double, h double").withColumn("block", F.lit("clash"))
    got = sorted((r.ws, r.e, r.generation, r.last_sequence, r.x, r.h) for r in replay(df.repartition(5), ("ws", "e"), "seq", "verb", "carries", ("x", "h"), ("x",), block).collect())
    assert got == brute_replay(rows) and got
    assert replay(df.limit(0), ("ws", "e"), "seq", "verb", "carries", ("x", "h"), ("x",)).count() == 0


# -- drift -----------------------------------------------------------------------------------------------
def feed(spark, files):
    rows = [(a, p, f, i + 1, body if isinstance(body, (str, type(None))) else json.dumps(body), "x") for a, p, f, bodies in files for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "artifact string, producer string, file_no int, line_no int, body string, path string")


def test_changes_between_files(spark):
    t = lambda **k: {"run": "r1", "timings": {"total_s": 200.5, "admit_s": 0.01}, "flag": True, **k}
    files = [
        ("runs", "p", 1, [t(note="first pass"), t(note=None), "{bad", None, "[1]", ""]),
        ("runs", "p", 3, [{"run": "r2", "timings": {"total_s": 180.25, "admission_s": 0.012}, "flag": True, "note": "by hand"}] * 2),
        ("runs", "p", 4, ["{still bad"]),
        ("runs", "p", 5, [{"run": 7, "timings": {"total_s": None, "admission_s": 0.02}, "flag": True, "pages": 51234}]),
        ("runs", "p", 6, [{"run": 8, "timings": {"total_s": "190.0", "admission_s": 0.02}, "flag": True, "pages": 50111, "meta": {}}]),
        ("runs", "q", 1, [{"a": 1}]),
        ("runs", None, 1, [{"a": 1}]),
    ]
    got = sorted((r.file_no, r.change_kind, r.old_field, r.new_field) for r in drift.changes(feed(spark, files)).collect())
    assert got == [
        (3, "renamed", "timings.admit_s", "timings.admission_s"),
        (5, "added", "", "pages"), (5, "removed", "note", ""), (5, "retyped", "run", "run"),
        (6, "retyped", "timings.total_s", "timings.total_s"),
    ]
    table = {(r.producer, r.file_no, r.line_no): dict(r.fields) for r in drift.consistent_table(feed(spark, files)).collect()}
    assert table["p", 3, 1] == {"run": "r2", "timings.total_s": "180.25", "timings.admit_s": "0.012", "flag": "true", "note": "by hand"}
    assert table["p", 5, 1]["timings.total_s"] is None and ("p", 4, 1) not in table and len(table) == 7
    assert drift.changes(feed(spark, files).limit(0)).count() == 0


def fields(**kinds):
    out = {}
    for path, values in kinds.items():
        p = drift.Profile()
        for v in values:
            p.see(v)
        path = path.replace("__", ".")
        out[path] = {"path": path, **{c: getattr(p, c) for c in drift._SUMS}, **{f"h{i}": h for i, h in enumerate(p.mins)}}
    return out


def test_edit_scripts():
    s = drift.edit_script
    assert s(fields(a__x=[1], a__y=["q w"]), fields(b__x=[1], b__y=["q w"])) == ([("a.x", "b.x"), ("a.y", "b.y")], [], [])  # an object under another name
    assert s(fields(schema_version=[3]), fields(meta__schema_version=[4])) == ([("schema_version", "meta.schema_version")], [], [])  # a move
    assert s(fields(schema_version=[3]), fields(page_faults=[81234])) == ([], ["schema_version"], ["page_faults"])
    assert s(fields(w__n_rows=[250]), fields(w__height=[255])) == ([("w.n_rows", "w.height")], [], [])
    assert s({}, {}) == ([], [], []) and s(fields(strict=[0]), fields(strict_bits=[1]))[0] == [("strict", "strict_bits")]


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert abs(sum(cost[i, j] for i, j in drift.assign(cost)) - best) < 1e-9


# -- spikes ---------------------------------------------------------------------------------------------------
def station(n=400, start=datetime(2024, 6, 1), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = start + timedelta(minutes=15 * i)
        h = t.hour + t.minute / 60
        sun = float(spikes.sun_sine(np.array([t.timetuple().tm_yday]), np.array([h]), np.array([47.0]))[0])
        g = max(0.0, 1361 * sun) * 0.5
        rows.append([i, "s1", "t1", t, 15 + 6 * float(np.sin((h - 9) / 24 * 6.283)) + float(rng.normal(0, 0.1)), 60 - 15 * float(np.sin((h - 9) / 24 * 6.283)) + float(rng.normal(0, 0.5)), round(g + float(rng.random()) * 0.3 if g > 5 else 0.0, 2), round(g * 0.3, 2) if g > 5 else 0.0, None])
    return rows


SCHEMA = "reading_id bigint, station string, tile string, obs_time timestamp, ta double, rh double, radg double, radd double, chunk string"


def found(spark, rows):
    grid = spark.createDataFrame([("t1", 47.0), ("t1", 47.0)], "tile string, latitude double")
    return sorted((r.reading_id, r.field) for r in spikes.implausible(spark.createDataFrame(rows, SCHEMA), grid).collect())


def test_no_cases_in_plain_weather(spark):
    assert found(spark, station()) == []
    assert found(spark, station(0)) == []


def test_each_kind_of_case(spark):
    rows = station(5 * 96)
    want = set()

    def put(i, field, value, case=True):
        rows[i][{"ta": 4, "rh": 5, "radg": 6, "radd": 7}[field]] = value
        if case:
            want.add((i, field))

    put(50, "ta", rows[50][4] + 9)
    put(60, "ta", -300.0)
    put(61, "ta", -999.0, False)
    put(62, "ta", None, False)
    put(63, "ta", float("nan"), False)
    put(70, "rh", 101.5)
    for i in range(100, 107):
        put(i, "rh", 55.5)  # seven equal values
    for i in range(120, 125):
        put(i, "rh", 52.0, False)  # five are none
    for i in range(200, 212):
        put(i, "ta", rows[i][4] * 1.8 + 32)  # another unit for three hours
    noon = 96 * 3 + 48
    put(noon, "radg", 0.4)
    put(noon + 3, "radg", 2500.0)
    put(noon + 6, "radd", rows[noon + 6][6] + 20)
    put(96 * 2 + 4, "radg", 150.0)  # by night
    put(96 * 2 + 8, "radd", -3.0)
    rows.append(list(rows[50]))  # delivered twice
    assert set(found(spark, rows)) == want


def test_runs_across_chunks_and_gaps(spark):
    edge = datetime(1970, 1, 1) + timedelta(days=32 * 622)
    rows = station(12, edge - timedelta(minutes=15 * 3))
    for r in rows[:4]:
        r[5] = 44.0
    late = station(4, edge + timedelta(days=40))
    for i, r in enumerate(late):
        r[0] = 100 + i
    for r in rows[4:]:
        r[5] = None
    late[0][5] = late[1][5] = 44.0
    assert [x for x in found(spark, rows + late) if x[1] == "rh"] == [(i, "rh") for i in (0, 1, 2, 3, 100, 101)]


def test_rows_without_time_tile_or_station(spark):
    rows = [[1, "s", "t1", None, 99.0, 50.0, 1.0, 2.0, None], [2, None, "nowhere", datetime(2024, 1, 1), 5.0, 120.0, -1.0, 0.0, None]]
    assert found(spark, rows) == [(1, "radd"), (1, "ta"), (2, "radg"), (2, "rh")]


def test_spikes_of_radiation_inside_its_bounds(spark):
    """Judged against the station's own course: a clear reading amid a dark overcast day, in global and in diffuse radiation."""
    rows = station(6 * 96)
    for r in rows:
        r[6], r[7] = r[6] * 0.2, r[7] * 0.2
    noon = 96 * 4 + 48
    rows[noon][6] = 1361 * 0.86 * 0.9
    assert found(spark, rows) == [(noon, "radg")]


@pytest.mark.parametrize("days", [8, 32, 90])
def test_verdicts_do_not_depend_on_chunks(spark, days):
    import os.path

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    run = lambda n: sorted(map(tuple, spikes.implausible(read("met_inputs"), read("grid_tiles").select("tile", "latitude"), chunk_days=n).collect()))
    whole = run(1000)
    assert run(days) == whole and len(whole) > 50
