"""Sources and sinks by round trip, components and the pipeline on small scenes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from thermaloom.operators import raster
from thermaloom.plans import pipeline
from thermaloom.sources import io


def test_met_text_round_trip(spark, tmp_path):
    rows = [(2024, 200, h, 0, 2.123456789, 55.555, None if h == 3 else 20.0 + h) for h in range(24)]
    met = spark.createDataFrame(rows, "iy int, id int, it int, imin int, wind double, rh double, ta double")
    path = str(tmp_path / "met.txt")
    io.write_met_text(met, path)
    back = {r.it: r for r in io.read_met_text(spark, path).collect()}
    assert len(back) == 24 and back[5].wind == 2.12346 and back[5].rh == pytest.approx(55.56, abs=0.011) and back[5].ta == 25.0 and back[3].ta is None and back[0].uhii is None
    short = str(tmp_path / "short.txt")
    spark.createDataFrame([("iy id it imin",), ("2024 1 0 0 odd",), ("",)], "value string").write.text(short)
    assert [(r.iy, r.q_star) for r in io.read_met_text(spark, short).collect()] == [(2024, None)]


def test_model_file_names(spark):
    names = ["wrfout_d01_2020-08-13_06_00_00", "a/b/wrfout_d02_2020-08-13_12:30:45", "wrfout_d03_2020-08-13_23", "wrfout_d1_2020-08-13_23", "wrfout_d01_2020-13-45_06_00_00", None]
    p = io.model_file_parts(F.col("n"))
    got = [(r.d, str(r.s)) for r in spark.createDataFrame([(n,) for n in names], "n string").select(p["domain"].alias("d"), p["starts"].alias("s")).collect()]
    assert got == [(1, "2020-08-13 06:00:00"), (2, "2020-08-13 12:30:45"), (3, "2020-08-13 23:00:00"), (None, "None"), (1, "None"), (None, "None")]


def test_valid_time(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 6, None), ("2024-01-01 00:00:00", None, "2024-02-01 00:00:00")], "time string, step int, valid_time string")
    assert [str(r.t) for r in df.select(io.valid_time(df).alias("t")).collect()] == ["2024-01-01 06:00:00", "2024-02-01 00:00:00"]
    with pytest.raises(ValueError):
        io.valid_time(df.select("step"))


def test_revisions_are_published_once_and_rotated(spark, tmp_path):
    root = f"file://{tmp_path}/results"
    assert io.revisions(spark, root) == []
    for rev in range(6):
        io.publish(spark.createDataFrame([(rev, "utci")], "v int, variable string"), root, rev)
    with pytest.raises(ValueError):
        io.publish(spark.createDataFrame([(9, "utci")], "v int, variable string"), root, 5)
    assert io.read_revision(spark, root).first().v == 5 and io.read_revision(spark, root, 2).first().v == 2
    assert io.rotate(spark, root) == [1, 2] and io.revisions(spark, root) == [0, 3, 4, 5] and io.rotate(spark, root) == []


def test_fingerprints_and_keys(spark):
    g = spark.createDataFrame([("tile_0_40", 4, 4, 1.0, 2.0, 1.0), ("b", 4, 4, 1.00000001, 2.0, 1.0), ("c", 5, 4, 1.0, 2.0, 1.0)], "tile string, n_rows int, n_cols int, origin_x double, origin_y double, pixel double")
    f = {r.tile: r.fingerprint for r in io.grid_fingerprint(g).collect()}
    assert f["tile_0_40"] == f["b"] != f["c"]
    assert [r.k for r in g.select(io.tile_key(F.col("tile")).alias("k")).collect()] == ["0_40", None, None]


def test_components_against_flood_fill(spark):
    rng = random.Random(5)
    on = {(r, c) for r in range(15) for c in range(15) if rng.random() < 0.55}
    got = {(r.r, r.c): r.component for r in raster.components(spark.createDataFrame(sorted(on), "r int, c int")).collect()}
    left, want = set(on), {}
    while left:
        stack, part = [min(left)], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.remove(p)
                part.add(p)
                stack += [(p[0] + a, p[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        for p in part:
            want[p] = min((r << 31) + c for r, c in part)
    assert got == want


def test_pipeline_shade_is_cooler_and_buildings_are_null(spark):
    rows = [(r, c, 1.0, 13.0 if 8 <= r <= 9 and 4 <= c <= 15 else 1.0, 0.0, 1) for r in range(20) for c in range(20)]
    city = spark.createDataFrame(rows, "r int, c int, dem double, dsm double, trees double, lc int")
    hours = [(t, float(t), 200, 48.0, 28.0, 40.0, 0.0 if t < 6 else 700.0, 1.5, 101.3) for t in (2, 10, 12)]
    forcing = spark.createDataFrame(hours, "t int, hour double, doy int, latitude double, ta double, rh double, radg double, wind double, p_kpa double")
    got = {(r.t, r.r, r.c): r for r in pipeline.thermal_comfort(city, forcing, 13.0, ("tmrt", "utci", "lit", "wbgt")).collect()}
    assert len(got) == 3 * 400 and got[12, 8, 8].utci is None
    shade, sun = got[12, 7, 10], got[12, 17, 10]  # north of the block, and far south of it
    assert shade.lit == 0 and sun.lit == 1 and shade.tmrt < sun.tmrt - 10 and shade.utci < sun.utci
    assert got[2, 17, 10].lit == 0 and got[2, 17, 10].tmrt < 30
    with pytest.raises(ValueError):
        pipeline.thermal_comfort(city, forcing, 13.0, ("odd",))


def test_pipeline_runs_every_series_and_marches_low_suns(spark):
    from thermaloom.functions import sky
    from thermaloom.functions.formula import apply

    rows = [(r, c, 1.0, 13.0 if 8 <= r <= 9 and 4 <= c <= 15 else 1.0, 0.0, 1) for r in range(20) for c in range(20)]
    city = spark.createDataFrame(rows, "r int, c int, dem double, dsm double, trees double, lc int")
    steps = [(s, doy, 15 * q, q / 4, doy, lat, 20.0, 50.0, 0.0 if q < 24 else 300.0, 2.0, 101.3) for s, doy, lat in (("a", 200, 48.0), ("a", 201, 48.0), ("b", 80, 60.0)) for q in (8, 26, 48, 49, 50)]
    forcing = spark.createDataFrame(steps, "station string, date int, t int, hour double, doy int, latitude double, ta double, rh double, radg double, wind double, p_kpa double")
    out = pipeline.thermal_comfort(city, forcing, 13.0, ("tmrt", "lit"), keys=("station", "date")).collect()
    assert len({(r.station, r.date, r.t, r.r, r.c) for r in out}) == len(out) == 15 * 400
    alone = pipeline.thermal_comfort(city, forcing.where("station = 'b'"), 13.0, ("tmrt", "lit")).collect()
    assert {(r.t, r.r, r.c): r.tmrt for r in alone} == {(r.t, r.r, r.c): r.tmrt for r in out if r.station == "b"}
    # a sun less than one degree up lights the cells on its side of the block
    fine = apply(spark.range(0, 2880).selectExpr("id / 120.0D as hour", "200 as doy", "48.0D as latitude"), sky.LOCAL_SUN)
    hour = fine.where("altitude > 0 and altitude < 1 and hour < 12").first().hour
    low = spark.createDataFrame([(0, hour, 200, 48.0, 20.0, 50.0, 5.0, 2.0, 101.3)], "t int, hour double, doy int, latitude double, ta double, rh double, radg double, wind double, p_kpa double")
    lit = {(r.r, r.c): r.lit for r in pipeline.thermal_comfort(city, low, 13.0, ("lit",)).collect()}
    assert lit[18, 19] == 1 and lit[12, 0] == 0


def test_registered_pipeline_has_every_hour_of_every_mean_day(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    got = {(r.month, r.t) for r in pipeline.comfort_by_hour(spark, data).select("month", "t").collect()}
    city, forcing = pipeline._zones(spark, data)
    assert got == {(r.month, r.t) for r in forcing.select("month", "t").collect()} and len(got) >= 24
    assert {r.zone for r in city.select("zone").distinct().collect()} == {r.zone for r in forcing.select("zone").distinct().collect()}
