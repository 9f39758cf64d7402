"""Marches and raster operators against plain loops on small scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaloom.operators import march, raster


def scene(spark, n=14, m=11, seed=3):
    rng = np.random.default_rng(seed)
    dem = rng.integers(0, 3, (n, m)) * 0.25 + 1.0
    dsm = dem + np.where(rng.random((n, m)) < 0.15, rng.integers(4, 9, (n, m)), 0)
    trees = np.where((dsm == dem) & (rng.random((n, m)) < 0.2), rng.integers(3, 8, (n, m)), 0)
    rows = [(r, c, float(dem[r, c]), float(dsm[r, c]), float(trees[r, c]), 5) for r in range(n) for c in range(m)]
    return spark.createDataFrame(rows, "r int, c int, dem double, dsm double, trees double, lc int"), dem, dsm, trees


def plane(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = r[name]
    return out


def loop_shadow(dsm, steps):
    out = np.ones(dsm.shape)
    for r in range(dsm.shape[0]):
        for c in range(dsm.shape[1]):
            front = dsm[r, c]
            for _, dr, dc, drop in steps:
                a, b = r + dr, c + dc
                front = max(front, dsm[a, b] - drop if 0 <= a < dsm.shape[0] and 0 <= b < dsm.shape[1] else 0.0)
            out[r, c] = 0.0 if front > dsm[r, c] else 1.0
    return out


@pytest.mark.parametrize("azimuth", [0.0, 30.0, 90.0, 135.0, 200.0, 271.5, 359.0])
def test_three_forms_of_the_shadow_agree(spark, azimuth):
    cells, dem, dsm, trees = scene(spark)
    top = 12.0
    steps = raster.step_table(azimuth, 30.0, top, 14, 11)
    want = loop_shadow(dsm, steps)
    layered = raster.layers(cells)
    assert (plane(raster.building_shadow(cells, steps), "sh", dsm.shape) == want).all()
    folded = raster.vegetation_shadow(layered, steps).cache()
    veg = np.where(trees > 0, trees + dsm, 0.0)
    trunk = np.where(trees > 0, 0.25 * trees + dsm, 0.0)
    sh, vegsh, vb = march.shadows(dsm, veg, trunk, steps)
    assert (sh == want).all()
    for name, p in (("sh", sh), ("vegsh", vegsh), ("vbshvegsh", vb)):
        assert (plane(folded, name, dsm.shape) == p).all(), name


def test_blocks_with_halo_equal_the_whole(spark):
    cells, *_ , dsm, trees = (*scene(spark, 60, 50),)
    layered = raster.layers(cells)
    whole = march.shadow_blocks(layered, 140.0, 40.0, 12.0, size=512)
    parts = march.shadow_blocks(layered, 140.0, 40.0, 12.0, size=32)
    for name in ("sh", "vegsh", "vbshvegsh"):
        assert (plane(whole, name, dsm.shape) == plane(parts, name, dsm.shape)).all()
    assert march.shadow_blocks(layered.limit(0), 140.0, 40.0, 12.0).count() == 0


def test_shadow_falls_away_from_the_sun(spark):
    rows = [(r, c, 1.0, 9.0 if (r, c) == (10, 10) else 1.0, 0.0, 5) for r in range(21) for c in range(21)]
    cells = spark.createDataFrame(rows, "r int, c int, dem double, dsm double, trees double, lc int")
    south = plane(raster.building_shadow(cells, raster.step_table(180.0, 45.0, 9.0, 21, 21)), "sh", (21, 21))
    assert (south[3:10, 10] == 0).all() and south[11:, 10].all() and south[:, 9].all()


def test_step_table_overshoots_once():
    steps = raster.step_table(180.0, 45.0, 3.5, 100, 100)
    assert [s[0] for s in steps] == [1, 2, 3, 4] and steps[-1][3] == pytest.approx(4.0) and {s[2] for s in steps} == {0} and steps[0][1] == 1


def test_sky_view_of_open_ground_and_beside_a_wall():
    open_ = march.sky_view(np.full((9, 9), 2.0), np.zeros((9, 9)), np.zeros((9, 9)), 3.0)
    assert open_["svf"].min() > 0.99 and open_["total"].min() > 0.99
    wall = np.full((15, 15), 2.0)
    wall[:, 9:] = 12.0
    s = march.sky_view(wall, np.zeros((15, 15)), np.zeros((15, 15)), 13.0)
    assert s["svf"][7, 8] < 0.75 and s["svf_e"][7, 8] < s["svf_w"][7, 8] and s["svf"][7, 1] > s["svf"][7, 8]


def test_box_statistics_frontal_area_erosion_walls(spark):
    cells, dem, dsm, _ = scene(spark)
    built = dsm - dem >= 2
    n, m = dsm.shape
    low, wall, plan, lam = (np.zeros(dsm.shape) for _ in range(4))
    edge = np.zeros(dsm.shape)
    for r in range(n):
        for c in range(m):
            near = [(a, b) for a in range(max(0, r - 3), min(n, r + 4)) for b in range(max(0, c - 3), min(m, c + 4)) if (a - r) ** 2 + (b - c) ** 2 <= 9]
            low[r, c] = min(dsm[p] for p in near)
            around = [(r + a, c + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= r + a < n and 0 <= c + b < m]
            rise = max(dsm[p] for p in around) - dsm[r, c]
            wall[r, c] = rise if len(around) == 4 and rise >= 3 else 0
            edge[r, c] = sum(not built[p] for p in around) * (dsm - dem)[r, c] if built[r, c] else 0
    for r in range(n):
        for c in range(m):
            box = (slice(max(0, r - 2), r + 3), slice(max(0, c - 2), c + 3))
            plan[r, c] = built[box].mean()
            lam[r, c] = min(1.0, edge[box].sum() / built[box].size / math.pi)
    assert np.allclose(plane(raster.disc_minimum(cells, "dsm", 3), "low", dsm.shape), low)
    assert np.allclose(plane(raster.walls(cells), "wall", dsm.shape), wall)
    assert np.allclose(plane(raster.box_statistics(cells, 2), "plan_fraction", dsm.shape), plan)
    assert np.allclose(plane(raster.frontal_area(cells, 2), "lambda_f", dsm.shape), lam)


def test_polygon_and_disc(spark):
    ring = [(1.0, 1.0), (6.0, 1.0), (6.0, 4.0), (1.0, 4.0)]
    schema = "id int, ring array<struct<x: double, y: double>>"
    for points in (ring, ring[::-1]):
        got = {(r.r, r.c) for r in raster.polygons_on_cells(spark.createDataFrame([(1, points)], schema)).collect()}
        assert got == {(r, c) for r in range(1, 4) for c in range(1, 6)}
    disc = raster.discs_on_cells(spark.createDataFrame([(1, 5.0, 5.0, 1.6)], "id int, x double, y double, radius double"), 1.0)
    assert {(r.r, r.c) for r in disc.collect()} == {(r, c) for r in range(10) for c in range(10) if (r - 4.5) ** 2 + (c - 4.5) ** 2 <= 1.6**2}


def test_gaussian_keeps_constants_and_skips_gaps(spark):
    cells = spark.createDataFrame([(r, c, None if (r + c) % 5 == 0 else 4.0) for r in range(9) for c in range(9)], "r int, c int, v double")
    assert all(abs(r.smooth - 4.0) < 1e-9 for r in raster.gaussian(cells, "v", 1.5, 4).collect())


def test_tiles(spark):
    grid = spark.createDataFrame([("t", 48, 64)], "tile string, n_rows int, n_cols int")
    got = sorted((r.window, r.width, r.height) for r in raster.tile_windows(grid, 32, 8).collect())
    assert got == [("0_0", 40, 40), ("0_32", 40, 16), ("32_0", 32, 40), ("32_32", 32, 16)]
    assert raster.tile_windows(grid, 100, 0).count() == 1
    with pytest.raises(ValueError):
        raster.tile_windows(grid, 8, 8)
    codes = spark.createDataFrame([("EPSG:32633",), ("32633",), ("urn:ogc:def:crs:EPSG::32633",), (None,), ("odd",)], "crs string")
    assert [r.e for r in codes.select(raster.epsg(F.col("crs")).alias("e")).collect()] == [32633, 32633, 32633, None, None]


def test_sky_view_in_groups_equals_one_array(spark):
    cells, _, dsm, trees = scene(spark)
    veg, trunk = np.where(trees > 0, trees + dsm, 0.0), np.where(trees > 0, 0.25 * trees + dsm, 0.0)
    want = march.sky_view(dsm, veg, trunk, 13.0)
    got = march.sky_view_blocks(raster.layers(cells), 13.0, size=512).cache()
    for name in march.SKY:
        assert np.allclose(plane(got, name, dsm.shape), want[name], atol=1e-9), name


def test_ground_below_zero(spark):
    rng = np.random.default_rng(1)
    dsm = rng.integers(-3, 5, (8, 9)).astype(float)
    steps = raster.step_table(200.0, 25.0, 6.0, 8, 9)
    assert (march.shadows(dsm, np.zeros_like(dsm), np.zeros_like(dsm), steps)[0] == loop_shadow(dsm, steps)).all()


def test_walls_face_away_from_the_building():
    dsm = np.full((24, 24), 2.0)
    dsm[8:16, 8:16] = 12.0
    walls = np.zeros((24, 24))
    walls[7, 8:16] = walls[16, 8:16] = walls[8:16, 7] = walls[8:16, 16] = 10.0
    a = np.degrees(march.wall_aspect(dsm, walls))
    assert a[7, 11] % 360 == pytest.approx(0, abs=20) or a[7, 11] == pytest.approx(360, abs=20)
    assert a[16, 11] == pytest.approx(180, abs=20) and a[11, 16] == pytest.approx(90, abs=20) and a[11, 7] == pytest.approx(270, abs=20)
    assert a[0, 0] == 0 and (march.wall_aspect(np.zeros((3, 3)), np.zeros((3, 3))) == 0).all()


def test_wall_light():
    dsm = np.full((12, 12), 1.0)
    dsm[5:7, 5:7] = 9.0
    walls, aspect = np.zeros((12, 12)), np.zeros((12, 12))
    walls[7, 5], aspect[7, 5] = 8.0, math.pi  # faces south
    walls[4, 5], aspect[4, 5] = 8.0, 0.0  # faces north
    lit, shade = march.wall_light(dsm, walls, aspect, 180.0, raster.step_table(180.0, 40.0, 9.0, 12, 12, first=0))
    assert lit[7, 5] == 8.0 and shade[7, 5] == 0 and lit[4, 5] == 0 and shade[4, 5] == 8.0


def test_sky_view_has_every_kind_by_side(spark):
    """Vegetation, and vegetation before buildings, by side too: 15 planes and the total; and the patches seen, as bits."""
    cells, _, dsm, trees = scene(spark)
    veg, trunk = (np.where(trees > 0, part * trees + dsm, 0.0) for part in (1.0, 0.25))
    got = march.sky_view_blocks(raster.layers(cells), 13.0)
    planes = {"total", *(k + s for k in ("svf", "veg", "aveg") for s in ("", "_e", "_s", "_w", "_n"))}
    assert set(got.columns) == {"r", "c", *planes, *march.BITS} and planes == set(march.SKY)
    rows = got.collect()
    seen = march.visible({b: np.array([r[b] for r in rows]) for b in march.BITS})
    at = ([r.r for r in rows], [r.c for r in rows])
    for i, (alt, azi, *_) in enumerate(march.patches(2)):
        for plane, want in zip(seen, march.shadows(dsm, veg, trunk, raster.step_table(azi, alt, 13.0, *dsm.shape))):
            assert (plane[:, i] == want[at].astype(bool)).all(), (i, alt, azi)


def test_vegetation_shadow_broadcasts_nothing(spark):
    """What cells send is many times the cells: no join may take it for small and gather it at the driver."""
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 9.0, 0.0, 0.0)], "r int, c int, dsm double, vegdsm double, vegdsm2 double")
    got = raster.vegetation_shadow(cells, raster.step_table(180.0, 45.0, 9.0, 10, 10))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 1, 1), (1, 0, 1, 1, 1)]


@pytest.mark.parametrize("many", [1, 24])
def test_sky_of_what_cells_see(spark, monkeypatch, many):
    """View factors from the patches seen are those of the sums, whether a block is one task or several."""
    monkeypatch.setattr(march, "MANY_BLOCKS", many)
    cells, *_ = scene(spark)
    layered = raster.layers(cells)
    got = {(x.r, x.c): x.bits for x in march.sky_bits_blocks(layered, 12.0, 8).collect()}
    want = march.sky_view_blocks(layered, 12.0, 8).join(layered.select("r", "c", "vegdsm2"), ["r", "c"]).collect()
    assert len(got) == len(want) == 14 * 11
    at = [(x.r, x.c) for x in want]
    bits = dict(zip(march.SEEN, np.array([got[x] for x in at]).T))
    sky = march.sky_of(bits, np.array([x.vegdsm2 == 0 for x in want]))
    for name, v in sky.items():
        assert np.allclose(v, [x[name] for x in want], atol=1e-12), name
    assert all((bits[b] == np.array([x[b] for x in want])).all() for b in march.BITS)
