"""Thermal comfort end to end: a zone against loops over scalars, the kernel against the expression chains, zones against the whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaloom.functions import radiation, sky
from thermaloom.functions.formula import apply
from thermaloom.operators import march, raster, solve
from thermaloom.plans import pipeline

SBC = 5.67051e-8
LC = {1: (0.18, 0.95, 0.58, -9.78, 15.0), 5: (0.16, 0.94, 0.21, -3.38, 14.0)}


def scene(spark, n=20, zones=1):
    rows = []
    for r in range(n):
        for c in range(n):
            high = 8.0 if 4 <= r < 9 and 6 <= c < 10 else 0.0
            rows.append((r * zones // n, r, c, 2.0, 2.0 + high, 4.0 if (r, c) in ((14, 5), (15, 5), (3, 15)) else 0.0, 1 if c % 2 else 5))
    return spark.createDataFrame(rows, "zone int, r int, c int, dem double, dsm double, trees double, lc int")


def day(spark, zones=1):
    rows = [(z, "a", h, h + 0.5, 180, 47.0, 18.0 + 8 * math.sin((h - 9) / 24 * 2 * math.pi), 60.0, max(0.0, 780.0 * math.sin((h + 0.5 - 4.5) / 15 * math.pi)), 1.5, 101.3) for z in range(zones) for h in range(24)]
    return spark.createDataFrame(rows, "zone int, day string, t int, hour double, doy int, latitude double, ta double, rh double, radg double, wind double, p_kpa double")


def weight(x):
    return 63.227 * x**6 - 161.51 * x**5 + 156.91 * x**4 - 70.424 * x**3 + 16.773 * x**2 - 0.4863 * x


def by_hand(step, s, lit, l_up):
    """Downward short wave and mean radiant temperature of one cell, a formula at a time."""
    ta, sun = step["ta"] + 273.15, step["altitude"] > 0
    f_sh = 0.5
    both = s["svf"] + s["veg"] - 1
    if sun and 0 < both < 1 - 1e-9:
        base = 1 / math.tan(math.asin(math.sqrt(1 - both)))
        h = 2 * base / math.tan(step["zen"])
        q = math.tan(step["zen"]) / 2
        area = 2 * base * h
        defined = True
        if 1 - h < 0:
            inner = base**2 - q**2 / 4
            if inner < 0:
                defined = False
            else:
                phi = math.atan(math.sqrt(inner) / q)
                area += 2 * base * (1 - h) * (math.sin(phi) - phi * math.cos(phi)) / (1 - math.cos(phi))
        f_sh = (2 * math.pi * base - area) / (2 * math.pi * base) if defined else 0.5
    buveg = s["svf"] - (1 - s["veg"]) * 0.97
    k_down = k_up = k_side = k_sides = 0.0
    if sun:
        wall_light = step["radg"] * (1 - f_sh) + step["scatter"] * f_sh
        from_sky = step["scatter"] * buveg + 0.2 * (1 - buveg) * wall_light
        k_down = step["beam"] * lit * step["sin_alt"] + from_sky
        k_up = s["albedo"] * (lit * step["beam"] * step["sin_alt"] + from_sky)
        k_side = step["beam"] * lit * step["cos_alt"]
    air = SBC * ta**4
    lw = lambda e: both * e * air + (2 - s["veg"] - s["aveg"]) * 0.9 * air + (s["aveg"] - s["svf"]) * 0.9 * SBC * (ta + step["tg_wall"]) ** 4 + (1 - both) * 0.1 * e * air
    ci = step["ci_used"]
    l_down = lw(step["esky"]) if ci >= 0.95 else ci * lw(step["esky"]) + (1 - ci) * lw(1.0)
    l_sides = 0.0
    for x, start in (("e", 180), ("s", 270), ("w", 0), ("n", 90)):
        svf, veg, aveg = s[f"svf_{x}"], s[f"veg_{x}"], s[f"aveg_{x}"]
        w_open, w_wall = weight(svf + veg - 1) / 4.4897, (weight(aveg) - weight(svf)) / 4.4897
        if sun:
            walls = 1 - weight(svf) / 4.4897
            seen = walls + (1 - w_open - walls) * 0.97
            k_sides += 0.5 * (step["scatter"] * (1 - seen) + 0.2 * seen * wall_light + k_up)
        turn = 2 * f_sh - 1
        wall = air
        angle = (step["azimuth"] - start) % 360
        if sun and 0 < angle <= 180:
            alfa = math.asin(math.sqrt(max(0.0, 1 - svf)))
            a, b = math.atan(alfa), math.atan(math.tan(alfa * turn))
            wall = SBC * (ta + step["tg_wall"] * math.sin(math.radians(angle))) ** 4 * (1 - turn) * math.cos((a - b) / 2 + b) + air * turn
        l_sides += 0.5 * ((svf + veg - 1) * (step["esky"] * air * ci + (1 - ci) * air) * w_open + 0.9 * w_wall * wall + 0.9 * air * (1 - w_open - w_wall) + l_up + (l_down + l_up) * (1 - w_open) * 0.1)
    absorbed = 0.7 * (0.28 * k_side + 0.06 * (k_down + k_up) + 0.22 * k_sides) + 0.95 * (0.06 * (l_down + l_up) + 0.22 * l_sides)
    return k_down, (absorbed / (0.95 * SBC)) ** 0.25 - 273.2


def by_patch(step, s, planes, lit, l_up):
    """The same under an anisotropic sky: a loop over the patches that one cell sees, a formula at a time."""
    sun, ta = step["altitude"] > 0, step["ta"] + 273.15
    rad = math.radians
    patches = march.patches(2)
    solid = []
    for i, (alt, _, n, _, _) in enumerate(patches):
        solid.append(math.radians(360 / n) * (math.sin(rad(alt + 6)) - math.sin(rad(alt - 6)) if n > 1 else math.sin(rad(alt)) - math.sin(rad(patches[i - 1][0] + 6))))
    k_down = k_up = k_side = 0.0
    asvf = math.acos(math.sqrt(s["svf"]))
    limit = lambda azi: math.degrees(math.atan(math.tan(asvf) + min(2 * math.cos(rad(abs(step["azimuth"] - azi))) * math.tan(rad(step["altitude"])), 0.0)))
    if sun:
        buveg = s["svf"] - (1 - s["veg"]) * 0.97
        f_sh = float(solve.shaded_share(step["zen"], np.array([math.asin(math.sqrt(2 - s["svf"] - s["veg"]))]))[0]) if 0 < s["svf"] + s["veg"] - 1 < 1 - 1e-9 else 0.5
        wall_light = 0.2 * (1 - buveg) * (step["radg"] * (1 - f_sh) + step["scatter"] * f_sh)
        z = math.pi / 2 - step["zen"]
        lum = []
        for alt, azi, *_ in patches:
            gamma = math.acos(max(-1, min(1, math.sin(rad(alt)) * math.sin(z) + math.cos(z) * math.cos(rad(alt)) * math.cos(rad(azi - step["azimuth"])))))
            lum.append((1 + step["px_a"] * math.exp(step["px_b"] / math.cos(rad(90 - alt)))) * (1 + step["px_c"] * math.exp(step["px_d"] * gamma) + step["px_e"] * math.cos(gamma) ** 2))
        lum = [x / sum(lum) for x in lum]
        total = sum(x * w * math.sin(rad(p[0])) for x, w, p in zip(lum, solid, patches))
        diffuse = 0.0
        k_side = step["beam"] * lit * step["cos_alt"]
        for x, w, (alt, azi, *_), sh, veg, vb in zip(lum, solid, patches, *planes):
            seen, wide = sh - (1 - veg) * 0.97, w * math.cos(rad(alt))
            diffuse += seen * x * step["scatter"]
            k_side += seen * x * step["scatter"] / total * wide
            shade = 0.2 * step["scatter"] * 0.5 / math.pi
            if veg == 0 or vb == 0:
                k_side += shade * wide
            if (1 - sh) * vb == 1:
                k_side += wide * ((0.2 * step["beam"] * step["cos_alt"] + step["scatter"] * 0.5) / math.pi if limit(azi) < alt else shade)
        k_down = step["beam"] * lit * step["sin_alt"] + diffuse + wall_light
        k_up = s["albedo"] * (lit * step["beam"] * step["sin_alt"] + step["scatter"] * buveg + wall_light)
    ci = step["ci_used"]
    esky = ci * step["esky"] + 1 - ci if ci < 0.95 else step["esky"]
    l_side = l_down = sky_down = 0.0
    for w, (alt, azi, *_), sh, veg, vb in zip(solid, patches, *planes):
        side, down = w * math.cos(rad(alt)), w * math.sin(rad(alt))
        give = 0.0
        if sh == 1 and veg == 1:
            give += (1 - (1 - esky) * math.exp(0.308 * (1.7 - 1 / math.cos(rad(90 - alt))))) * SBC * ta**4 / math.pi
            sky_down += give * down
        if veg == 0 or vb == 0:
            give += 0.9 * SBC * ta**4 / math.pi
        if (1 - sh) * vb == 1:
            warm = sun and 90 < abs(step["azimuth"] - azi) < 270 and limit(azi) < alt
            give += 0.9 * SBC * (ta + (step["tg_wall"] if warm else 0.0)) ** 4 / math.pi
        l_side, l_down = l_side + give * side, l_down + give * down
    for w, (alt, *_), sh, veg, vb in zip(solid, patches, *planes):
        if sh == 0 or veg == 0 or vb == 0:
            back = (sky_down + l_up) * 0.1 * 0.5 / math.pi
            l_side, l_down = l_side + back * w * math.cos(rad(alt)), l_down + back * w * math.sin(rad(alt))
    absorbed = 0.7 * (0.28 * k_side + 0.06 * (k_down + k_up) + 0.22 * 4 * 0.5 * k_up) + 0.95 * (0.06 * (l_down + l_up) + 0.28 * l_side + 0.22 * 4 * 0.5 * l_up)
    return k_down, (absorbed / (0.95 * SBC)) ** 0.25 - 273.2


@pytest.mark.parametrize("isotropic", [True, False])
def test_a_zone_against_loops(spark, isotropic):
    city, forcing = scene(spark), day(spark)
    got = {(r.t, r.r, r.c): r for r in pipeline.thermal_comfort(city, forcing, 14.0, ("tmrt", "lit", "k_down", "l_up", "utci"), keys=("day",), overlap=0, isotropic=isotropic).collect()}
    assert len(got) == 24 * 400
    layered = {(r.r, r.c): r for r in raster.layers(city).collect()}
    plane = lambda name: np.array([[getattr(layered[r, c], name) for c in range(20)] for r in range(20)], float)
    dsm, veg, trunk = plane("dsm"), plane("vegdsm"), plane("vegdsm2")
    view = march.sky_view(dsm, veg, trunk, 14.0)
    domes = [march.shadows(dsm, veg, trunk, raster.step_table(azi, alt, 14.0, 20, 20)) for alt, azi, *_ in march.patches(2)]
    steps = sorted((r.asDict() for r in apply(forcing.select("t", *pipeline._FORCING[1:]), pipeline.STEP_FORCING).collect()), key=lambda s: s["t"])
    held = {}
    for s in steps:
        sun = s["altitude"] > 0
        shadow = march.shadows(dsm, veg, trunk, raster.step_table(s["azimuth"], s["altitude"], 14.0, 21, 21)) if sun else None
        for (r, c), cell in layered.items():
            row = got[s["t"], r, c]
            if not cell.ground:
                assert row.tmrt is None
                continue
            albedo, emissivity, tgk, tstart, tmax = LC[cell.lc]
            site = {"albedo": albedo, **{k: float(v[r, c]) for k, v in view.items()}}
            lit = tg = 0.0
            if sun:
                lit = max(float(shadow[0][r, c]) - (1 - float(shadow[1][r, c])) * 0.97, 0.0)
                tg = max((tgk * s["altmax"] + tstart) * math.sin((s["hour"] - s["sunrise"]) / (tmax - s["sunrise"]) * math.pi / 2) * s["ci_surface"], 0.0)
            now = SBC * emissivity * (tg * lit + s["ta"] + 273.15) ** 4
            if sun:
                if (r, c) in held:
                    keep = math.exp(-33.27 / 24)
                    now = now * (1 - keep) + held[r, c] * keep
                held[r, c] = now
            else:
                held.pop((r, c), None)
            assert row.lit == pytest.approx(lit) and row.l_up == pytest.approx(now)
            if isotropic:
                k_down, tmrt = by_hand(s, site, lit, now)
            elif (r * 20 + c + s["t"]) % 7 == 0:
                k_down, tmrt = by_patch(s, site, [[float(d[k][r, c]) for d in domes] for k in range(3)], lit, now)
            else:
                continue
            assert row.k_down == pytest.approx(k_down) and row.tmrt == pytest.approx(tmrt, abs=1e-6), (s["t"], r, c)
    noon = [r for (t, _, _), r in got.items() if t == 12 and r.tmrt is not None]
    assert max(r.tmrt for r in noon if r.lit == 1) > max(r.tmrt for r in noon if r.lit == 0) + 5


def test_zones_agree_with_the_whole(spark):
    """With an overlap as wide as shadows reach, a city in zones is the city in one."""
    pick = ("tmrt", "wbgt")
    whole = pipeline.thermal_comfort(scene(spark), day(spark), 14.0, pick, keys=("day",), ground_only=True)
    parts = pipeline.thermal_comfort(scene(spark, zones=3), day(spark, 3), 14.0, pick, keys=("day",), ground_only=True, overlap=20, parts=2)
    a, b = ({(r.t, r.r, r.c): (r.tmrt, r.wbgt) for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys() and all(v == pytest.approx(b[k]) for k, v in a.items())


def test_kernel_agrees_with_the_expressions(spark):
    """Wedge, downward short wave and downward long wave of the kernel are those of the chains that queries use."""
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, (*rng.uniform((0.3, 0.8, 0.85, 0.05), (0.95, 1.0, 1.0, 1.5)), rng.uniform(0, 1), *rng.uniform((50, 0, 10), (900, 600, 300)), rng.uniform(5, 35), rng.uniform(0, 8), rng.uniform(0.3, 1)))) for _ in range(200)]
    names = "svf svfveg svfaveg zen lit radg beam scatter ta tg_wall ci".split()
    chain = [
        ("both", "svf + svfveg - 1.0"), ("svfalfa", "case when both < 1.0 and both > 0 then asin(sqrt(1.0 - both)) end"), *radiation.WEDGE, ("svfbuveg", "svf - (1.0 - svfveg) * 0.97"),
        ("sin_alt", "cos(zen)"), ("direct", "beam"), ("diffuse", "scatter"), ("d_rad", "scatter * svfbuveg"), ("k_down", radiation.K_DOWN), ("rh", "50.0 + 0.0 * ta"), *radiation.CLEAR_SKY, *radiation.l_down(),
        ("k_up", radiation.k_up("(0.15 * lit)", "0.15")), ("k_side_i", "direct * lit * sin(zen)"), ("azimuth", "200.0 + 0.0 * ta"), ("l_up", "400.0 + 0.0 * ta"),
        *radiation.k_weights(), *radiation.l_weights(), *radiation.FOUR_SIDES, ("tmrt", radiation.mean_radiant(radiation.SSTR["cyl_iso"])),
    ]
    df = apply(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), chain)
    for r in df.collect():
        one = {k: np.array([r.svf if k.startswith("svf") else r.svfveg if k.startswith("veg") else r.svfaveg if k.startswith("aveg") else 0.15]) for k in solve.STATIC}
        step = {"altitude": 90 - math.degrees(r.zen), "azimuth": 200.0, "zen": r.zen, "sin_alt": math.cos(r.zen), "cos_alt": math.sin(r.zen), "ta": r.ta, "ci_used": r.ci, "esky": r.esky, "radg": r.radg, "beam": r.beam, "scatter": r.scatter, "tg_wall": r.tg_wall}
        site = solve.Site(one)
        assert solve.shaded_share(r.zen, site.alfa)[0] == pytest.approx(r.f_sh, abs=1e-9)
        k_down, tmrt = solve.fluxes(site, step, np.array([r.lit]), np.array([400.0]))
        assert k_down[0] == pytest.approx(r.k_down) and tmrt[0] == pytest.approx(r.tmrt, abs=1e-7)


def test_nothing_to_solve(spark):
    city, forcing = scene(spark), day(spark)
    assert pipeline.thermal_comfort(city, forcing.limit(0), 14.0, ("tmrt",), keys=("day",)).count() == 0
    assert pipeline.thermal_comfort(city, forcing.withColumn("zone", F.lit(9)), 14.0, ("tmrt",), keys=("day",)).count() == 0
    assert pipeline.thermal_comfort(city, forcing.withColumn("latitude", F.lit(None).cast("double")), 14.0, ("tmrt",), keys=("day",)).count() == 0
    with pytest.raises(ValueError):
        pipeline.thermal_comfort(city, forcing, 14.0, ("heat",))
    assert sky.bands()  # the sky has patches


def test_summary_is_the_hours_grouped(spark):
    """Folded where a zone is solved, or every hour grouped by cell and series: the same."""
    every = day(spark, 2).withColumnRenamed("day", "spell")
    night = every.withColumn("spell", F.lit("b")).where("t < 5").withColumn("ta", F.col("ta") - 9)
    city, forcing = scene(spark, zones=2), every.where("t > 3").unionByName(night)
    hours = pipeline.thermal_comfort(city, forcing, 14.0, ("tmrt", "utci", "wbgt"), keys=("spell",), ground_only=True)
    slow = hours.groupBy("zone", "spell", "r", "c").agg(F.count("*").alias("hours"), *(g(x).alias(f"{n}_{x}") for x in ("tmrt", "utci", "wbgt") for n, g in (("mean", F.avg), ("max", F.max))))
    key = lambda r: (r.zone, r.spell, r.r, r.c, r.hours)
    want = {key(r): [r[x] for x in slow.columns[5:]] for r in slow.collect()}
    once = forcing.where("zone = 0").withColumnRenamed("zone", "place").withColumn("place", F.lit("here"))
    which = spark.createDataFrame([(0, "here"), (1, "here")], "zone int, place string")
    for out in (pipeline.thermal_summary(city, forcing, 14.0, keys=("spell",)), pipeline.thermal_summary(city, once, 14.0, keys=("spell",), which=which)):
        got = {key(r): [r[x] for x in slow.columns[5:]] for r in out.collect()}
        assert len(want) == 2 * 380 and got.keys() == want.keys() and all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())


def test_comfort_cells_joins_no_cell_with_steps(spark):
    """Cells times steps never are rows: what solves a zone gives the result, with no join, shuffle or aggregation behind it, and readings are grouped once."""
    out = pipeline.comfort_cells(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    behind = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert not any(x in behind for x in ("Join", "Exchange", "Aggregate")), behind
    assert "met_inputs" not in plan


@pytest.mark.parametrize("low", [0.0, -2.0])
def test_part_of_a_march(spark, low):
    """What surrounds a part casts shadows into it as in the whole."""
    rng = np.random.default_rng(5)
    for azimuth, altitude in ((20.0, 8.0), (135.0, 30.0), (250.0, 2.0), (300.0, 65.0)):
        dsm = low + rng.integers(0, 9, (23, 31)) / 4 + 12.0 * (rng.random((23, 31)) < 0.2)
        trees = rng.integers(3, 9, dsm.shape) * (rng.random(dsm.shape) < 0.2)
        planes = (dsm, np.where(trees == 0, 0.0, trees + dsm), np.where(trees == 0, 0.0, trees / 4 + dsm))
        steps = raster.step_table(azimuth, altitude, 26.0, 24, 32)
        core = (slice(7, 15), slice(0, 30))
        for whole, part in zip(march.shadows(*planes, steps), march.shadows(*planes, steps, core)):
            assert (whole[core] == part).all()
