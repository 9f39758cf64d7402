"""Published anchors and limits of the physics formulas."""

import pytest

from thermaloom.functions import comfort, radiation, sky
from thermaloom.functions.formula import apply


def one(spark, steps, **given):
    names = list(given)
    return apply(spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} double" for n in names)), steps).first()


@pytest.mark.parametrize("ta,rh,tmrt,va,low,high", [(25.0, 50.0, 25.0, 1.0, 23, 27), (35.0, 40.0, 50.0, 0.5, 35, 60), (5.0, 70.0, 5.0, 5.0, -30, 5)])
def test_utci(spark, ta, rh, tmrt, va, low, high):
    assert low < one(spark, comfort.UTCI, ta=ta, rh=rh, tmrt=tmrt, va=va).utci < high


def test_utci_of_missing_input_is_null(spark):
    assert one(spark, comfort.UTCI, ta=None, rh=50.0, tmrt=20.0, va=1.0).utci is None


def test_utci_has_all_monomials():
    assert len(comfort.UTCI_COEFFICIENTS) == 210


def test_wet_bulb_and_dew_point(spark):
    steps = [("t_k", "ta + 273.15"), ("p_pa", "101325.0 + 0.0 * ta"), ("rh_part", "rh / 100.0"), ("e_pa", f"rh_part * ({comfort.saturation_pressure('t_k')})"), ("q", comfort.specific_humidity("p_pa", "e_pa")), *comfort.dew_point(), *comfort.wet_bulb(8)]
    r = one(spark, steps, ta=30.0, rh=50.0)
    assert r.td_k - 273.15 == pytest.approx(18.4, abs=0.2) and r.tw_k - 273.15 == pytest.approx(22.0, abs=0.3)
    # at the dew point the air is saturated
    s = one(spark, [("es", comfort.saturation_pressure("t_k"))], t_k=r.td_k)
    assert s.es == pytest.approx(r.e_pa, rel=1e-6)
    full = one(spark, steps, ta=30.0, rh=100.0)
    assert full.td_k == pytest.approx(303.15, abs=1e-3) and full.tw_k == pytest.approx(303.15, abs=1e-3)


def test_globe_lies_between_air_and_radiation(spark):
    r = one(spark, comfort.GLOBE, ta=30.0, tmrt=60.0, va=1.0)
    assert 30 < r.globe < 60
    assert one(spark, comfort.GLOBE, ta=30.0, tmrt=30.0, va=1.0).globe == pytest.approx(30.0, abs=0.1)


def test_sun_at_equinox_and_solstice(spark):
    noon = {"latitude": 52.5, "longitude": 0.0}
    assert one(spark, sky.SUN, sec=1710936000.0, **noon).altitude == pytest.approx(37.5, abs=0.5)  # 2024-03-20 12:00 UT
    assert one(spark, sky.SUN, sec=1718884800.0, **noon).altitude == pytest.approx(60.9, abs=0.5)  # 2024-06-20 12:00 UT
    assert one(spark, sky.SUN, sec=1718884800.0, **noon).azimuth == pytest.approx(180, abs=2)
    morning = one(spark, sky.SUN, sec=1718884800.0 - 6 * 3600, **noon)
    assert 60 < morning.azimuth < 120 and morning.altitude > 0


def test_day_length(spark):
    assert one(spark, sky.DAY_LENGTH, doy=80.0, latitude=50.0).day_hours == pytest.approx(12, abs=0.2)
    assert one(spark, sky.DAY_LENGTH, doy=172.0, latitude=80.0).day_hours == 24
    assert one(spark, sky.DAY_LENGTH, doy=355.0, latitude=80.0).day_hours == 0


def test_patches_and_weights():
    assert [sum(c for *_, c, _, _ in sky.bands(o)) for o in (1, 2, 3, 4)] == [145, 153, 305, 609]
    from thermaloom.operators.march import annulus

    assert sum(n * annulus(k, n) for _, _, _, n, lo, hi in sky.bands(2) for k in range(int(lo) + 1, int(hi) + 1)) == pytest.approx(1, abs=1e-3)


def test_mean_radiant_of_a_uniform_field(spark):
    """In a closed room all surfaces of one temperature give that temperature."""
    flux = "(5.67051e-8 * pow(t + 273.2, 4.0))"
    got = one(spark, [("l_down", flux), ("l_up", flux), ("l_sides", f"4.0 * {flux}"), ("k_down", "0.0"), ("k_up", "0.0"), ("k_sides", "0.0"), ("k_side_i", "0.0"), ("tmrt", radiation.mean_radiant(radiation.SSTR["cyl_iso"]))], t=25.0)
    assert got.tmrt == pytest.approx(25.0, abs=0.01)


def _odd_readings(spark, folder, rows):
    """Tables of a few readings (ta, rh, p), all else missing."""
    from thermaloom.plans.bindings import MEASURES

    plain = "station string, tile string, obs_time timestamp, t int, iy int, id int, it int, imin int"
    schema = f"reading_id bigint, {plain}, " + ", ".join(f"{m} double" for m in MEASURES)
    here = [(i, "s001", "a", None, 0, 2025, 180, 12, 0, *(x.get(m) for m in MEASURES)) for i, x in enumerate(dict(zip(("ta", "rh", "p"), r)) for r in rows)]
    spark.createDataFrame(here, schema).coalesce(1).write.parquet(f"{folder}/met_inputs.parquet")
    spark.createDataFrame([("a", 48.0)], "tile string, latitude double").coalesce(1).write.parquet(f"{folder}/grid_tiles.parquet")


def _equals_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    from thermaloom.plans import physics_queries

    con = duckdb.connect()
    for t in ("met_inputs", "grid_tiles"):
        con.sql(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
    got = sorted(tuple(map(str, r)) for r in physics_queries.QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(physics_queries.SQL[name]).fetchall()) and got


#: Temperatures at which the Magnus formula divides by zero, itself or by way of its result, and plain ones.
ODD_READINGS = [(-243.5, 50.0, 1000.0), (-233.5, 50.0, 1000.0), (-243.4, 99.0, 1000.0), (-243.6, 20.0, None), (-250.0, 100.0, 1000.0), (-243.5, None, 1000.0), (-243.45, -16.0, 1000.0), (None, 50.0, 1000.0), (20.0, 50.0, 1000.0), (20.0, 150.0, 900.0), (float("nan"), 1.0, 1.0)]


def test_magnus_of_impossible_temperatures(spark, tmp_path):
    _odd_readings(spark, tmp_path, ODD_READINGS)
    _equals_sql(spark, tmp_path, "magnus_rh")


def test_wrf_humidity_of_impossible_temperatures(spark, tmp_path):
    _odd_readings(spark, tmp_path, ODD_READINGS)
    _equals_sql(spark, tmp_path, "wrf_rh")
