"""Queries over the physics of forcing, sky, radiation and comfort, each a chain of formulas over a base relation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.functions import comfort, radiation, sky
from thermaloom.functions.formula import Step, apply, chain_sql, over, real, wrap360
from thermaloom.plans import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Steps that several queries share.
SUNNY: list[Step] = [*sky.LOCAL_SUN, ("cos_alt", "cos(asin(least(1.0, greatest(-1.0, sin_alt))))"), *sky.DAY_LENGTH, *sky.CLEARNESS]
#: A stand-in for the sky view of a reading's site, from its station's number, in (0.4, 1).
SITE: list[Step] = [
    ("site", "cast(substr(station, length(station) - 2) as int)"),
    ("svf", "0.4 + (site % 13) / 22.0"),
    ("svfveg", "0.75 + (site % 5) / 20.0"),
    ("svfaveg", "0.80 + (site % 7) / 40.0"),
    ("svfbuveg", "svf - (1.0 - svfveg) * (1.0 - 0.03)"),
    ("svfalfa", "case when svf + svfveg - 1.0 < 1.0 - 1e-9 and svf + svfveg - 1.0 > 0 then asin(exp(ln(1.0 - (svf + svfveg - 1.0)) / 2.0)) end"),
    ("lit", "cast(site % 2 as double)"),
]
AIR: list[Step] = [("tmrt", "case when abs(ta) < 90.0 and abs(radg) < 2000.0 then ta + 0.03 * radg end"), ("va", "case when wind is not null and wind < 100.0 then greatest(wind, 0.15) end")]


def define(name: str, steps: Sequence[Step], out: Sequence[tuple[str, int | None]], keep: Sequence[str] = ("reading_id",), base: str = "met", where: str | None = None, plan: Sequence[Step] | None = None) -> None:
    """A query that applies a chain to a base relation and gives ``keep`` and rounded ``out`` columns.

    ``plan``: the same chain in Spark's words, where they differ from those of the SQL.
    """
    make, sql = {"met": (bindings.met, bindings.MET_SQL), "cells": (bindings.cells, bindings.CELLS_SQL)}[base]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = apply(make(spark, sf_dir), steps if plan is None else plan)
        if where:
            df = df.where(real(where))
        return df.select(*keep, *(F.col(c) if digits is None else F.expr(f"round({c}, {digits}) + 0e0").alias(c) for c, digits in out))

    run.__doc__ = f"{name.replace('_', ' ')} of the {base} relation."
    QUERIES[name] = run
    cols = ", ".join([*keep, *(c if digits is None else f"round({c}, {digits}) + 0e0 as {c}" for c, digits in out)])
    SQL[name] = f"select {cols} from ({chain_sql(sql, steps)}) q" + (f" where {real(where)}" if where else "")


MAGNUS = "6.112 * exp(17.67 * ({0}) / (({0}) + 243.5))"
#: The same for Spark: near -243.5 degrees, as broken sensors report, the divisor or the whole is 0.
_MAGNUS = "6.112 * exp(" + over("17.67 * ({0})", "({0}) + 243.5") + ")"
# -- forcing ------------------------------------------------------------------
define("met_clean", [], [(m, None) for m in bindings.MEASURES], keep=("reading_id", "station", "tile", "obs_time"))
define("magnus_rh", [("dew", "ta - (100.0 - rh) / 5.0"), ("rh_magnus", f"least(100.0, greatest(0.0, 100.0 * ({MAGNUS.format('dew')}) / ({MAGNUS.format('ta')})))")], [("rh_magnus", 6)],
       plan=[("dew", "ta - (100.0 - rh) / 5.0"), ("e_dew", _MAGNUS.format("dew")), ("e_ta", _MAGNUS.format("ta")), ("rh_magnus", f"least(100.0, greatest(0.0, {over('100.0 * e_dew', 'e_ta')}))")])
define("wind_speed_dir", [("u", "-wind * sin(wd * (pi() / 180.0))"), ("v", "-wind * cos(wd * (pi() / 180.0))"), ("speed", "sqrt(u * u + v * v)"), ("wind_from", f"case when speed > 0.01 then {wrap360('270.0 - atan2(v, u) / (pi() / 180.0)')} when speed is not null then 0.0 end"), ("dir_wrapped", "case when wind_from > 359.999999 then 0.0 else wind_from end")], [("speed", 6), ("dir_wrapped", 5)])
define("wrf_rh", [("q2", "0.002 + rh / 8000.0"), ("e_pa", "q2 * (p * 100.0) / (287.05 / 461.5 + q2)"), ("rh_wrf", f"least(100.0, greatest(0.0, e_pa / (100.0 * {MAGNUS.format('ta')}) * 100.0))")], [("rh_wrf", 6)],
       plan=[("q2", "0.002 + rh / 8000.0"), ("e_pa", over("q2 * (p * 100.0)", "287.05 / 461.5 + q2")), ("e_ta", _MAGNUS.format("ta")), ("rh_wrf", f"least(100.0, greatest(0.0, {over('e_pa', '100.0 * e_ta')} * 100.0))")])
define("wind_rotation", [("turn", "latitude / 200.0"), ("u", "-wind * sin(wd * (pi() / 180.0))"), ("v", "-wind * cos(wd * (pi() / 180.0))"), ("u_earth", "u * cos(turn) - v * sin(turn)"), ("v_earth", "v * cos(turn) + u * sin(turn)")], [("u_earth", 6), ("v_earth", 6)])
define("wind_dir_bin", [("dir_bin", f"case when wd >= 0 then cast(floor(({wrap360('wd')} + 15.0) / 30.0) * 30 as int) % 360 end")], [("dir_bin", None)])
define("met_file_format", [("f_wind", "coalesce(round(wind, 5), -999.0)"), ("f_ta", "coalesce(round(ta, 2), -999.0)"), ("f_rh", "coalesce(round(rh, 2), -999.0)"), ("f_kdn", "coalesce(round(radg, 2), -999.0)"), ("f_press", "coalesce(round(p_kpa, 2), -999.0)")], [("f_wind", None), ("f_ta", None), ("f_rh", None), ("f_kdn", None), ("f_press", None)], keep=("reading_id", "iy", "doy", "it", "imin"))
define("time_normalise", [("valid_time", "case when t % 3 = 0 then null else obs_time end"), ("stamp", "coalesce(valid_time, obs_time)")], [("stamp", None)])
define("min_wind_clamp", [("coeff", "0.05 + (t % 10) / 10.0"), ("va_site", "case when wind is not null then greatest(coeff * wind, 0.15) end")], [("va_site", 6)])
define("leaf_on", [("leafon", "case when doy > 97 and doy < 300 then 1 else 0 end"), ("leafon_south", "case when doy > 300 or doy < 97 then 1 else 0 end"), ("psi", "case when leafon = 1 then 0.03 else 0.5 end")], [("leafon", None), ("leafon_south", None), ("psi", 2)])
# -- sun and sky ----------------------------------------------------------------
_SEC = [("sec", "cast(iy - 1970 as double) * 31556952.0 + doy * 86400.0 + hour * 3600.0"), ("longitude", "0.0 * latitude + 12.5")]
define("julian_day", [*_SEC, *sky.JULIAN], [("jd", 6), ("jc", 8)])
define("solar_position", [*_SEC, *sky.SUN], [("altitude", 4), ("azimuth", 3), ("declination", 6)], where="latitude is not null and altitude < 89.9")
define("sun_local", sky.LOCAL_SUN, [("altitude", 5), ("declination", 7)], where="latitude is not null")
define("daylen", sky.DAY_LENGTH, [("dec_deg", 6), ("day_hours", 6), ("sunrise", 6), ("sunset", 6)])
define("sun_distance", sky.SUN_DISTANCE, [("sun_distance", 8)])
define("clearness", SUNNY, [("i0", 4), ("ci", 4), ("kt", 5), ("i0et", 4)], where="altitude > 3.0")
define("diffuse_split", [*SUNNY, *sky.diffuse_fraction()], [("diffuse", 4), ("direct", 3)], where="altitude > 3.0")
define("zenith_clamp", [*sky.LOCAL_SUN, ("zen_deg", "90.0 - altitude"), ("zen_used", "case when zen_deg > 89 and zen_deg <= 90 then 89.0 else zen_deg end")], [("zen_used", 5)], where="latitude is not null")
define("esky_prata", [*radiation.CLEAR_SKY, ("ci", "0.3 + (t % 8) / 10.0"), ("esky_cloud", radiation.CLOUDY_SKY)], [("ea", 6), ("esky", 6), ("esky_cloud", 6)])
# -- radiation ---------------------------------------------------------------------
_K = [*SUNNY, *sky.diffuse_fraction(), *SITE, *radiation.WEDGE, ("d_rad", "diffuse * svfbuveg")]
define("wedge_shade", [*SUNNY, *SITE, *radiation.WEDGE], [("f_sh", 4)], where="altitude > 3.0")
define("kdown", [*_K, ("k_down", radiation.K_DOWN)], [("k_down", 3)], where="altitude > 3.0")
define("kup", [*_K, ("k_up", radiation.k_up("(0.15 * lit)", "0.15")), ("k_up_e", radiation.k_up("(0.12 * lit)", "0.14"))], [("k_up", 3), ("k_up_e", 3)], where="altitude > 3.0")
define("kside_direct", [*_K, *((f"k_{s}", radiation.k_direct_side(s)) for s in "eswn"), ("k_side_i", "direct * lit * cos_alt")], [("k_e", 2), ("k_s", 2), ("k_w", 2), ("k_n", 2), ("k_side_i", 2)], where="altitude > 3.0 and abs(azimuth - 90.0) > 1e-6 and abs(azimuth - 180.0) > 1e-6 and abs(azimuth - 270.0) > 1e-6")
define("k_weights", [*SITE, *radiation.k_weights()], [("kw_wall", 6), ("kw_veg", 6)])
define("l_weights", [*SITE, *radiation.l_weights()], [("lw_wall", 6), ("lw_veg", 6), ("lw_sky", 6), ("lw_refl", 6)])
_L = [*SITE, *radiation.CLEAR_SKY, ("ci", "0.3 + (t % 8) / 10.0"), ("tg_wall", "0.01 * radg"), *radiation.l_down()]
define("ldown_iso", _L, [("l_down", 4)])
_TG = [*SUNNY, ("altmax", "90.0 - abs(latitude - dec_deg)"), ("tgk", "0.37 + 0.0 * ta"), ("tstart", "-3.41 + 0.0 * ta"), ("tmax_h", "15.0"), *radiation.CLEAR_GLOBAL, ("ci_surface", radiation.CI_SURFACE), *radiation.SURFACE_WAVE]
define("surface_wave", _TG, [("tg_wave", 5), ("tg", 4)], where="altitude > 3.0 and abs(tmax_h - sunrise) > 0.01")
define("night_branch", [*sky.LOCAL_SUN, ("tg", "0.0"), ("night", "altitude <= 0"), ("k_any", "case when night then 0.0 else radg end"), ("l_up", radiation.ground_flux())], [("night", None), ("k_any", 4), ("l_up", 4)], where="latitude is not null and abs(altitude) > 1e-6")
_FLUX = [
    *_TG, *sky.diffuse_fraction(), *SITE, *radiation.WEDGE, ("d_rad", "diffuse * svfbuveg"), *radiation.CLEAR_SKY, ("tg_wall", "greatest(0.6 * tg, 0.0)"), *radiation.l_down(),
    ("k_down", radiation.K_DOWN), ("k_up", radiation.k_up("(0.15 * lit)", "0.15")), ("k_side_i", "direct * lit * cos_alt"),
    ("l_up", radiation.ground_flux("ta", "(tg * lit)")), *radiation.k_weights(), *radiation.l_weights(), *radiation.FOUR_SIDES,
]
#: A reading has no patches of sky: the anisotropic form is that of the pipeline over cells.
for _kind in ("cyl_iso", "box"):
    _form = radiation.SSTR[_kind]
    define(f"sstr_{_kind}", [*_FLUX, ("sstr", _form), ("tmrt", radiation.mean_radiant(_form))], [("sstr", 3), ("tmrt", 3)], where="altitude > 3.0 and abs(tmax_h - sunrise) > 0.01 and " + " and ".join(f"abs(azimuth - {a}) > 1e-6" for a in (90.0, 180.0, 270.0)))
# -- comfort --------------------------------------------------------------------------
define("utci", [*AIR, *comfort.UTCI], [("utci", 5)])
define("utci_category", [*AIR, *comfort.UTCI, ("utci_r", "round(utci, 3)"), ("stress", comfort.utci_class("utci_r"))], [("stress", None)])
define("utci_only_recompute", [*AIR, *comfort.UTCI, ("before", "utci"), ("va2", "case when wind is not null then greatest(0.7 * wind, 0.15) end"), ("after", comfort.utci_polynomial(va="va2")), ("delta", "after - before")], [("before", 5), ("after", 5), ("delta", 5)], where="tmrt is not null and rh is not null and va is not null")
_T = [("t_k", "ta + 273.15"), ("p_pa", "p * 100.0")]
define("saturation_pressure", [*_T, ("omega", comfort.ice_fraction("t_k")), ("es_liquid", comfort.saturation_pressure("t_k")), ("es_ice", comfort.saturation_pressure("t_k", "ice")), ("es_mixed", comfort.saturation_pressure("t_k", "mixed", "omega"))], [("omega", 6), ("es_liquid", 4), ("es_ice", 4), ("es_mixed", 4)], where="ta > -80.0 and ta < 70.0")
_Q = [*_T, ("rh_part", "rh / 100.0"), ("e_pa", f"rh_part * ({comfort.saturation_pressure('t_k')})"), ("q", comfort.specific_humidity("p_pa", "e_pa"))]
_SANE = "ta > -60.0 and ta < 60.0 and rh > 1.0 and rh <= 100.0 and p is not null"
define("specific_humidity", _Q, [("q", 8)], where=_SANE)
define("dewpoint_lambertw", [*_Q, *comfort.dew_point()], [("td_k", 4)], where=_SANE)
define("frost_point", [*_T, ("rh_part", "rh / 100.0"), *comfort.dew_point("ice")], [("td_k", 4)], where=_SANE)
define("wet_bulb", [*_Q, *comfort.dew_point(), *comfort.wet_bulb(5)], [("tw_k", 4)], where=_SANE)
define("black_globe", [*AIR, *comfort.GLOBE], [("globe", 3)], where="ta > -60.0 and ta < 60.0 and radg >= 0 and radg < 2000.0")
define("wbgt", [*AIR, *comfort.GLOBE, *_Q, *comfort.dew_point(), *comfort.wet_bulb(5), *SITE, ("tw_c", "tw_k - 273.15"), ("wbgt", comfort.wbgt())], [("wbgt", 3)], where=_SANE + " and radg >= 0 and radg < 2000.0")
