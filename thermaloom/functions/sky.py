"""Sun and sky: position, day length, clearness, diffuse fraction, luminance, emissivity, sky patches."""

from __future__ import annotations

from thermaloom.functions.formula import Step, wrap360

DEG = "(pi() / 180.0)"

#: Julian day (UT) of a timestamp: days since 2000-01-01 12:00 plus the epoch's number; ``sec`` is seconds since 1970.
JULIAN: list[Step] = [("jd", "sec / 86400.0 + 2440587.5"), ("jc", "(jd - 2451545.0) / 36525.0")]

#: Apparent place of the sun, from jd, latitude, longitude (degrees east): the low-precision series of the
#: Astronomical Almanac, good to 0.01 degrees between 1950 and 2050.
SUN: list[Step] = [
    *JULIAN,
    ("sun_n", "jd - 2451545.0"),
    ("sun_l", wrap360("280.460 + 0.9856474 * sun_n")),
    ("sun_g", f"{wrap360('357.528 + 0.9856003 * sun_n')} * {DEG}"),
    ("ecl_lon", f"(sun_l + 1.915 * sin(sun_g) + 0.020 * sin(2.0 * sun_g)) * {DEG}"),
    ("obliquity", f"(23.439 - 0.0000004 * sun_n) * {DEG}"),
    ("right_ascension", "atan2(cos(obliquity) * sin(ecl_lon), cos(ecl_lon))"),
    ("declination", "asin(sin(obliquity) * sin(ecl_lon))"),
    ("gmst", wrap360("280.46061837 + 360.98564736629 * sun_n")),
    ("hour_angle", f"(gmst + longitude) * {DEG} - right_ascension"),
    ("sin_alt", f"sin(latitude * {DEG}) * sin(declination) + cos(latitude * {DEG}) * cos(declination) * cos(hour_angle)"),
    ("altitude", "asin(least(1.0, greatest(-1.0, sin_alt))) / (pi() / 180.0)"),
    ("azimuth", wrap360(f"180.0 + atan2(sin(hour_angle), cos(hour_angle) * sin(latitude * {DEG}) - tan(declination) * cos(latitude * {DEG})) / {DEG}")),
]

#: The same from local solar time: doy, hour (0..24), latitude.
LOCAL_SUN: list[Step] = [
    ("day_angle", "2.0 * pi() * (doy - 1.0) / 365.0"),
    ("declination", "0.006918 - 0.399912 * cos(day_angle) + 0.070257 * sin(day_angle) - 0.006758 * cos(2.0 * day_angle) + 0.000907 * sin(2.0 * day_angle) - 0.002697 * cos(3.0 * day_angle) + 0.00148 * sin(3.0 * day_angle)"),
    ("hour_angle", f"15.0 * (hour - 12.0) * {DEG}"),
    ("sin_alt", f"sin(latitude * {DEG}) * sin(declination) + cos(latitude * {DEG}) * cos(declination) * cos(hour_angle)"),
    ("altitude", "asin(least(1.0, greatest(-1.0, sin_alt))) / (pi() / 180.0)"),
    ("azimuth", wrap360(f"180.0 + atan2(sin(hour_angle), cos(hour_angle) * sin(latitude * {DEG}) - tan(declination) * cos(latitude * {DEG})) / {DEG}")),
    ("zen", "pi() / 2.0 - asin(least(1.0, greatest(-1.0, sin_alt)))"),
]

#: Day length and sunrise in hours from doy and latitude.
DAY_LENGTH: list[Step] = [
    ("dec_deg", "-23.45 * cos(2.0 * pi() * (doy + 10.0) / 365.0)"),
    ("day_sine", f"least(1.0, greatest(-1.0, tan(dec_deg * {DEG}) * tan(latitude * {DEG})))"),
    ("day_hours", "12.0 + 24.0 * asin(day_sine) / pi()"),
    ("sunrise", "12.0 - day_hours / 2.0"),
    ("sunset", "12.0 + day_hours / 2.0"),
]

SUN_DISTANCE: list[Step] = [
    ("sd_b", "2.0 * pi() * doy / 365.0"),
    ("sun_distance", "sqrt(1.00011 + 0.034221 * cos(sd_b) + 0.001280 * sin(sd_b) + 0.000719 * cos(2.0 * sd_b) + 0.000077 * sin(2.0 * sd_b))"),
]

# Water-vapour constant by latitude band (10 degrees each, from the equator) and season (winter, spring, summer, autumn).
VAPOUR_BANDS = (
    (3.37, 2.85, 2.80, 2.64), (2.99, 3.02, 2.70, 2.93), (3.60, 3.00, 2.98, 2.93), (3.04, 3.11, 2.92, 2.94), (2.70, 2.95, 2.77, 2.71),
    (2.52, 3.07, 2.67, 2.93), (1.76, 2.69, 2.61, 2.61), (1.60, 1.67, 2.24, 2.63), (1.11, 1.44, 1.94, 2.02),
)


def _vapour_constant() -> str:
    season = lambda row: f"case when doy > 335 or doy <= 60 then {row[0]} when doy <= 152 then {row[1]} when doy <= 244 then {row[2]} else {row[3]} end"
    bands = " ".join(f"when latitude < {10 * (i + 1)} then {season(row)}" for i, row in enumerate(VAPOUR_BANDS))
    return f"case {bands} end"


#: Clearness index of Crawford and Duchon from zen (radians), doy, ta, rh (percent), radg, p_kpa, latitude.
#: Null at night and where an input is missing; latitudes south of 10 degrees north share the first band.
CLEARNESS: list[Step] = [
    *SUN_DISTANCE,
    ("up", "case when zen < pi() / 2.0 - 1e-9 then cos(zen) end"),
    ("air_mass", "35.0 * up / sqrt(1224.0 * up * up + 1.0)"),
    ("p_mb", "coalesce(p_kpa * 10.0, 1013.0)"),
    ("tr_gas", "1.021 - 0.084 * sqrt(air_mass * (0.000949 * p_mb + 0.051))"),
    ("vapour_g", _vapour_constant()),
    ("dew_x", "case when rh > 0 then 17.27 * ta / (237.7 + ta) + ln(rh / 100.0) end"),
    ("dew_f", "237.7 * dew_x / (17.27 - dew_x) * 1.8 + 32.0"),
    ("water", "exp(0.1133 - ln(vapour_g + 1.0) + 0.0393 * dew_f)"),
    ("tr_water", "1.0 - 0.077 * pow(water * air_mass, 0.3)"),
    ("i0", "1370.0 * up * tr_gas * tr_water * sun_distance * pow(0.935, air_mass)"),
    ("low_sun", "0.1473 * ln(90.0 - zen / pi() * 180.0 + case when up is null then 1e9 else 0.0 end) + 0.3454"),
    ("ci", "case when i0 > 1e-6 then radg / i0 + 1.0 - low_sun end"),
    ("i0et", "1370.0 * up * sun_distance"),
    ("kt", "case when i0et > 1e-6 then radg / i0et end"),
]


def diffuse_fraction(radg: str = "radg", kt: str = "kt") -> list[Step]:
    """Reindl's diffuse and direct radiation from radg, kt, sin_alt, altitude, ta, rh; without air data the coarser form."""
    bare = f"case when {kt} <= 0.3 then 1.020 - 0.248 * {kt} when {kt} < 0.78 then 1.45 - 1.67 * {kt} else 0.147 end"
    full = (
        f"case when {kt} <= 0.3 then 1.0 - 0.232 * {kt} + 0.0239 * sin_alt - 0.000682 * ta + 0.0195 * rh / 100.0"
        f" when {kt} < 0.78 then 1.329 - 1.716 * {kt} + 0.267 * sin_alt - 0.00357 * ta + 0.106 * rh / 100.0"
        f" else 0.426 * {kt} - 0.256 * sin_alt + 0.00349 * ta + 0.0734 * rh / 100.0 end"
    )
    return [
        ("df_raw", f"case when {kt} is null or {radg} is null then null when ta is null or rh is null then {radg} * ({bare}) else {radg} * ({full}) end"),
        ("df_beam", f"case when sin_alt > 1e-9 then greatest(0.0, ({radg} - df_raw) / sin_alt) end"),
        ("direct", f"case when altitude < 1.0 and df_beam > {radg} then {radg} else df_beam end"),
        ("diffuse", f"case when df_raw > {radg} then {radg} else df_raw end"),
    ]


# Perez coefficients by clearness class (rows) for a, b, c, d, e, four each.
PEREZ = (
    (1.3525, -0.2576, -0.2690, -1.4366, -0.7670, 0.0007, 1.2734, -0.1233, 2.8000, 0.6004, 1.2375, 1.0000, 1.8734, 0.6297, 0.9738, 0.2809, 0.0356, -0.1246, -0.5718, 0.9938),
    (-1.2219, -0.7730, 1.4148, 1.1016, -0.2054, 0.0367, -3.9128, 0.9156, 6.9750, 0.1774, 6.4477, -0.1239, -1.5798, -0.5081, -1.7812, 0.1080, 0.2624, 0.0672, -0.2190, -0.4285),
    (-1.1000, -0.2515, 0.8952, 0.0156, 0.2782, -0.1812, -4.5000, 1.1766, 24.7219, -13.0812, -37.7000, 34.8438, -5.0000, 1.5218, 3.9229, -2.6204, -0.0156, 0.1597, 0.4199, -0.5562),
    (-0.5484, -0.6654, -0.2672, 0.7117, 0.7234, -0.6219, -5.6812, 2.6297, 33.3389, -18.3000, -62.2500, 52.0781, -3.5000, 0.0016, 1.1477, 0.1062, 0.4659, -0.3296, -0.0876, -0.0329),
    (-0.6000, -0.3566, -2.5000, 2.3250, 0.2937, 0.0496, -5.6812, 1.8415, 21.0000, -4.7656, -21.5906, 7.2492, -3.5000, -0.1554, 1.4062, 0.3988, 0.0032, 0.0766, -0.0656, -0.1294),
    (-1.0156, -0.3670, 1.0078, 1.4051, 0.2875, -0.5328, -3.8500, 3.3750, 14.0000, -0.9999, -7.1406, 7.5469, -3.4000, -0.1078, -1.0750, 1.5702, -0.0672, 0.4016, 0.3017, -0.4844),
    (-1.0000, 0.0211, 0.5025, -0.5119, -0.3000, 0.1922, 0.7023, -1.6317, 19.0000, -5.0000, 1.2438, -1.9094, -4.0000, 0.0250, 0.3844, 0.2656, 1.0468, -0.3788, -2.4517, 1.4656),
    (-1.0500, 0.0289, 0.4260, 0.3590, -0.3250, 0.1156, 0.7781, 0.0025, 31.0625, -14.5000, -46.1148, 55.3750, -7.2312, 0.4050, 13.3500, 0.6234, 1.5000, -0.6426, 1.8564, 0.5636),
)
#: Upper bounds of the clearness classes.
PEREZ_BOUNDS = (1.065, 1.230, 1.500, 1.950, 2.800, 4.500, 6.200)


def _perez(i: int) -> str:
    whens = " ".join(f"when px_class = {k} then {row[i]!r}" for k, row in enumerate(PEREZ))
    return f"(case {whens} end)"


def _perez_linear(first: int) -> str:
    a, b, c, d = (_perez(first + k) for k in range(4))
    return f"{a} + {b} * zen + px_bright * ({c} + {d} * zen)"


#: Parameters of Perez' all-weather luminance from zen, altitude (degrees), diffuse, direct, doy.
PEREZ_STEPS: list[Step] = [
    ("px_z3", "1.041 * pow(zen, 3.0)"),
    ("px_clear", "case when diffuse + px_z3 > 0 then (diffuse + direct) / (diffuse + px_z3) / (1.0 + px_z3) end"),
    ("px_angle", "2.0 * pi() * doy / 365.0"),
    ("px_i0", "1367.0 * (1.00011 + 0.034221 * cos(px_angle) + 0.00128 * sin(px_angle) + 0.000719 * cos(2.0 * px_angle) + 0.000077 * sin(2.0 * px_angle))"),
    ("px_mass", "case when altitude >= 10 then 1.0 / sin(altitude * (pi() / 180.0)) when altitude > 0 then 1.0 / sin(altitude * (pi() / 180.0)) + 0.50572 * pow(altitude + 6.07995, -1.6364) end"),
    ("px_bright", "case when diffuse <= 10 then 0.0 else px_mass * diffuse / px_i0 end"),
    ("px_class", "case " + " ".join(f"when px_clear < {b} then {i}" for i, b in enumerate(PEREZ_BOUNDS)) + f" else {len(PEREZ_BOUNDS)} end"),
    ("px_a", _perez_linear(0)),
    ("px_b", _perez_linear(4)),
    ("px_c", f"case when px_class > 0 then {_perez_linear(8)} else exp(pow(greatest(px_bright * ({_perez(8)} + {_perez(9)} * zen), 0.0), {_perez(10)})) - 1.0 end"),
    ("px_d", f"case when px_class > 0 then {_perez_linear(12)} else -exp(px_bright * ({_perez(12)} + {_perez(13)} * zen)) + {_perez(14)} + px_bright * {_perez(15)} * px_bright end"),
    ("px_e", _perez_linear(16)),
]

#: Relative luminance (not normalized) of a patch from the parameters and patch_alt, patch_azi in degrees.
PATCH_LUMINANCE: list[Step] = [
    ("pl_cos", "sin(patch_alt * (pi() / 180.0)) * sin_alt + cos(asin(sin_alt)) * cos(patch_alt * (pi() / 180.0)) * cos(abs(patch_azi - azimuth) * (pi() / 180.0))"),
    ("luminance", "(1.0 + px_a * exp(px_b / greatest(cos((90.0 - patch_alt) * (pi() / 180.0)), 1e-9))) * (1.0 + px_c * exp(px_d * acos(least(1.0, greatest(-1.0, pl_cos)))) + px_e * pl_cos * pl_cos)"),
]

#: Emissivity of a sky band by three models, from esky and band_alt (degrees); the second is the one in use.
BAND_EMISSIVITY: list[Step] = [
    ("band_cos", "cos((90.0 - band_alt) * (pi() / 180.0))"),
    ("emissivity_1", "0.67 + 0.094 * (esky / 0.094 - 0.67 / 0.094 - 0.5 - ln(band_cos))"),
    ("emissivity_2", "1.0 - (1.0 - esky) * exp(0.308 * (1.7 - 1.0 / band_cos))"),
    ("emissivity_3", "1.0 - pow(1.0 - esky, 1.0 / (1.8 * band_cos))"),
]

# Sky divisions. Band altitudes, first azimuths, patches in a band, annuli bounds.
_ALT = (6, 18, 30, 42, 54, 66, 78, 90)
_AZI = (0, 4, 2, 5, 8, 0, 10, 0)
_ANNULI = (0, 12, 24, 36, 48, 60, 72, 84, 90)
_FINE_ALT = (3, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 75, 81, 90)
_FINE_ANNULI = (0, 4.5, 9, 15, 21, 27, 33, 39, 45, 51, 57, 63, 69, 75, 81, 90)
_COUNTS = (31, 30, 28, 24, 19, 13, 7)
DIVISIONS = {
    1: (_ALT, _AZI, (30, 30, 24, 24, 18, 12, 6, 1), _ANNULI),
    2: (_ALT, _AZI, (*_COUNTS, 1), _ANNULI),
    3: (_ALT, _AZI, (*(2 * c for c in _COUNTS), 1), _ANNULI),
    4: (_FINE_ALT, tuple(a for a in _AZI[:7] for _ in range(2)) + (0,), (*(2 * c for c in _COUNTS for _ in range(2)), 1), _FINE_ANNULI),
}


def bands(option: int = 2) -> list[tuple]:
    """(band, altitude, first azimuth, patches, lower annulus, upper annulus) of a sky division."""
    alt, azi, count, annuli = DIVISIONS[option]
    return [(i, float(alt[i]), float(azi[i]), count[i], float(annuli[i]), float(annuli[i + 1])) for i in range(len(alt))]


def bands_sql(option: int = 2) -> str:
    rows = ", ".join(f"({b}, {a}e0, {z}e0, {n}, {lo}e0, {hi}e0)" for b, a, z, n, lo, hi in bands(option))
    return f"select * from (values {rows}) v(band, band_alt, azi_0, n_patches, annulus_lo, annulus_hi)"


#: Weight of one annulus (91 minus its altitude counts from the zenith) in a band of n patches.
def annulus_weight(annulus: str, n: str) -> str:
    return f"(2.0 * pi() / {n}) * (1.0 / (2.0 * pi())) * sin(pi() / 180.0) * sin(pi() * (2.0 * (91.0 - {annulus}) - 1.0) / 180.0)"


#: Solid angle of a patch from band_alt, n_patches, first_alt (lowest band) and below_alt (band underneath).
STERADIAN = f"(2.0 * pi() / n_patches) * case when n_patches > 1 then sin((band_alt + first_alt) * {DEG}) - sin((band_alt - first_alt) * {DEG}) else sin(band_alt * {DEG}) - sin((below_alt + first_alt) * {DEG}) end"
