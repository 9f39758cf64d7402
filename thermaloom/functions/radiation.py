"""Radiation at a standing person: short and long wave, surface temperature, absorbed flux, mean radiant temperature."""

from __future__ import annotations

from thermaloom.functions.formula import Step, wrap360

#: Fixed value: the Stefan-Boltzmann constant as the radiation model rounds it.
SBC = "5.67051e-8"
ALBEDO_WALL, ALBEDO_GROUND, EMIS_WALL, EMIS_GROUND = 0.20, 0.15, 0.90, 0.95
ABS_K, ABS_L = 0.70, 0.95
F_SIDE, F_UP, F_CYL = 0.22, 0.06, 0.28
F_SIDE_BOX, F_UP_BOX = 0.166666, 0.166667
VIKT_TOTAL = 4.4897

#: Vapour pressure (hPa) and Prata's clear-sky emissivity from ta, rh.
CLEAR_SKY: list[Step] = [
    ("ea", "6.107 * pow(10.0, 7.5 * ta / (237.3 + ta)) * rh / 100.0"),
    ("prata", "46.5 * ea / (ta + 273.15)"),
    ("esky", "1.0 - (1.0 + prata) * exp(-sqrt(1.2 + 3.0 * prata))"),
]
#: Clouds: emissivity goes to one as the clearness goes to nothing.
CLOUDY_SKY = "case when ci < 0.95 then ci * esky + 1.0 - ci else esky end"

#: Surface temperature above the air by day: amplitude from the day's largest sun altitude, quarter sine since sunrise.
#: From altmax, tgk, tstart, tmax_h, hour, sunrise, ci_surface.
SURFACE_WAVE: list[Step] = [
    ("tg_amp", "tgk * altmax + tstart"),
    ("tg_wave", "tg_amp * sin((hour - sunrise) / (tmax_h - sunrise) * pi() / 2.0)"),
    ("tg", "greatest(tg_wave * ci_surface, 0.0)"),
]

#: Global radiation under a clear sky, split by the diffuse fraction at a clearness of one, from i0, sin_alt, altitude, ta, rh.
CLEAR_GLOBAL: list[Step] = [
    ("clear_diffuse", "least(i0, i0 * (0.426 - 0.256 * sin_alt + 0.00349 * ta + 0.0734 * rh / 100.0))"),
    ("clear_beam", "case when sin_alt > 1e-9 then greatest(0.0, (i0 - clear_diffuse) / sin_alt) end"),
    ("clear_global", "case when altitude < 1.0 and clear_beam > i0 then i0 else clear_beam end * sin_alt + clear_diffuse"),
]
#: How far the surface warms of what a clear sky would give, corrected for a low sun.
CI_SURFACE = "case when clear_global > 1e-6 then least(1.0, radg / clear_global + 1.0 - low_sun) else 0.0 end"

#: Share of walls in shade as seen by a cylinder, from zen and svfalfa (both radians); a half where undefined.
WEDGE: list[Step] = [
    ("wd_tan", "tan(svfalfa) * tan(zen)"),
    ("wd_x", "case when abs(wd_tan) > 1e-12 then 1.0 - 2.0 / wd_tan end"),
    ("wd_h", "case when abs(wd_tan) > 1e-12 then 2.0 / wd_tan end"),
    ("wd_b", "case when abs(tan(svfalfa)) > 1e-12 then 1.0 / tan(svfalfa) end"),
    ("wd_q", "case when wd_x < 0 then tan(zen) / 2.0 end"),
    ("wd_z2", "wd_b * wd_b - wd_q * wd_q / 4.0"),
    ("wd_phi", "case when wd_z2 >= 0 and abs(wd_q) > 1e-12 then atan(sqrt(wd_z2) / wd_q) end"),
    ("wd_a", "case when abs(1.0 - cos(wd_phi)) > 1e-12 then (sin(wd_phi) - wd_phi * cos(wd_phi)) / (1.0 - cos(wd_phi)) end"),
    ("wd_surface", "2.0 * wd_b * wd_h + case when wd_x < 0 then 2.0 * wd_b * wd_x * wd_a else 0.0 end"),
    ("f_sh", "coalesce((2.0 * pi() * wd_b - wd_surface) / (2.0 * pi() * wd_b), 0.5)"),
]


def side_weight(x: str) -> str:
    """Sixth-order weight of a sky view factor for a vertical side."""
    return f"(63.227 * pow({x}, 6.0) - 161.51 * pow({x}, 5.0) + 156.91 * pow({x}, 4.0) - 70.424 * pow({x}, 3.0) + 16.773 * pow({x}, 2.0) - 0.4863 * {x})"


def k_weights(svf: str = "svf", svfveg: str = "svfveg") -> list[Step]:
    """Weights of walls and vegetation in the short-wave side fluxes."""
    return [
        ("kw_wall", f"({VIKT_TOTAL} - {side_weight(svf)}) / {VIKT_TOTAL}"),
        ("kw_both", f"({svfveg} + {svf} - 1.0)"),
        ("kw_veg", f"({VIKT_TOTAL} - {side_weight('kw_both')}) / {VIKT_TOTAL} - kw_wall"),
    ]


def l_weights(svf: str = "svf", svfveg: str = "svfveg", svfaveg: str = "svfaveg") -> list[Step]:
    """Weights of wall, sky, vegetation and reflection in the long-wave side fluxes."""
    return [
        ("lw_wall", f"({side_weight(svfaveg)} - {side_weight(svf)}) / {VIKT_TOTAL}"),
        ("lw_both", f"({svfveg} + {svf} - 1.0)"),
        ("lw_sky", f"{side_weight('lw_both')} / {VIKT_TOTAL}"),
        ("lw_refl", f"({VIKT_TOTAL} - {side_weight('lw_both')}) / {VIKT_TOTAL}"),
        ("lw_veg", "lw_refl - lw_wall"),
    ]


#: What walls send back, from radg, diffuse, f_sh and svfbuveg.
WALL_REFLECTION = f"{ALBEDO_WALL} * (1.0 - svfbuveg) * (radg * (1.0 - f_sh) + diffuse * f_sh)"
#: Downward short wave from direct, lit, sin_alt and the diffuse sky d_rad.
K_DOWN = f"direct * lit * sin_alt + d_rad + {WALL_REFLECTION}"


def k_up(gvf: str, gvf_nosh: str) -> str:
    """Upward short wave from the view of lit and of all ground, each weighted by albedo."""
    return f"{gvf} * direct * sin_alt + (diffuse * svfbuveg + {WALL_REFLECTION}) * {gvf_nosh}"


#: Direct short wave on the four sides of a box, from azimuth, direct, lit, cos_alt.
SIDES = {"e": 0.0, "s": 90.0, "w": 180.0, "n": 270.0}


def k_direct_side(side: str) -> str:
    """A side gets sun while the azimuth is less than a half turn beyond its start; the east side starts at 0."""
    start = SIDES[side]
    seen = f"azimuth > {start} and azimuth <= {start + 180.0}" if side != "n" else "azimuth <= 90.0 or azimuth > 270.0"
    seen = "azimuth <= 180.0 or azimuth > 360.0" if side == "e" else seen
    return f"case when {seen} then direct * lit * cos_alt * sin((azimuth - {start}) * (pi() / 180.0)) else 0.0 end"


def ground_flux(t: str = "ta", tg: str = "tg", emissivity: str | float = EMIS_GROUND) -> str:
    return f"{SBC} * {emissivity} * pow({t} + {tg} + 273.15, 4.0)"


#: Downward long wave under an isotropic sky with walls and trees, clouds mixed in; from svf, svfveg, svfaveg, esky, ci, ta, tg_wall.
def l_down(ta: str = "ta", wall: str = "tg_wall") -> list[Step]:
    air, warm = f"{SBC} * pow({ta} + 273.15, 4.0)", f"{SBC} * pow({ta} + 273.15 + {wall}, 4.0)"

    def form(e: str) -> str:
        return f"(svf + svfveg - 1.0) * {e} * {air} + (2.0 - svfveg - svfaveg) * {EMIS_WALL} * {air} + (svfaveg - svf) * {EMIS_WALL} * {warm} + (2.0 - svf - svfveg) * (1.0 - {EMIS_WALL}) * {e} * {air}"

    return [("ld_clear", form("esky")), ("ld_cloud", form("1.0")), ("l_down", "case when ci < 0.95 then ci * ld_clear + (1.0 - ci) * ld_cloud else ld_clear end")]


#: Sum over the four sides of a site that is alike in all directions, under an isotropic sky, from k_weights, l_weights, radg, diffuse, f_sh, k_up,
#: l_down, l_up, esky, ci, ta, tg_wall, azimuth, svf, svfveg. The sun heats the walls that a side sees while it stands within half a turn beyond ``HEATED``.
HEATED = {"e": 180.0, "s": 270.0, "w": 0.0, "n": 90.0}
FOUR_SIDES: list[Step] = [
    ("sides_seen", "kw_wall + kw_veg * 0.97"),
    ("k_sides", f"2.0 * (diffuse * (1.0 - sides_seen) + {ALBEDO_WALL} * sides_seen * (radg * (1.0 - f_sh) + diffuse * f_sh) + k_up)"),
    ("sides_turn", "2.0 * f_sh - 1.0"), ("sides_alfa", "asin(sqrt(1.0 - svf))"), ("sides_high", "cos((atan(sides_alfa) + atan(tan(sides_alfa * sides_turn))) / 2.0)"),
    ("sides_air", f"{SBC} * pow(ta + 273.15, 4.0)"), ("sides_ci", "least(coalesce(ci, 1.0), 1.0)"),
    *((f"sides_at_{x}", wrap360(f"azimuth + 360.0 - {start}")) for x, start in HEATED.items()),
    *((f"sides_wall_{x}", f"case when sides_at_{x} > 0.0 and sides_at_{x} <= 180.0 then {SBC} * pow(ta + 273.15 + tg_wall * sin(sides_at_{x} * (pi() / 180.0)), 4.0) * (1.0 - sides_turn) * sides_high + sides_air * sides_turn else sides_air end") for x in HEATED),
    ("l_sides", f"2.0 * ((svf + svfveg - 1.0) * sides_air * (esky * sides_ci + 1.0 - sides_ci) * lw_sky + {EMIS_WALL} * sides_air * lw_veg + l_up + (l_down + l_up) * lw_refl * (1.0 - {EMIS_WALL})) + 0.5 * {EMIS_WALL} * lw_wall * (" + " + ".join(f"sides_wall_{x}" for x in HEATED) + ")"),
]

#: Absorbed flux of a cylinder under an isotropic sky, of a cylinder under an anisotropic sky, and of a box.
SSTR = {
    "cyl_iso": f"{ABS_K} * (k_side_i * {F_CYL} + (k_down + k_up) * {F_UP} + k_sides * {F_SIDE}) + {ABS_L} * ((l_down + l_up) * {F_UP} + l_sides * {F_SIDE})",
    "cyl_aniso": f"{ABS_K} * (k_side * {F_CYL} + (k_down + k_up) * {F_UP} + k_sides * {F_SIDE}) + {ABS_L} * ((l_down + l_up) * {F_UP} + l_side * {F_CYL} + l_sides * {F_SIDE})",
    "box": f"{ABS_K} * ((k_down + k_up) * {F_UP_BOX} + k_sides * {F_SIDE_BOX}) + {ABS_L} * ((l_down + l_up) * {F_UP_BOX} + l_sides * {F_SIDE_BOX})",
}


def mean_radiant(sstr: str) -> str:
    """Fixed value: the offset to degrees Celsius is 273.2 here."""
    return f"case when ({sstr}) > 0 then sqrt(sqrt(({sstr}) / ({ABS_L} * {SBC}))) - 273.2 end"
