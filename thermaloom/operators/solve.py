"""One zone of a city through its steps: shadows, surface temperature, and the fluxes at a standing person.

A kernel over arrays for what plain expressions cannot state: marches, and a state
that is carried from step to step. What does not change with time (side weights of the
sky view) is worked out once for a zone and not once for each step. Formulas are those
of ``functions/radiation.py``, to which the tests compare.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from thermaloom.functions import radiation as rad
from thermaloom.functions.comfort import UTCI_COEFFICIENTS
from thermaloom.operators.march import BITS, TRANSMISSION, patches, shadows, visible
from thermaloom.operators.raster import step_table

SBC = float(rad.SBC)
#: The sides with the span of azimuths from which the sun heats the walls seen on that side, and where the span starts.
SIDES = {"e": 180.0, "s": 270.0, "w": 0.0, "n": 90.0}
#: Decay of the surface temperature, a day, and the gap from which a step renews the state, in hours.
DECAY, RENEW = 33.27, 59 / 60 - 1e-9
STATIC = ("ground", "albedo", "emissivity", "tgk", "tstart", "tmax_h", "svf", "veg", "aveg", *(f"{k}_{s}" for k in ("svf", "veg", "aveg") for s in SIDES))
#: Parameters of the luminance of the sky, null where it is alike all over.
PEREZ = ("px_a", "px_b", "px_c", "px_d", "px_e")
STEP = (*PEREZ, "hour", "altitude", "azimuth", "zen", "sin_alt", "cos_alt", "sunrise", "altmax", "psi", "ci_surface", "ci_used", "esky", "ta", "radg", "beam", "scatter", "tg_wall")
OUT = ("lit", "l_up", "k_down", "tmrt")
#: What comfort needs of a step besides, and what is folded over the steps of a series.
AIR, FELT = ("va", "pa", "tw_c", "bg_a"), ("tmrt", "utci", "wbgt")
#: So many numbers are worked out at once for the sky over all cells in several steps.
AT_ONCE = 1 << 20


def side_weight(x: np.ndarray) -> np.ndarray:
    return (((((63.227 * x - 161.51) * x + 156.91) * x - 70.424) * x + 16.773) * x - 0.4863) * x


def shaded_share(zen: float, svfalfa: np.ndarray) -> np.ndarray:
    """Share of the walls around a cylinder that lies in shade; a half where undefined."""
    with np.errstate(all="ignore"):
        edge, sun = np.tan(svfalfa), np.tan(zen)
        x, height, base = 1 - 2 / (edge * sun), 2 / (edge * sun), 1 / edge
        q = sun / 2
        phi = np.arctan(np.sqrt(base**2 - q**2 / 4) / q)
        cap = (np.sin(phi) - phi * np.cos(phi)) / (1 - np.cos(phi))
        surface = 2 * base * height + np.where(x < 0, 2 * base * x * cap, 0.0)
        share = (2 * np.pi * base - surface) / (2 * np.pi * base)
    return np.where(np.isfinite(share), share, 0.5)


class Site:
    """What the cells of a zone see, once for all steps."""

    def __init__(self, s: dict[str, np.ndarray]) -> None:
        self.s = s
        both = s["svf"] + s["veg"] - 1
        with np.errstate(all="ignore"):
            self.alfa = np.where((both < 1 - 1e-9) & (both > 0), np.arcsin(np.sqrt(1 - both)), np.nan)
        self.buveg = s["svf"] - (1 - s["veg"]) * (1 - TRANSMISSION)
        total = rad.VIKT_TOTAL
        self.k, self.l = {}, {}
        for x in SIDES:
            svf, veg, aveg = s[f"svf_{x}"], s[f"veg_{x}"], s[f"aveg_{x}"]
            open_ = side_weight(veg + svf - 1)
            wall = (total - side_weight(svf)) / total
            self.k[x] = wall + ((total - open_) / total - wall) * (1 - TRANSMISSION)
            behind = (side_weight(aveg) - side_weight(svf)) / total
            with np.errstate(invalid="ignore"):
                alfa = np.arcsin(np.sqrt(np.clip(1 - svf, 0, 1)))
            self.l[x] = (behind, open_ / total, (total - open_) / total, veg + svf - 1, alfa)


class Dome:
    """The sky and what stands before it, patch by patch, for the cells of a zone."""

    def __init__(self, bits: dict[str, np.ndarray], svf: np.ndarray, option: int = 2) -> None:
        p = patches(option)
        self.alt, self.azi = np.radians([x[0] for x in p]), np.array([x[1] for x in p])
        count, first = np.array([x[2] for x in p]), self.alt[0]
        below = np.concatenate([[0.0], self.alt[:-1]])
        wide = np.sin(self.alt + first) - np.sin(self.alt - first)
        self.solid = 2 * np.pi / count * np.where(count > 1, wide, np.sin(self.alt) - np.sin(below + first))
        self.side, self.down = self.solid * np.cos(self.alt), self.solid * np.sin(self.alt)
        sh, veg, behind = visible(bits, option)
        self.open_ = (sh - (1.0 - veg) * (1 - TRANSMISSION)).astype(np.float64)
        wall = ~sh & behind
        self.wall = wall.T.copy()
        toward = np.stack([self.side, self.down], axis=1)
        self.green = (~veg | ~behind) @ toward
        self.walls = wall @ toward
        self.mirror = (~sh | ~veg | ~behind) @ toward
        # the emissivity of the sky is that of a band
        bands, at = np.unique(self.alt, return_inverse=True)
        one = np.eye(len(bands))[at]
        self.sky_side, self.sky_down = (sh & veg) @ (one * self.side[:, None]), (sh & veg) @ (one * self.down[:, None])
        self.path = 1 / np.cos(np.pi / 2 - bands)
        with np.errstate(invalid="ignore"):
            self.rise = np.tan(np.arccos(np.sqrt(np.clip(svf, 0, 1))))

    def luminance(self, step: dict) -> np.ndarray:
        """Share of each patch in the diffuse light."""
        if any(step[x] is None for x in PEREZ):
            return np.full(len(self.alt), 1 / len(self.alt))
        a, b, c, d, e = (step[x] for x in PEREZ)
        towards = np.sin(self.alt) * step["sin_alt"] + step["cos_alt"] * np.cos(self.alt) * np.cos(np.radians(self.azi - step["azimuth"]))
        with np.errstate(over="ignore"):
            bright = (1 + a * np.exp(b / np.maximum(np.sin(self.alt), 1e-9))) * (1 + c * np.exp(d * np.arccos(np.clip(towards, -1, 1))) + e * towards**2)
        return bright / bright.sum()

    def skies(self, steps: Sequence[dict]) -> Iterator[tuple[np.ndarray, ...]]:
        """By cell, for each of the steps that is by day: diffuse light of the open sky on the level and from the side, and of the walls that the sun lights
        all from the side, those opposite to it from the side and down.

        What is summed over the same patches for all cells is one product for many steps.
        """
        days = [s for s in steps if s["altitude"] > 0]
        size = max(1, AT_ONCE // max(1, 5 * len(self.rise)))
        low, high = self.rise.min(initial=np.inf), self.rise.max(initial=-np.inf)
        for first in range(0, len(days), size):
            some = days[first : first + size]
            bright, beside, wide, edges = [], [], [], []
            for s in some:
                x = self.luminance(s)
                bright.append(x * s["scatter"])
                beside.append(bright[-1] * self.side / (x * self.down).sum())
                turn = np.abs(s["azimuth"] - self.azi)
                which = (turn > 90) & (turn < 270)
                wide.append(np.stack([self.side, self.side * which, self.down * which]))
                # a wall is lit where the cell's sky rises less than this
                edges.append(np.tan(self.alt) - np.minimum(2 * np.cos(np.radians(turn)) * np.tan(np.radians(s["altitude"])), 0.0))
            every = [w * (e > high) for w, e in zip(wide, edges)]
            n = len(some)
            sky = np.array([*bright, *beside]) @ self.open_.T
            lit = (np.concatenate(every) @ self.wall).reshape(n, 3, -1)
            for i, (w, e) in enumerate(zip(wide, edges)):
                p = np.flatnonzero((e > low) & (e <= high))  # for some cells and not for others
                yield sky[i], sky[n + i], *(lit[i] + w[:, p] @ (self.wall[p] & (self.rise < e[p, None])))


def anisotropic(site: Site, dome: Dome, step: dict, lit: np.ndarray, l_up: np.ndarray, skies: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Downward short wave and mean radiant temperature under a sky that is brighter here than there."""
    s, day = site.s, step["altitude"] > 0
    ta = step["ta"] + 273.15
    ew, aw = rad.EMIS_WALL, rad.ALBEDO_WALL
    k_down = k_up = k_side = np.zeros(len(lit))
    if day:
        share = shaded_share(step["zen"], site.alfa)
        reflected = aw * (1 - site.buveg) * (step["radg"] * (1 - share) + step["scatter"] * share)
        sky, beside, on, *hot = next(skies)
        k_down = step["beam"] * lit * step["sin_alt"] + sky + reflected
        k_up = s["albedo"] * lit * step["beam"] * step["sin_alt"] + (step["scatter"] * site.buveg + reflected) * s["albedo"]
        dark = aw * step["scatter"] * 0.5 / np.pi
        sunny = (aw * step["beam"] * step["cos_alt"] + step["scatter"] * 0.5) / np.pi
        k_side = step["beam"] * lit * step["cos_alt"] + beside + dark * dome.green[:, 0] + sunny * on + dark * (dome.walls[:, 0] - on)
    ci = step["ci_used"]
    esky = ci * step["esky"] + 1 - ci if ci < 0.95 else step["esky"]
    air = SBC * ta**4
    from_sky = (1 - (1 - esky) * np.exp(0.308 * (1.7 - dome.path))) * air / np.pi
    sky_side, sky_down = dome.sky_side @ from_sky, dome.sky_down @ from_sky
    cold, warm = ew * air / np.pi, ew * SBC * (ta + step["tg_wall"]) ** 4 / np.pi
    if not day:
        hot = np.zeros((2, len(lit)))
    back = (sky_down + l_up) * (1 - ew) * 0.5 / np.pi
    l_side, l_down = (sky + cold * dome.green[:, i] + warm * hot[i] + cold * (dome.walls[:, i] - hot[i]) + back * dome.mirror[:, i] for i, sky in ((0, sky_side), (1, sky_down)))
    absorbed = rad.ABS_K * (k_side * rad.F_CYL + (k_down + k_up) * rad.F_UP + 2 * k_up * rad.F_SIDE) + rad.ABS_L * ((l_down + l_up) * rad.F_UP + l_side * rad.F_CYL + 2 * l_up * rad.F_SIDE)
    with np.errstate(invalid="ignore"):
        return k_down, np.sqrt(np.sqrt(absorbed / (rad.ABS_L * SBC))) - 273.2


def fluxes(site: Site, step: dict, lit: np.ndarray, l_up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Downward short wave and mean radiant temperature under an isotropic sky."""
    s, day = site.s, step["altitude"] > 0
    air = SBC * (step["ta"] + 273.15) ** 4
    ew, aw = rad.EMIS_WALL, rad.ALBEDO_WALL
    ci, esky = step["ci_used"], step["esky"]
    share = shaded_share(step["zen"], site.alfa) if day else np.full(len(lit), 0.5)
    if day:
        walls = step["radg"] * (1 - share) + step["scatter"] * share
        reflected = aw * (1 - site.buveg) * walls
        sky = step["scatter"] * site.buveg
        k_down = step["beam"] * lit * step["sin_alt"] + sky + reflected
        k_up = s["albedo"] * lit * step["beam"] * step["sin_alt"] + (sky + reflected) * s["albedo"]
        k_direct = step["beam"] * lit * step["cos_alt"]
        k_sides = sum(0.5 * (step["scatter"] * (1 - v) + aw * v * walls + k_up) for v in site.k.values())
    else:
        k_down = k_up = k_direct = k_sides = np.zeros(len(lit))
    hot = SBC * (step["ta"] + 273.15 + step["tg_wall"]) ** 4

    def down(e: float) -> np.ndarray:
        return (s["svf"] + s["veg"] - 1) * e * air + (2 - s["veg"] - s["aveg"]) * ew * air + (s["aveg"] - s["svf"]) * ew * hot + (2 - s["svf"] - s["veg"]) * (1 - ew) * e * air

    l_down = ci * down(esky) + (1 - ci) * down(1.0) if ci < 0.95 else down(esky)
    sky_air = air * (esky * ci + 1 - ci)
    turned = 2 * share - 1
    l_sides = np.zeros(len(lit))
    for x, (behind, open_, refl, seen, alfa) in site.l.items():
        angle = (step["azimuth"] - SIDES[x]) % 360.0
        if day and 0 < angle <= 180:
            a, b = np.arctan(alfa), np.arctan(np.tan(alfa * turned))
            warm = SBC * (step["ta"] + 273.15 + step["tg_wall"] * np.sin(np.radians(angle))) ** 4
            wall = ew * behind * 0.5 * (warm * (1 - turned) * np.cos((a + b) / 2) + air * turned)
        else:
            wall = ew * behind * 0.5 * air
        l_sides += 0.5 * (seen * sky_air * open_ + ew * air * (refl - behind) + l_up + (l_down + l_up) * refl * (1 - ew)) + wall
    absorbed = rad.ABS_K * (k_direct * rad.F_CYL + (k_down + k_up) * rad.F_UP + k_sides * rad.F_SIDE) + rad.ABS_L * ((l_down + l_up) * rad.F_UP + l_sides * rad.F_SIDE)
    with np.errstate(invalid="ignore"):
        return k_down, (absorbed / (rad.ABS_L * SBC)) ** 0.25 - 273.2


def each(planes: Sequence[np.ndarray], at: tuple[np.ndarray, np.ndarray], static: dict[str, np.ndarray], steps: Sequence[dict], series: Sequence, top: float, scale: float = 1.0, bits: dict[str, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """``OUT`` of the cells ``at``, step by step.

    ``planes``: dsm, vegdsm, vegdsm2 of the zone with what lies around it; ``steps`` in order
    of time within each of ``series``, for which the carried state begins anew. With ``bits``, the
    patches that the cells see, the sky is anisotropic.
    """
    site, m = Site(static), len(at[0])
    dome = Dome(bits, static["svf"]) if bits is not None else None
    skies = dome.skies(steps) if dome else None
    reach = planes[0].shape
    # only the cells' own part is marched; what lies around it casts shadows
    core = tuple(slice(int(x.min()), int(x.max()) + 1) for x in at) if m else None
    inside = tuple(x - s.start for x, s in zip(at, core)) if m else at
    last = since = None
    for i, step in enumerate(steps):
        if i == 0 or series[i] != series[i - 1]:
            last = since = None
        day, ta = step["altitude"] > 0, step["ta"]
        if day:
            sh, veg, _ = shadows(*planes, step_table(step["azimuth"], step["altitude"], top, reach[0] + 1, reach[1] + 1, scale), core)
            lit = np.maximum(sh[inside] - (1 - veg[inside]) * (1 - step["psi"]), 0.0)
            with np.errstate(all="ignore"):
                wave = np.sin((step["hour"] - step["sunrise"]) / (static["tmax_h"] - step["sunrise"]) * np.pi / 2)
            tg = np.maximum(np.nan_to_num((static["tgk"] * step["altmax"] + static["tstart"]) * wave * step["ci_surface"]), 0.0)
        else:
            lit = tg = np.zeros(m)
        now = SBC * static["emissivity"] * np.square(np.square(tg * lit + ta + 273.15))
        if day:
            gap = 0.0 if since is None else (step["hour"] - since) % 24.0
            keep = np.exp(-DECAY / 24 * gap)
            held = now if last is None else now * (1 - keep) + last * keep
            if last is None or gap >= RENEW:
                last, since = held, step["hour"]
            now = held
        else:
            last = since = None
        yield (lit, now, *(fluxes(site, step, lit, now) if dome is None else anisotropic(site, dome, step, lit, now, skies)))


def solve(planes: Sequence[np.ndarray], at: tuple[np.ndarray, np.ndarray], static: dict[str, np.ndarray], steps: Sequence[dict], series: Sequence, top: float, scale: float = 1.0, bits: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """``OUT`` of the cells ``at`` in each step, an array (step, cell) each; the arguments are those of ``each``."""
    out = {o: np.zeros((len(steps), len(at[0]))) for o in OUT}
    for i, found in enumerate(each(planes, at, static, steps, series, top, scale, bits)):
        for o, v in zip(OUT, found):
            out[o][i] = v
    return out


def utci_by_radiation(ta: np.ndarray, va: np.ndarray, pa: np.ndarray) -> list[np.ndarray]:
    """UTCI - ta as a polynomial in tmrt - ta for each state of the air, constant first; the order is that of ``comfort.utci_polynomial``."""
    out, at = [np.zeros(len(ta)) for _ in range(7)], iter(UTCI_COEFFICIENTS)
    for l in range(7):
        for k in range(7 - l):
            for j in range(7 - l - k):
                out[k] += pa**l * va**j * sum(next(at) * ta**i for i in range(7 - l - k - j))
    return out


def felt(step: dict, by: np.ndarray, tmrt: np.ndarray, lit: np.ndarray) -> tuple[np.ndarray | None, ...]:
    """UTCI and WBGT in a step; None for one that the step's air leaves undefined. ``by``: the step's ``utci_by_radiation``. The formulas are ``comfort.UTCI``, ``comfort.GLOBE`` and ``comfort.wbgt``."""
    ta, va, pa, tw, a = step["ta"], *(step[x] for x in AIR)
    utci = wbgt = None
    if None not in (va, pa):
        d = tmrt - ta
        utci = np.full(len(d), by[-1])
        for x in by[-2::-1]:
            utci *= d
            utci += x
        utci += ta
    if None not in (tw, a):
        b = np.square(np.square(tmrt + 273.15)) + a * (ta + 273.15)
        e = np.cbrt(9 * a * a + 1.73205 * np.sqrt(27 * a**4 + 256 * b * b * b))
        k = 0.381571 * e - 3.4943 * b / e
        globe = 0.5 * np.sqrt(np.maximum(2 * a / np.sqrt(np.maximum(k, 1e-30)) - k, 0.0)) - 0.5 * np.sqrt(np.maximum(k, 0.0)) - 273.15
        wbgt = 0.7 * tw + np.where(lit < 0.1, 0.3 * globe, 0.2 * globe + 0.1 * ta)
    return utci, wbgt


def fold(found: Iterator[tuple[np.ndarray, ...]], steps: Sequence[dict], series: Sequence, m: int) -> Iterator[tuple[int, int, dict[str, np.ndarray | None]]]:
    """(first step, steps, mean_x and max_x of each x of ``FELT`` by cell) of each series; what a step leaves undefined is left out."""
    first, n, total, most = 0, {}, {}, {}
    by = np.transpose(utci_by_radiation(*(np.array([s[x] for s in steps], float) for x in ("ta", "va", "pa"))))
    for i, (step, (lit, _, _, tmrt)) in enumerate(zip(steps, found)):
        if i and series[i] != series[i - 1]:
            yield first, i - first, _folded(n, total, most)
            first, n, total, most = i, {}, {}, {}
        for x, v in zip(FELT, (tmrt, *felt(step, by[i], tmrt, lit))):
            if v is None:
                continue
            n[x] = n.get(x, 0) + 1
            if n[x] == 1:
                total[x], most[x] = v.copy(), v.copy()
            else:
                total[x] += v
                np.maximum(most[x], v, out=most[x])
    if steps:
        yield first, len(steps) - first, _folded(n, total, most)


def _folded(n: dict[str, int], total: dict[str, np.ndarray], most: dict[str, np.ndarray]) -> dict[str, np.ndarray | None]:
    return {f"mean_{x}": total[x] / n[x] if x in n else None for x in FELT} | {f"max_{x}": most.get(x) for x in FELT}
