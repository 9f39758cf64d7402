"""Marches over raster blocks as grouped Arrow kernels.

The relational forms in ``raster.py`` send every cell along every step; for whole
skies that is cells times patches times steps rows. Here a raster is dealt out in
square blocks with a halo as wide as any ray can reach (the relief by the tangent
of the lowest altitude), each block is marched with array slices, and only its
core comes back. Both forms share the step table and agree exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaloom.functions.sky import bands
from thermaloom.operators.raster import step_table

#: Light that passes a tree, and the share that the lowest annuli lack in the southern and western sums.
TRANSMISSION, LOW_ANNULI = 0.03, 3.0459e-4


def shifted(plane: np.ndarray, dr: int, dc: int, fill: float = 0.0) -> np.ndarray:
    """The plane as seen from (r, c) at (r + dr, c + dc); ``fill`` beyond its border."""
    out = np.full(plane.shape, fill, dtype=plane.dtype)
    n, m = plane.shape
    if abs(dr) < n and abs(dc) < m:
        r0, r1, c0, c1 = max(0, -dr), min(n, n - dr), max(0, -dc), min(m, m - dc)
        out[r0:r1, c0:c1] = plane[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def shadows(dsm: np.ndarray, veg: np.ndarray, trunk: np.ndarray, steps: Sequence[tuple], core: tuple[slice, slice] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(building, vegetation, vegetation before buildings), 1 lit and 0 shaded, by one march from index 1.

    Only the cells whose source lies inside are touched in a step; a source beyond
    the border has height 0, which can rise only above ground below 0.
    With ``core`` the planes of that part alone, upon which the rest casts its shadows.
    """
    n, m = dsm.shape
    rows, cols = core or (slice(0, n), slice(0, m))
    whole = dsm[rows, cols]
    shade = np.zeros(whole.shape, bool)
    tree, behind = np.zeros(whole.shape, bool), np.zeros(whole.shape, bool)
    planted, before = bool((veg > 0).any()), np.ones(whole.shape, bool)
    sunken = bool((dsm < 0).any())
    rooted = trunk[rows, cols] > whole
    relief = max(dsm.max(), veg.max()) - whole.min() if whole.size and not sunken else math.inf
    canopy = veg.max() - whole.min() if whole.size and not sunken else math.inf
    for i, dr, dc, drop in steps:
        if i > 2 and drop >= relief:  # nothing is left that could rise above any ground
            break
        if planted and i > 2 and drop >= canopy:  # no vegetation is left that could; what buildings shade from here on is taken out at the end
            planted, before = False, shade.copy()
        r0, r1, c0, c1 = max(rows.start, -dr), min(rows.stop, n - dr), max(cols.start, -dc), min(cols.stop, m - dc)
        both = r0 < r1 and c0 < c1
        here, there = (slice(r0 - rows.start, r1 - rows.start), slice(c0 - cols.start, c1 - cols.start)), (slice(r0 + dr, r1 + dr), slice(c0 + dc, c1 + dc))
        if sunken:  # beyond the border
            outside = whole < 0
            if both:
                outside[here] = False
            shade |= outside
            tree &= ~shade
        if both:
            ground, s = whole[here], shade[here]
            a = dsm[there] - drop
            s |= a > ground
            if planted:
                v = veg[there] - drop
                t = tree[here]
                t |= (v > ground) & (trunk[there] - drop <= ground)
                np.greater(t, s, out=t)  # and not in the shade of a building
                if i == 1:
                    gap = v - a
                    t |= (gap > 0) & (gap < drop) | (gap <= 0) & (1000.0 < drop)
        if not planted:
            continue
        if i == 1:
            tree &= rooted
            behind[:] = False
        elif i == 2 or sunken:
            behind |= tree
        elif both:
            behind[here] |= tree[here]
    tree &= ~shade | before
    return 1.0 - shade, 1.0 - tree, 1.0 - (behind.astype(float) - tree)


def annulus(k: float, n: float) -> float:
    return 2 * math.pi / n * (1 / (2 * math.pi)) * math.sin(math.pi / 180) * math.sin(math.pi * (2 * (91.0 - k) - 1) / 180)


def patches(option: int = 2) -> list[tuple[float, float, int, float, float]]:
    """(altitude, azimuth, patches of the band, lower, upper annulus) of every patch."""
    return [(alt, (azi + k * 360.0 / n) % 360.0 if azi + k * 360.0 / n > 360.0 else azi + k * 360.0 / n, n, lo, hi) for _, alt, azi, n, lo, hi in bands(option) for k in range(n)]


#: Planes of a march: buildings, vegetation, vegetation before buildings.
KINDS = ("svf", "veg", "aveg")
#: Patches of the sky are marched in so many groups.
GROUPS = 8
#: Which patches of a group a cell sees, a bit each (below 2**53, so a double holds them), by kind and group.
BITS = tuple(f"{kind}_bits{g}" for kind in KINDS for g in range(GROUPS))


def sky_sums(dsm: np.ndarray, veg: np.ndarray, trunk: np.ndarray, top: float, scale: float, option: int, reach: tuple[int, int], some: Sequence[tuple]) -> dict[str, np.ndarray]:
    """Weighted sums of what is visible over some patches of the sky, for buildings, vegetation, vegetation before buildings, all round and by side, and the patches themselves as bits."""
    out = {f"{kind}_bits": np.zeros(dsm.shape) for kind in KINDS}
    out |= {f"{kind}{side}": np.zeros(dsm.shape) for kind in ("svf", "veg", "aveg") for side in ("", "_e", "_s", "_w", "_n")}
    for i, (alt, azi, n, lo, hi) in enumerate(some):
        planes = shadows(dsm, veg, trunk, step_table(azi, alt, top, *reach, scale))
        all_w = sum(annulus(k, n) for k in np.arange(lo + 1, hi + 1))
        half_w = sum(annulus(k, math.ceil(n / 2)) for k in np.arange(lo + 1, hi + 1))
        sides = [s for s, yes in (("_e", 0 <= azi < 180), ("_s", 90 <= azi < 270), ("_w", 180 <= azi < 360), ("_n", azi >= 270 or azi < 90)) if yes]
        for kind, plane in zip(("svf", "veg", "aveg"), planes):
            out[kind] += all_w * plane
            out[kind + "_bits"] += (plane != 0) * 2.0**i
            for s in sides:
                out[kind + s] += half_w * plane
    return out


def sky_view(dsm: np.ndarray, veg: np.ndarray, trunk: np.ndarray, top: float, scale: float = 1.0, option: int = 2, reach: tuple[int, int] | None = None) -> dict[str, np.ndarray]:
    """Sky view factors of one array: all, east, south, west, north for each kind, and the total."""
    out = sky_sums(dsm, veg, trunk, top, scale, option, reach or dsm.shape, patches(option))
    bare = np.where(trunk == 0, LOW_ANNULI, 0.0)
    for s in ("_s", "_w"):
        out["svf" + s] += LOW_ANNULI
        out["veg" + s] += bare
        out["aveg" + s] += bare
    out = {k: np.minimum(v, 1.0) for k, v in out.items() if not k.endswith("_bits")}
    out["total"] = out["svf"] - (1 - out["veg"]) * (1 - TRANSMISSION)
    return out


def sun_facing(aspect: np.ndarray, azimuth: float) -> np.ndarray:
    """Walls whose outward direction (radians) lies within a right angle of the sun."""
    turn = np.abs((aspect - math.radians(azimuth) + math.pi) % (2 * math.pi) - math.pi)
    return turn < math.pi / 2


def wall_light(dsm: np.ndarray, walls: np.ndarray, aspect: np.ndarray, azimuth: float, steps: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(height of wall in the sun, height of wall in shade): a wall is lit above the shadow volume at its foot, if it faces the sun."""
    front = dsm.copy()
    for _, dr, dc, drop in steps:
        outside = shifted(np.ones(dsm.shape), dr, dc) == 0
        np.maximum(front, np.where(outside, 0.0, shifted(dsm, dr, dc) - drop), out=front)
    lit = np.where(sun_facing(aspect, azimuth), np.maximum(walls - (front - dsm), 0.0), 0.0)
    return lit, walls - lit


def wall_aspect(dsm: np.ndarray, walls: np.ndarray, half: int = 4) -> np.ndarray:
    """Direction (radians clockwise from north) that each wall cell faces; 0 without a wall.

    The line through a cell along which most wall cells lie gives the wall's run,
    the first of 180 angles on ties; it faces the side on which the surface is lower.
    """
    wall = (walls > 0).astype(float)
    best, angle = np.full(dsm.shape, -1.0), np.zeros(dsm.shape)
    padded = dsm - dsm.min() if dsm.size else dsm
    for degrees in range(180):
        a = math.radians(degrees)
        # along the wall: north is -r, east is +c
        line = sorted({(round(-k * math.cos(a)), round(k * math.sin(a))) for k in range(-half, half + 1)})
        count = sum(shifted(wall, dr, dc) for dr, dc in line) / len(line)
        better = count > best + 1e-12
        if not better.any():
            continue
        right = sum(shifted(padded, round(k * math.sin(a)), round(k * math.cos(a))) for k in range(1, half + 1))
        left = sum(shifted(padded, -round(k * math.sin(a)), -round(k * math.cos(a))) for k in range(1, half + 1))
        faces = np.where(right <= left, a + math.pi / 2, a - math.pi / 2) % (2 * math.pi)
        best[better] = count[better]
        angle[better] = faces[better]
    return np.where(wall > 0, angle, 0.0)


def ground_view(buildings: np.ndarray, lit: np.ndarray, albedo: np.ndarray, near: int, far: int) -> dict[str, np.ndarray]:
    """What a person sees of the ground around, over 18 azimuths: share lit, albedo of lit and of all ground.

    Each walk ends at the first building; near and far parts are blended 0.5 to
    0.4. Walls are left out, they enter with their own fluxes.
    """
    total = {k: np.zeros(buildings.shape) for k in ("lit", "albedo_lit", "albedo")}
    planes = {"lit": lit, "albedo_lit": lit * albedo, "albedo": albedo}
    for azimuth in range(5, 360, 20):
        open_ = buildings.copy()
        sums = {k: np.zeros(buildings.shape) for k in planes}
        close: dict[str, np.ndarray] = {}
        steps = [(0, 0, 0, 0.0), *step_table(azimuth, 0.0, math.inf, far + 1, far + 1)][:far]
        for n, (_, dr, dc, _) in enumerate(steps):
            open_ = np.minimum(open_, shifted(buildings, dr, dc))
            for k, p in planes.items():
                sums[k] += shifted(p, dr, dc) * open_
            if n + 1 == near:
                close = {k: v.copy() for k, v in sums.items()}
        for k in planes:
            total[k] += (0.5 * close[k] / near + 0.4 * sums[k] / len(steps)) / 0.9 / 18
    return total


# -- over blocks ----------------------------------------------------------------------------
def reach_of(top: float, altitude: float, scale: float = 1.0) -> int:
    """Cells that a ray can cross before it is above everything."""
    return math.ceil(top * scale / math.tan(math.radians(altitude))) + 1


def over_blocks(cells: DataFrame, planes: Sequence[str], kernel: Callable[..., dict[str, np.ndarray]], out: Sequence[str], halo: int, size: int = 512, groups: int = 0, within: Sequence[int] | None = None, cores: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Run a kernel over square blocks with a symmetric halo and return the cores: ``r, c`` and the kernel's planes.

    Cells that are missing inside a block count as 0, as beyond the border. A cell
    goes to as many blocks as reach it; with blocks wider than twice the halo that
    is four at most. With ``groups`` every block is given to the kernel once for
    each group, with its number, and a cell comes back as often. ``within``: least and largest r and c of all
    cells, by which none are dealt to blocks that have no cells of their own. With ``cores`` the kernel also gets
    the slices of a block's core, and gives the planes of the core alone. Columns ``carry`` come back with each cell as they are.
    """
    size = max(size, 2 * halo)

    def near(x: str):
        low, high = (F.floor((F.col(x) + d) / size).cast("int") for d in (-halo, halo))
        if within:
            first, last = within["rc".index(x) * 2 :][:2]
            low, high = F.greatest(low, F.lit(first // size)), F.least(high, F.lit(last // size))
        return F.sequence(low, high)

    dealt = cells.select("r", "c", *(F.col(p).cast("double").alias(p) for p in planes), *carry).withColumn("br", F.explode(near("r"))).withColumn("bc", F.explode(near("c")))
    ddl = ", ".join(("r int, c int", *(f"{o} double" for o in out), *(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*carry).schema)))
    plain = pa.schema([("r", pa.int32()), ("c", pa.int32()), *((o, pa.float64()) for o in out)])

    def block(t: pa.Table) -> pa.Table:
        schema = pa.schema([*plain, *(t.schema.field(x) for x in carry)])
        r, c = t["r"].to_numpy(), t["c"].to_numpy()
        br, bc = t["br"][0].as_py(), t["bc"][0].as_py()
        inner = (r // size == br) & (c // size == bc)
        if not inner.any():
            return schema.empty_table()
        r0, c0 = r.min(), c.min()
        shape = (int(r.max() - r0 + 1), int(c.max() - c0 + 1))
        grids = {}
        for p in planes:
            g = np.zeros(shape)
            g[r - r0, c - c0] = np.nan_to_num(t[p].to_numpy(zero_copy_only=False))
            grids[p] = g
        ri, ci = r[inner], c[inner]
        core = (slice(int(ri.min() - r0), int(ri.max() - r0 + 1)), slice(int(ci.min() - c0), int(ci.max() - c0 + 1)))
        done = kernel(grids, *([t["g"][0].as_py()] if groups else []), *([core] if cores else []))
        if cores:
            r0, c0 = r0 + core[0].start, c0 + core[1].start
        return pa.table([pa.array(ri, pa.int32()), pa.array(ci, pa.int32()), *(pa.array(done[o][ri - r0, ci - c0]) for o in out), *(t[x].filter(pa.array(inner)) for x in carry)], schema=schema)

    if groups:
        dealt = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.groupBy("br", "bc", *(["g"] if groups else [])).applyInArrow(block, ddl)


def shadow_blocks(cells: DataFrame, azimuth: float, altitude: float, top: float, size: int = 512, scale: float = 1.0) -> DataFrame:
    """Shadow planes of a raster with dsm, vegdsm, vegdsm2; ``top`` is the largest height of the whole domain."""
    halo = reach_of(top, altitude, scale)
    steps = step_table(azimuth, altitude, top, halo + 1, halo + 1, scale)

    def kernel(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return dict(zip(("sh", "vegsh", "vbshvegsh"), shadows(g["dsm"], g["vegdsm"], g["vegdsm2"], steps)))

    return over_blocks(cells, ("dsm", "vegdsm", "vegdsm2"), kernel, ("sh", "vegsh", "vbshvegsh"), halo, size)


def sun_blocks(cells: DataFrame, suns: DataFrame, keys: Sequence[str], top: float, size: int = 512, scale: float = 1.0) -> DataFrame:
    """``keys, t, r, c, sh, vegsh`` of each cell for every row of ``suns`` (keys, t, hour, azimuth, altitude), which may be of any number.

    Each block meets the suns of a key and three hours at a time. Suns that are not
    above the horizon give sh = 0 and vegsh = 1. The halo is as wide as the lowest
    sun reaches, but never wider than the scene, beyond which no march goes.
    """
    low = suns.where("altitude > 0").agg(F.min("altitude")).first()[0]
    e = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    extent = 0 if e[0] is None else max(e[1] - e[0], e[3] - e[2]) + 1
    halo = 0 if low is None else min(reach_of(top, low, scale), extent)
    size = max(size, 2 * halo)

    def near(x: str, first: int | None, last: int | None):  # only blocks that have cells of their own
        at = lambda v: F.floor(v / size).cast("int")
        return F.sequence(F.greatest(at(F.col(x) - halo), F.lit((first or 0) // size)), F.least(at(F.col(x) + halo), F.lit((last or 0) // size)))

    planes = ("dsm", "vegdsm", "vegdsm2")
    dealt = cells.select("r", "c", *(F.col(p).cast("double").alias(p) for p in planes)).withColumn("br", F.explode(near("r", e[0], e[1]))).withColumn("bc", F.explode(near("c", e[2], e[3])))
    suns = suns.select(*keys, F.floor(F.col("hour") / 3).cast("int").alias("part"), "t", "azimuth", "altitude")
    by = [*keys, "part", "br", "bc"]
    fresh = lambda df, *names: df.select(*(F.col(n).alias(n) for n in names)).distinct()  # noqa: E731  columns of its own, as both sides meet again
    parts, blocks = fresh(suns, *keys, "part"), fresh(dealt, "br", "bc")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in suns.select(*keys, "t").schema)

    def block(t: pa.Table, sky: pa.Table) -> pa.Table:
        r, c = t["r"].to_numpy(), t["c"].to_numpy()
        n = sky.num_rows
        inner = np.zeros(0, bool) if not (len(r) and n) else (r // size == t["br"][0].as_py()) & (c // size == t["bc"][0].as_py())
        m = int(inner.sum())
        sh, veg = np.zeros((n, m)), np.ones((n, m))
        if m:
            r0, c0 = r.min(), c.min()
            grids = []
            for p in planes:
                g = np.zeros((int(r.max() - r0 + 1), int(c.max() - c0 + 1)))
                g[r - r0, c - c0] = np.nan_to_num(t[p].to_numpy())
                grids.append(g)
            at = (r[inner] - r0, c[inner] - c0)
            for i, (azimuth, altitude) in enumerate(zip(sky["azimuth"].to_pylist(), sky["altitude"].to_pylist())):
                if altitude is not None and altitude > 0:
                    lit, green, _ = shadows(*grids, step_table(azimuth, altitude, top, halo + 1, halo + 1, scale))
                    sh[i], veg[i] = lit[at], green[at]
        out = sky.select([*keys, "t"]).take(pa.array(np.repeat(np.arange(n), m)))
        for name, v in (("r", pa.array(np.tile(r[inner], n), pa.int32())), ("c", pa.array(np.tile(c[inner], n), pa.int32())), ("sh", pa.array(sh.ravel())), ("vegsh", pa.array(veg.ravel()))):
            out = out.append_column(name, v)
        return out

    return dealt.crossJoin(parts).groupBy(*by).cogroup(suns.crossJoin(blocks).groupBy(*by)).applyInArrow(block, f"{types}, r int, c int, sh double, vegsh double")


_PARTS = tuple(f"{kind}{side}" for kind in ("svf", "veg", "aveg") for side in ("", "_e", "_s", "_w", "_n"))
SKY = (*_PARTS, "total")


def sky_view_blocks(cells: DataFrame, top: float, size: int = 512, scale: float = 1.0, option: int = 2) -> DataFrame:
    """Sky view factors of a raster with dsm, vegdsm, vegdsm2.

    The patches of the sky are dealt out in groups, so a block is marched by as many tasks, and their sums are added.
    ``BITS`` tell which patches each cell sees; ``visible`` unpacks them.
    """
    groups = GROUPS
    halo = reach_of(top, min(a for _, a, *_ in bands(option)), scale)
    total = F.least(F.col("svf"), F.lit(1.0)) - (1 - F.least(F.col("veg"), F.lit(1.0))) * (1 - TRANSMISSION)

    def kernel(g: dict[str, np.ndarray], group: int) -> dict[str, np.ndarray]:
        sums = sky_sums(g["dsm"], g["vegdsm"], g["vegdsm2"], top, scale, option, (halo + 1, halo + 1), patches(option)[group::groups])
        if group == 0:
            for p in ("veg_s", "veg_w", "aveg_s", "aveg_w"):
                sums[p] += np.where(g["vegdsm2"] == 0, LOW_ANNULI, 0.0)
        return sums | {"group": np.full(g["dsm"].shape, float(group))}

    parts = over_blocks(cells, ("dsm", "vegdsm", "vegdsm2"), kernel, (*_PARTS, *(f"{k}_bits" for k in KINDS), "group"), halo, size, groups)
    seen = (F.sum(F.when(F.col("group") == g, F.col(f"{k}_bits"))).alias(f"{k}_bits{g}") for k in KINDS for g in range(groups))
    sums = parts.groupBy("r", "c").agg(*(F.sum(p).alias(p) for p in _PARTS), *seen)
    low = {"svf_s": LOW_ANNULI, "svf_w": LOW_ANNULI}
    return sums.select("r", "c", *(F.least(F.col(p) + low.get(p, 0.0), F.lit(1.0)).alias(p) for p in _PARTS), total.alias("total"), *BITS)


#: The same for ``visible`` and for patches before which vegetation stands alone: these count twice in the sums of aveg.
_WORDS = (*KINDS, "alone")
SEEN = (*BITS, *(f"alone_bits{g}" for g in range(GROUPS)))
#: From so many blocks on, one task marches all patches of a block.
MANY_BLOCKS = 24
#: A march goes over so many cells at a time, which a core's cache holds.
STRIP = 65_536


def sky_bits_blocks(cells: DataFrame, top: float, size: int = 512, scale: float = 1.0, option: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """``r, c, carry, bits``: the patches that each cell sees, an integer for each of ``SEEN``; ``sky_of`` gives the sky view factors.

    Columns ``carry`` travel with the cells, so that none has to be joined with what it sees. Many blocks are marched by a task each and nothing is shuffled behind them; of few, the patches are dealt out in groups.
    """
    halo = reach_of(top, min(a for _, a, *_ in bands(option)), scale)
    e = cells.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    within, wide = tuple(e) if e[0] is not None else (0, 0, 0, 0), max(size, 2 * halo)
    many = (within[1] // wide - within[0] // wide + 1) * (within[3] // wide - within[2] // wide + 1) >= MANY_BLOCKS

    def words(g: dict[str, np.ndarray], group: int, core: tuple[slice, slice]) -> list[np.ndarray]:
        rows, cols = core
        out = [np.zeros((rows.stop - rows.start, cols.stop - cols.start)) for _ in _WORDS]
        high = max(1, STRIP // out[0].shape[1])
        for i, (alt, azi, *_) in enumerate(patches(option)[group::GROUPS]):
            steps = step_table(azi, alt, top, halo + 1, halo + 1, scale)
            for first in range(rows.start, rows.stop, high):
                strip = slice(first, min(first + high, rows.stop))
                open_ = shadows(g["dsm"], g["vegdsm"], g["vegdsm2"], steps, (strip, cols))
                for word, plane in zip(out, (*open_, open_[2] > 1)):
                    word[strip.start - rows.start : strip.stop - rows.start] += (plane != 0) * 2.0**i
        return out

    def all_of(g: dict[str, np.ndarray], core: tuple[slice, slice]) -> dict[str, np.ndarray]:
        by = [words(g, group, core) for group in range(GROUPS)]
        return {f"{kind}_bits{group}": by[group][k] for k, kind in enumerate(_WORDS) for group in range(GROUPS)}

    def some_of(g: dict[str, np.ndarray], group: int, core: tuple[slice, slice]) -> dict[str, np.ndarray]:
        out = words(g, group, core)
        return dict(zip(_WORDS, out)) | {"group": np.full(out[0].shape, float(group))}

    planes = ("dsm", "vegdsm", "vegdsm2")
    if many:
        return over_blocks(cells, planes, all_of, SEEN, halo, size, within=within, cores=True, carry=carry).select("r", "c", *carry, F.array(*(F.col(b).cast("int") for b in SEEN)).alias("bits"))
    parts = over_blocks(cells, planes, some_of, ("group", *_WORDS), halo, size, GROUPS, within, cores=True, carry=carry)
    each = F.struct(*(F.col(x).cast("int").alias(x) for x in ("group", *_WORDS)))
    m = parts.groupBy("r", "c", *carry).agg(F.array_sort(F.collect_list(each)).alias("m"))  # all groups, in order
    return m.select("r", "c", *carry, F.array(*(F.col("m")[g][kind] for kind in _WORDS for g in range(GROUPS))).alias("bits"))


def sky_of(bits: dict[str, np.ndarray], bare: np.ndarray, option: int = 2) -> dict[str, np.ndarray]:
    """Sky view factors from the patches that cells see; ``bare``: cells without a trunk zone."""
    weights = np.zeros((5, len(patches(option))))
    for i, (_, azi, n, lo, hi) in enumerate(patches(option)):
        some = np.arange(lo + 1, hi + 1)
        weights[0, i] = sum(annulus(k, n) for k in some)
        sides = (0 <= azi < 180, 90 <= azi < 270, 180 <= azi < 360, azi >= 270 or azi < 90)
        weights[1:, i] = np.array(sides) * sum(annulus(k, math.ceil(n / 2)) for k in some)
    out = {}
    sh, veg, aveg, alone = visible(bits, option, _WORDS)
    for kind, plane in zip(KINDS, (sh, veg, aveg.astype(float) + alone)):
        for side, w in zip(("", "_e", "_s", "_w", "_n"), weights):
            low = LOW_ANNULI * (1.0 if kind == "svf" else bare) if side in ("_s", "_w") else 0.0
            out[kind + side] = np.minimum(plane @ w + low, 1.0)
    return out


def visible(bits: dict[str, np.ndarray], option: int = 2, kinds: Sequence[str] = KINDS) -> tuple[np.ndarray, ...]:
    """Planes (cell, patch) of the patches that buildings, vegetation and vegetation before buildings leave open, from ``BITS``."""
    n = len(patches(option))
    out = []
    for kind in kinds:
        plane = np.zeros((len(bits[f"{kind}_bits0"]), n), bool)
        for g in range(GROUPS):
            word = bits[f"{kind}_bits{g}"].astype(np.int64)
            for j, patch in enumerate(range(g, n, GROUPS)):
                plane[:, patch] = word >> j & 1
        out.append(plane)
    return tuple(out)


def wall_light_blocks(cells: DataFrame, azimuth: float, altitude: float, top: float, size: int = 512) -> DataFrame:
    """Sunlit and shaded wall height of a raster with dsm, wall, aspect."""
    halo = reach_of(top, altitude)
    steps = step_table(azimuth, altitude, top, halo + 1, halo + 1, first=0)

    def kernel(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return dict(zip(("wall_sun", "wall_shade"), wall_light(g["dsm"], g["wall"], g["aspect"], azimuth, steps)))

    return over_blocks(cells, ("dsm", "wall", "aspect"), kernel, ("wall_sun", "wall_shade"), halo, size)


def ground_view_blocks(cells: DataFrame, near: int = 1, far: int = 22, size: int = 512) -> DataFrame:
    """Ground view of a raster with ground, lit, albedo."""

    def kernel(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return ground_view(g["ground"], g["lit"], g["albedo"], near, far)

    return over_blocks(cells, ("ground", "lit", "albedo"), kernel, ("lit", "albedo_lit", "albedo"), far + 1, size)



def wall_aspect_blocks(cells: DataFrame, size: int = 512) -> DataFrame:
    """Aspects (degrees) of the walls of a raster with dsm, wall."""

    def kernel(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"aspect": np.degrees(wall_aspect(g["dsm"], g["wall"]))}

    return over_blocks(cells, ("dsm", "wall"), kernel, ("aspect",), 5, size)
