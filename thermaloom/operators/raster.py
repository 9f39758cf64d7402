"""Raster operators in relational form: layers, stencils, marches, sky view, walls, windows.

A raster is a relation of cells (r, c, ...). A stencil is an equi-join on shifted
coordinates; a march is a join with a table of steps. The same operators exist as
grouped Arrow kernels in ``march.py`` for large tiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Land-cover classes of the model with albedo, emissivity, slope and start of surface temperature, hour of its maximum.
LAND_COVER = (
    (0, 0.20, 0.95, 0.37, -3.41, 15.0), (1, 0.18, 0.95, 0.58, -9.78, 15.0), (2, 0.18, 0.95, 0.58, -9.78, 15.0), (5, 0.16, 0.94, 0.21, -3.38, 14.0),
    (6, 0.25, 0.94, 0.33, -3.01, 14.0), (7, 0.05, 0.98, 0.00, 0.00, 12.0), (99, 0.20, 0.90, 0.58, -3.41, 15.0),
)
#: WorldCover code to class of the model.
WORLD_COVER = {0: 0, 10: 4, 20: 3, 30: 5, 40: 5, 50: 1, 60: 6, 70: 6, 80: 7, 90: 5, 95: 3, 100: 6}


def layers(cells: DataFrame) -> DataFrame:
    """Vegetation surfaces, bushes and ground mask from dem, dsm, trees."""
    veg = F.greatest(F.col("trees"), F.lit(0.0))
    out = cells.withColumns({"vegdem": veg + F.col("dem"), "vegdem2": 0.25 * veg + F.col("dem")})
    surface = lambda part: F.when(part == 0, 0.0).otherwise(part + F.col("dsm"))
    return out.withColumns({
        "vegdsm": surface(veg), "vegdsm2": surface(0.25 * veg),
        "bush": F.when(F.col("vegdem") * F.col("vegdem2") == 0, F.col("vegdem")).otherwise(0.0),
        "ground": F.when(F.col("dsm") - F.col("dem") < 2.0, 1).otherwise(0),
    })


def clean_land_cover(lc: Column) -> Column:
    """Codes outside 1..7 are soil (6); 3 and 4 are grass (5)."""
    return F.when((lc < 1) | (lc > 7) | lc.isNull(), 6).when(lc.isin(3, 4), 5).otherwise(lc)


def reclassify_world_cover(code: Column, building_height: Column) -> Column:
    """WorldCover codes to classes (unknown codes to 0); buildings above 1 m are class 2."""
    mapped = F.create_map(*(F.lit(x) for kv in WORLD_COVER.items() for x in kv))
    return F.when(building_height > 1, 2).otherwise(F.coalesce(mapped[code], F.lit(0)))


def land_cover_properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAND_COVER), "lc int, albedo double, emissivity double, tgk double, tstart double, tmax_h double")


def shift(cells: DataFrame, columns: Sequence[str], dr: int, dc: int, prefix: str) -> DataFrame:
    """The cells at (r + dr, c + dc), seen from (r, c)."""
    return cells.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), *(F.col(x).alias(prefix + x) for x in columns))


def walls(cells: DataFrame, limit: float = 3.0) -> DataFrame:
    """Wall heights: how far the highest of the four neighbours rises above a cell, if by ``limit`` at least; none on the border.

    Neighbours send their height to the cells around them, so that one aggregation serves all four.
    """
    sent = cells.select("r", "c", F.lit(None).cast("double").alias("n"), "dsm").unionByName(
        cells.withColumn("d", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))))
        .select((F.col("r") + F.col("d.a")).alias("r"), (F.col("c") + F.col("d.b")).alias("c"), F.col("dsm").alias("n"), F.lit(None).cast("double").alias("dsm"))
    )
    g = sent.groupBy("r", "c").agg(F.max("n").alias("top"), F.max("dsm").alias("dsm"), F.count("n").alias("k")).where("dsm is not null")
    rise = F.col("top") - F.col("dsm")
    return g.select("r", "c", F.when((F.col("k") == 4) & (rise >= limit), rise).otherwise(0.0).alias("wall"))


def box_sums(cells: DataFrame, values: Sequence[str], half: int) -> DataFrame:
    """Sums over the (2 half + 1)-square box around each cell, cut at the border, by one window along rows and one along columns."""
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-half, half)
    across = Window.partitionBy("c").orderBy("r").rangeBetween(-half, half)
    out = cells.withColumns({f"{v}_row": F.sum(v).over(along) for v in values} | {"n_row": F.count("*").over(along)})
    return out.withColumns({f"{v}_box": F.sum(f"{v}_row").over(across) for v in values} | {"n_box": F.sum("n_row").over(across)}).drop(*(f"{v}_row" for v in values), "n_row")


def box_statistics(cells: DataFrame, half: int = 4) -> DataFrame:
    """Plan fraction of buildings and their mean height in the box."""
    rise = F.col("dsm") - F.col("dem")
    masked = cells.select("r", "c", F.when(rise >= 2, 1).otherwise(0).alias("m"), F.when(rise >= 2, rise).otherwise(0.0).alias("h"))
    s = box_sums(masked, ("m", "h"), half)
    return s.select("r", "c", (F.col("m_box") / F.col("n_box")).alias("plan_fraction"), F.when(F.col("m_box") > 0, F.col("h_box") / F.col("m_box")).otherwise(0.0).alias("mean_height"))


def frontal_area(cells: DataFrame, half: int = 4, pixel: float = 1.0) -> DataFrame:
    """Frontal area index: lateral wall area of the box by its ground area, over pi, at most 1. Outer borders are no walls."""
    m = cells.select("r", "c", (F.col("dsm") - F.col("dem") >= 2).alias("m"), (F.col("dsm") - F.col("dem")).alias("h"))
    out = m
    for i, (dr, dc) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0))):
        out = out.join(shift(m, ["m"], dr, dc, f"s{i}_"), ["r", "c"], "left")
    edges = sum(F.when(F.col("m") & ~F.coalesce(F.col(f"s{i}_m"), F.col("m")), 1).otherwise(0) for i in range(4))
    s = box_sums(out.select("r", "c", (edges * F.col("h") * pixel).alias("area")), ("area",), half)
    return s.select("r", "c", F.least(F.col("area_box") / (F.col("n_box") * pixel * pixel) / math.pi, F.lit(1.0)).alias("lambda_f"))


def disc_minimum(cells: DataFrame, column: str, radius: int) -> DataFrame:
    """Grey erosion: the least value in a disc around each cell."""
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    d = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc)))
    sent = cells.select("r", "c", column).withColumn("d", d).select((F.col("r") + F.col("d.a")).alias("r"), (F.col("c") + F.col("d.b")).alias("c"), column)
    return sent.groupBy("r", "c").agg(F.min(column).alias("low")).join(cells.select("r", "c"), ["r", "c"], "left_semi")


def gaussian(cells: DataFrame, column: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian smoothing with missing cells left out and the weights renormalized; separable: along rows, then columns."""
    weights = [(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    w = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("w")) for k, v in weights)))
    base = cells.select("r", "c", F.coalesce(F.col(column), F.lit(0.0)).alias("x"), F.when(F.col(column).isNull(), 0.0).otherwise(1.0).alias("g"))
    for axis in ("c", "r"):
        base = base.withColumn("w", w).select(*((F.col(a) + F.col("w.k")).alias(a) if a == axis else F.col(a) for a in ("r", "c")), (F.col("x") * F.col("w.w")).alias("x"), (F.col("g") * F.col("w.w")).alias("g")).groupBy("r", "c").agg(F.sum("x").alias("x"), F.sum("g").alias("g"))
    return base.join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", F.when(F.col("g") > 0, F.col("x") / F.col("g")).alias("smooth"))


# -- marches ---------------------------------------------------------------------------
def step_table(azimuth: float, altitude: float, top: float, rows: int, cols: int, scale: float = 1.0, first: int = 1) -> list[tuple[int, int, int, float]]:
    """(index, dr, dc, drop) of a march towards the sun.

    The axis is the one along which the ray moves a whole cell a step; the other
    offset is rounded half to even. The march goes on while the drop and offsets
    of the step before are inside ``top`` and the grid, so it ends one step beyond.
    """
    az = math.radians(azimuth if azimuth else 1e-12)
    by_column = math.pi / 4 <= az < 3 * math.pi / 4 or 5 * math.pi / 4 <= az < 7 * math.pi / 4
    sign = lambda v: (v > 0) - (v < 0)
    rise = math.tan(math.radians(altitude)) / scale
    length = abs(1 / math.sin(az)) if by_column else abs(1 / math.cos(az))
    out, i, dr, dc, drop = [], first, 0, 0, 0.0
    while top >= drop and abs(dr) < rows and abs(dc) < cols:
        if by_column:
            dc, dr = sign(math.sin(az)) * i, -sign(math.cos(az)) * abs(round(i / math.tan(az)))
        else:
            dc, dr = sign(math.sin(az)) * abs(round(i * math.tan(az))), -sign(math.cos(az)) * i
        drop = length * i * rise
        out.append((i, int(dr), int(dc), drop))
        i += 1
    return out


def _steps(steps: Sequence[tuple]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(z)).alias("drop")) for i, a, b, z in steps)))


def building_shadow(cells: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """1 where lit, 0 in the shadow of surfaces: a cell is shaded if a cell towards the sun, lowered by the drop, is higher.

    Cells send their lowered height down-sun; no self-join is needed. Beyond the grid the height counts as 0, as in a zero-padded march.
    """
    s = F.col("s")
    sent = cells.select("r", "c", "dsm", _steps(steps).alias("s")).select((F.col("r") - s["dr"]).alias("r"), (F.col("c") - s["dc"]).alias("c"), (F.col("dsm") - s["drop"]).alias("front"))
    front = sent.groupBy("r", "c").agg(F.max("front").alias("front"))
    return cells.select("r", "c", "dsm").join(front, ["r", "c"], "left").select("r", "c", F.when(F.greatest(F.coalesce("front", F.lit(0.0)), F.lit(0.0)) > F.col("dsm"), 0).otherwise(1).alias("sh"))


def vegetation_shadow(cells: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Building and vegetation shadow by an ordered fold over the steps of each cell (1 lit, 0 shaded).

    The vegetation state is cleared where the building front shades the cell, so order matters; ``cells`` has dsm, vegdsm, vegdsm2.
    A cell sends its heights to itself as well, so one aggregation has all that it needs: what cells send is many times the cells,
    which a join's estimate of its size does not see.
    """
    s, own = F.col("s"), -1
    sent = cells.select("dsm", "vegdsm", "vegdsm2", "r", "c", _steps([(own, 0, 0, 0.0), *steps]).alias("s")).select(
        (F.col("r") - s["dr"]).alias("r"), (F.col("c") - s["dc"]).alias("c"),
        F.struct(s["i"].alias("i"), F.struct(F.col("dsm").alias("a"), F.col("vegdsm").alias("v"), F.col("vegdsm2").alias("w")).alias("x")).alias("e"),
    )
    got = sent.groupBy("r", "c").agg(F.map_from_entries(F.collect_list("e")).alias("m")).withColumn("own", F.element_at("m", own)).where("own is not null")
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(z)).alias("drop")) for i, _, _, z in steps))
    met = F.transform(every, lambda e: F.struct(e["i"].alias("i"), e["drop"].alias("drop"), F.element_at("m", e["i"]).alias("x")))
    lowered = lambda e, h: F.when(e["x"].isNull(), 0.0).otherwise(e["x"][h] - e["drop"]).alias(h)
    xs = F.transform(met, lambda e: F.struct(e["i"].alias("i"), e["drop"].alias("drop"), *(lowered(e, h) for h in "avw")))
    here = got.select("r", "c", F.col("own.a").alias("dsm"), F.col("own.w").alias("vegdsm2"), xs.alias("xs"))
    start = F.struct(F.col("dsm").alias("f"), F.lit(0.0).alias("veg"), F.lit(0.0).alias("vb"))

    def fold(acc: Column, x: Column) -> Column:
        f = F.greatest(acc["f"], x["a"])
        sh = F.when(f > F.col("dsm"), 1.0).otherwise(0.0)
        new = F.when(x["v"] > F.col("dsm"), 1.0).otherwise(0.0) - F.when(x["w"] > F.col("dsm"), 1.0).otherwise(0.0)
        veg = F.greatest(acc["veg"], new)
        veg = F.when(veg * sh > 0, 0.0).otherwise(veg)
        gap = x["v"] - x["a"]
        close = F.when(F.when(gap <= 0, 1000.0).otherwise(gap) < x["drop"], 1.0).otherwise(veg)
        at_first = x["i"] == 1
        veg1 = F.when(at_first, close * F.when(F.col("vegdsm2") > F.col("dsm"), 1.0).otherwise(0.0)).otherwise(veg)
        return F.struct(f.alias("f"), veg1.alias("veg"), F.when(at_first, 0.0).otherwise(acc["vb"] + veg).alias("vb"))

    folded = here.withColumn("z", F.aggregate("xs", start, fold))
    veg = F.when(F.col("z.veg") > 0, 1).otherwise(0)
    vb = F.when(F.col("z.vb") > 0, 1).otherwise(0)
    return folded.select("r", "c", F.when(F.col("z.f") > F.col("dsm"), 0).otherwise(1).alias("sh"), (1 - veg).alias("vegsh"), (1 - (vb - veg)).alias("vbshvegsh"))


# -- windows over rasters -----------------------------------------------------------------
def tile_windows(grid: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of a tiling with overlap to the right and below: one row a window, named by its first column and row."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the tile size")
    g = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1, F.lit(size)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1, F.lit(size))))
    return g.select("tile", F.concat_ws("_", "x", "y").alias("window"), "x", "y", F.least(F.lit(size + overlap), F.col("n_cols") - F.col("x")).alias("width"), F.least(F.lit(size + overlap), F.col("n_rows") - F.col("y")).alias("height"))


def epsg(crs: Column) -> Column:
    """EPSG number of a reference system, however written; null if none is named."""
    return F.nullif(F.regexp_extract(crs, r"(\d{4,5})\D*$", 1), F.lit("")).cast("int")


def discs_on_cells(trees: DataFrame, pixel: float) -> DataFrame:
    """Cells whose centre lies in a tree's crown: trees name the cells of their bounding box, an exact test follows."""
    span = lambda mid, radius: F.sequence(F.floor((mid - radius) / pixel).cast("int"), F.ceil((mid + radius) / pixel).cast("int"))
    boxed = trees.withColumn("c", F.explode(span(F.col("x"), F.col("radius")))).withColumn("r", F.explode(span(F.col("y"), F.col("radius"))))
    dx, dy = (F.col("c") + 0.5) * pixel - F.col("x"), (F.col("r") + 0.5) * pixel - F.col("y")
    return boxed.where(dx * dx + dy * dy <= F.col("radius") * F.col("radius"))


def polygons_on_cells(rings: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Cells whose centre lies in a polygon or on its edge: parity of crossings over the edges of each candidate cell.

    ``rings``: id and ``ring``, an array of (x, y); winding does not matter.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / pixel).cast("int"), F.ceil(F.array_max(v) / pixel).cast("int"))
    cand = rings.withColumn("c", F.explode(span(xs))).withColumn("r", F.explode(span(ys)))
    px, py = (F.col("c") + 0.5) * pixel, (F.col("r") + 0.5) * pixel
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("ring", i).alias("a"), F.element_at("ring", F.when(i == n, 1).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        area = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        inside = (px - a["x"]) * (px - b["x"]) + (py - a["y"]) * (py - b["y"]) <= 0
        return (F.abs(area) <= 1e-9 * ((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)) & inside

    return cand.withColumn("edges", edges).where((F.size(F.filter("edges", crosses)) % 2 == 1) | F.exists("edges", on_edge)).select(*[x for x in rings.columns if x != "ring"], "r", "c")


# -- wind ---------------------------------------------------------------------------------------
def log_ratio(z: float, roughness: Column, displacement: Column) -> Column:
    """Logarithm of height over roughness, both kept away from the edge of its domain."""
    z0 = F.greatest(roughness, F.lit(1e-6))
    return F.log(F.greatest(F.greatest(F.lit(z) - displacement, 1.01 * z0) / z0, F.lit(1.01)))


def canopy_wind(height: Column, density: Column, z: float = 1.5, reference_roughness: float = 0.03, most: float = 1.0) -> Column:
    """Wind at height z as a part of the reference's, over or inside a canopy of a height and frontal density.

    Inside, the profile decays exponentially from the canopy's top; above, it is
    logarithmic over a raised ground. Without a canopy it is 1.
    """
    h = F.greatest(height, F.lit(1e-6))
    z0, d = F.greatest(0.1 * h, F.lit(0.03)), 0.7 * h
    reference = F.log(F.greatest(F.lit(z), F.lit(1.01 * reference_roughness)) / reference_roughness)
    inside = F.exp(9.6 * density * (F.lit(z) / h - 1.0)) * F.log(F.greatest((h - d) / z0, F.lit(1.01))) / reference
    ratio = (F.lit(z) - d) / z0
    outside = F.log(F.when(ratio <= 1.0, 1.01).otherwise(ratio)) / reference
    return F.when((height <= 0) | (density <= 0), 1.0).otherwise(F.least(F.when(h > z, inside).otherwise(outside), F.lit(most)))


def components(cells: DataFrame) -> DataFrame:
    """Connected components (by edges) of the cells given: r, c and the least cell number of the component.

    Labels spread over runs of rows and columns by window minima, so a round crosses
    a whole run; labels only fall, so it ends, when nothing changes. Each round is written to the shared
    folder, so lineage does not grow and no executor's loss repeats it.
    """
    from thermaloom.session import materialize

    lab = cells.select("r", "c", (F.col("r").cast("bigint") * (1 << 31) + F.col("c")).alias("label"))
    for axis, other in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(axis).orderBy(other)
        lab = lab.withColumn(f"run_{axis}", F.col(other) - F.row_number().over(w))
    lab = materialize(lab, "components")
    while True:
        low = lab.withColumn("a", F.min("label").over(Window.partitionBy("r", "run_r"))).withColumn("b", F.min("a").over(Window.partitionBy("c", "run_c")))
        after = materialize(low.select("r", "c", "run_r", "run_c", "label", F.col("b").alias("next")), "components")
        changed = after.where("next < label").limit(1).count()
        lab = after.select("r", "c", F.col("next").alias("label"), "run_r", "run_c")
        if not changed:
            return lab.select("r", "c", F.col("label").alias("component"))
