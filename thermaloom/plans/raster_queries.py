"""Queries of forcing ETL and raster operators, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaloom.functions import sky
from thermaloom.operators import forcing, march, raster
from thermaloom.sources import io
from thermaloom.plans.bindings import CELLS_SQL, MET_SQL, cells, met
from thermaloom.session import table

MET = f"with met as ({MET_SQL}) "
CELL = f"with cell as ({CELLS_SQL}) "
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: str, digits: int = 6) -> F.Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def m6(c: str) -> F.Column:
    """A mean to six decimals; sums differ in their last bit with the order of rows, so ties are moved off the edge."""
    return (F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c)


# -- forcing --------------------------------------------------------------------------------
@query(MET + """select a.station, a.obs_time, a.ta, round(b.j / 3600.0e0, 6) + 0e0 as shortwave from met a
 join (select station, obs_time, max(radg * 3600.0e0) j from met where imin = 0 and radg is not null group by 1, 2) b on a.station = b.station and a.obs_time = b.obs_time where a.ta is not null""")
def era5_align_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instantaneous air temperature joined with hourly accumulated radiation on exact times."""
    m = met(spark, sf_dir)
    hourly = m.where("imin = 0 and radg is not null").groupBy("station", "obs_time").agg(F.max(F.col("radg") * 3600.0).alias("ssrd"))
    joined = forcing.align_accumulated(m.where("ta is not null").select("station", "obs_time", "ta"), hourly, ["station", "obs_time"])
    return joined.select("station", "obs_time", "ta", r6("shortwave"))


_DAILY = """daily as (select station, cast(obs_time as date) as day, avg(radg) sw, avg(wind) ws, max(ta) tmax, min(ta) tmin, count(*) n from met group by 1, 2),
 amp as (select *, pow(greatest(coalesce(sw / (1.225e0 * 1005.0e0) * pow(tmax - tmin, 3), 0e0), 0e0) / case when ws > 1 then ws else 1e0 end, 0.25e0) amplitude from daily) """


@query(MET.rstrip() + ", " + _DAILY + "select station, day, round(sw + 1e-9, 6) + 0e0 as sw, round(ws + 1e-9, 6) + 0e0 as ws, round(tmax - tmin, 6) + 0e0 as dtr, round(amplitude, 5) + 0e0 as amplitude, n from amp")
def uhi_daily_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily diagnostics and heat-island amplitude of each station."""
    d = forcing.daily_amplitude(met(spark, sf_dir)).withColumn("dtr", F.col("tmax") - F.col("tmin"))
    return d.select("station", "day", m6("sw"), m6("ws"), r6("dtr"), r6("amplitude", 5), "n")


@query(MET.rstrip() + ", " + _DAILY + """, n as (select m.reading_id, m.station, m.obs_time, coalesce(m.radg <= 5, false) night, a.amplitude from met m join amp a on a.station = m.station and a.day = cast(m.obs_time as date)),
 s as (select *, sum(case when night and prev then 0 else 1 end) over (partition by station order by obs_time, reading_id rows unbounded preceding) island from (select *, lag(night, 1, false) over (partition by station order by obs_time, reading_id) prev from n)),
 t as (select *, row_number() over (partition by station, island order by obs_time, reading_id) - 1 i, count(*) over (partition by station, island) k, avg(amplitude) over (partition by station, island) mean from s)
 select reading_id, night, round(case when night and k >= 2 and mean > 0 then mean * greatest(sin(pi() * i / (k - 1)), 0e0) else 0e0 end, 5) + 0e0 as uhi from t""")
def uhi_night_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-sine heat-island profile of every night."""
    m = met(spark, sf_dir)
    return forcing.night_profile(m, forcing.daily_amplitude(m)).select("reading_id", "night", r6("uhi", 5))


@query(MET + "select reading_id, last_value(ta ignore nulls) over (partition by station order by obs_time, reading_id rows unbounded preceding) as ta_filled from met")
def uhi_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air temperature filled forward."""
    return forcing.forward_fill(met(spark, sf_dir), "ta").select("reading_id", "ta_filled")


@query(MET.rstrip() + ", " + _DAILY + ", pos as (select * from amp where amplitude > 0) select m.reading_id, round(p.amplitude, 5) + 0e0 as as_of from met m asof left join pos p on m.station = p.station and cast(m.obs_time as date) >= p.day")
def amplitude_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading with the latest daily amplitude at its day or before."""
    m = met(spark, sf_dir)
    return forcing.as_of_daily(m, forcing.daily_amplitude(m)).select("reading_id", r6("as_of", 5))


@query(MET + "select tile, date_trunc('hour', obs_time) as hour_ts, round(coalesce(avg(ta), -999) + 1e-9, 6) + 0e0 as ta, round(coalesce(avg(rh), -999) + 1e-9, 6) + 0e0 as rh, round(coalesce(avg(wind), -999) + 1e-9, 6) + 0e0 as wind, count(*) as n from met where tile in (select tile from grid_tiles) group by 1, 2")
def tile_mean_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of each tile, the sentinel where nothing is known."""
    return forcing.tile_means(met(spark, sf_dir), table(spark, sf_dir, "grid_tiles")).select("tile", "hour_ts", m6("ta"), m6("rh"), m6("wind"), "n")


@query(MET + """, g as (select tile, date_trunc('hour', obs_time) hour_ts, avg(wd) plain, sum(sin(radians(wd))) s, sum(cos(radians(wd))) c from met where wd is not null group by 1, 2),
 h as (select *, degrees(atan2(s, c)) + 360.0e0 d, sqrt(s * s + c * c) resultant from g)
 select tile, hour_ts, round(plain + 1e-9, 6) + 0e0 as plain, round(d - 360.0e0 * floor(d / 360.0e0), 4) + 0e0 as circular from h where resultant > 1e-6 and abs(d - 360.0e0) > 1e-3""")
def wind_direction_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and circular hourly wind direction of each tile."""
    d = forcing.circular_direction(met(spark, sf_dir)).where("resultant > 1e-6 and circular > 1e-3 and circular < 359.999")
    return d.select("tile", "hour_ts", m6("plain"), r6("circular", 4))


@query(MET + "select g.tile as to_tile, s.reading_id, s.obs_time, s.ta from (select * from met where station = (select min(station) from met)) s, grid_tiles g")
def own_met_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station's series for every tile."""
    m = met(spark, sf_dir)
    first = m.agg(F.min("station").alias("station"))
    one = m.join(first, "station", "left_semi").select("reading_id", "obs_time", "ta")
    return forcing.fan_out(one, table(spark, sf_dir, "grid_tiles")).select("to_tile", "reading_id", "obs_time", "ta")


@query("""with p as (select a.tile, b.tile nearest, sqrt((a.origin_x - b.origin_x) * (a.origin_x - b.origin_x) + (a.origin_y - b.origin_y) * (a.origin_y - b.origin_y)) distance from grid_tiles a join grid_tiles b on a.tile <> b.tile)
 select tile, nearest, round(distance, 6) + 0e0 as distance from p qualify row_number() over (partition by tile order by distance, nearest) = 1""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other tile, by squares of 2 km and wider ones where those hold none."""
    return forcing.nearest_tile(table(spark, sf_dir, "grid_tiles"), 2000.0).select("tile", "nearest", r6("distance"))


# -- grid preparation --------------------------------------------------------------------------
@query(CELL + """, v as (select *, greatest(trees, 0e0) veg from cell), w as (select *, veg + dem vegdem, 0.25e0 * veg + dem vegdem2 from v)
 select r, c, vegdem, vegdem2, case when veg = 0 then 0e0 else veg + dsm end as vegdsm, case when veg = 0 then 0e0 else 0.25e0 * veg + dsm end as vegdsm2, case when vegdem * vegdem2 = 0 then vegdem else 0e0 end as bush, case when dsm - dem < 2 then 1 else 0 end as ground from w""")
def veg_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vegetation surfaces, bushes and ground mask."""
    return raster.layers(cells(spark, sf_dir)).select("r", "c", "vegdem", "vegdem2", "vegdsm", "vegdsm2", "bush", "ground")


@query(CELL + "select r, c, case when x < 1 or x > 7 then 6 when x in (3, 4) then 5 else x end as lc from (select r, c, cast((r * 7 + c * 3) % 10 as int) x from cell)")
def lc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover codes cleaned."""
    return cells(spark, sf_dir).select("r", "c", raster.clean_land_cover(((F.col("r") * 7 + F.col("c") * 3) % 10).cast("int")).alias("lc"))


_LC_SQL = "(values " + ", ".join(f"({a}, {b}e0, {c}e0, {d}e0, {e}e0, {f}e0)" for a, b, c, d, e, f in raster.LAND_COVER) + ") p(lc, albedo, emissivity, tgk, tstart, tmax_h)"


@query(CELL + f"select r, c, cell.lc, albedo, emissivity, tgk, tstart, tmax_h from cell left join {_LC_SQL} on cell.lc = p.lc")
def lc_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the properties of their land cover (a seven-row dimension)."""
    return cells(spark, sf_dir).join(F.broadcast(raster.land_cover_properties(spark)), "lc", "left").select("r", "c", "lc", "albedo", "emissivity", "tgk", "tstart", "tmax_h")


@query(CELL + "select r, c, case when dsm - dem > 1 then 2 else coalesce(case ((r + 2 * c) % 12) * 10 " + " ".join(f"when {k} then {v}" for k, v in raster.WORLD_COVER.items() if k != 95) + " end, 0) end as lc from cell")
def worldcover_reclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WorldCover codes to classes, buildings on top."""
    code = (((F.col("r") + 2 * F.col("c")) % 12) * 10).cast("int")
    return cells(spark, sf_dir).select("r", "c", raster.reclassify_world_cover(code, F.col("dsm") - F.col("dem")).alias("lc"))


@query("""with g as (select *, cast(nullif(regexp_extract(crs, '(\\d{4,5})\\D*$', 1), '') as int) epsg from grid_tiles)
 select coalesce(epsg, -1) as epsg, pixel, count(*) as tiles, count(distinct n_rows) as row_counts, count(distinct n_cols) as col_counts, count(distinct pixel) = 1 as aligned from g group by 1, 2""")
def raster_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by reference system and pixel, however the system is written."""
    g = table(spark, sf_dir, "grid_tiles").withColumn("epsg", F.coalesce(raster.epsg(F.col("crs")), F.lit(-1)))
    return g.groupBy("epsg", "pixel").agg(F.count("*").alias("tiles"), F.countDistinct("n_rows").alias("row_counts"), F.countDistinct("n_cols").alias("col_counts"), (F.countDistinct("pixel") == 1).alias("aligned"))


@query("""select tile, cast(x as varchar) || '_' || cast(y as varchar) as "window", cast(x as int) as x, cast(y as int) as y, cast(least(150, n_cols - x) as int) as width, cast(least(150, n_rows - y) as int) as height
 from (select *, unnest(range(0, n_cols, 128)) x from grid_tiles) a, (select tile t2, unnest(range(0, n_rows, 128)) y from grid_tiles) b where a.tile = b.t2""")
def tiles_with_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 cells with an overlap of 22."""
    return raster.tile_windows(table(spark, sf_dir, "grid_tiles"), 128, 22)


@query("""with m as (select distinct tile from met_inputs), d as (select distinct site from documents where site is not null) select g.tile, m.tile is not null as has_met, d.site is not null as has_documents from grid_tiles g left join m on g.tile = m.tile left join d on g.tile = d.site""")
def tile_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with the layers that exist for them."""
    m = table(spark, sf_dir, "met_inputs").select("tile").distinct().withColumn("has_met", F.lit(True))
    d = table(spark, sf_dir, "documents").where("site is not null").select(F.col("site").alias("tile")).distinct().withColumn("has_documents", F.lit(True))
    return table(spark, sf_dir, "grid_tiles").select("tile").join(m, "tile", "left").join(d, "tile", "left").na.fill(False)


@query("select tile from grid_tiles where tile not in (select tile from met_inputs where tile is not null) union all select 'both ' || tile from (select tile from grid_tiles intersect select tile from met_inputs)")
def tile_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles without forcing, and the tiles that both sides have."""
    g, m = table(spark, sf_dir, "grid_tiles").select("tile"), table(spark, sf_dir, "met_inputs").select("tile")
    return g.join(m.distinct(), "tile", "left_anti").unionByName(g.intersect(m).select(F.concat(F.lit("both "), "tile").alias("tile")))


@query(CELL + """, n as (select r, c, max(h) top, count(*) k from (select r + 1 r, c, dsm h from cell union all select r - 1, c, dsm from cell union all select r, c + 1, dsm from cell union all select r, c - 1, dsm from cell) group by 1, 2)
 select cell.r, cell.c, case when k = 4 and top - dsm >= 3 then top - dsm else 0e0 end as wall from cell left join n on n.r = cell.r and n.c = cell.c""")
def walls_findwalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall heights from the highest of four neighbours."""
    return raster.walls(cells(spark, sf_dir))


_BOX = """, b as (select r, c, case when dsm - dem >= 2 then 1 else 0 end m, case when dsm - dem >= 2 then dsm - dem else 0e0 end h from cell),
 rw as (select *, sum(m) over w m1, sum(h) over w h1, count(*) over w n1 from b window w as (partition by r order by c range between 4 preceding and 4 following)),
 bx as (select r, c, sum(m1) over w m, sum(h1) over w h, sum(n1) over w n from rw window w as (partition by c order by r range between 4 preceding and 4 following)) """


@query(CELL + _BOX + "select r, c, round(m * 1.0e0 / n, 8) + 0e0 as plan_fraction, round(case when m > 0 then h / m else 0e0 end, 6) + 0e0 as mean_height from bx")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan fraction and mean height of buildings in a moving box."""
    return raster.box_statistics(cells(spark, sf_dir)).select("r", "c", r6("plan_fraction", 8), r6("mean_height"))


@query(CELL + """, m as (select r, c, dsm - dem >= 2 m, dsm - dem h from cell),
 e as (select a.r, a.c, a.h, (case when a.m and not coalesce(w.m, true) then 1 else 0 end + case when a.m and not coalesce(x.m, true) then 1 else 0 end + case when a.m and not coalesce(y.m, true) then 1 else 0 end + case when a.m and not coalesce(z.m, true) then 1 else 0 end) k
  from m a left join m w on w.r = a.r and w.c = a.c - 1 left join m x on x.r = a.r and x.c = a.c + 1 left join m y on y.r = a.r - 1 and y.c = a.c left join m z on z.r = a.r + 1 and z.c = a.c),
 rw as (select r, c, sum(k * h) over w s1, count(*) over w n1 from e window w as (partition by r order by c range between 4 preceding and 4 following)),
 bx as (select r, c, sum(s1) over w s, sum(n1) over w n from rw window w as (partition by c order by r range between 4 preceding and 4 following))
 select r, c, round(least(s / n / pi(), 1.0e0), 7) + 0e0 as lambda_f from bx""")
def frontal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontal area index in a moving box."""
    return raster.frontal_area(cells(spark, sf_dir)).select("r", "c", r6("lambda_f", 7))


_DISC = ", ".join(f"({a}, {b})" for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9)


@query(CELL + f"select t.r, t.c, min(s.dsm) as low from cell t, (values {_DISC}) d(a, b), cell s where s.r = t.r - d.a and s.c = t.c - d.b group by 1, 2")
def min_filter_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least surface height in a disc of three cells."""
    return raster.disc_minimum(cells(spark, sf_dir), "dsm", 3)


@query(CELL + ", g as (select k, exp(-k * k / 4.5e0) w from range(-4, 5) t(k)), x as (select r, c + k c, sum(case when trees > 0 then dsm * w else 0e0 end) x, sum(case when trees > 0 then w else 0e0 end) g from cell, g group by 1, 2), y as (select r + k r, c, sum(x * w) x, sum(x.g * w) g from x, g group by 1, 2) select cell.r, cell.c, round(case when y.g > 0 then y.x / y.g end, 6) + 0e0 as smooth from cell join y on y.r = cell.r and y.c = cell.c")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian smoothing of the surface under trees, other cells missing."""
    c = cells(spark, sf_dir).withColumn("x", F.when(F.col("trees") > 0, F.col("dsm")))
    return raster.gaussian(c, "x", 1.5, 4).select("r", "c", r6("smooth"))


@query(CELL + "select max(dsm) as top_surface, max(case when trees > 0 then trees + dsm else 0e0 end) as top_vegetation, greatest(max(dsm), max(case when trees > 0 then trees + dsm else 0e0 end)) as amax, quantile_disc(dem, 0.5) as median_dem from cell")
def domain_amax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest surface and vegetation of the domain, and the lower median of the terrain."""
    c = raster.layers(cells(spark, sf_dir))
    return c.agg(F.max("dsm").alias("top_surface"), F.max("vegdsm").alias("top_vegetation"), F.greatest(F.max("dsm"), F.max("vegdsm")).alias("amax"), F.expr("percentile_disc(0.5) within group (order by dem)").alias("median_dem"))


# -- sky -----------------------------------------------------------------------------------------
def _bands(spark: SparkSession, option: int) -> DataFrame:
    return spark.createDataFrame(sky.bands(option), "band int, band_alt double, azi_0 double, n_patches int, annulus_lo double, annulus_hi double")


@query(" union all ".join(f"select {o} as option, band, band_alt, k, round(azi_0 + k * 360.0e0 / n_patches, 6) + 0e0 as azimuth from ({sky.bands_sql(o)}) b, range(0, 70) t(k) where k < n_patches" for o in sky.DIVISIONS))
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of all four sky divisions."""
    parts = [_bands(spark, o).withColumn("option", F.lit(o)) for o in sky.DIVISIONS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    e = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_patches") - 1))).withColumn("k", F.col("k").cast("bigint"))
    return e.select("option", "band", "band_alt", "k", F.round(F.col("azi_0") + F.col("k") * 360.0 / F.col("n_patches"), 6).alias("azimuth"))


@query(f"select band, n_patches, round(sum({sky.annulus_weight('k', 'n_patches')}), 9) + 0e0 as weight, round(sum({sky.annulus_weight('k', 'ceil(n_patches / 2.0)')}), 9) + 0e0 as side_weight from ({sky.bands_sql()}) b, range(1, 91) t(k) where k > annulus_lo and k <= annulus_hi group by 1, 2".replace("1.0 ", "1.0e0 "))
def annulus_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the sky bands in view factors."""
    e = _bands(spark, 2).withColumn("k", F.explode(F.sequence((F.col("annulus_lo") + 1).cast("int"), F.col("annulus_hi").cast("int"))))
    return e.groupBy("band", "n_patches").agg(F.round(F.sum(F.expr(sky.annulus_weight("k", "n_patches"))), 9).alias("weight"), F.round(F.sum(F.expr(sky.annulus_weight("k", "ceil(n_patches / 2.0)"))), 9).alias("side_weight"))


@query(f"select band, round({sky.STERADIAN}, 8) + 0e0 as steradian from (select *, min(band_alt) over () first_alt, lag(band_alt) over (order by band) below_alt from ({sky.bands_sql()}) b)")
def patch_steradian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid angles of the patches of each band."""
    from pyspark.sql import Window

    b = _bands(spark, 2).withColumn("first_alt", F.min("band_alt").over(Window.partitionBy())).withColumn("below_alt", F.lag("band_alt").over(Window.orderBy("band")))
    return b.select("band", F.round(F.expr(sky.STERADIAN), 8).alias("steradian"))


# -- marches ----------------------------------------------------------------------------------------
AZIMUTH, ALTITUDE, TOP = 140.0, 38.0, 26.0
STEPS = raster.step_table(AZIMUTH, ALTITUDE, TOP, 100000, 100000)
_STEPS_SQL = "(values " + ", ".join(f"({i}, {a}, {b}, {z!r}e0)" for i, a, b, z in STEPS) + ") s(i, dr, dc, drop_)"


@query(f"select i, dr, dc, round(drop_, 9) + 0e0 as drop_ from {_STEPS_SQL}")
def shadow_step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the march towards one sun position, the overshooting one included."""
    return spark.createDataFrame(STEPS, "i int, dr int, dc int, drop_ double").select("i", "dr", "dc", r6("drop_", 9))


@query(CELL + f"select t.r, t.c, case when greatest(coalesce(max(x.dsm - s.drop_), 0e0), 0e0) > any_value(t.dsm) then 0 else 1 end as sh from cell t, {_STEPS_SQL} left join cell x on x.r = t.r + s.dr and x.c = t.c + s.dc group by 1, 2")
def shadow_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building shadow, relational form."""
    return raster.building_shadow(cells(spark, sf_dir), STEPS)


_VEG_SQL = CELL + f""", v as (select r, c, dsm, case when trees > 0 then trees + dsm else 0e0 end v, case when trees > 0 then 0.25e0 * trees + dsm else 0e0 end w from cell),
 x as (select t.r, t.c, any_value(t.dsm) dsm, any_value(t.w) tw, list(struct_pack(i := s.i, drop_ := s.drop_, a := coalesce(y.dsm - s.drop_, 0e0), v := coalesce(y.v - s.drop_, 0e0), w := coalesce(y.w - s.drop_, 0e0), f := t.dsm, veg := 0e0, vb := 0e0, dsm := t.dsm, tw := t.w) order by s.i) xs
   from v t, {_STEPS_SQL} left join v y on y.r = t.r + s.dr and y.c = t.c + s.dc group by 1, 2),
 z as (select r, c, dsm, list_reduce(list_prepend(struct_pack(i := 0, drop_ := 0e0, a := 0e0, v := 0e0, w := 0e0, f := dsm, veg := 0e0, vb := 0e0, dsm := dsm, tw := tw), xs), lambda p, e: struct_pack(
   i := e.i, drop_ := e.drop_, a := e.a, v := e.v, w := e.w, f := greatest(p.f, e.a),
   veg := case when e.i = 1 then (case when case when e.v - e.a <= 0 then 1000e0 else e.v - e.a end < e.drop_ then 1e0 when greatest(p.f, e.a) > e.dsm and greatest(p.veg, (e.v > e.dsm)::int - (e.w > e.dsm)::int) > 0 then 0e0 else greatest(p.veg, ((e.v > e.dsm)::int - (e.w > e.dsm)::int)::double) end) * (e.tw > e.dsm)::int
      when greatest(p.f, e.a) > e.dsm and greatest(p.veg, ((e.v > e.dsm)::int - (e.w > e.dsm)::int)::double) > 0 then 0e0 else greatest(p.veg, ((e.v > e.dsm)::int - (e.w > e.dsm)::int)::double) end,
   vb := case when e.i = 1 then 0e0 else p.vb + case when greatest(p.f, e.a) > e.dsm and greatest(p.veg, ((e.v > e.dsm)::int - (e.w > e.dsm)::int)::double) > 0 then 0e0 else greatest(p.veg, ((e.v > e.dsm)::int - (e.w > e.dsm)::int)::double) end end,
   dsm := e.dsm, tw := e.tw)) q from x)
 select r, c, case when q.f > dsm then 0 else 1 end as sh, 1 - case when q.veg > 0 then 1 else 0 end as vegsh, 1 - (case when q.vb > 0 then 1 else 0 end - case when q.veg > 0 then 1 else 0 end) as vbshvegsh from z"""


@query(_VEG_SQL)
def shadow_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building and vegetation shadow by ordered fold, relational form."""
    return raster.vegetation_shadow(raster.layers(cells(spark, sf_dir)), STEPS)


@query(_VEG_SQL)
def shadow_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shadows by array marches over blocks with halo."""
    s = march.shadow_blocks(raster.layers(cells(spark, sf_dir)), AZIMUTH, ALTITUDE, TOP, size=96)
    return s.select("r", "c", *(F.col(x).cast("int").alias(x) for x in ("sh", "vegsh", "vbshvegsh")))


@query()
def svf_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky view factors over the 153 patches, by blocks."""
    s = march.sky_view_blocks(raster.layers(cells(spark, sf_dir)), TOP)
    return s.select("r", "c", *(r6(x) for x in march.SKY))


def _walled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return raster.walls(c).join(c.select("r", "c", "dsm"), ["r", "c"])


@query()
def wall_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction that each wall faces."""
    return march.wall_aspect_blocks(_walled(spark, sf_dir), size=128).where("aspect > 0").select("r", "c", r6("aspect", 4))


@query()
def wall_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunlit and shaded wall heights, by the direction that the walls face."""
    w = _walled(spark, sf_dir)
    faced = w.join(march.wall_aspect_blocks(w, size=128).withColumn("aspect", F.radians("aspect")), ["r", "c"])
    return march.wall_light_blocks(faced, AZIMUTH, ALTITUDE, TOP, size=128).select("r", "c", r6("wall_sun"), r6("wall_shade"))


@query()
def gvf_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground view over 18 azimuths."""
    c = raster.layers(cells(spark, sf_dir))
    lit = raster.building_shadow(c, STEPS).withColumnRenamed("sh", "lit")
    a = c.join(F.broadcast(raster.land_cover_properties(spark).select("lc", "albedo")), "lc", "left").join(lit, ["r", "c"])
    return march.ground_view_blocks(a, size=128).select("r", "c", r6("lit"), r6("albedo_lit"), r6("albedo"))


# -- objects on rasters ---------------------------------------------------------------------------------
_TREES = "(select p_partkey as tree, (p_partkey * 37 % 4000) / 4.0e0 as x, (p_partkey * 91 % 4000) / 4.0e0 as y, 1.0e0 + (p_partkey % 9) / 2.0e0 as radius, 3.0e0 + p_partkey % 20 as height from part)"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("tree"), ((k * 37 % 4000) / 4.0).alias("x"), ((k * 91 % 4000) / 4.0).alias("y"), (1.0 + (k % 9) / 2.0).alias("radius"), (3.0 + k % 20).alias("height"))


@query(f"""select cast(r as int) as r, cast(c as int) as c, max(height) as canopy, count(*) as crowns from (select t.*, unnest(range(cast(floor((y - radius) / 2.0e0) as bigint), cast(ceil((y + radius) / 2.0e0) as bigint) + 1)) r from {_TREES} t) a,
 lateral (select unnest(range(cast(floor((x - radius) / 2.0e0) as bigint), cast(ceil((x + radius) / 2.0e0) as bigint) + 1)) c) b
 where ((c + 0.5e0) * 2.0e0 - x) * ((c + 0.5e0) * 2.0e0 - x) + ((r + 0.5e0) * 2.0e0 - y) * ((r + 0.5e0) * 2.0e0 - y) <= radius * radius group by 1, 2""")
def raster_tree_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canopy height of crowns on cells: the largest of the discs that hold the centre."""
    return raster.discs_on_cells(_trees(spark, sf_dir), 2.0).groupBy("r", "c").agg(F.max("height").alias("canopy"), F.count("*").alias("crowns"))


_HEX = ((0, 4), (6, 0), (14, 0), (20, 4), (14, 9), (6, 9))
#: A convex ring holds a point if it lies on one side of every edge, or on it.
_INSIDE = " and ".join(f"({bx - ax}) * (r + 0.5e0 - oy - {ay}) - ({by - ay}) * (c + 0.5e0 - ox - {ax}) >= 0" for (ax, ay), (bx, by) in zip(_HEX, _HEX[1:] + _HEX[:1]))


@query(f"with p as (select s_suppkey * 53 % 900 ox, s_suppkey * 29 % 900 oy, 3e0 + s_suppkey % 30 as height from supplier), x as (select p.*, ox + unnest(range(0, 21)) c from p), y as (select x.*, oy + unnest(range(0, 10)) r from x) select cast(r as int) as r, cast(c as int) as c, max(height) as height from y where {_INSIDE} group by 1, 2")
def raster_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building heights on cells from hexagonal footprints, the highest where they overlap."""
    k = F.col("s_suppkey")
    corner = lambda dx, dy: F.struct((k * 53 % 900 + F.lit(float(dx))).alias("x"), (k * 29 % 900 + F.lit(float(dy))).alias("y"))
    rings = table(spark, sf_dir, "supplier").select((3.0 + k % 30).alias("height"), F.array(corner(0, 4), corner(6, 0), corner(14, 0), corner(20, 4), corner(14, 9), corner(6, 9)).alias("ring"))
    return raster.polygons_on_cells(rings).groupBy("r", "c").agg(F.max("height").alias("height"))


@query(f"""with a as (select tree, x, y, height, radius, x - height * 2 x0, x + height * 2 x1, y - height * 2 y0, y + height * 2 y1 from {_TREES} t) select a.tree as edited, count(*) as affected from a join a b on a.tree % 50 = 0 and a.tree <> b.tree and b.x - b.radius <= a.x1 and b.x + b.radius >= a.x0 and b.y - b.radius <= a.y1 and b.y + b.radius >= a.y0 group by 1""")
def spatial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees whose crown box meets the influence box of each fiftieth tree, by an index of 64 m buckets."""
    size = 64
    t = _trees(spark, sf_dir)
    near = lambda mid, half: F.sequence(F.floor((mid - half) / size).cast("int"), F.floor((mid + half) / size).cast("int"))
    index = t.select(F.col("tree").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("radius").alias("br"), F.explode(near(F.col("x"), F.col("radius"))).alias("kx"), "y", "radius").withColumn("ky", F.explode(near(F.col("y"), F.col("radius")))).drop("y", "radius")
    probe = t.where("tree % 50 = 0").withColumn("half", F.col("height") * 2).select(F.col("tree").alias("edited"), "x", "y", "half", F.explode(near(F.col("x"), F.col("half"))).alias("kx")).withColumn("ky", F.explode(near(F.col("y"), F.col("half"))))
    hit = probe.join(index, ["kx", "ky"]).where((F.col("edited") != F.col("b")) & (F.col("bx") - F.col("br") <= F.col("x") + F.col("half")) & (F.col("bx") + F.col("br") >= F.col("x") - F.col("half")) & (F.col("by") - F.col("br") <= F.col("y") + F.col("half")) & (F.col("by") + F.col("br") >= F.col("y") - F.col("half")))
    return hit.select("edited", "b").distinct().groupBy("edited").agg(F.count("*").alias("affected"))


# -- wind, components, sources ------------------------------------------------------------------------------
_RF = "ln(1.5e0 / 0.03e0)"


@query(CELL + f"""select r, c, round(case when trees <= 0 then 1e0 when greatest(trees, 1e-6) > 1.5e0 then least(exp(9.6e0 * 0.4e0 * (1.5e0 / trees - 1)) * ln(greatest((trees - 0.7e0 * trees) / greatest(0.1e0 * trees, 0.03e0), 1.01e0)) / {_RF}, 1e0)
 else least(ln(case when (1.5e0 - 0.7e0 * trees) / greatest(0.1e0 * trees, 0.03e0) <= 1 then 1.01e0 else (1.5e0 - 0.7e0 * trees) / greatest(0.1e0 * trees, 0.03e0) end) / {_RF}, 1e0) end, 7) + 0e0 as coefficient from cell""")
def wind_coeff_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind coefficient at 1.5 m in and over tree canopies of density 0.4."""
    return cells(spark, sf_dir).select("r", "c", F.round(raster.canopy_wind(F.col("trees"), F.lit(0.4)), 7).alias("coefficient"))


_WIND = (
    "select b.r, b.c, round(case when b.h <= 0 or f.l <= 0 then 1e0 else least(case when hh > 1.5e0 then exp(9.6e0 * f.l * (1.5e0 / hh - 1)) * ln(greatest(0.3e0 * hh / greatest(0.1e0 * hh, 0.03e0), 1.01e0)) else ln(case when (1.5e0 - 0.7e0 * hh) / greatest(0.1e0 * hh, 0.03e0) <= 1 then 1.01e0 else (1.5e0 - 0.7e0 * hh) / greatest(0.1e0 * hh, 0.03e0) end) end / ln(1.5e0 / 0.03e0), 1e0) end, 6) as coefficient from (select *, greatest(h, 1e-6) hh from ("
    + CELL + _BOX + "select r, c, case when m > 0 then h / m else 0e0 end as h from bx) q) b join (" + SQL["frontal_area"].replace("round(least(s / n / pi(), 1.0e0), 7) + 0e0 as lambda_f", "least(s / n / pi(), 1.0e0) as l") + ") f on f.r = b.r and f.c = b.c"
)


@query(_WIND)
def wind_coeff_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind coefficient at 1.5 m from the mean height and frontal area of the buildings around."""
    c = cells(spark, sf_dir)
    both = raster.box_statistics(c).join(raster.frontal_area(c), ["r", "c"])
    return both.select("r", "c", F.round(raster.canopy_wind(F.col("mean_height"), F.col("lambda_f")), 6).alias("coefficient"))


@query(CELL.replace("with ", "with recursive ") + ", b as (select r, c, dsm - dem h from cell where dsm - dem >= 2), w(r, c, r0, c0) as (select r, c, r, c from b union select b.r, b.c, w.r0, w.c0 from w join b on abs(b.r - w.r) + abs(b.c - w.c) = 1), l as (select r, c, min(r0 * 1000000 + c0) k from w group by 1, 2) select min(b.r) as r0, max(b.r) as r1, min(b.c) as c0, max(b.c) as c1, count(*) as cells, round(avg(h), 6) as mean_height from l join b on b.r = l.r and b.c = l.c group by k")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as connected components with their box, size and mean height."""
    c = cells(spark, sf_dir).where("dsm - dem >= 2").withColumn("h", F.col("dsm") - F.col("dem"))
    lab = raster.components(c)
    g = lab.join(c.select("r", "c", "h"), ["r", "c"]).groupBy("component")
    return g.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("cells"), F.round(F.avg("h"), 6).alias("mean_height")).drop("component")


_NAMES = "case event_id % 4 when 0 then 'wrfout_d0' || (1 + event_id % 3) || '_2020-08-' || lpad(cast(1 + event_id % 28 as varchar), 2, '0') || '_' || lpad(cast(event_id % 24 as varchar), 2, '0') when 1 then 'wrfout_d02_2020-08-13_12:30:45' when 2 then 'out/wrfout_d01_2020-08-13_06_00_00' else 'wrfinput_d01' end"


@query(f"""with n as (select event_id, {_NAMES} as name from events), p as (select event_id, regexp_extract(name, '([^/]+)$', 1) b from n), q as (select event_id, b, regexp_extract(b, '^wrfout_d(\\d{{2}})_(\\d{{4}}-\\d{{2}}-\\d{{2}})_(\\d{{2}})(?:[_:](\\d{{2}}))?(?:[_:](\\d{{2}}))?$', ['d', 'day', 'h', 'm', 's']) x from p)
 select event_id, cast(nullif(x.d, '') as int) as domain, case when x.d <> '' then cast(x.day || ' ' || x.h || ':' || case when x.m = '' then '00' else x.m end || ':' || case when x.s = '' then '00' else x.s end as timestamp) end as starts from q""")
def model_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and start of model output files by their names; other names give nulls."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_NAMES.replace("varchar", "string")).alias("name"))
    parts = io.model_file_parts(F.col("name"))
    return e.select("event_id", parts["domain"].alias("domain"), parts["starts"].alias("starts"))


@query(CELL + "select r, c, dsm from cell where r >= 3 and r < 40 and c >= 10 and c < 90")
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one window of the raster."""
    return io.window(cells(spark, sf_dir).select("r", "c", "dsm"), 3, 40, 10, 90)


@query("select tile, regexp_extract(tile, '(\\d+_\\d+)$', 1) as key, cast(split_part(regexp_extract(tile, '(\\d+_\\d+)$', 1), '_', 1) as int) as x, cast(split_part(regexp_extract(tile, '(\\d+_\\d+)$', 1), '_', 2) as int) as y from grid_tiles order by x, y")
def tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by the key in their name, in numeric order."""
    g = table(spark, sf_dir, "grid_tiles").select("tile", io.tile_key(F.col("tile")).alias("key"))
    xy = F.split("key", "_")
    return g.select("tile", "key", xy[0].cast("int").alias("x"), xy[1].cast("int").alias("y")).orderBy("x", "y")
