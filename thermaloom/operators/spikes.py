"""Implausible readings: spikes, stuck values and impossible measurements.

Readings are judged against their own station. The rows of a station are dealt
out in chunks of time with a halo on either side, so a station may hold any share
of the rows. Within a chunk:

1. Physical bounds. Humidity outside 0..100, negative radiation, temperature
   outside what occurs on earth. Radiation is also bounded by the sun's height at
   the station (local solar time and latitude): nothing by night, nothing far
   above the sky's own course by day, nothing near zero by day.
2. Stuck values. Runs of six or more equal successive values, unless humidity is
   100 or the radiation 0 with the sun down.
3. Hampel filter, for all four fields; radiation as its part of that above the
   atmosphere, with the sun well up. Distance from the rolling median beyond a multiple of the
   station's own scale (the rolling median absolute deviation), and
   beyond what any weather does within the window.
4. Excursions. A jump out of the course and one back into it within half a day,
   each larger than any weather makes in that time (as when a logger changes its
   unit), and humidities that are a small part of the station's course.
5. Diffuse above global radiation, where the latter is no case itself.

Runs of equal values that cross the borders of chunks are put together exactly:
each chunk passes on the first and last run of each field, with at most five
reading ids, and a window over these few rows per chunk adds up their lengths,
however far apart in time they lie. Windows end at ``REACH``, which is less than the halo,
so verdicts do not depend on where chunks begin. How much of the sun's radiation a station
sees at most comes from one aggregate over all its readings.

Defined results: null, NaN and -999 are missing, never cases, and skipped in runs.
A reading delivered several times counts once. Rows without a time get the bounds
that need none. Without a latitude, radiation has only the bounds that need no sun.
Readings of one station at the same time are ordered by reading id. An empty table
has no cases.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("ta", "rh", "radg", "radd")
MISSING = -999.0
RUN = 6
CHUNK_DAYS, HALO_DAYS = 32, 2
SOLAR_CONSTANT = 1361.0
#: Half-widths of the rolling median and of the rolling deviation, in readings, and in seconds.
HALF, WIDE, COURSE = 4, 24, 28
REACH = 86400.0
#: Least distance from the rolling median, and multiple of the station's scale, for a spike; of radiation as a part (clouds move it by half at once).
FLOOR = {"ta": 3.8, "rh": 17.0, "radg": 0.6, "radd": 0.6}
SCALE = 10.0
#: Jump between two readings a quarter of an hour apart that no weather makes, and what each further step allows.
JUMP = {"ta": (6.0, 2.0), "rh": (22.0, 6.0)}
STEP_S = 900
EXCURSION_S = 12 * 3600
#: A humidity below this part of the course around it.
PART = 0.1
AIR = (-90.0, 60.0)
#: Global and diffuse radiation as parts of that above the atmosphere: largest that any sky gives.
TOP = {"radg": 0.95, "radd": 0.30}
#: ... and how far above the station's own 95th percentile they may lie, if it has so many readings with the sun up.
OVER, ENOUGH = 1.25, 200
#: Least part by day, with the sun above and below a sine of 0.1 of its height.
LEAST_HIGH, LEAST_LOW = 0.015, 0.003
#: Sines of the sun's height from which and up to which it is day and night for sure.
SUN_UP, SUN_DOWN = 0.02, -0.02
#: ... and from which the sun is well up.
HIGH = 0.1

_OUT = "kind int, reading_id bigint, field string, station string, chunk bigint, pos int, value double, length bigint, whole boolean, ids array<bigint>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("reading_id", pa.int64()), ("field", pa.string()), ("station", pa.string()), ("chunk", pa.int64()), ("pos", pa.int32()), ("value", pa.float64()), ("length", pa.int64()), ("whole", pa.bool_()), ("ids", pa.list_(pa.int64()))])
CASE, EDGE = 0, 1


def sun_sine(day_of_year: np.ndarray, hour: np.ndarray, latitude: np.ndarray) -> np.ndarray:
    """Sine of the sun's height from local solar time."""
    decl = np.radians(23.45) * np.sin(2 * np.pi * (284 + day_of_year) / 365)
    lat = np.radians(latitude)
    return np.sin(lat) * np.sin(decl) + np.cos(lat) * np.cos(decl) * np.cos(np.radians(15 * (hour - 12)))


def rolling_median(x: np.ndarray, t: np.ndarray, half: int, reach: float = REACH) -> np.ndarray:
    """Median of up to ``2 half + 1`` values around each that lie within ``reach`` seconds."""
    pad = lambda v: np.concatenate([np.full(half, np.nan), v, np.full(half, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(pad(x), 2 * half + 1)
    when = np.lib.stride_tricks.sliding_window_view(pad(t), 2 * half + 1)
    with np.errstate(invalid="ignore"):
        window = np.sort(np.where(np.abs(when - t[:, None]) <= reach, view, np.nan), axis=1)  # what is out comes last
    k = np.count_nonzero(~np.isnan(window), axis=1)
    row = np.arange(len(x))
    return (window[row, (k - 1) // 2] + window[row, k // 2]) / 2


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(x):
        return np.zeros(0, int), np.zeros(0, int)
    start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return start, np.diff(np.append(start, len(x)))


def lasts_by_nature(field: str, value: np.ndarray) -> np.ndarray:
    return value == (100.0 if field == "rh" else 0.0) if field != "ta" else np.zeros(np.shape(value), bool)


def hampel(x: np.ndarray, t: np.ndarray, field: str) -> np.ndarray:
    """Values too far from the rolling median; x without missing values, in order of t (seconds)."""
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    away = np.abs(x - rolling_median(x, t, HALF))
    least = np.maximum(FLOOR[field], SCALE * 1.4826 * rolling_median(away, t, WIDE))
    near = np.searchsorted(t, t + 10 * STEP_S, "right") - np.searchsorted(t, t - 10 * STEP_S, "left") - 1
    bad = away > np.where(near >= 4, least, 4 * least)
    for i in np.flatnonzero(bad):  # beside a gap the median may lie on its far side: what agrees with a good neighbour is good
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and bad[j] and abs(j - i) < 3:
                j += step
            if 0 <= j < n and not bad[j] and abs(t[j] - t[i]) <= 4 * STEP_S and abs(x[j] - x[i]) < 0.35 * least[i]:
                bad[i] = False
                break
    return bad


def spikes(x: np.ndarray, t: np.ndarray, field: str) -> np.ndarray:
    """Hampel filter, then excursions and, for humidity, parts of the course."""
    bad = hampel(x, t, field)
    ok = np.flatnonzero(~bad)
    bad[ok[_excursions(x[ok], t[ok], field)]] = True
    if field == "rh":
        ok = np.flatnonzero(~bad)
        if len(ok):
            course = rolling_median(x[ok], t[ok], COURSE)
            bad[ok[(x[ok] < PART * course) & (course > 8)]] = True
    return bad


def _excursions(x: np.ndarray, t: np.ndarray, field: str) -> np.ndarray:
    out = np.zeros(len(x), bool)
    if len(x) < 3:
        return out
    d, steps = np.diff(x), np.maximum(1, np.round(np.diff(t) / STEP_S))
    base, more = JUMP[field]
    jumps = np.flatnonzero((np.abs(d) > base + more * (steps - 1)) & (steps <= 8))
    i = 0
    while i < len(jumps):
        a = jumps[i]
        for k in range(i + 1, len(jumps)):
            b = jumps[k]
            if t[b] - t[a + 1] > EXCURSION_S:
                break
            if d[a] * d[b] < 0 and abs(d[a] + d[b]) <= 0.4 * max(abs(d[a]), abs(d[b])):
                out[a + 1 : b + 1] = True
                i = k
                break
        i += 1
    return out


def judge(t: np.ndarray, sun: np.ndarray, values: dict[str, np.ndarray], top: dict[str, float]) -> dict[str, np.ndarray]:
    """Cases among the readings of one station in order of time, all but those of runs that reach over the ends."""
    bad = {}
    for f in FIELDS:
        v = values[f]
        seen = ~np.isnan(v)
        with np.errstate(invalid="ignore"):
            if f == "ta":
                b = (v < AIR[0]) | (v > AIR[1])
            elif f == "rh":
                b = (v < 0) | (v > 100)
            else:
                b = (v < 0) | _sky(v, sun, top[f])
        at = np.flatnonzero(seen)
        start, length = runs(v[at])
        for s, n in zip(start[length >= RUN], length[length >= RUN]):
            rows = at[s : s + n]
            if not lasts_by_nature(f, v[rows[0]]):
                b[rows] = True
            elif f in ("radg", "radd"):
                b[rows[sun[rows] > SUN_UP]] = True
        with np.errstate(invalid="ignore"):
            ok = np.flatnonzero(seen & ~b & ((sun > HIGH) | (f in JUMP)))
        b[ok[spikes(v[ok], t[ok], f) if f in JUMP else hampel(v[ok] / (SOLAR_CONSTANT * sun[ok]), t[ok], f)]] = True
        bad[f] = b & seen
    with np.errstate(invalid="ignore"):
        bad["radd"] |= (values["radd"] > values["radg"]) & ~bad["radg"]
    return bad


def _sky(v: np.ndarray, sun: np.ndarray, top: float) -> np.ndarray:
    """Radiation that no sky gives with the sun at this height; false where the height is unknown."""
    above = SOLAR_CONSTANT * np.maximum(sun, 0)
    with np.errstate(invalid="ignore"):
        too_much = v > top * above + np.where(sun > SUN_DOWN, 6.0, 3.0)
        too_little = (sun > SUN_UP) & (v < np.where(sun > HIGH, LEAST_HIGH, LEAST_LOW) * above)
        return too_much | too_little


def _chunk_kernel(table: pa.Table, days: int) -> pa.Table:
    chunk = table["chunk"][0].as_py()
    station = table["station"][0].as_py()
    ids = table["reading_id"].to_numpy()
    t = table["sec"].to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((ids, t))
    order = order[np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (t[order][1:] != t[order][:-1])])] if len(order) else order
    ids, t = ids[order], t[order]
    values = {f: table[f].to_numpy(zero_copy_only=False).astype(float)[order] for f in FIELDS}
    if np.isnan(t).any():  # rows without a time: bounds only
        sun = np.full(len(t), np.nan)
        bad = {f: np.zeros(len(t), bool) for f in FIELDS}
        with np.errstate(invalid="ignore"):
            bad["ta"] = (values["ta"] < AIR[0]) | (values["ta"] > AIR[1])
            bad["rh"] = (values["rh"] < 0) | (values["rh"] > 100)
            bad["radg"], bad["radd"] = values["radg"] < 0, values["radd"] < 0
            bad["radd"] |= (values["radd"] > values["radg"]) & ~bad["radg"]
        core = np.ones(len(t), bool)
    else:
        day = np.floor(t / 86400)
        latitude = table["latitude"].to_numpy(zero_copy_only=False).astype(float)[order]
        doy = table["doy"].to_numpy(zero_copy_only=False).astype(float)[order]
        sun = sun_sine(doy, (t - day * 86400) / 3600, latitude)
        bad = judge(t, sun, values, {f: table[f"top_{f}"][0].as_py() for f in TOP})
        core = np.floor(day / days) == chunk
    rows: list[tuple] = []
    for f in FIELDS:
        rows += [(CASE, int(i), f, None, None, None, None, None, None, None) for i in ids[bad[f] & core]]
        at = np.flatnonzero(core & ~np.isnan(values[f]))
        start, length = runs(values[f][at])
        edges = [(0, 0)] if len(start) == 1 else [(0, 0), (1, len(start) - 1)] if len(start) else []
        for pos, k in edges:
            pending = ids[at[start[k] : start[k] + length[k]]].tolist() if length[k] < RUN else []
            rows.append((EDGE, None, f, station, chunk, pos, float(values[f][at[start[k]]]), int(length[k]), len(start) == 1, pending))
    if not rows:
        return _SCHEMA.empty_table()
    return pa.table({n.name: pa.array(list(c), n.type) for n, c in zip(_SCHEMA, zip(*rows))}, schema=_SCHEMA)


def _tops(rows: DataFrame) -> DataFrame:
    """``station, top_radg, top_radd``: the largest part of the radiation above the atmosphere that the station may see."""
    decl = F.radians(F.lit(23.45)) * F.sin(2 * np.pi * (284 + F.col("doy")) / 365)
    lat, hour = F.radians("latitude"), F.pmod("sec", F.lit(86400.0)) / 3600
    sun = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(F.radians(15 * (hour - 12)))
    part = lambda f: F.when(F.col("sun") > HIGH, F.col(f) / (SOLAR_CONSTANT * F.col("sun")))
    seen = rows.select("station", sun.alias("sun"), *TOP).groupBy("station").agg(*(g(part(f)).alias(f"{n}_{f}") for f in TOP for n, g in (("n", F.count), ("q", lambda c: F.percentile_approx(c, 0.95, 1000)))))
    own = lambda f: F.when(F.col(f"n_{f}") >= ENOUGH, OVER * F.col(f"q_{f}")).otherwise(0.0)
    return seen.select("station", *(F.least(F.greatest(F.lit(TOP[f]), own(f)), F.lit(1.5 * TOP[f])).alias(f"top_{f}") for f in TOP))


def implausible(readings: DataFrame, latitudes: DataFrame, keep: Iterable[str] = FIELDS, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """``reading_id, field`` of every implausible reading, each pair once.

    ``readings``: reading_id, station, tile, obs_time and the measured fields;
    ``latitudes``: tile, latitude (a dimension of the grid).
    """
    from thermaloom.session import materialize

    clean = [F.when(F.isnan(F.col(f).cast("double")) | (F.col(f).cast("double") == MISSING), None).otherwise(F.col(f).cast("double")).alias(f) for f in FIELDS]
    sec = F.unix_micros(F.col("obs_time").cast("timestamp")) / 1e6
    where = latitudes.groupBy("tile").agg(F.min("latitude").alias("latitude"))
    rows = readings.select("reading_id", F.col("station").cast("string").alias("station"), "tile", sec.alias("sec"), F.dayofyear("obs_time").alias("doy"), *clean).join(where, "tile", "left").drop("tile")
    rows = rows.join(_tops(rows), "station", "left").fillna({f"top_{f}": top for f, top in TOP.items()})  # a null station has no course of its own
    day = F.floor(F.col("sec") / 86400)
    chunks = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-HALO_DAYS), F.lit(HALO_DAYS)), lambda h: F.floor((day + h) / chunk_days)))
    no_time = F.array(-F.pmod(F.col("reading_id"), F.lit(64)) - F.lit(1 << 40))
    dealt = rows.withColumn("chunk", F.explode(F.when(F.col("sec").isNull(), no_time).otherwise(chunks)))
    judged = materialize(dealt.groupBy("station", "chunk").applyInArrow(lambda rows: _chunk_kernel(rows, chunk_days), _OUT), "judged")

    found = judged.where(F.col("kind") == CASE).select("reading_id", "field")
    line = Window.partitionBy("station", "field").orderBy("chunk", "pos")
    edges = judged.where((F.col("kind") == EDGE) & (F.col("chunk") > -(1 << 40)))
    # an edge run goes on from the edge before if the value is the same, unless both are runs of one chunk
    before = F.lag("value").over(line)
    goes_on = (before == F.col("value")) & ~((F.lag("chunk").over(line) == F.col("chunk")))
    island = edges.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("length").over(Window.partitionBy("station", "field", "island"))
    natural = ((F.col("field") == "rh") & (F.col("value") == 100)) | (F.col("field").isin("radg", "radd") & (F.col("value") == 0))
    across = island.withColumn("total", total).where((F.col("total") >= RUN) & ~natural & (F.size("ids") > 0)).select(F.explode("ids").alias("reading_id"), "field")
    return found.unionByName(across).where(F.col("field").isin(*keep)).distinct()
