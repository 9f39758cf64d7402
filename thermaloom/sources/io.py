"""Sources and sinks: forcing text files, model output names, raster windows, result tables with atomic publication."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a forcing text file in order, and the number of decimals of each that is not 2.
MET_COLUMNS = ("iy", "id", "it", "imin", "q_star", "qh", "qe", "qs", "qf", "wind", "rh", "ta", "press", "rain", "kdn", "snow", "ldown", "fcld", "wuh", "xsmd", "lai_hr", "kdiff", "kdir", "wd", "uhii")
MET_DECIMALS = {"wind": 5, "iy": 0, "id": 0, "it": 0, "imin": 0}
SENTINEL = -999.0
#: Names of regional-model output: domain and start of the file; hours, minutes and seconds may be missing.
MODEL_FILE = r"^wrfout_d(\d{2})_(\d{4}-\d{2}-\d{2})_(\d{2})(?:[_:](\d{2}))?(?:[_:](\d{2}))?$"


def read_met_text(spark: SparkSession, path: str) -> DataFrame:
    """A forcing text file (blanks between columns, one header line); the sentinel becomes null. Later columns may be missing.

    Rows that hold no numbers are left out.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^-?\d"))
    number = lambda i: F.when(F.size(parts) > i, F.try_element_at(parts, F.lit(i + 1)).try_cast("double"))
    return rows.select(*(F.when(number(i) != SENTINEL, number(i)).alias(c) for i, c in enumerate(MET_COLUMNS))).withColumns({c: F.col(c).cast("int") for c in MET_COLUMNS[:4]})


def met_lines(met: DataFrame) -> DataFrame:
    """Rows as lines of a forcing text file with their fixed number of decimals; what is missing is the sentinel."""
    have = set(met.columns)

    def text(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) if c in have else F.lit(SENTINEL)
        return F.format_string(f"%.{MET_DECIMALS.get(c, 2)}f", x)

    return met.select(F.concat_ws(" ", *(text(c) for c in MET_COLUMNS)).alias("value"))


def write_met_text(met: DataFrame, path: str) -> None:
    """Part files of lines in order of time, with the header in the first line of each."""
    header = met.sparkSession.createDataFrame([(" ".join(MET_COLUMNS),)], "value string")
    lines = met_lines(met.orderBy("iy", "id", "it", "imin"))
    header.unionByName(lines).coalesce(1).write.mode("errorifexists").text(path)


def model_file_parts(name: Column) -> dict[str, Column]:
    """Domain and start time named by a model output file; null for other names."""
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    part = lambda i: F.nullif(F.regexp_extract(base, MODEL_FILE, i), F.lit(""))
    stamp = F.concat(part(2), F.lit(" "), part(3), F.lit(":"), F.coalesce(part(4), F.lit("00")), F.lit(":"), F.coalesce(part(5), F.lit("00")))
    return {"domain": part(1).cast("int"), "starts": F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))}


def valid_time(frame: DataFrame) -> Column:
    """The time of a row whichever way it is given: ``valid_time``, or ``time`` and ``step`` (an interval in hours), or ``time``."""
    have = set(frame.columns)
    forms = [F.col("valid_time")] if "valid_time" in have else []
    if "time" in have:
        forms += [F.timestamp_seconds(F.unix_timestamp("time") + F.col("step") * 3600)] if "step" in have else []
        forms.append(F.col("time"))
    if not forms:
        raise ValueError("neither valid_time nor time is given")
    return F.coalesce(*(f.cast("timestamp") for f in forms))


def window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """The cells of a half-open window; both bounds reach the Parquet scan."""
    return cells.where(f"r >= {int(r0)} and r < {int(r1)} and c >= {int(c0)} and c < {int(c1)}")


def tile_key(path: Column) -> Column:
    """The ``x_y`` key at the end of a tile's file name; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"(\d+_\d+)(?:\.\w+)?$", 1), F.lit(""))


def grid_fingerprint(grid: DataFrame) -> DataFrame:
    """A hash of each tile's geometry, rounded to a millionth, by which cached results are known to fit."""
    parts = ("n_rows", "n_cols", *(F.round(c, 6).alias(c) for c in ("origin_x", "origin_y", "pixel")))
    return grid.select("tile", F.sha2(F.to_json(F.struct(*parts)), 256).alias("fingerprint"))


# -- results ------------------------------------------------------------------------------
def publish(result: DataFrame, root: str, revision: int, partition_by: Sequence[str] = ("variable",)) -> str:
    """Write a revision to a staging folder and give it its name by one rename; a revision is published once.

    Readers see whole revisions only, and a writer that dies leaves a staging folder that no reader looks at.
    """
    spark = result.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    final, staged = f"{root}/revision={int(revision)}", f"{root}/.staged-{int(revision)}"
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(final)):
        raise ValueError(f"revision {revision} is published already")
    result.write.mode("overwrite").partitionBy(*partition_by).parquet(staged)
    fs.mkdirs(path(root))
    if not fs.rename(path(staged), path(final)):
        raise RuntimeError(f"{final} could not be published")
    return final


def revisions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    names = [str(s.getPath().getName()) for s in fs.listStatus(path(root))]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"revision=(\d+)", n)))


def read_revision(spark: SparkSession, root: str, revision: int | None = None) -> DataFrame:
    """A revision, by default the newest."""
    known = revisions(spark, root)
    if not known:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/revision={revision if revision is not None else known[-1]}")


def rotate(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Delete all but the first and the ``keep`` newest revisions; returns those deleted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    known = revisions(spark, root)
    gone = known[1:-keep] if len(known) > keep + 1 else []
    for r in gone:
        fs.delete(path(f"{root}/revision={r}"), True)
    return gone
