"""Session helpers: the shared work folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only in a local session that names none (tests) a folder of our own is made
    and recorded in the session, so later calls agree on it; on a cluster it must be named.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        where = "file://" + os.path.join(tempfile.gettempdir(), "thermaloom-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that nothing else uses, removed when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{folder}/data"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    The files survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for those whose Python path does not hold it.

    The archive is served by the driver; executors keep their own copy of it.
    """
    import shutil

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
