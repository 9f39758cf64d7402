"""All registered queries of the core library and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermaloom.plans import catalog_queries, datasets, engine_queries, log_queries, physics_queries, pipeline, raster_queries, stream_queries

MODULES = (datasets, physics_queries, raster_queries, log_queries, catalog_queries, engine_queries, stream_queries, pipeline)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.comfort_by_hour(spark, sf_dir)
