"""Run a registered query from the command line: python -m thermaloom NAME TABLES [--out FOLDER] [--list]."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="thermaloom", description="Run a registered query over a folder of Parquet tables.")
    parser.add_argument("name", nargs="?", help="query")
    parser.add_argument("tables", nargs="?", help="folder that holds NAME.parquet for each table")
    parser.add_argument("--out", help="folder to write Parquet to; without it twenty rows are shown")
    parser.add_argument("--list", action="store_true", help="list the queries")
    args = parser.parse_args(argv)
    from thermaloom.plans import registry

    if args.list or not args.name:
        print("\n".join(sorted(registry.queries())))
        return 0
    if args.name not in registry.queries() or not args.tables:
        parser.error("name a registered query and a folder of tables")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"thermaloom {args.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = registry.queries()[args.name](spark, args.tables)
    if args.out:
        result.write.mode("errorifexists").parquet(args.out)
    else:
        result.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
