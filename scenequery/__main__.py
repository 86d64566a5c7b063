"""python -m scenequery QUERY SF_DIR OUT [--format parquet|json|csv] [--compression CODEC] [--overwrite], or --list."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .catalogue import QUERIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scenequery", description="Run a named query and write its result.")
    parser.add_argument("query", nargs="?")
    parser.add_argument("sf_dir", nargs="?")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    parser.add_argument("--compression", help="the format's codec, such as zstd; the session's if not given")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--list", action="store_true")
    given = parser.parse_args(args)
    if given.list:
        print(*sorted(QUERIES), sep="\n")
        return 0
    if given.query not in QUERIES or not given.sf_dir or not given.out:
        print(f"unknown query or missing paths: {given.query}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("scenequery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        writer = QUERIES[given.query](spark, given.sf_dir).write.mode("overwrite" if given.overwrite else "errorifexists").format(given.format)
        (writer.option("compression", given.compression) if given.compression else writer).save(given.out)
    except Exception as failed:  # a front end reports and ends
        print(f"{type(failed).__name__}: {failed}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
