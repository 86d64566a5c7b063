"""One session for all tests, and a comparison of query results with DuckDB's."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    session = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def value(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return "[" + ",".join(map(value, x)) + "]"
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return str(bool(x))
    if isinstance(x, str):
        return x
    return repr(round(float(x), 6) + 0.0) if not isinstance(x, dict) else str({k: value(v) for k, v in sorted(x.items())})


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted("|".join(map(value, r)) for r in frame[columns].itertuples(index=False, name=None))


def run_sql(sql: str, folder: str = DATA) -> pd.DataFrame:
    with duckdb.connect() as db:
        for path in glob.glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        return db.execute(sql).df()


@pytest.fixture(scope="session")
def same():
    """Whether a query's result has the columns and rows of its SQL."""

    def check(result, sql, folder=DATA):
        got, expected = result.toPandas(), run_sql(sql, folder)
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)

    return check
