"""A small Spark session, and a comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT)]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g",
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same_rows(columns: list[str], rows, other_columns: list[str], other_rows) -> None:
    """Assert that both sides have the same columns and the same rows in any order."""
    assert sorted(columns) == sorted(other_columns)
    a, b = (sorted(range(len(c)), key=c.__getitem__) for c in (columns, other_columns))
    left = sorted(tuple(_plain(r[i]) for i in a) for r in rows)
    right = sorted(tuple(_plain(r[i]) for i in b) for r in other_rows)
    assert left == right


@pytest.fixture
def matches_sql(spark, duck):
    """A function that runs a query and its SQL over the test tables and compares them."""

    def check(query, sql: str) -> None:
        df = query(spark, str(DATA))
        got = [tuple(r) for r in df.collect()]
        cur = duck.execute(sql)
        want = cur.fetchall()
        same_rows(df.columns, got, [d[0] for d in cur.description], want)

    return check
