"""One local session for all tests, and a comparison of queries with their SQL."""

import glob
import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("LEAFGAUGE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(value):
    """A value in a form that compares across engines."""
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def same_as_sql(duck, df, sql):
    columns = sorted(df.columns)
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((plain(tuple(r[i] for i in at)) for r in cursor.fetchall()), key=repr)
    assert rows_of(df, columns) == expected
