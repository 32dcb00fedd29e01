import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same_rows(df, con, sql):
    """Sorted rows of both engines, compared as text with columns in order of name."""
    columns = sorted(df.columns)
    show = lambda v: "None" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    here = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    there = sorted(tuple(show(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert here == there


@pytest.fixture(scope="session")
def agree(duck):
    return lambda df, sql: same_rows(df, duck, sql)
