import pytest
from conftest import DATA
from pyspark.sql import functions as F

from flowloom.llm import traffic_queries
from flowloom.llm.quantiles import sketch_percentiles
from flowloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["p1_found", "p1_bounds", "p2_found", "p2_bounds"])
def test_query_agrees_with_sql(spark, agree, name):
    agree(QUERIES[name](spark, DATA), SQL[name])


def test_a_bracket_that_misses_loses_no_pair(spark, tmp_path, monkeypatch):
    """The estimate of the 50th is some codes too high, within its exact counter: the ratio is 20 all the same."""
    rows = [("a", "h", 1000)] * 60 + [("a", "h", 20_000)] * 40 + [("b", "h", 1000)] * 60 + [("b", "h", 19_999)] * 40
    spark.createDataFrame(rows, "authority string, protocol string, duration_micros long").write.parquet(f"{tmp_path}/flows.parquet")

    def wrong(*args, **more):
        some = sketch_percentiles(*args, **more)
        return some.withColumns({c: F.when(F.col("percent") == 50, F.lit(1012)).otherwise(F.col(c)).cast("long") for c in ("value_low", "value_high")})

    monkeypatch.setattr(traffic_queries, "sketch_percentiles", wrong)
    assert [tuple(r) for r in traffic_queries.p1_found(spark, str(tmp_path)).collect()] == [("a", "h")]


def test_nothing_imports_this_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2] / "flowloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"flowloom\.llm|from flowloom import llm", p.read_text()), p
