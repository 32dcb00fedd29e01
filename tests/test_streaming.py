from datetime import datetime

import pytest

from flowloom.plans.filters import FilterError
from flowloom.plans.side import SideTables
from flowloom.streaming import changelog as live

DDL = "id string, status int, method string, pushed_at timestamp"
T = [datetime(2026, 1, 1, 0, 0, k) for k in range(9)]


def test_changes_over_restarts(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [[("a", 0, "GET", T[0]), ("b", 200, "GET", T[1])], [("a", 200, "GET", T[2]), ("b", 200, "GET", T[3])], [("b", 500, "GET", T[4]), ("a", 500, "GET", T[5]), ("a", 201, "GET", T[6])]]
    spark.createDataFrame([], DDL).write.parquet(src)
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(src)
        q = live.changelog(live.push_stream(spark, src), "~c ^2").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.id, r.op) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id", "change_no").collect()]
    assert got == [("a", "added"), ("a", "unmatched"), ("a", "added"), ("b", "added"), ("b", "updated"), ("b", "unmatched")]


def test_side_terms_are_refused(spark):
    with pytest.raises(FilterError):
        live.holds(spark.createDataFrame([], DDL), "~hq x")


def test_side_terms_over_tables(spark):
    t = SideTables(headers=spark.createDataFrame([("a", 0, 0, "x-kind", "probe")], "flow_id string, response int, ord int, name string, value string"))
    rows = spark.createDataFrame([("a", 200, "GET", T[0]), ("b", 200, "GET", T[0])], DDL)
    assert {r.id: r.matches for r in live.holds(rows, "~hq probe", t).collect()} == {"a": True, "b": False}


def test_flush_by_number_and_restart(spark, tmp_path):
    ddl = "id string, body_done boolean, error string, websocket boolean, body string, v long"
    table = live.FlushTable(spark, str(tmp_path / "t"), ["id"], ["v"], dirty=3, seconds=1e9)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.take(spark.createDataFrame([("a", False, "", False, "x", 1), ("b", True, "", False, "y", 1)], ddl), 0)
    assert table.flushes == 0
    table.take(spark.createDataFrame([("a", True, "", False, "z", 2)], ddl), 1)
    assert table.flushes == 1 and {r.id: r.body for r in table.read().collect()} == {"a": "z", "b": "y"}
    again = live.FlushTable(spark, str(tmp_path / "t"), ["id"], ["v"], dirty=3, seconds=1e9)
    again.take(spark.createDataFrame([("a", True, "", False, "late", 1), ("c", True, "", False, "c", 1)], ddl), 2)
    again.close()
    again.close()
    assert {r.id: r.body for r in again.read().collect()} == {"a": "z", "b": "y", "c": "c"} and again.flushes == 1


def test_wait_and_flush(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 200, "GET", T[0]), ("b", 200, "GET", T[1])], DDL).coalesce(1).write.parquet(src)
    assert len(live.wait_for_flows(live.push_stream(spark, src), "~s", 2, 60)[0]) == 2
    assert live.wait_for_flows(live.push_stream(spark, src), "~s", 2, 60, "closed") == ([], "the session is closed")
    rows = spark.createDataFrame([("a", True, "", False, "x"), ("b", False, "", False, "x"), ("c", False, "e", False, "x"), ("d", True, "", True, "x")], "id string, body_done boolean, error string, websocket boolean, body string")
    assert {r.id: (r.body, r.body_state) for r in live.settled_bodies(rows).collect()} == {"a": ("x", "final"), "b": (None, "pending"), "c": ("x", "final"), "d": (None, "pending")}
