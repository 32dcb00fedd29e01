from datetime import datetime

import pytest

from flowloom.operators.wide import cells, discover_attributes, infer_attributes, widen

KEYS = [("host.cores", "integer"), ("link.rtt_ms", "decimal"), ("on", "boolean"), ("seen", "timestamp"), ("note", "text")]


def table(spark, rows):
    return spark.createDataFrame(rows, "sid string, key string, value string, merged_at timestamp, extra string")


def found(spark, rows):
    wide = widen(table(spark, rows), KEYS, entity="sid", key="key", value="value", order="merged_at")
    return {(r.sid, r.attr_name): r.typed_value for r in cells(wide, KEYS, "sid").collect()}


T = [datetime(2026, 1, 1, 0, 0, k) for k in range(5)]


@pytest.mark.parametrize(
    ("key", "value", "want"),
    [
        ("Host Cores", " 0067 ", "67"), ("host-cores", "52,250", "52250"), ("HOST_CORES", "1_000", "1000"), ("host.cores", "11396.00", "11396"), ("host.cores", "1.5", None), ("host.cores", "-3", "-3"), ("host.cores", "1.2e3", "1200"), ("host.cores", "12x", None), ("host.cores", "1.2.3", None), ("host.cores", "", None),
        ("link.rtt_ms", "3.323122e+03", "3323.122"), ("link.rtt_ms", "5", "5.000"), ("link.rtt_ms", "1,234.5", "1234.500"), ("link.rtt_ms", "- ", None), ("link.rtt_ms", ".25", "0.250"),
        ("ON", "Yes", "true"), ("on", "off", "false"), ("on", "2", None), ("on", "1", "true"),
        ("seen", "1770000000", "1770000000000000"), ("seen", "1770000000000", "1770000000000000"), ("seen", "1770000000000000", "1770000000000000"), ("seen", "2026-02-02T02:40:00Z", "1770000000000000"), ("seen", "2026-02-02 02:40:00", "1770000000000000"), ("seen", "2026-02-01T21:40:00-05:00", "1770000000000000"), ("seen", "2026-02-02", "1769990400000000"), ("seen", "2026-02-02 2:40", "1770000000000000"), ("seen", "2026-13-01T00:00:00Z", None), ("seen", "soon", None),
        ("note", "\t a b \n", "a b"), ("note", "  ", None), ("unknown", "1", None),
    ],
)
def test_notations(spark, key, value, want):
    got = found(spark, [("s", key, value, T[0], "x")])
    assert list(got.values()) == ([] if want is None else [want])


def test_latest_row_alone_decides(spark):
    rows = [("s", "note", "old", T[0], None), ("s", "note", "new", T[2], None), ("s", "host.cores", "5", T[0], None), ("s", "host cores", "bad", T[1], None), ("s", "on", "true", None, None), ("s", "ON", "false", T[0], None), ("t", "note", "a", T[1], None), ("t", "note", "b", T[1], None), ("t", "note", "b", T[1], None)]
    assert found(spark, rows) == {("s", "note"): "new", ("s", "on"): "false", ("t", "note"): "b"}


def test_entities_nulls_and_empty_tables(spark):
    rows = [("only_unknown", "x.y", "1", T[0], None), (None, "note", "a", T[0], None), ("", "note", "a", T[0], None), ("n", None, "a", T[0], None), ("v", "note", None, T[0], None)]
    wide = widen(table(spark, rows), KEYS, entity="sid", key="key", value="value", order="merged_at")
    assert sorted(r.sid for r in wide.collect()) == ["n", "only_unknown", "v"]
    assert wide.columns == ["sid", *[k for k, _ in KEYS]]
    assert widen(table(spark, []), KEYS, entity="sid", key="key", value="value", order="merged_at").count() == 0
    assert cells(widen(table(spark, rows), [], entity="sid", key="key", value="value", order="merged_at"), [], "sid").count() == 0


def test_discovery(spark):
    keys = spark.createDataFrame([("b", "text"), ("a", "integer"), ("a", "integer")], "attr_name string, value_type string")
    assert discover_attributes(keys) == [("a", "integer"), ("b", "text")]
    with pytest.raises(ValueError):
        discover_attributes(spark.createDataFrame([("a.b", "text"), ("A_B", "text")], "attr_name string, value_type string"))
    with pytest.raises(ValueError):
        widen(table(spark, []), [("SID", "text")], entity="sid", key="key", value="value", order="merged_at")


def test_attributes_from_the_data(spark):
    rows = [("s", "Host Cores", " 8 ", T[0], None), ("s", "host.cores", "1,024", T[0], None), ("t", "host.cores", "", T[0], None), ("s", "rtt", "1.5", T[0], None), ("s", "rtt", "2", T[0], None), ("s", "on", "yes", T[0], None), ("s", "seen", "2026-02-02", T[0], None), ("s", "note", "5", T[0], None), ("s", "note", "x", T[0], None), ("s", " ", "x", T[0], None), ("s", None, "x", T[0], None), ("s", "blank", None, T[0], None)]
    assert infer_attributes(table(spark, rows), "key", "value") == [("blank", "text"), ("host.cores", "integer"), ("note", "text"), ("on", "boolean"), ("rtt", "decimal"), ("seen", "timestamp")]
    assert infer_attributes(table(spark, []), "key", "value") == []
    with pytest.raises(ValueError):
        infer_attributes(table(spark, rows), "key", "value", limit=2)
