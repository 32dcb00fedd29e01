import pytest

from flowloom.operators.references import orphan_references

DAY = 86_400_000_000


def test_fates_and_their_order(spark):
    refs = spark.createDataFrame([("ok", DAY), ("late", DAY), ("gone", DAY), ("back", DAY), ("never", DAY), ("gone_late", DAY), ("ok", None), ("", DAY), (None, DAY)], "ref string, at long")
    parents = spark.createDataFrame([("ok", 5), ("late", 2 * DAY), ("gone", 5), ("back", 5), ("back", 50), ("gone_late", 2 * DAY), (None, 1)], "id string, arr long")
    gone = spark.createDataFrame([("gone", 9), ("back", 9), ("gone_late", 3 * DAY), ("gone", 7), (None, 7)], "rid string, del long")
    out = orphan_references(refs, ["ref"], parents, ["id"], at="at", arrived="arr", deletions=gone, deleted_keys=["rid"], deleted_at="del")
    assert sorted((r.ref, r.fate) for r in out.collect()) == [("gone", "deleted"), ("gone_late", "deleted"), ("late", "late"), ("never", "missing")]


def test_deleted_at_the_moment_of_arrival_is_deleted(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = orphan_references(one([("a", 1)], "r string, at long"), ["r"], one([("a", 9)], "id string, arr long"), ["id"], at="at", arrived="arr", deletions=one([("a", 9)], "i string, d long"), deleted_keys=["i"], deleted_at="d")
    assert [r.fate for r in out.collect()] == ["deleted"]


@pytest.mark.parametrize(
    ("match", "want"),
    [
        ("simple", {("a", "y", "00", "missing")}),
        ("partial", {("a", "y", "00", "missing"), ("z", None, "01", "missing")}),
        ("full", {("a", "y", "00", "missing"), ("z", None, "01", "partly_null"), ("a", "", "01", "partly_null"), (None, "x", "10", "partly_null")}),
    ],
)
def test_match_semantics(spark, match, want):
    refs = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", None), ("a", ""), (None, "x"), (None, None)], "k1 string, k2 string")
    parents = spark.createDataFrame([("a", "x"), ("b", "y")], "k1 string, k2 string")
    out = orphan_references(refs, ["k1", "k2"], parents, ["k1", "k2"], match=match)
    assert {tuple(r) for r in out.collect()} == want


def test_empty_tables_repeats_and_clashing_names(spark):
    refs = spark.createDataFrame([("a", "p"), ("a", "p")], "id string, name string")
    none = refs.limit(0)
    assert orphan_references(none, ["id"], refs, ["id"]).count() == 0
    out = orphan_references(refs, ["id"], none, ["id"])
    assert out.columns == ["id", "name", "null_mask", "fate"] and out.count() == 2
    with pytest.raises(ValueError):
        orphan_references(refs, ["id"], refs, ["id"], match="exact")


def test_partly_absent_references_to_deleted_records(spark):
    """Deleted only if every record that may be meant is; a deletion of a record that isn't stored counts too."""
    refs = spark.createDataFrame([("a", None, DAY), ("b", None, DAY), ("c", None, DAY), ("d", None, DAY), ("e", None, DAY), ("f", None, DAY)], "k1 string, k2 string, at long")
    parents = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("b", "2", 5), ("c", "1", 5), ("c", "1", 50), ("e", "1", 2 * DAY)], "k1 string, k2 string, arr long")
    gone = spark.createDataFrame([("a", "1", 9), ("b", "1", 9), ("c", "1", 9), ("d", "7", 9)], "k1 string, k2 string, del long")
    out = orphan_references(refs, ["k1", "k2"], parents, ["k1", "k2"], match="partial", at="at", arrived="arr", deletions=gone, deleted_keys=["k1", "k2"], deleted_at="del")
    assert {(r.k1, r.fate) for r in out.collect()} == {("a", "deleted"), ("d", "deleted"), ("e", "late"), ("f", "missing")}
