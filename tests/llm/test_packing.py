import numpy as np
import pytest
from conftest import DATA
from hypothesis import given
from hypothesis import strategies as st

from flowloom.llm.packing import best_fit, containers, fill_report, pack, packing_faults, token_counts


@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 6), st.sampled_from(["norm", "dot"]))
def test_no_capacity_is_exceeded(sizes, most, score):
    at = best_fit(np.array(sizes, np.int64), 100, most, 12_000, score)
    for k in set(at.tolist()):
        inside = [s for s, a in zip(sizes, at) if a == k]
        assert sum(inside) <= 100 and len(inside) <= most and sum(s * s for s in inside) <= 12_000


def test_fill_is_close_to_what_is_possible():
    sizes = np.random.default_rng(0).integers(1, 1000, 4000)
    at = best_fit(sizes, 1000, 100, 10**6)
    assert len(set(at.tolist())) <= 1.02 * np.ceil(sizes.sum() / 1000)
    with pytest.raises(ValueError):
        best_fit(np.array([5]), 4, 1, 100)


def test_all_tokens_are_placed_once(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([0, 1, 10, 25, 10, 7, 3, 3, 3, 30, 9])] + [(1, 1)], "doc_id long, n_tokens long")
    budgets = spark.createDataFrame([("a", 10), ("b", 64)], "budget_name string, capacity_tokens int")
    rows = pack(sizes, budgets, shard=4).collect()
    for name, capacity in (("a", 10), ("b", 64)):
        mine = [r for r in rows if r.budget_name == name]
        held = {}
        for r in mine:
            if r.container_id is not None:
                held[r.container_id] = held.get(r.container_id, 0) + r.token_end - r.token_start
        assert max(held.values()) <= capacity and sum(held.values()) == 102
        whole = {r.doc_id for r in mine if r.piece > 0}
        assert whole == ({3, 9} if name == "a" else set())
        assert [r.doc_id for r in mine if r.container_id is None] == [0]
    assert pack(sizes.limit(0), budgets).count() == 0
    with pytest.raises(ValueError):
        pack(sizes, spark.createDataFrame([("a", None)], "budget_name string, capacity_tokens int"))


def test_tokens_and_report(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000, "x")], "doc_id long, text string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {1: 2, 2: 0, 3: 0, 4: 50_001}
    budgets = spark.read.parquet(f"{DATA}/context_budgets.parquet")
    for r in fill_report(pack(token_counts(spark.read.parquet(f"{DATA}/documents.parquet")), budgets)).collect():
        assert r.unused_share < 0.05


def test_all_three_capacities_bind(spark):
    r = np.random.default_rng(3)
    sizes = spark.createDataFrame([(k, int(n)) for k, n in enumerate([*r.integers(1, 5, 300), *r.integers(20, 60, 300), *r.integers(60, 101, 60), 250, 0])], "doc_id long, n_tokens long")
    budgets = spark.createDataFrame([("a", 100)], "budget_name string, capacity_tokens int")
    packed = pack(sizes, budgets, max_texts=6, attention=5000, shard=100)
    rows = containers(packed, 6, 5000).collect()
    assert {r.closed_by for r in rows} == {"tokens", "texts", "attention"} and not any(r.over for r in rows)
    assert all(r.n_texts == 1 for r in rows if r.cost > 5000) and any(r.cost > 5000 for r in rows)
    assert [tuple(r) for r in packing_faults(packed, sizes, 6, 5000).collect()] == [("a", 662, 0, 0, 0)]
    broken = packed.filter("doc_id <> 5").unionByName(packed.filter("doc_id = 6"))
    assert packing_faults(broken, sizes, 6, 5000).filter("lost_tokens > 0").count() > 0


def test_properties_on_the_test_data(spark, agree):
    from flowloom.llm.text_queries import QUERIES, SQL

    agree(QUERIES["p6_checked"](spark, DATA), SQL["p6_checked"])
