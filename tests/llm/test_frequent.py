from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm.frequent import VoteSketch, _place, frequent_items, merge_cells, vote_sketch


def rows_of(spark):
    rng = np.random.default_rng(3)
    tail = [f"v{int(x)}" for x in rng.integers(0, 9000, 20_000)]
    heavy = ["hot"] * 9000 + ["warm"] * 400 + ["cool"] * 180
    values = tail + heavy
    rng.shuffle(values)
    return spark.createDataFrame([(v, "only" if k % 3 else "") for k, v in enumerate(values)] + [(None, None), ("", "")], "a string, b string").repartition(7), Counter(values)


def test_bounds_hold_and_nothing_frequent_is_missed(spark):
    df, counts = rows_of(spark)
    got = frequent_items(vote_sketch(df, ["a", "b"], width=512), ["a", "b"], 1 / 200, width=512).collect()
    n = sum(counts.values())
    a = {r.item_value: r for r in got if r.field_name == "a"}
    assert {v for v, c in counts.items() if 200 * c >= n} <= set(a)
    for v, r in a.items():
        assert r.n_low <= counts[v] <= r.n_high and r.n_rows == n
    b = [r for r in got if r.field_name == "b"]
    assert [(r.item_value, r.n_low, r.n_high) for r in b] == [("only", b[0].n_rows, b[0].n_rows)]


def test_merging_in_groups_keeps_the_bounds(spark):
    df, counts = rows_of(spark)
    parts = [vote_sketch(df.filter(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == k), ["a"], width=512) for k in range(3)]
    cells = merge_cells(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    for r in frequent_items(cells, ["a"], 1 / 200, width=512).collect():
        assert r.n_low <= counts[r.item_value] <= r.n_high


def test_cell_invariants():
    rng = np.random.default_rng(1)
    s, total = VoteSketch(2, 8), Counter()
    for _ in range(20):
        values, counts = np.unique(rng.zipf(1.5, 200) % 50, return_counts=True)
        s.add(values.astype(np.int64), values.astype(str).astype(object), counts)
        total.update(dict(zip(values.tolist(), counts.tolist())))
    for v, c in total.items():
        for row in range(2):
            at = _place(np.array([v]), row, 8)[0]
            whole, kept, surplus = s.total[row, at], s.hash[row, at], s.surplus[row, at]
            assert c <= (whole + surplus) / 2 if kept == v else c <= (whole - surplus) / 2
            assert kept != v or c >= surplus


def test_edges(spark):
    empty = spark.createDataFrame([], "a string, field string")
    assert frequent_items(vote_sketch(empty, ["a", "field"]), ["a", "field"], 0.1).count() == 0
    absent = spark.createDataFrame([(None,), ("",)], "a string")
    assert frequent_items(vote_sketch(absent, ["a"]), ["a"], 0.1).count() == 0
    long = spark.createDataFrame([("x" * 100_000,)] * 3, "a string")
    assert frequent_items(vote_sketch(long, ["a"]), ["a"], 0.1).first().n_low == 3
    with pytest.raises(ValueError):
        frequent_items(vote_sketch(empty, ["a"]), ["a"], 1 / 5000)
