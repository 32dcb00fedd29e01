import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import quantiles as q


@given(st.integers(-(2**63), 2**63 - 1))
def test_codes_keep_values_and_order(v):
    def code(x):
        size = ~x if x < 0 else x
        shift = max(size.bit_length() - q.MANTISSA - 1, 0)
        c = (shift << q.MANTISSA) + (size >> shift)
        return q.HALF - 1 - c if x < 0 else q.HALF + c

    low, high = (int(a[0]) for a in q.decode(np.array([code(v)])))
    assert low <= v <= high and high - low <= abs(v) / 1000 + 1
    assert 0 <= code(v) < 1 << q.BITS
    if v < 2**63 - 1:
        assert code(v) <= code(v + 1)


def rank_of(values, v_low, v_high):
    values = np.sort(values)
    return np.searchsorted(values, v_low) + 1, np.searchsorted(values, v_high, side="right")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", int(v), int(d)) for v, d in zip(rng.lognormal(10, 3, 40_000), rng.integers(0, 4, 40_000))]
    rows += [("small", v, 0) for v in range(-20, 21)] + [("one", 7, 1), (None, 3, 1), (None, 5, 2), ("gap", None, 1)]
    return spark.createDataFrame(rows, "k string, v long, day int"), rows


def check(got, rows):
    by = {}
    for k, v, _ in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {r.k for r in got} == set(by)
    for r in got:
        assert r.n == len(by[r.k])
        rank = -(-r.n * r.percent // 100)
        exact = sorted(by[r.k])[rank - 1]
        assert r.value_low <= exact <= r.value_high
        near = sorted((r.value * 0.998, r.value * 1.002))
        low, high = rank_of(by[r.k], *near)
        assert low - r.rank_error - 1 <= rank <= high + r.rank_error + 1
        assert r.rank_error <= (0.02 * r.n if r.n > 1000 else r.n)


def test_percentiles_within_the_stated_error(spark, data):
    df, rows = data
    check(q.sketch_percentiles(q.build_sketches(df, ["k"], "v"), ["k"], [1, 50, 90, 99, 100]).collect(), rows)


def test_days_merge_to_the_same_sketch(spark, data):
    df, rows = data
    whole = q.build_sketches(df, ["k"], "v")
    merged = q.merge_sketches(q.build_sketches(df, ["k", "day"], "v"), ["k"])
    key = lambda s: {r.k: (r.n, list(r.cells), list(r.counts)) for r in s.collect()}
    assert key(whole) == key(merged)


def test_deletions_undo(spark, data):
    df, rows = data
    more = df.withColumn("w", F.lit(1)).unionByName(spark.createDataFrame([("hot", 10**9, 0, 1), ("hot", 10**9, 0, -1), ("gone", 4, 0, 1), ("gone", 4, 0, -1)], "k string, v long, day int, w int"))
    kept = {r.k: (r.n, list(r.cells)) for r in q.build_sketches(more, ["k"], "v", "w", min_rows=1).collect()}
    assert kept == {r.k: (r.n, list(r.cells)) for r in q.build_sketches(df, ["k"], "v").collect()}


def test_edges(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert q.sketch_percentiles(q.build_sketches(empty, ["k"], "v"), ["k"], [50]).count() == 0
    ties = spark.createDataFrame([("a", 5)] * 99 + [("a", 2**62)], "k string, v long")
    got = {r.percent: (r.value_low, r.value, r.value_high) for r in q.sketch_percentiles(q.build_sketches(ties, ["k"], "v"), ["k"], [50, 99, 100]).collect()}
    assert got[50] == (5, 5, 5) and got[99][:2] == (5, 5) and got[100][0] <= 2**62 <= got[100][2]
    with pytest.raises(ValueError):
        q.build_sketches(spark.createDataFrame([], "n string, v long"), ["n"], "v")
    with pytest.raises(ValueError):
        q.sketch_percentiles(q.build_sketches(empty, ["k"], "v"), ["k"], [0])


def test_exact_check_tells_a_bracket_that_misses(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 101)], "k string, v long")
    b = spark.createDataFrame([("a", 100, 45, 55, 10, 20)], "k string, n long, low_50 long, high_50 long, low_99 long, high_99 long")
    r = q.exact_in_brackets(df, ["k"], "v", b.select("k", "n", F.col("low_50"), F.col("high_50"), F.lit(90).alias("low_99"), F.lit(100).alias("high_99")), [50, 99]).first()
    assert (r.p_50, r.p_99) == (50, 99)
    r = q.exact_in_brackets(df, ["k"], "v", b.select("k", "n", "low_50", "high_50", F.lit(60).cast("long").alias("low_99"), F.lit(70).cast("long").alias("high_99")), [50, 99]).first()
    assert r.p_50 == 50 and r.p_99 is None


def test_codes_turn_into_cells(spark, monkeypatch):
    """A group of SPARSE codes is exact, one of more is a sketch; parts in any number and order give the same."""
    rows = [("few", 1000 + k % q.SPARSE) for k in range(3000)] + [("many", 1000 + k % (q.SPARSE + 1)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r for r in q.build_sketches(df.repartition(7), ["k"], "v").collect()}
    assert min(got["few"].cells) >= q.CELLS and len(got["few"].cells) == q.SPARSE and max(got["many"].cells) < q.CELLS
    monkeypatch.setattr(q, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(q, "HELD_CELLS", 1000)
    monkeypatch.setattr(q, "FAN_IN", 2)
    again = {r.k: r for r in q.build_sketches(df.repartition(5), ["k"], "v").collect()}
    assert got == again
    for r in q.sketch_percentiles(q.build_sketches(df, ["k"], "v"), ["k"], [50, 99]).collect():
        exact = sorted(v for k, v in rows if k == r.k)[-(-r.n * r.percent // 100) - 1]
        assert r.value_low <= exact <= r.value_high and (r.rank_error == 0 or r.k == "many")


def test_exact_percentiles_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [("a", int(v)) for v in rng.lognormal(12, 4, 4000)] + [("b", int(v)) for v in rng.integers(0, 50, 999)] + [(None, 4)]
    df = spark.createDataFrame(rows, "k string, v long")
    whole = spark.createDataFrame([("a", 4000), ("b", 999)], "k string, n long").select("k", "n", *[F.lit(v).cast("long").alias(f"{s}_{p}") for p in (50, 99) for s, v in (("low", -(2**63)), ("high", 2**63 - 1))])
    got = {r.k: (r.p_50, r.p_99) for r in q.exact_in_brackets(df, ["k"], "v", whole, [50, 99]).collect()}
    for k in "ab":
        values = sorted(v for x, v in rows if x == k)
        assert got[k] == tuple(values[-(-len(values) * p // 100) - 1] for p in (50, 99))
