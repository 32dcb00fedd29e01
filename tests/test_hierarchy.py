import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowloom.operators.hierarchy import descendants, resolve_hierarchy

DDL = "id string, parent_id string, updated_at long, name string"


def brute(links):
    out = {}
    for i in links:
        path, x = [i], i
        while links.get(x) in links and links[x] not in path:
            x = links[x]
            path.append(x)
        up = links.get(x)
        looped = up in links and up in path
        if not looped:
            out[i] = ("rooted", path[-1], len(path) - 1, "/".join(path[::-1]))
        else:
            on = path[path.index(up) :]
            out[i] = ("on_cycle" if i in on else "below_cycle", "", -1, "")
    return out


def resolved(spark, rows, **more):
    return {r.id: (r.state, r.root, r.depth, r.path) for r in resolve_hierarchy(spark.createDataFrame(rows, DDL), **more).collect()}


def pairs(spark, rows, **more):
    return sorted((r.ancestor, r.descendant, r.distance) for r in descendants(spark.createDataFrame(rows, DDL), **more).collect())


def brute_pairs(links):
    out = []
    for i, (state, *_) in brute(links).items():
        x, n = links[i], 1
        while state == "rooted" and x in links:
            out.append((x, i, n))
            x, n = links[x], n + 1
    return sorted(out)


WAYS = [{"local_rows": 0}, {"local_rows": 3}, {"local_rows": 1000}, {"local_rows": 0, "thin": 1}, {"local_rows": 2, "thin": 2}]


@pytest.mark.parametrize("way", WAYS)
def test_shapes(spark, way):
    links = {"r": "", "a": "r", "b": "a", "c": "b", "d": "b", "x": "y", "y": "z", "z": "x", "w": "x", "v": "w", "self": "self", "lost": "nowhere", "n": None}
    rows = [(k, v, 1, "") for k, v in links.items()] + [("a", "c", 0, "older"), ("b", "a", 1, "repeat"), (None, "r", 1, ""), ("", "r", 1, "")]
    assert resolved(spark, rows, **way) == brute(links)
    assert pairs(spark, rows, **way) == brute_pairs(links)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from("abcdefghij"), st.sampled_from([*"abcdefghij", "", "q", None]), min_size=1), st.sampled_from(WAYS))
def test_any_links(spark, links, way):
    rows = [(k, v, 1, "n") for k, v in links.items()]
    assert resolved(spark, rows, **way) == brute(links)
    assert pairs(spark, rows, **way) == brute_pairs(links)


@pytest.mark.parametrize("way", [{"local_rows": 100, "thin": 10**9}, {"local_rows": 0}, {}])
def test_counts_chain_and_descendants(spark, way):
    n = 120 if "thin" not in way else 105
    rows = [(f"n{k:03d}", f"n{k - 1:03d}" if k else "", 1, "") for k in range(n)]
    df = spark.createDataFrame(rows, DDL)
    assert {r.id: r.n_below for r in resolve_hierarchy(df, **way).collect()} == {f"n{k:03d}": n - 1 - k for k in range(n)}
    assert descendants(df, **way).count() == n * (n - 1) // 2


def test_a_long_chain_costs_few_rounds(spark):
    """More nodes than one task takes, hundreds of levels, a subtree on every level and a cycle with a tail besides."""
    rows = [(f"n{k}", f"n{k - 1}" if k else "", 1, "") for k in range(300)] + [(f"b{k}", f"n{k}", 1, "") for k in range(300)] + [(f"c{k}", f"c{(k + 1) % 7}", 1, "") for k in range(7)] + [("t0", "c3", 1, ""), ("t1", "t0", 1, "")]
    out = {r.id: r for r in resolve_hierarchy(spark.createDataFrame(rows, DDL), local_rows=50).collect()}
    assert all(out[f"n{k}"].depth == k and out[f"n{k}"].n_below == 2 * (300 - k) - 1 and out[f"b{k}"].depth == k + 1 for k in range(300))
    assert out["b200"].path == "/".join([f"n{k}" for k in range(201)] + ["b200"])
    assert {out[f"c{k}"].state for k in range(7)} == {"on_cycle"} and out["t0"].state == out["t1"].state == "below_cycle"


@pytest.mark.parametrize("way", [{}, {"local_rows": 0}, {"local_rows": 0, "thin": 1}])
def test_ids_that_hold_the_separator(spark, way):
    rows = [("a/b", "", 1, ""), ("c", "a/b", 1, ""), ("d", "c", 1, "")]
    assert pairs(spark, rows, **way) == [("a/b", "c", 1), ("a/b", "d", 2), ("c", "d", 1)]
    assert {r.id: r.ids for r in resolve_hierarchy(spark.createDataFrame(rows, DDL), **way).collect()}["d"] == ["a/b", "c", "d"]


def test_empty(spark):
    empty = spark.createDataFrame([], DDL)
    for way in WAYS:
        assert resolve_hierarchy(empty, **way).count() == 0 and descendants(empty, **way).count() == 0


@pytest.mark.parametrize("way", [{"piece_rows": 1}, {"piece_rows": 4}])
def test_large_trees_are_spelled_by_pieces(spark, way):
    links = {f"n{k}": f"n{(k - 1) // 2}" if k else "" for k in range(15)} | {f"c{k}": f"c{k - 1}" if k else "n9" for k in range(12)} | {"r": "", "a": "r", "x": "y", "y": "x", "w": "x", "v": "w", "self": "self"}
    rows = [(k, v, 1, "") for k, v in links.items()]
    assert resolved(spark, rows, **way) == brute(links)
    assert {r.id: r.parent for r in resolve_hierarchy(spark.createDataFrame(rows, DDL), **way).collect()} == {k: v or None for k, v in links.items()}


def test_ids_whose_numbers_meet_are_told_apart(spark, monkeypatch):
    """The first two salts give all ids one number."""
    from flowloom.operators import hierarchy

    number = hierarchy._number
    monkeypatch.setattr(hierarchy, "_number", lambda c, salt: number(c, salt) % 1 if salt < 2 else number(c, salt))
    links = {"r": "", "a": "r", "b": "a", "x": "x", "lost": "nowhere"}
    assert resolved(spark, [(k, v, 1, "") for k, v in links.items()]) == brute(links)
