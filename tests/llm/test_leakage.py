import random

import pytest
from conftest import DATA

from flowloom.llm import leakage as lk
from flowloom.llm.plain import plain, words

WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean pearl quarry ridge shore tidal under vale willow yonder zephyr anchor beacon canyon dune estuary".split()


def passage(seed, n=50):
    r = random.Random(seed)
    return [f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(n)]


ITEMS = [(k, " ".join(passage(k))) for k in range(40)]


def carried(text, items=ITEMS):
    return {i for _, i in lk.carried_items(lk.build_index(items), [text])}


def edited(ws, edits, seed):
    r, out = random.Random(seed), list(ws)
    for k in range(edits):
        at = (k + 1) * len(out) // (edits + 1)
        out[at : at + 1] = r.choice([["changed"], [], [out[at], "added"]])
    return out


def test_excerpts_of_all_lengths():
    for n, want in ((10, set()), (14, set()), (15, {3}), (20, {3}), (50, {3})):
        assert carried("before it all " + " ".join(passage(3)[:n]) + " and after") == want


def test_recall_against_brute_force_with_edits():
    """Every stretch of 15 or more words with an edit per ten words is found by an exhaustive search; the embedding must find 9 of 10."""
    index = lk.build_index(ITEMS)
    found = exhaustive = 0
    for seed in range(150):
        r = random.Random(seed)
        n = r.choice([15, 17, 20, 30, 50])
        ws = edited(passage(seed % 40)[:n], n // 10, seed)
        ids = [index[0].vocabulary.get(w, -1) for w in words(plain(" ".join(ws)))]
        import numpy as np

        if lk.longest_stretch(index[0].passage(seed % 40), np.array(ids), 15) >= 15:
            exhaustive += 1
            found += (0, seed % 40) in set(lk.carried_items(index, ["x y z " * 5 + " ".join(ws) + " q" * 9]))
    assert exhaustive >= 60 and found >= 0.9 * exhaustive


def test_too_many_edits_and_wrong_order_are_no_leak():
    ws = passage(5)[:30]
    assert carried(" ".join(w if k % 4 else "other" for k, w in enumerate(ws))) == set()
    assert carried(" ".join(sorted(passage(5)))) == set()


@pytest.mark.parametrize("wrap", [lambda t: t.upper(), lambda t: "<p>" + t.replace(" ", "</b> <b>") + "</p>", lambda t: t.replace(" ", "\\n"), lambda t: t.replace(" ", "&nbsp;"), lambda t: t.replace(" ", "\r\n> "), lambda t: "\x1b[31m" + t.replace("a", "a\u200b") + "\x1b[0m", lambda t: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t), lambda t: t.replace("e", "\\u0065")])
def test_layout_does_not_matter(wrap):
    assert carried(wrap(" ".join(passage(7)[:25]))) == {7}


def test_shared_instruction_is_no_evidence():
    rule = " ".join(passage(99, 20))
    items = [(k, rule + " " + " ".join(passage(k))) for k in range(5)]
    assert carried(rule, items) == set()
    assert carried(rule + " " + " ".join(passage(2)[:16]), items) == {2}


def test_words_shared_with_a_neighbour_are_evidence():
    """Bodies that go on alike behind their instruction: 15 words right behind it are a stretch, 14 are none."""
    rule, other = passage(99, 20), passage(98, 9)
    bodies = {k: passage(k) for k in range(9)}
    for a, b, n in ((0, 1, 1), (2, 3, 5), (4, 5, 2), (5, 6, 2)):  # the last: three share two words
        bodies[b][:n] = bodies[a][:n]
    items = [(k, " ".join(rule + (other if k > 6 else []) + b)) for k, b in bodies.items()]
    items += [(k, " ".join(rule + other + passage(k))) for k in (9, 10)]  # a longer instruction that opens like the first
    cut = lk.cut_instructions({k: words(plain(t)) for k, t in items}, lk.WORDS.shared_prefix)
    assert [cut[k] for k, _ in items] == [20] * 7 + [29] * 4
    for k, b in bodies.items():
        assert carried(" ".join(b[:15]), items) == {k} and carried(" ".join(b[:14]), items) == set()
        assert carried(" ".join(rule + other + b[:14]), items) == set()


def test_instructions_of_the_evaluation_set(duck):
    """Every instruction has one length in its suite."""
    rows = duck.execute("SELECT item_id, suite, passage FROM eval_items").fetchall()
    cut = lk.cut_instructions({k: words(plain(t)) for k, _, t in rows}, lk.WORDS.shared_prefix)
    assert {(s, cut[k]) for k, s, _ in rows if cut[k]} == {("follow-up", 21), ("ledger-math", 22), ("reading-h", 21)}


def test_spaceless_script():
    r = random.Random(4)
    chars = [chr(r.randrange(0x4E00, 0x6000)) for _ in range(90)]
    items = [(1, "".join(chars)), (2, " ".join(passage(2)))]
    assert carried("头" * 9 + "，".join(chars[10:45]), items) == {1}
    assert carried("".join(chars[10:35]), items) == set()


def test_recall_of_edited_spaceless_stretches():
    """30 to 39 characters with three edits, the unknown characters anywhere or all in the middle, against an exhaustive search."""
    import numpy as np

    r = random.Random(11)
    items = [(k, "".join(chr(r.randrange(0x4E00, 0x6000)) for _ in range(60))) for k in range(20)]
    index = lk.build_index(items)
    for middle in (False, True):
        found = exhaustive = 0
        for seed in range(200):
            r = random.Random(seed)
            k, n = seed % 20, r.randrange(30, 40)
            cs, begin = list(items[k][1]), r.randrange(0, 60 - n)
            cs = cs[begin : begin + n]
            for at in r.sample(range(10, 20) if middle else range(1, n - 1), 3):
                cs[at] = chr(r.randrange(0x7000, 0x7800))
            ids = np.array([index[0].vocabulary.get(c, -1) for c in cs])
            if lk.longest_stretch(index[0].passage(k), ids, 30) >= 30:
                exhaustive += 1
                found += (0, k) in set(lk.carried_items(index, ["頭" * 40 + "".join(cs) + "尾" * 40]))
        assert exhaustive >= 150 and found >= 0.9 * exhaustive, (middle, found, exhaustive)


def test_cells_and_long_texts():
    ws = passage(11)
    text = " ".join(f"w{k}" for k in range(60_000)) + " " + " ".join(ws[:9]) + "\n\n" + " ".join(ws[9:20])
    assert carried(text) == {11}


def test_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(passage(3))), (2, None), (3, ""), (4, "nothing"), (5, " ".join(passage(3))), (5, " ".join(passage(3)))], "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, (98, None), (99, "too short"), (None, "x")], "item_id long, passage string")
    want = [(1, 3), (5, 3), (5, 3)]
    assert sorted(map(tuple, lk.leaked_items(docs, items).collect())) == want
    assert sorted(map(tuple, lk.leaked_items(docs, items, items_at_once=7).collect())) == want
    assert lk.leaked_items(docs.limit(0), items).count() == 0 and lk.leaked_items(docs, items.limit(0)).count() == 0


def test_equal_passages_are_found_for_all_their_items(spark):
    rule = passage(99, 20)
    items = [(k, " ".join(rule + passage(k % 5))) for k in range(10)]
    docs = spark.createDataFrame([(1, " ".join(rule)), (2, " ".join(passage(2)[:20]))], "doc_id long, text string")
    rows = spark.createDataFrame(items, "item_id long, passage string")
    for at_once in (100, 3, 1):
        assert sorted(map(tuple, lk.leaked_items(docs, rows, items_at_once=at_once).collect())) == [(2, 2), (2, 7)]


def test_window_distance_against_brute_force():
    import numpy as np

    def brute(x, y, most):
        best = {}
        for n in range(max(0, len(y) - most), len(y) + most + 1):
            a, row = x[:n], list(range(len(y) + 1))
            for i, u in enumerate(a, 1):
                row, old = [i], row
                for j, v in enumerate(y, 1):
                    row.append(min(old[j - 1] + (u != v), old[j] + 1, row[-1] + 1))
            best[n] = row[-1]
        return min(min(best.values()), most + 1)

    r = np.random.default_rng(5)
    for most in (1, 3):
        x, y = r.integers(0, 3, 400), r.integers(0, 3, 300)
        at, of = r.integers(0, 370, 500), r.integers(0, 290, 500)
        got = lk.window_distance(x, at, y, of, 10, most)
        assert got.tolist() == [brute(x[a : a + 10 + most].tolist(), y[b : b + 10].tolist(), most) for a, b in zip(at, of)]


def test_a_window_that_many_passages_share(monkeypatch):
    """Slices of meetings change nothing."""
    shared = passage(77, 18)
    items = [(k, " ".join(passage(k)[:20] + shared)) for k in range(25)]
    text = " ".join(shared * 8)
    want = carried(text, items)
    monkeypatch.setattr(lk, "HITS_AT_ONCE", 100)
    assert carried(text, items) == want == set(range(25))


def test_instructions_do_not_depend_on_blocks(spark):
    rule, more = passage(99, 20), passage(98, 12)
    items = [(k, " ".join(rule + (more if k > 5 else []) + passage(k))) for k in range(10)] + [(k, " ".join(passage(k))) for k in (20, 21)]
    docs = spark.createDataFrame([(1, " ".join(rule)), (2, " ".join(rule + more)), (3, " ".join(passage(2)[:15])), (4, " ".join(passage(21)))], "doc_id long, text string")
    rows = spark.createDataFrame(items, "item_id long, passage string")
    want = lk.cut_instructions({k: words(plain(p)) for k, p in items}, lk.WORDS.shared_prefix)
    assert {r.item_id: r.opening for r in lk.instruction_lengths(rows, "item_id", "passage").collect()} == want
    assert sorted(set(want.values())) == [0, 20, 32]
    for at_once in (100, 3, 1):
        assert sorted(map(tuple, lk.leaked_items(docs, rows, items_at_once=at_once).collect())) == [(3, 2), (4, 21)]


def test_registered(spark):
    from flowloom.llm.queries import QUERIES

    rows = [tuple(r) for r in QUERIES["p7_found"](spark, DATA).collect()]
    assert rows and len(rows) == len(set(rows))
