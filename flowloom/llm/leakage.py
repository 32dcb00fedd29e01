"""Evaluation passages in a training corpus.

Passages and documents become streams of units: words, or characters for passages in scripts
without spaces. Windows of both are embedded by random walks (CGK: at step j the walk writes the
unit it stands on and moves on if a random bit of (j, unit) says so), which maps a small edit distance
to a small Hamming distance; each repetition has its own walk and samples a few of its places as the
key under which windows meet (bit-sampling LSH). Windows that met are compared by banded edit distance, and
around the places of those that are near enough the exact rule is verified.

Exact rule: an item is carried if at least ``MIN_UNITS`` consecutive units of its passage, from a
matching unit to a matching unit, can be turned into consecutive units of the document by at most one
edit (change, insertion, deletion) per ten of those passage units.

A carried stretch always has a window of no more than ``foreign`` edits, so windows with more units that no passage holds are
not embedded, and windows that met but are further apart are dropped; both are necessary conditions, not samples. Missed pairs
come from the embedding alone: windows without an edit always meet, and a stretch of fifteen units with an edit in the
middle has six windows times ``REPEATS`` chances. Nothing but these meetings leads to a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.common import cut
from flowloom.llm.plain import SPACELESS_CHAR, characters, is_spaceless, plain, words

REPEATS = 12
SAMPLED = 6
SEED_RUN = 6
ITEMS_AT_ONCE = 20_000
DOCS_AT_ONCE = 256
SEVERAL = 3
HITS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Unit:
    """How one kind of stream is measured."""

    least: int
    window: int
    foreign: int
    shared_prefix: int


WORDS = Unit(least=15, window=10, foreign=1, shared_prefix=8)
CHARACTERS = Unit(least=30, window=20, foreign=3, shared_prefix=12)


def cut_instructions(streams: dict[int, list[str]], least: int) -> dict[int, int]:
    """Per item, the length of its instruction: the opening common to all of the ``SEVERAL`` or more different items that share its first
    ``least`` units. Where items part, an instruction goes on only for those of which as many share ``least`` units more, so units
    that a few passages happen to share behind it stay evidence."""
    different = sorted({tuple(s) for s in streams.values()})
    found = {}
    todo = [(0, 0, len(different))]
    while todo:
        at, begin, end = todo.pop()
        for key, group in groupby(range(begin, end), lambda k: different[k][: at + least]):
            some = list(group)
            if len(key) < at + least or len(some) < SEVERAL:
                found |= dict.fromkeys((different[k] for k in some), at)
                continue
            first, last = different[some[0]], different[some[-1]]
            n = next((k for k, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
            todo.append((n, some[0], some[-1] + 1))
    return {item: found[tuple(s)] for item, s in streams.items()}


def _bits(unit: np.ndarray, step: int, repeat: int) -> np.ndarray:
    """The walk's random bit of (step, unit)."""
    with np.errstate(over="ignore"):
        z = (unit.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 1009 + repeat * 9176501 + 12345) * 0xD1342543DE82EF95 & (2**64 - 1))
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((z >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def sampled_places(size: int, repeat: int) -> list[int]:
    return sorted(np.random.default_rng(7919 * size + repeat).choice(2 * size, SAMPLED, replace=False).tolist())


def walk_keys(stream: np.ndarray, starts: np.ndarray, size: int, repeat: int, table: np.ndarray | None = None) -> np.ndarray:
    """LSH key of the window at each start. table: bits by (step, unit + 1), else they are computed."""
    places = sampled_places(size, repeat)
    at, key = np.zeros(len(starts), np.int64), np.full(len(starts), 1469598103934665603, np.uint64)
    with np.errstate(over="ignore"):
        for step in range(places[-1] + 1):
            inside = at < size
            unit = np.where(inside, stream[np.minimum(starts + at, len(stream) - 1)], -2)
            if step in places:
                key = (key ^ (unit + 3).astype(np.uint64)) * np.uint64(0x100000001B3)
                key ^= key >> np.uint64(32)
            at += table[step, unit + 2] if table is not None else _bits(unit, step, repeat)
    return key


@dataclass
class Index:
    """Windows of all different passages measured in one unit."""

    unit: Unit
    vocabulary: dict[str, int] = field(default_factory=dict)
    owners: list[list[int]] = field(default_factory=list)  # items of each different passage
    stream: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # all passages, one after the other
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per repetition: sorted keys, places of their windows
    tables: list[np.ndarray] = field(default_factory=list)

    def build(self, streams: dict[int, list[str]], opening: dict[int, int] | None = None) -> None:
        opening = cut_instructions(streams, self.unit.shared_prefix) if opening is None else opening
        owners: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, stream in streams.items():
            rest = stream[opening[item] :]
            if len(rest) >= self.unit.least:
                owners[tuple(rest)].append(item)
        if not owners:
            return
        self.owners = list(owners.values())
        passages = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in rest], np.int64) for rest in owners]
        self.stream, self.begin = np.concatenate(passages), np.cumsum([0, *map(len, passages)])
        size = self.unit.window
        starts = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(self.begin, self.begin[1:])])
        for turn in range(REPEATS):
            table = np.stack([_bits(np.arange(-2, len(self.vocabulary)), step, turn) for step in range(2 * size)])
            self.tables.append(table)
            key = walk_keys(self.stream, starts, size, turn, table).view(np.int64)
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], starts[order]))

    def passage(self, number: int) -> np.ndarray:
        return self.stream[self.begin[number] : self.begin[number + 1]]

    def hits(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in joined, places in the passages) of windows that met and are no more than ``foreign`` edits apart."""
        size, most = self.unit.window, self.unit.foreign
        known = np.r_[0, np.cumsum(joined >= 0)]
        starts = np.flatnonzero(known[size:] - known[:-size] >= size - most)
        near, met_now, waiting = [np.zeros(0, np.int64)], [], 0

        def compare() -> None:
            pair = distinct(np.concatenate(met_now))
            at, of = np.divmod(pair, len(self.stream))
            near.append(pair[window_distance(joined, at, self.stream, of, size, most) <= most])
            met_now.clear()

        for turn, (keys, places) in enumerate(self.keys if len(starts) else ()):
            key = walk_keys(joined, starts, size, turn, self.tables[turn]).view(np.int64)
            low, n = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            n -= low
            met = np.flatnonzero(n)
            total = np.r_[0, np.cumsum(n[met])]
            a = 0
            while a < len(met):  # a slice at a time: a key that many passages share is no large array
                b = max(a + 1, int(np.searchsorted(total, total[a] + HITS_AT_ONCE, side="right")) - 1)
                count = n[met[a:b]]
                of = places[np.repeat(low[met[a:b]] - total[a:b] + total[a], count) + np.arange(count.sum())]
                met_now.append(np.repeat(starts[met[a:b]], count) * len(self.stream) + of)
                waiting, a = waiting + len(of), b
                if waiting >= HITS_AT_ONCE:
                    compare()
                    waiting = 0
        if met_now:
            compare()
        return np.divmod(distinct(np.concatenate(near)), max(len(self.stream), 1))

    def carried(self, docs: list[list[str]], exhaustive: bool = False) -> Iterator[tuple[int, int]]:
        """(document, item) of every document that carries an item. exhaustive: from all runs of SEED_RUN equal units
        instead of the windows that met, to measure what the embedding misses."""
        get, gap = self.vocabulary.get, np.full(self.unit.window, -1, np.int64)
        joined = np.concatenate([x for d in docs for x in (np.fromiter(map(get, d, repeat(-1)), np.int64, len(d)), gap)])
        begin = np.cumsum([0, *[len(d) + len(gap) for d in docs]])
        place, of = equal_runs(joined, self.stream) if exhaustive else self.hits(joined)
        number = np.searchsorted(self.begin, of, side="right") - 1
        pair = (np.searchsorted(begin, place, side="right") - 1) * len(self.owners) + number
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else []
        for a, b in zip(new, [*new[1:], len(pair)]):
            d, i = divmod(int(pair[a]), len(self.owners))
            passage = self.passage(i)
            reach = len(passage) + len(passage) // 5 + self.unit.window
            for lo, hi in regions(place[a:b], reach, int(begin[d]), int(begin[d + 1]) - len(gap)):
                if longest_stretch(passage, joined[lo:hi], self.unit.least) >= self.unit.least:
                    for item in self.owners[i]:
                        yield d, item
                    break


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def window_distance(x: np.ndarray, at: np.ndarray, y: np.ndarray, of: np.ndarray, size: int, most: int) -> np.ndarray:
    """Edits from the windows of y at ``of`` to what begins in x at ``at`` and ends where it fits best; more than ``most`` is most + 1."""
    width = 2 * most + 1
    far = np.int64(most + 1)
    units = np.stack([x[np.minimum(at + k, len(x) - 1)] for k in range(size + most)])
    row = np.stack([np.full(len(at), d - most if d >= most else far, np.int64) for d in range(width)])  # diagonal d: place in x minus place in y is d - most
    for i in range(size):
        unit, before = y[of + i], row
        row = np.full_like(before, far)
        for d in range(width):
            j = i + d - most
            if 0 <= j < len(units):
                row[d] = before[d] + (units[j] != unit)
            if d + 1 < width:
                np.minimum(row[d], before[d + 1] + 1, out=row[d])
            if d and j >= 0:
                np.minimum(row[d], row[d - 1] + 1, out=row[d])
        np.minimum(row, far, out=row)
    return row.min(axis=0)


def equal_runs(joined: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in joined, places in stream) of all runs of SEED_RUN equal units."""
    own, other = grams_of(joined), grams_of(stream)
    order = np.argsort(other, kind="stable")
    at = np.flatnonzero(np.isin(own, other))
    low, n = np.searchsorted(other[order], own[at]), np.searchsorted(other[order], own[at], side="right")
    n -= low
    return np.repeat(at, n), order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def grams_of(stream: np.ndarray) -> np.ndarray:
    """Hash of the SEED_RUN units from each place on."""
    n = max(len(stream) - SEED_RUN + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED_RUN):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (stream[k : n + k] + 7).astype(np.uint64)
    return out


def regions(places: np.ndarray, reach: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document around sorted places in it; places further apart than two reaches are apart."""
    for p in np.split(places, np.flatnonzero(np.diff(places) > 2 * reach) + 1):
        yield max(begin, int(p[0]) - reach), min(end, int(p[-1]) + reach)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    if not n or x[0] != y[0]:
        return 0
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _reach(x: np.ndarray, y: np.ndarray, most: int) -> list[int]:
    """Greatest number of units of x, up to a match, that y follows with 0, 1 ... ``most`` edits."""
    best, far = [0], {0: 0}  # far: diagonal (place in y minus place in x) -> units of x used
    for _ in range(most):
        new: dict[int, int] = {}
        top = best[-1]
        for d, i in far.items():
            for step, e in ((1, d), (1, d - 1), (0, d + 1)):  # change, left out, added
                k = i + step
                if k <= len(x) and 0 <= k + e <= len(y) and k > new.get(e, -1):
                    new[e] = k
        for e, k in new.items():
            r = _common(x[k : k + 64], y[k + e : k + e + 64])
            while r and r % 64 == 0 and (more := _common(x[k + r : k + r + 64], y[k + e + r : k + e + r + 64])):
                r += more
            new[e] = k + r
            if r and k + r > top:
                top = k + r
        best.append(top)
        far = new
    return best


def longest_stretch(passage: np.ndarray, part: np.ndarray, least: int) -> int:
    """Units of the longest stretch of the passage that ``part`` carries, 0 if shorter than ``least``.

    A stretch of 15 or more units with an edit per ten has SEED_RUN units without one between them, so
    each is found from such a run."""
    own: dict[int, list[int]] = defaultdict(list)
    of_passage, grams = grams_of(passage), grams_of(part)
    for i, g in enumerate(of_passage.tolist()):
        own[g].append(i)
    longest = 0
    for j in np.flatnonzero(np.isin(grams, of_passage)).tolist():
        for i in own[int(grams[j])]:
            if i and j and passage[i - 1] == part[j - 1]:
                continue
            length = _common(passage[i:], part[j:])
            if length < SEED_RUN:
                continue
            ahead_of, behind_of = passage[i + length :], passage[:i][::-1]
            most = len(passage) // 10
            ahead = _reach(ahead_of, part[j + length :], most)
            behind = _reach(behind_of, part[:j][::-1], most)
            for e1, f in enumerate(ahead):
                for e2, b in enumerate(behind):
                    total = length + f + b
                    if total >= least and 10 * (e1 + e2) <= total and total > longest:
                        longest = total
    return longest


def stream_of(passage: str | None) -> tuple[Unit, list[str]]:
    """A passage's units."""
    text = plain(passage or "")
    unit = CHARACTERS if is_spaceless(text) else WORDS
    return unit, (characters if unit is CHARACTERS else words)(text)


def build_index(items: Iterable[tuple[int, str | None]], opening: dict[int, int] | None = None) -> list[Index]:
    """Indexes of passages by unit. opening: lengths of instructions, where these are known from more items than these."""
    streams: dict[Unit, dict[int, list[str]]] = {WORDS: {}, CHARACTERS: {}}
    for item, passage in items:
        unit, stream = stream_of(passage)
        streams[unit][item] = stream
    out = []
    for unit, some in streams.items():
        index = Index(unit)
        index.build(some, opening)
        if index.owners:
            out.append(index)
    return out


def carried_items(index: list[Index], texts: list[str | None], exhaustive: bool = False) -> Iterator[tuple[int, int]]:
    """(place in texts, item) for every passage that a text carries."""
    cleaned = [plain(t) if t else "" for t in texts]
    for one in index:
        if one.unit == CHARACTERS:
            at = [k for k, t in enumerate(cleaned) if SPACELESS_CHAR.search(t)]
            docs = [characters(cleaned[k]) for k in at]
        else:
            at = range(len(cleaned))
            docs = [words(t) for t in cleaned]
        if docs:
            for k, item in one.carried(docs, exhaustive):
                yield at[k], item


def instruction_lengths(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """item_id, passage, opening: ``cut_instructions`` over any number of items, a round for each instruction that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [stream_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u.shared_prefix for u, _ in some], pa.int32()), pa.array([x for _, x in some], pa.list_(pa.string()))], names=["item_id", "passage", "least", "stream"])

    rows = items.select(F.col(item_id).cast("long"), F.col(passage).cast("string")).mapInArrow(run, "item_id long, passage string, least int, stream array<string>")
    state = cut(rows.withColumn("opening", F.lit(0)))
    while True:
        whole = F.size("stream") >= F.col("opening") + F.col("least")
        keyed = state.withColumn("key", F.when(whole, F.slice("stream", F.lit(1), F.col("opening") + F.col("least"))))
        groups = keyed.filter(whole).groupBy("least", "key").agg(F.count_distinct("stream").alias("n"), F.min("stream").alias("low"), F.max("stream").alias("high")).filter(F.col("n") >= SEVERAL)
        parted = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True).cast("int") - 1
        further = cut(groups.select("least", "key", parted.alias("further")))
        if further.isEmpty():
            return state.select("item_id", "passage", "opening")
        state = cut(keyed.join(further, ["least", "key"], "left").withColumn("opening", F.coalesce("further", "opening")).select(*state.columns))


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", items_at_once: int = ITEMS_AT_ONCE, exhaustive: bool = False) -> DataFrame:
    """One row (doc_id, item_id) per document and item that it carries.

    Documents are read once per block of ``items_at_once`` items and aren't shuffled; a block's index, of
    that bounded size, is broadcast, and of several blocks each is released when its rows are written. NULL and empty
    texts carry nothing; NULL or short passages (fewer units than the rule needs, after a shared instruction is left
    out) are carried by nothing; equal passages are compared once and found for all their items. All items
    are compared for shared instructions, whatever their block. Repeated doc_ids give a row each time;
    item_ids must be unique and not NULL. exhaustive: without the embedding, to measure it.
    """
    spark = documents.sparkSession
    items = items.filter(items[item_id].isNotNull())
    blocks = max(1, -(-items.count() // items_at_once))
    known = instruction_lengths(items, item_id, passage) if blocks > 1 else items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage))
    schema = f"doc_id {dict(documents.dtypes)[doc_id]}, item_id long"
    out = None
    for block in range(blocks):
        some = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else known.collect()
        shared = spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in some], {r[0]: r[2] for r in some} if blocks > 1 else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for a in range(0, batch.num_rows, DOCS_AT_ONCE):
                    part = batch.slice(a, DOCS_AT_ONCE)
                    pairs = list(carried_items(shared.value, part.column(1).to_pylist(), exhaustive))
                    if pairs:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([k for k, _ in pairs])), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        found = documents.select(doc_id, text).mapInArrow(run, schema)
        if blocks > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
