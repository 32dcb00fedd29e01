"""Filling fixed-capacity containers with whole texts: vector best-fit.

A container has three capacities: tokens, number of texts, and attention cost (sum of squared lengths
of the texts in it, which attend only to themselves). An item goes into an open container that has
room in all three, the one with the best score: the least weighted norm of what would stay free
(``norm``) or the greatest weighted dot product of free space and item (``dot``); only where no open
container has room a new one is opened. Items are taken in order of falling size.

A text whose attention cost alone is beyond the limit, though its tokens aren't, gets a container of its own: it is never split for it.

Items are packed in shards of about ``SHARD`` items that a hash draws evenly from all sizes. The
containers of a shard that stay emptier than ``FULL`` are given back; their items form fewer shards in
the next round, until one shard is left or a round gives back more than half; then the emptier containers of that round stay as they are
(limits that leave most containers short of ``FULL`` tokens, as a low number of texts does, end the packing this way).

A text larger than the token capacity, and no other, is cut into pieces: all but the last fill a
container each, the last is an item like any other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD = 6000
FULL = 0.98
MAX_BUDGETS = 100
WEIGHTS = (1.0, 0.01, 0.01)

_PLACED = "budget_name string, doc_id long, piece int, token_start long, token_end long, size long, capacity long, container_id string, fill double"

TEXTS_SHARE = 8


def limits_of(capacity: int, max_texts: int | None = None, attention: int | None = None) -> tuple[int, int]:
    """Number of texts and attention cost of a container, where they aren't given."""
    return max_texts or max(capacity // TEXTS_SHARE, 1), attention or capacity**2


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row; NULL and empty texts have none. vocabulary: a rank file that all executors can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(sizes: np.ndarray, capacity: int, max_texts: int, attention: int, score: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item; items of falling size come first. An item that no empty container can hold is an error."""
    n = len(sizes)
    if n and (sizes.max() > capacity or int(sizes.max()) ** 2 > attention or max_texts < 1):
        raise ValueError("an item is larger than an empty container")
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    limits = np.array([capacity, max_texts, attention], float)
    scale = np.array(weights, float)
    room = np.zeros((3, n))
    number, used, out = np.zeros(n, np.int64), 0, np.zeros(n, np.int64)
    least, opened = float(sizes.min()) if n else 0.0, 0
    for i in np.argsort(-sizes, kind="stable"):
        need = np.array([sizes[i], 1, sizes[i] * sizes[i]], float)
        have = room[:, :used]
        fits = np.flatnonzero((have[0] >= need[0]) & (have[1] >= need[1]) & (have[2] >= need[2]))
        if len(fits):
            if score == "norm":
                value = scale @ np.square((have[:, fits] - need[:, None]) / limits[:, None])
                at = int(fits[np.argmin(value)])
            else:
                value = scale @ (have[:, fits] / limits[:, None] * (need / limits)[:, None])
                at = int(fits[np.argmax(value)])
        else:
            at, used = used, used + 1
            room[:, at], number[at] = limits, opened
            opened += 1
        out[i] = number[at]
        room[:, at] -= need
        if room[0, at] < least or room[1, at] < 1:  # full: the last open one takes its place
            used -= 1
            room[:, at], number[at] = room[:, used], number[used]
    return out


def pack(sizes: DataFrame, budgets: DataFrame, *, max_texts: int | None = None, attention: int | None = None, score: str = "norm", shard: int = SHARD) -> DataFrame:
    """One row per piece of a document and budget: budget_name, capacity, container_id, doc_id, piece,
    token_start, token_end.

    sizes: doc_id, n_tokens; budgets: budget_name, capacity_tokens (at most ``MAX_BUDGETS`` rows; NULL
    or capacities below 1 are an error). Defaults of the other capacities per container: capacity / 8
    texts, and capacity squared of attention cost, which a single full-size text needs and no other filling exceeds; a smaller
    ``attention`` binds. Documents without tokens get one row with container_id NULL. Repeated doc_ids are packed each for itself. An empty
    table gives no rows.
    """
    plans = [(r[0], r[1]) for r in budgets.select("budget_name", F.col("capacity_tokens").cast("long")).limit(MAX_BUDGETS + 1).collect()]
    if len(plans) > MAX_BUDGETS or any(c is None or c < 1 for _, c in plans):
        raise ValueError("budgets need 1 to MAX_BUDGETS rows with a capacity")
    offers = F.array(*[F.struct(F.lit(b).alias("budget_name"), F.lit(c).cast("long").alias("capacity")) for b, c in plans])
    each = sizes.select("doc_id", "n_tokens", F.explode(offers).alias("o")).select("doc_id", "n_tokens", "o.*")
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"), F.lit(1))
    split = each.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    split = split.withColumns({"token_start": F.col("piece") * F.col("capacity"), "token_end": F.least((F.col("piece") + 1) * F.col("capacity"), F.col("n_tokens"))}).withColumn("size", F.col("token_end") - F.col("token_start"))
    columns = ["budget_name", "capacity", "container_id", "doc_id", "piece", "token_start", "token_end"]
    most = F.lit(attention).cast("long") if attention else F.col("capacity") * F.col("capacity")
    single = (F.col("size") == F.col("capacity")) | (F.col("size") * F.col("size") > most)
    alone = split.filter(single | (F.col("size") == 0)).withColumn("container_id", F.when(F.col("size") > 0, F.concat_ws("-", F.lit("whole"), "doc_id", "piece", F.monotonically_increasing_id())))
    done = [alone.select(*columns)]
    left = split.filter(~single & (F.col("size") > 0)).select("budget_name", "capacity", "doc_id", "piece", "token_start", "token_end", "size")

    def place(turn: int):  # noqa: ANN202
        def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
            capacity = int(items["capacity"].iloc[0])
            items = items.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            at = best_fit(items["size"].to_numpy(), capacity, *limits_of(capacity, max_texts, attention), score)
            filled = np.bincount(at, weights=items["size"])[at] / capacity
            return items.assign(container_id=[f"{turn}-{key[1]}-{k}" for k in at], fill=filled)[["budget_name", "doc_id", "piece", "token_start", "token_end", "size", "capacity", "container_id", "fill"]]

        return run

    turn, before = 0, None
    counts = {r[0]: r[1] for r in left.groupBy("budget_name").count().collect()}
    while counts:
        shards = {b: -(-n // shard) for b, n in counts.items()}
        n_shards = F.lit(1)
        for b, k in shards.items():
            n_shards = F.when(F.col("budget_name") == b, F.lit(k)).otherwise(n_shards)
        keyed = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), n_shards))
        placed = cut(keyed.groupBy("budget_name", "shard").applyInPandas(place(turn), _PLACED))
        again = {r[0]: r[1] for r in placed.filter(F.col("fill") < FULL).groupBy("budget_name").count().collect()}
        again = {b: n for b, n in again.items() if shards[b] > 1 and 2 * n < counts[b]}
        open_ = F.col("budget_name").isin(*again) & (F.col("fill") < FULL) if again else F.lit(False)
        done.append(placed.filter(~open_).select(*columns))
        left = placed.filter(open_).drop("container_id", "fill")
        counts, turn = again, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """Per budget: n_containers, n_tokens, least_containers (tokens over capacity, rounded up), unused_share, texts_cut."""
    held = packed.filter(F.col("container_id").isNotNull())
    return held.groupBy("budget_name", "capacity").agg(F.count_distinct("container_id").alias("n_containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"), F.count_distinct(F.when(F.col("piece") > 0, F.col("doc_id"))).alias("texts_cut")).select(
        "budget_name", "capacity", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("unused_share"), "texts_cut"
    )


def containers(packed: DataFrame, max_texts: int | None = None, attention: int | None = None) -> DataFrame:
    """Per container: budget_name, capacity, container_id, n_tokens, n_texts, cost, and closed_by, the capacity that is used up to the
    greatest part (tokens before texts before attention where equal)."""
    size = F.col("token_end") - F.col("token_start")
    each = packed.filter(F.col("container_id").isNotNull()).groupBy("budget_name", "capacity", "container_id").agg(F.sum(size).alias("n_tokens"), F.count("*").alias("n_texts"), F.sum(size * size).alias("cost"))
    texts = F.lit(max_texts) if max_texts else F.greatest(F.floor(F.col("capacity") / TEXTS_SHARE), F.lit(1))
    most = F.lit(attention) if attention else F.col("capacity") * F.col("capacity")
    used = F.array(F.col("n_tokens") / F.col("capacity"), F.col("n_texts") / texts, F.col("cost") / most)
    names = F.array(*[F.lit(x) for x in ("tokens", "texts", "attention")])
    return each.withColumns({"over": (F.col("n_tokens") > F.col("capacity")) | (F.col("n_texts") > texts) | ((F.col("cost") > most) & (F.col("n_texts") > 1)), "closed_by": F.element_at(names, F.array_position(used, F.array_max(used)).cast("int"))})


def packing_faults(packed: DataFrame, sizes: DataFrame, max_texts: int | None = None, attention: int | None = None) -> DataFrame:
    """Per budget what must be 0: containers over a capacity, tokens of documents that no piece or two pieces hold, texts within the
    capacity that are cut. sizes: doc_id (unique), n_tokens."""
    over = containers(packed, max_texts, attention).groupBy("budget_name").agg(F.count_if("over").alias("over"))
    pieces = packed.groupBy("budget_name", "capacity", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.count("*").alias("n"), F.max("token_end").alias("end"))
    against = pieces.join(sizes.select("doc_id", "n_tokens"), "doc_id", "full")
    short = against.groupBy("budget_name").agg(
        F.coalesce(F.sum(F.abs(F.col("n_tokens") - F.col("held"))), F.lit(0)).alias("lost_tokens"),
        F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut_texts"), F.count("n_tokens").alias("n_texts"),
    )
    return short.join(over, "budget_name", "full").select("budget_name", F.col("n_texts").cast("long").alias("n_texts"), F.coalesce("over", F.lit(0)).alias("over_capacity"), F.col("lost_tokens").cast("long").alias("lost_tokens"), "cut_texts")
