"""Percentiles per group of very large numeric columns: dyadic Count-sketches.

Values (64-bit integers) are encoded, in order, into 2**17 codes: each binary order of magnitude
has 2**10 equal steps, so a code covers less than 0.1 % of its value. For each binary resolution of the
codes (the low 0, 1, 2 ... bits left out) there is one Count-sketch of ``DEPTH`` signed rows of
``WIDTH`` counters; resolutions that have no more prefixes than a sketch has counters are kept as
exact counters, of which the finest gives all coarser ones. Cells are linear in the input, so
sketches of files or days merge by adding cells, and a row of weight -1 deletes one of weight 1.

A sketch is a row: the group's columns, ``n`` (total weight), ``cells`` (sorted cell numbers) and
``counts``. Only cells that aren't zero are held, and a group of no more than ``SPARSE`` different codes is held as these codes
(numbers from ``CELLS`` on) with their counts; the code after that turns all of them into cells of the sketch. So a group of few values
is a short list and none has more than ``CELLS`` cells. Both kinds add up.

Sketches are made where the rows are: a task counts what it reads per group and code, and sends a sketch of each of its groups,
so that not more than that is shuffled, once.

Stated error: the value returned for rank k has a true rank within ``rank_error`` of k, up to the
width of a code. ``rank_error`` is ``Z`` standard deviations, computed for each group from its own
sketch (second moment of every resolution over WIDTH); it is 0 where no two prefixes collide much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from flowloom.common import cut

MANTISSA = 10
BITS = 17
HALF = 1 << (BITS - 1)
DEPTH = 5
WIDTH = 512
SKETCHED = 6
EXACT_CELLS = 1 << (BITS - SKETCHED)
CELLS = EXACT_CELLS + SKETCHED * DEPTH * WIDTH
STRIDE = CELLS + (1 << BITS)
SPARSE = 256
Z = 4.0
SLICE = 100_000
#: Rows that a task counts at once, cells of large sketches that it holds back until its end, and tasks whose sketches of a group one task adds up.
ROWS_AT_ONCE, HELD_CELLS, FAN_IN = 200_000, 4_000_000, 2000


def encode(value: Column) -> Column:
    """The code of a 64-bit integer; order is kept."""
    v = value.cast("long")
    size = F.when(v < 0, F.bitwise_not(v)).otherwise(v)
    shift = F.greatest(F.length(F.bin(size)) - F.lit(MANTISSA + 1), F.lit(0))
    code = (shift * F.lit(1 << MANTISSA)).cast("long") + F.call_function("shiftright", size, shift)
    return F.when(v < 0, F.lit(HALF - 1) - code).otherwise(F.lit(HALF) + code).cast("int")


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each code."""
    codes = codes.astype(np.int64)
    negative = codes < HALF
    c = np.where(negative, HALF - 1 - codes, codes - HALF)
    shift = np.maximum((c >> MANTISSA) - 1, 0)
    low = (c - (shift << MANTISSA)) << shift
    high = low + (np.int64(1) << shift) - 1
    return np.where(negative, ~high, low), np.where(negative, ~low, high)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _slot(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell number and sign of prefixes in one row of one resolution."""
    h = _mix(prefix, 1 + level * DEPTH + row)
    cell = EXACT_CELLS + (level * DEPTH + row) * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64)
    return cell, np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def _sum_by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their values, where these aren't zero."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(value, first) if len(first) else value
    return key[first][total != 0], total[total != 0]


def sketch_cells(group: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (group * STRIDE + cell) and counts of codes with weights, in all resolutions."""
    keys, values = [group * STRIDE + (code >> SKETCHED)], [weight]
    for level in range(SKETCHED):
        prefix = code >> level
        for row in range(DEPTH):
            cell, sign = _slot(prefix, level, row)
            keys.append(group * STRIDE + cell)
            values.append(sign * weight)
    return np.concatenate(keys), np.concatenate(values)


def settle(key: np.ndarray, count: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of cells by key, with the codes of groups that have too many of them, or cells besides, turned into cells."""
    key, count = _sum_by_key(key, count)
    begin = np.searchsorted(key, np.arange(groups + 1) * STRIDE)
    middle = np.searchsorted(key, np.arange(groups) * STRIDE + CELLS)
    large = (begin[1:] - middle > SPARSE) | ((begin[1:] > middle) & (middle > begin[:-1]))
    if not large.any():
        return key, count
    turned = large[key // STRIDE] & (key % STRIDE >= CELLS)
    more = sketch_cells(key[turned] // STRIDE, key[turned] % STRIDE - CELLS, count[turned])
    return _sum_by_key(np.concatenate([key[~turned], more[0]]), np.concatenate([count[~turned], more[1]]))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SLICE list entries each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py(), column.flatten().to_numpy(zero_copy_only=False)


def _list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(more)))


def part_sketches(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Sketches of what each task reads, made in place: no shuffle, and any number of rows per group, for ``merge_sketches``.

    Rows with a NULL value are left out; a NULL weight counts as 0; NULL keys are a group of their own. A task holds ``ROWS_AT_ONCE``
    rows and ``HELD_CELLS`` cells of groups that are large already. Key columns may have any name but cells, counts and n.
    """
    if {k.lower() for k in keys} & {"cells", "counts", "n"}:
        raise ValueError("key columns may not be called cells, counts or n")
    w = F.coalesce(df[weight].cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    coded = df.filter(df[value].isNotNull()).select(*[df[k] for k in keys], encode(df[value]).alias("__code"), w.alias("__w"))
    schema = _schema(coded, keys, "n long, cells array<int>, counts array<long>")

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).group_by([*keys, "__code"]).aggregate([("__w", "sum")])
        table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        group = _runs([table.column(k).combine_chunks() for k in keys])
        return _sketch_rows(table, keys, group, group * STRIDE + CELLS + table.column("__code").to_numpy(), table.column("__w_sum").to_numpy(), table.column("__w_sum").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []
        n_waiting = n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            made = count(waiting)
            waiting.clear()
            large = np.diff(_lists(made.column("cells"))[0]) > SPARSE
            held.append(made.filter(pa.array(large)))
            n_held += int(np.diff(_lists(made.column("cells"))[0])[large].sum())
            if n_held > HELD_CELLS:
                held = list(_added(held, keys))
                n_held = sum(len(_lists(b.column("cells"))[1]) for b in held)
                if n_held > HELD_CELLS:
                    yield from held
                    held, n_held = [], 0
            yield made.filter(pa.array(~large))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n_waiting += batch.num_rows
            if n_waiting >= ROWS_AT_ONCE:
                yield from flush()
                n_waiting = 0
        if waiting:
            yield from flush()
        yield from _added(held, keys)

    return coded.mapInArrow(run, schema)


def build_sketches(df: DataFrame, keys: list[str], value: str, weight: str | None = None, min_rows: int | None = None) -> DataFrame:
    """One sketch per group of key columns: ``part_sketches`` added up. ``min_rows``: groups of less weight get no sketch.
    An empty table gives no sketch."""
    merged = merge_sketches(part_sketches(df, keys, value, weight), keys)
    return merged if min_rows is None else merged.filter(F.col("n") >= min_rows)


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Number of the run of equal rows that each row belongs to; NULLs are equal."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def _sketch_rows(rows: pa.Table | pa.RecordBatch, keys: list[str], group: np.ndarray, key: np.ndarray, count: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A sketch per run of ``group`` over ``rows``, from cells with keys and counts and the weights of the rows."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    key, count = settle(key, count.astype(np.int64), len(first))
    ends = np.searchsorted(key, np.arange(len(first) + 1) * STRIDE)
    kept = rows.select(keys).take(pa.array(first))
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(n, first)), _list_array(ends, key % STRIDE, pa.int32()), _list_array(ends, count, pa.int64())], names=[*keys, "n", "cells", "counts"])


def _add(keys: list[str]):  # noqa: ANN202
    """Adds up the sketches of equal keys, which follow each other; one open group is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, _ = _lists(batch.column("cells"))
            for a, b in _slices(offsets):
                part = batch.slice(a, b - a).select([*keys, "n", "cells", "counts"])
                if carried is not None:
                    part = pa.Table.from_batches([carried, part]).combine_chunks().to_batches()[0]
                group = _runs([part.column(k) for k in keys])
                at, cells = _lists(part.column("cells"))
                out = _sketch_rows(part, keys, group, np.repeat(group, np.diff(at)) * STRIDE + cells, _lists(part.column("counts"))[1], part.column("n").to_numpy())
                carried = out.slice(out.num_rows - 1)
                if out.num_rows > 1:
                    yield out.slice(0, out.num_rows - 1)
        if carried is not None:
            yield carried

    return run


def _added(sketches: list[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sketches in any order, added up."""
    some = [b for b in sketches if b.num_rows]
    if some:
        table = pa.Table.from_batches(some)
        order = pa.compute.sort_indices(table.select(keys), sort_keys=[(k, "ascending") for k in keys])
        yield from _add(keys)(table.take(order).combine_chunks().to_batches())


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts added up to one per group, e.g. days to a month (keys without the day). However many parts a group has, a task
    holds one sketch of it and a batch; parts from more than ``FAN_IN`` tasks are added up in two steps, the first by group and part."""
    schema = _schema(sketches, keys, "n long, cells array<int>, counts array<long>")
    tasks = sketches.rdd.getNumPartitions()
    rows = sketches.select(*keys, "n", "cells", "counts")
    if tasks > FAN_IN:
        rows = rows.withColumn("__part", F.when(F.size("cells") > SPARSE, F.spark_partition_id() % F.lit(-(-tasks // FAN_IN))).otherwise(-1))
        rows = rows.repartition(*keys, "__part").sortWithinPartitions(*keys, "__part").mapInArrow(_add([*keys, "__part"]), T.StructType([*schema.fields[: len(keys)], T.StructField("__part", T.IntegerType()), *schema.fields[len(keys) :]]))
    placed = rows.select(*keys, "n", "cells", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(_add(keys), schema)


def invert_ranks(key: np.ndarray, count: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Codes at ranks (from 1) of groups. key = group * STRIDE + cell, sorted, with its count; a group has cells or codes."""
    coded = key % STRIDE >= CELLS
    begin = np.searchsorted(key[coded], group * STRIDE)
    sparse = np.searchsorted(key[coded], (group + 1) * STRIDE) > begin
    if sparse.any():
        out = np.zeros(len(group), np.int64)
        running = np.cumsum(count[coded])
        at = np.searchsorted(running, np.r_[0, running][begin[sparse]] + rank[sparse], side="left")
        last = np.searchsorted(key[coded], (group[sparse] + 1) * STRIDE) - 1
        out[sparse] = key[coded][np.minimum(at, last)] % STRIDE - CELLS
        if not sparse.all():
            out[~sparse] = invert_ranks(key[~coded], count[~coded], group[~sparse], rank[~sparse])
        return out
    exact = key % STRIDE < EXACT_CELLS
    ekey, running = key[exact], np.cumsum(count[exact])
    base = np.r_[0, running][np.searchsorted(ekey, group * STRIDE)]
    last = np.searchsorted(ekey, group * STRIDE + EXACT_CELLS) - 1
    at = np.minimum(np.searchsorted(running, base + rank, side="left"), last)
    prefix = ekey[at] % STRIDE
    left = rank - (np.r_[0, running][at] - base)
    inside = count[exact][at]
    for level in range(SKETCHED - 1, -1, -1):
        child = prefix * 2
        guesses = []
        for row in range(DEPTH):
            cell, sign = _slot(child, level, row)
            want = group * STRIDE + cell
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            guesses.append(np.where(key[i] == want, count[i], 0) * sign)
        lower = np.clip(np.median(np.stack(guesses), axis=0).round().astype(np.int64), 0, np.maximum(inside, 0))
        right = left > lower
        prefix = child + right
        left = np.where(right, left - lower, left)
        inside = np.where(right, inside - lower, lower)
    return prefix


def rank_errors(key: np.ndarray, count: np.ndarray, groups: int) -> np.ndarray:
    """Z standard deviations of a rank, per group; 0 for groups held as codes."""
    total = np.zeros(groups)
    count, key = count[key % STRIDE < CELLS], key[key % STRIDE < CELLS]
    group, cell = key // STRIDE, key % STRIDE - EXACT_CELLS
    for level in range(SKETCHED):
        moments = np.zeros((DEPTH, groups))
        for row in range(DEPTH):
            at = cell // WIDTH == level * DEPTH + row
            at &= cell >= 0
            moments[row] = np.bincount(group[at], weights=count[at].astype(float) ** 2, minlength=groups)
        spread = np.median(moments, axis=0) / WIDTH
        total += np.where(spread < 0.25, 0, spread)
    return np.ceil(Z * np.sqrt(total))


def sketch_percentiles(sketches: DataFrame, keys: list[str], percents: list[int], blocks: bool = False) -> DataFrame:
    """Per group and percent q: n, rank_error, value (the middle of the code at rank ceil(n*q/100)), and
    value_low and value_high, between which the exact percentile lies up to the stated error. Sketches
    of no weight give no row. blocks: also block_low and block_high, the ends of the exact counter that holds the
    rank, between which the exact percentile lies for certain."""
    names = ["percent", "n", "rank_error", "value", "value_low", "value_high", *(["block_low", "block_high"] if blocks else [])]
    qs = [int(q) for q in percents]
    if any(not 0 < q <= 100 for q in qs):
        raise ValueError("percents are whole numbers from 1 to 100")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("n").to_numpy() > 0)) if batch.num_rows else batch
            if not batch.num_rows:
                continue
            offsets, cells = _lists(batch.column("cells"))
            _, counts = _lists(batch.column("counts"))
            n_all = batch.column("n").to_numpy()
            for a, b in _slices(offsets):
                part = slice(offsets[a], offsets[b])
                key, count = settle(np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])) * STRIDE + cells[part].astype(np.int64), counts[part].astype(np.int64), b - a)
                n = n_all[a:b]
                error = rank_errors(key, count, b - a)
                for q in qs:
                    rank = -(-n * q // 100)
                    at = [invert_ranks(key, count, np.arange(b - a), np.clip(r, 1, n).astype(np.int64)) for r in (rank - error, rank, rank + error)]
                    mid = decode(at[1])
                    out = [batch.column(k).slice(a, b - a) for k in keys]
                    out += [pa.array(np.full(b - a, q, np.int32)), pa.array(n), pa.array(error.astype(np.int64)), pa.array(mid[0] + (mid[1] - mid[0]) // 2), pa.array(decode(at[0])[0]), pa.array(decode(at[2])[1])]
                    if blocks:
                        begin = at[1] >> SKETCHED << SKETCHED
                        out += [pa.array(decode(begin)[0]), pa.array(decode(begin + (1 << SKETCHED) - 1)[1])]
                    yield pa.RecordBatch.from_arrays(out, names=[*keys, *names])

    return sketches.select(*keys, "n", "cells", "counts").mapInArrow(run, _schema(sketches, keys, ", ".join(f"{x} {'int' if x == 'percent' else 'long'}" for x in names)))


def exact_in_brackets(df: DataFrame, keys: list[str], value: str, brackets: DataFrame, percents: list[int]) -> DataFrame:
    """Exact percentiles of the groups of ``brackets`` (keys, n, and low_q, high_q for each percent q): p_q per
    percent, NULL where the bracket doesn't hold it. Only values inside a bracket are told apart; all
    others are counted by their place between brackets, on the map side. Then the code that holds a rank is found over the counts
    of at most 2**17 codes of a group, and the value over the values of this code alone, so no group is ordered in one task."""
    steps = [s for q in percents for s in (f"low_{q}", f"high_{q}")]
    joined = df.select(*[df[k] for k in keys], df[value].cast("long").alias("__v")).filter(F.col("__v").isNotNull()).join(brackets, keys)
    slot = sum([(F.col("__v") >= F.col(s)).cast("int") if s.startswith("low") else (F.col("__v") > F.col(s)).cast("int") for s in steps], F.lit(0))
    inside = F.lit(False)
    for q in percents:
        inside = inside | F.col("__v").between(F.col(f"low_{q}"), F.col(f"high_{q}"))
    packed = cut(joined.groupBy(*keys, "n", slot.alias("slot"), F.when(inside, F.col("__v")).alias("v")).agg(F.count("*").alias("c")).withColumn("code", encode(F.col("v"))))
    counts = packed.groupBy(*keys, "n", "slot", "code").agg(F.sum("c").alias("c"))
    running = counts.withColumn("cum", F.sum("c").over(Window.partitionBy(*keys).orderBy("slot", "code")))
    rank = lambda q: F.ceil(F.col("n") * q / F.lit(100))
    first = [F.min(F.when(F.col("cum") >= rank(q), F.struct("slot", "code", (rank(q) - F.col("cum") + F.col("c")).alias("left")))).alias(f"at_{q}") for q in percents]
    found = running.groupBy(*keys, "n").agg(*first)
    wanted = found.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"at_{q}.slot").alias("slot"), F.col(f"at_{q}.code").alias("code"), F.col(f"at_{q}.left").alias("left")) for q in percents])).alias("__place")).select(*keys, "n", "__place.*")
    same = [F.col(f"__w.{k}").eqNullSafe(F.col(f"__p.{k}")) for k in [*keys, "slot", "code"]]
    held = wanted.alias("__w").join(packed.alias("__p"), same).select(*[F.col(f"__w.{k}").alias(k) for k in keys], F.col("__w.n").alias("n"), F.col("__w.q").alias("q"), F.col("__w.left").alias("left"), F.col("__p.v").alias("v"), F.col("__p.c").alias("c"))
    within = held.withColumn("cum", F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("v"))).filter("cum >= left")
    return within.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("q") == q, F.col("v"))).alias(f"p_{q}") for q in percents])
