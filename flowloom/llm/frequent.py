"""Most frequent values among billions in bounded memory: majority-vote sketches.

A sketch of a column has ``depth`` rows of ``width`` cells. A cell holds the total count of the values
hashed to it, a candidate value and the candidate's surplus of votes. A value of the cell that is its
candidate adds to the surplus, any other takes from it and becomes the candidate where it turns
negative. Cells of two sketches merge in the same way: totals add up, surpluses of equal candidates add
up, those of different ones cancel and the larger keeps the cell.

Of a value x with count f in a cell (total V, candidate K, surplus C) holds
``f <= (V + C) / 2`` and ``f >= C`` if x = K, and ``f <= (V - C) / 2`` otherwise. The upper bound of x is
the least over its rows, the lower bound the greatest. A value with more than half of one of its cells
is that cell's candidate, so it is found unless in all rows other frequent values share its cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 4
WIDTH = 2048
FAN_IN = 64
ROWS_AT_ONCE = 50_000

_CELL = "field int, row int, cell int, total long, hash long, candidate string, surplus long"


def _place(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return ((z ^ (z >> np.uint64(33))) % np.uint64(width)).astype(np.int64)


class VoteSketch:
    """One column's sketch while it is filled."""

    def __init__(self, depth: int, width: int) -> None:
        self.depth, self.width = depth, width
        self.total = np.zeros((depth, width), np.int64)
        self.surplus = np.zeros((depth, width), np.int64)
        self.hash = np.zeros((depth, width), np.int64)
        self.value = np.full((depth, width), None, object)

    def add(self, hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Distinct values with their counts."""
        for row in range(self.depth):
            cell = _place(hashes, row, self.width)
            self.total[row] += np.bincount(cell, weights=counts, minlength=self.width).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            placed = cell[order]
            start = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
            turn = np.arange(len(placed)) - np.repeat(start, np.diff(np.r_[start, len(placed)]))
            by_turn = order[np.argsort(turn, kind="stable")]
            for a, b in zip(*(lambda e: (np.r_[0, e[:-1]], e))(np.cumsum(np.bincount(turn)))):
                i = by_turn[a:b]
                c = cell[i]
                same = (self.hash[row, c] == hashes[i]) & (self.surplus[row, c] > 0)
                votes = self.surplus[row, c] + np.where(same, counts[i], -counts[i])
                turned = votes < 0
                self.surplus[row, c] = np.abs(votes)
                self.hash[row, c[turned]] = hashes[i[turned]]
                self.value[row, c[turned]] = values[i[turned]]


def _fill(fields: int, depth: int, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [VoteSketch(depth, width) for _ in range(fields)]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held)
            for k, sketch in enumerate(sketches):
                got = table.column(f"h{k}").combine_chunks()
                some = got.is_valid()
                hashes = got.filter(some).to_numpy()
                if len(hashes):
                    distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                    sketch.add(distinct, table.column(f"v{k}").combine_chunks().filter(some).take(pa.array(first)).to_numpy(zero_copy_only=False), counts)
            held.clear()

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                flush()
                n = 0
        if n:
            flush()
        for k, s in enumerate(sketches):
            row, cell = np.nonzero(s.total)
            if len(row):
                value = s.value[row, cell]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(row.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(s.total[row, cell]), pa.array(s.hash[row, cell]), pa.array(value, pa.string()), pa.array(s.surplus[row, cell])], names=["field", "row", "cell", "total", "hash", "candidate", "surplus"])

    return run


def merge_cells(cells: DataFrame, *group: str) -> DataFrame:
    """Cells of several sketches merged by vote cancellation, per field, row, cell (and ``group``)."""
    x = F.struct("surplus", "hash", "candidate")
    start = F.struct(F.lit(0).cast("long").alias("surplus"), F.lit(0).cast("long").alias("hash"), F.lit(None).cast("string").alias("candidate"))

    def vote(acc, one):  # noqa: ANN001, ANN202
        joined = F.struct((acc["surplus"] + one["surplus"]).alias("surplus"), one["hash"].alias("hash"), one["candidate"].alias("candidate"))
        kept = F.struct((acc["surplus"] - one["surplus"]).alias("surplus"), acc["hash"].alias("hash"), acc["candidate"].alias("candidate"))
        lost = F.struct((one["surplus"] - acc["surplus"]).alias("surplus"), one["hash"].alias("hash"), one["candidate"].alias("candidate"))
        return F.when(acc["candidate"].eqNullSafe(one["candidate"]), joined).when(acc["surplus"] >= one["surplus"], kept).otherwise(lost)

    merged = cells.groupBy("field", "row", "cell", *group).agg(F.sum("total").alias("total"), F.aggregate(F.sort_array(F.collect_list(x), asc=False), start, vote).alias("k"))
    return merged.select("field", "row", "cell", *group, "total", "k.hash", "k.candidate", "k.surplus")


def vote_sketch(df: DataFrame, columns: list[str], depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """The merged sketches of string columns: field (place in ``columns``), row, cell, total, hash, candidate, surplus.

    NULL and '' are absent and not counted. A task holds depth * width cells per column whatever its
    input; the sketches of tasks are merged ``FAN_IN`` at a time, so no merge holds more cells than
    that. An empty table gives no cells. Values are told apart by a 64-bit hash.
    """
    picked = []
    for k, c in enumerate(columns):
        v = F.when(df[c] != "", df[c])
        picked += [v.alias(f"v{k}"), F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{k}")]
    base = df.select(*picked)
    tasks = base.rdd.getNumPartitions()
    cells = base.mapInArrow(_fill(len(columns), depth, width), _CELL)
    if tasks > FAN_IN:
        cells = cells.withColumn("part", F.spark_partition_id())
        for _ in range(math.ceil(math.log(tasks, FAN_IN)) - 1):
            cells = merge_cells(cells.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), "part")
    return merge_cells(cells)


def frequent_items(sketch: DataFrame, columns: list[str], share: float, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Values whose upper bound reaches ``share`` of their column's rows: field_name, item_value, n_low,
    n_high, n_rows (rows in which the column is present). The sketch has at most depth * width cells
    per column, so it is read in one task."""
    if width < 2 / share:
        raise ValueError("width must be at least 2 / share")

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        for field, cells in pd.concat(parts, ignore_index=True).groupby("field"):
            total, surplus, kept = (np.zeros((depth, width), np.int64) for _ in range(3))
            total[cells["row"], cells["cell"]], surplus[cells["row"], cells["cell"]], kept[cells["row"], cells["cell"]] = cells["total"], cells["surplus"], cells["hash"]
            n = int(total[0].sum())
            some = cells[cells["candidate"].notna()].drop_duplicates("hash")
            hashes = some["hash"].to_numpy()
            low, high = np.zeros(len(some), np.int64), np.full(len(some), n, np.int64)
            for row in range(depth):
                at = _place(hashes, row, width)
                mine = kept[row, at] == hashes
                v, c = total[row, at], surplus[row, at]
                high = np.minimum(high, np.where(mine, v + c, v - c) // 2)
                low = np.maximum(low, np.where(mine, c, 0))
            enough = high >= share * n
            yield pd.DataFrame({"field_name": columns[int(field)], "item_value": some["candidate"].to_numpy()[enough], "n_low": low[enough], "n_high": high[enough], "n_rows": n})

    return sketch.repartition(1).mapInPandas(bounds, "field_name string, item_value string, n_low long, n_high long, n_rows long")
