"""Current versions kept as a table of their own, as an ingest leaves them.

Pushed versions are appended; what readers page through is the table of last versions, ranged by time and sorted within files, so that
a time window or a cursor prunes files and row groups. ``publish`` writes it, ``advance`` brings it up to date with further pushes: only
records that were pushed again are replaced, in a new table that takes the old one's place when it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import shared_folder
from flowloom.operators.versions import latest

ORDER = ("ts_micros", "frame_number", "id")


def publish(current: DataFrame, order: tuple[str, ...] = ORDER) -> str:
    """Write current versions to a new folder below the shared one; its path. Rows are ranged by the first column of ``order``."""
    path = shared_folder(current.sparkSession, "current")
    current.repartitionByRange(*[F.col(c) for c in order[:1]]).sortWithinPartitions(*order).write.parquet(path)
    return path


def advance(path: str, spark: SparkSession, pushed: DataFrame, keys: list[str], version: list[str], order: tuple[str, ...] = ORDER) -> str:
    """The published table with pushed versions over it; a pushed version of the same order wins. Its new path."""
    stored = spark.read.parquet(path)
    fresh = latest(pushed, keys, version).select(*stored.columns)
    again = stored.join(fresh.select(*keys), keys, "left_semi").withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    last = latest(again, keys, [*version, "__new"]).drop("__new")
    return publish(stored.join(fresh.select(*keys), keys, "left_anti").unionByName(last), order)
