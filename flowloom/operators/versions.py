"""Latest-wins views over appended versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, of equal ones the greatest in ``ties`` (all other columns by default).

    NULL is least; NULL keys are a key of their own. Only the first row of a key leaves each task before the shuffle, so
    a record pushed very often is no large group, and columns that nothing downstream reads aren't scanned if ``ties`` names few.
    """
    names = columns or rows.columns
    if ties is None:
        ties = [c for c, t in rows.dtypes if c in names and c not in keys and c not in order and not t.startswith("map") and t != "variant"]
    rank = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *ties]] or [F.lit(1)])
    return rows.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").select(*names)
