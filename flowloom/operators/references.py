"""References to records that do not exist.

A reference is one or more key columns. Rows are grouped by their null mask (which key columns
are absent: NULL, or '' for strings); every mask that its match semantics make checkable is
joined to the parents on its own non-null columns only.

Match semantics, as in the SQL standard:

* ``simple``  - a reference with any absent column refers to nothing and is never an orphan;
* ``partial`` - some parent must agree on all columns that are present;
* ``full``    - all columns or none: a partly absent reference is an orphan (fate ``partly_null``).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.common import DAY_MICROS

MATCHES = ("simple", "partial", "full")
MAX_KEY_COLUMNS = 6


def _absent(df: DataFrame, name: str) -> Column:
    c = df[name]
    return (c.isNull() | (c == "")) if dict(df.dtypes)[name] == "string" else c.isNull()


def orphan_references(
    refs: DataFrame,
    keys: list[str],
    parents: DataFrame,
    parent_keys: list[str],
    *,
    match: str = "simple",
    at: str | None = None,
    arrived: str | None = None,
    deletions: DataFrame | None = None,
    deleted_keys: list[str] | None = None,
    deleted_at: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` whose record is absent, with two more columns: ``null_mask`` (one digit per
    key column, 1 = absent) and ``fate``, the first that holds:

    * ``partly_null`` - only under ``full``;
    * ``deleted`` - ``deletions`` names the record and no parent row arrived after its last deletion; of a partly absent reference:
      every record that it may mean is deleted so, and there is one;
    * ``missing`` - no parent row agrees;
    * ``late`` - the first parent row arrived on a later UTC day than ``at``.

    ``at``, ``arrived`` and ``deleted_at`` are microseconds since the epoch; without ``at`` and
    ``arrived`` nothing is late, and a deletion counts unless ``arrived`` shows a later row. A NULL
    ``at`` is never late. A NULL arrival neither revives a record nor makes it late. Duplicates of refs
    are kept; callers that want one row per reference pass distinct rows, which also removes any
    hot key before the join. Parents and deletions are aggregated per key, with map-side combine,
    before they are joined. Empty inputs give empty results (all references are missing where
    there are no parents). Other columns of the inputs may have any names.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not keys or len(keys) != len(parent_keys) or len(keys) > MAX_KEY_COLUMNS:
        raise ValueError(f"1 to {MAX_KEY_COLUMNS} key columns are needed, as many on both sides")
    if deletions is not None and (len(deleted_keys or ()) != len(keys) or deleted_at is None):
        raise ValueError("deletions need deleted_keys for every key column, and deleted_at")
    width = range(len(keys))
    names = [f"__k{i}" for i in width]

    state = parents.select(*[parents[c].alias(n) for c, n in zip(parent_keys, names)], (parents[arrived].cast("long") if arrived else F.lit(None).cast("long")).alias("__arr"))
    gone = None
    if deletions is not None:
        gone = deletions.select(*[deletions[c].alias(n) for c, n in zip(deleted_keys, names)], deletions[deleted_at].cast("long").alias("__del")).groupBy(*names).agg(F.max("__del").alias("__last_del"), F.lit(True).alias("__gone"))

    mask = F.concat(*[F.when(_absent(refs, k), "1").otherwise("0") for k in keys])
    at_day = F.floor(refs[at].cast("long") / F.lit(DAY_MICROS)) if at else F.lit(None).cast("long")
    tagged = refs.withColumns({"null_mask": mask, "__at_day": at_day} | {n: refs[k] for n, k in zip(names, keys)})
    columns = [*refs.columns, "null_mask", "fate"]

    found: list[DataFrame] = []
    for n_absent in range(len(keys) if match == "partial" else 1):
        for gap in combinations(width, n_absent):
            on = [names[i] for i in width if i not in gap]
            these = tagged.filter(F.col("null_mask") == "".join("1" if i in gap else "0" for i in width))
            live = state.groupBy(*on).agg(F.min("__arr").alias("__first"), F.max("__arr").alias("__last"), F.lit(True).alias("__known"))
            late = F.when(F.floor(F.col("__first") / F.lit(DAY_MICROS)) > F.col("__at_day"), "late")
            if gone is not None and gap:
                # every record that may be meant, stored or named by a deletion, and whether one of them is left
                each = state.groupBy(*names).agg(F.min("__arr").alias("__first"), F.max("__arr").alias("__last"), F.lit(True).alias("__known"))
                both = each.alias("__s").join(gone.alias("__d"), [F.col(f"__s.{n}").eqNullSafe(F.col(f"__d.{n}")) for n in names], "full")
                dead = F.col("__gone") & ~F.coalesce(F.col("__last") > F.col("__last_del"), F.lit(False))
                one = both.select(*[F.coalesce(f"__s.{n}", f"__d.{n}").alias(n) for n in names], "__first", F.col("__known").alias("__k"), F.coalesce(dead, F.lit(False)).alias("__dead"))
                live = one.groupBy(*on).agg(F.min("__first").alias("__first"), F.max("__k").alias("__known"), F.max("__dead").alias("__gone"), F.max(F.col("__k") & ~F.col("__dead")).alias("__left"))
                joined = these.join(live, on, "left")
                fate = F.when(F.col("__gone") & ~F.coalesce("__left", F.lit(False)), "deleted").when(F.col("__known").isNull(), "missing").otherwise(late)
            else:
                joined = these.join(live, on, "left")
                fate = F.when(F.col("__known").isNull(), "missing").otherwise(late)
                if gone is not None:
                    joined = joined.join(gone, on, "left")
                    fate = F.when(F.col("__gone") & ~F.coalesce(F.col("__last") > F.col("__last_del"), F.lit(False)), "deleted").otherwise(fate)
            found.append(joined.withColumn("fate", fate).filter(F.col("fate").isNotNull()).select(*columns))
    if match == "full":
        mixed = tagged.filter(F.col("null_mask").contains("0") & F.col("null_mask").contains("1"))
        found.append(mixed.withColumn("fate", F.lit("partly_null")).select(*columns))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
