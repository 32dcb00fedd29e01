"""Changes to stored tables as plans: each function gives the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.common import text
from flowloom.operators.versions import latest
from flowloom.plans.side import FAVORITE

TERMINAL = ("closed", "error")


def upsert(stored: DataFrame, pushed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each record; a pushed row wins over a stored one of the same order."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(pushed.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "__new"]).drop("__new")


def replace_children(stored: DataFrame, pushed_children: DataFrame, pushed_parents: DataFrame, key: str) -> DataFrame:
    """Side rows after a push: those of pushed parents are replaced as a whole, all others stay."""
    gone = pushed_parents.select(F.col("id").alias(key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(pushed_children, allowMissingColumns=True)


def body_refs(versions: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """key, body_ref of each record by its versions (body_state final, pending or stored): the last version decides; pending has no
    body yet, stored keeps the last final reference."""
    last = versions.groupBy(key).agg(F.max_by("body_state", order).alias("state"), F.max_by(F.col("body_ref"), F.when(F.col("body_state") == "final", F.col(order))).alias("last_final"))
    return last.select(key, F.when(F.col("state") != "pending", F.col("last_final")).alias("body_ref"))


def set_assignments(stored: DataFrame, record_ids: DataFrame, value_ids: list[str], column: str) -> DataFrame:
    """The records have exactly these tags (or groups); a set, so repeats vanish."""
    ids = record_ids.select("record_id").distinct()
    new = ids.withColumn(column, F.explode(F.array(*[F.lit(v) for v in value_ids]))) if value_ids else ids.withColumn(column, F.lit("")).filter("false")
    return stored.select("record_id", column).join(ids, "record_id", "left_anti").unionByName(new).distinct()


def toggle_favorite(record_tags: DataFrame, record_ids: DataFrame) -> DataFrame:
    """Favorite goes to all records if any lacks it, else is taken from all."""
    ids = record_ids.select("record_id").distinct()
    have = record_tags.filter(F.col("tag_id") == FAVORITE).select("record_id").distinct()
    given = ids.withColumn("tag_id", F.lit(FAVORITE))
    tags = record_tags.select("record_id", "tag_id")
    if ids.join(have, "record_id", "left_anti").isEmpty():
        return tags.join(given, ["record_id", "tag_id"], "left_anti").distinct()
    return tags.unionByName(given).distinct()


def delete_definition(definitions: DataFrame, id_: str) -> DataFrame:
    """The definition is marked as deleted: assignments still find its name. The favorite tag can't be deleted."""
    if id_ == FAVORITE:
        raise ValueError("the favorite tag can't be deleted")
    deleted = F.col("deleted") if "deleted" in definitions.columns else F.lit(False)
    return definitions.withColumn("deleted", deleted | (F.col("id") == id_))


def put_definition(definitions: DataFrame, id_: str, **fields: object) -> DataFrame:
    """Create or change a definition."""
    spark = definitions.sparkSession
    known = definitions.filter(F.col("id") == id_).limit(1)
    row = spark.createDataFrame([(id_,)], "id string").join(known, "id", "left").select(*[F.lit(fields[c]).cast(t).alias(c) if c in fields else F.col(c) for c, t in definitions.dtypes])
    return definitions.filter(F.col("id") != id_).unionByName(row)


def mirror_definitions(bundle: DataFrame, catalog: DataFrame) -> DataFrame:
    """Definitions of a bundle with those of the catalog that it lacks."""
    return bundle.unionByName(catalog.join(bundle.select("id"), "id", "left_anti"), allowMissingColumns=True)


def set_mark(marks: DataFrame, record_ids: DataFrame, color: str | None) -> DataFrame:
    """One mark per record; None clears."""
    ids = record_ids.select("record_id").distinct()
    kept = marks.select("record_id", "color").join(ids, "record_id", "left_anti")
    return kept if color is None else kept.unionByName(ids.withColumn("color", F.lit(color)))


def edit_comments(comments: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Comments by id: changed rows replace or add, deleted ids go."""
    gone = deleted.select("id").unionByName(changed.select("id")).distinct()
    return comments.join(gone, "id", "left_anti").unionByName(changed, allowMissingColumns=True)


def finish_session(sessions: DataFrame, id_: str, status: str, now_millis: int) -> DataFrame:
    """New status; a terminal one closes the session, once."""
    if status not in (*TERMINAL, "open", "decoding"):
        raise ValueError(f"unknown status {status!r}")
    here = F.col("id") == id_
    closed = F.when(here & F.lit(status in TERMINAL), F.coalesce(F.col("closed_at"), F.lit(now_millis))).otherwise(F.col("closed_at"))
    return sessions.withColumns({"closed_at": closed, "status": F.when(here, F.lit(status)).otherwise(F.col("status"))})


def delete_session(sessions: DataFrame, id_: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The session and its rows in all tables; refused while it is open."""
    status = sessions.filter(F.col("id") == id_).select("status").limit(1).collect()
    if not status:
        raise ValueError(f"no session {id_!r}")
    if status[0].status == "open":
        raise ValueError(f"session {id_!r} is open")
    return sessions.filter(F.col("id") != id_), {n: t.filter(~F.col("session_id").eqNullSafe(id_)) for n, t in tables.items()}


def merge_metadata(stored: DataFrame, pushed: DataFrame) -> DataFrame:
    """(session_id, key, value) with pushed keys replacing stored ones."""
    both = stored.select("session_id", "key", "value").withColumn("__n", F.lit(0)).unionByName(pushed.select("session_id", "key", "value").withColumn("__n", F.lit(1)))
    return latest(both, ["session_id", "key"], ["__n"]).select("session_id", "key", "value")


def delete_flows(flows: DataFrame, condition: Column, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Flows without those of the condition, and side tables (name -> (table, key)) without their rows."""
    gone = flows.filter(F.coalesce(condition, F.lit(False))).select("id").distinct()
    return flows.join(gone, "id", "left_anti"), {n: t.join(gone.select(F.col("id").alias(k)), k, "left_anti") for n, (t, k) in children.items()}


def prune_packets(packets: DataFrame, pids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): packets of the processes, those of unknown owner kept."""
    keep = F.col("owner_pid").isNull() | F.col("owner_pid").isin(*pids)
    return packets.filter(keep), packets.filter(~keep)


def resolve_prefix(rows: DataFrame, prefix: str) -> str:
    """The id given exactly, or the only one that begins with prefix; else an error that says how many do."""
    hits = [r.id for r in rows.filter(text(F.col("id")).startswith(prefix)).select("id").distinct().orderBy(F.col("id") != prefix, "id").limit(101).collect()]
    if hits and (hits[0] == prefix or len(hits) == 1):
        return hits[0]
    raise ValueError(f"{prefix!r} matches {'over 100' if len(hits) > 100 else len(hits)} ids")
