"""Side tables of flows and messages, aggregated per record before they are joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.common import text

FAVORITE = "__favorite__"


@dataclass(frozen=True)
class SideTables:
    """What belongs to a record, each in its stored form (None: there is none).

    headers: flow_id, response, ord, name, value; metadata: record_id, key, value; tags: id, name,
    is_favorite; record_tags: record_id, tag_id; groups: id, name; group_members: record_id, group_id;
    marks: record_id, color; comments: record_id, created_at, body; blobs: sha256, bytes;
    messages: id, flow_id. A table may be given as a function that makes it, which is called where the table is needed.
    """

    headers: DataFrame | None = None
    metadata: DataFrame | None = None
    tags: DataFrame | None = None
    record_tags: DataFrame | None = None
    groups: DataFrame | None = None
    group_members: DataFrame | None = None
    marks: DataFrame | None = None
    comments: DataFrame | None = None
    blobs: DataFrame | None = None
    messages: DataFrame | None = None

    def __getattribute__(self, name: str):  # noqa: ANN204
        value = object.__getattribute__(self, name)
        return value() if name in type(self).__dataclass_fields__ and callable(value) else value

    def with_(self, **changes: DataFrame) -> SideTables:
        return SideTables(**{k: v for k, v in self.__dict__.items()} | changes)


def header_lists(headers: DataFrame) -> DataFrame:
    """flow_id, request_headers, response_headers: arrays of (ord, name, value) in wire order, repeated rows once.
    A flow's headers are bounded by the protocol; rows without a flow_id are left out."""
    entry = F.struct("ord", text(F.col("name")).alias("name"), text(F.col("value")).alias("value"))
    rows = headers.filter(text(F.col("flow_id")) != "").select("flow_id", "response", "ord", "name", "value").distinct()
    return rows.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.when(F.col("response") == 0, entry))).alias("request_headers"), F.array_sort(F.collect_list(F.when(F.col("response") == 1, entry))).alias("response_headers"))


def header_text(headers: Column) -> Column:
    """'name: value' lines, each ended by a line feed."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\n"))), "")


def metadata_map(rows: DataFrame, record: str = "record_id", order: str | None = None) -> DataFrame:
    """record_id, metadata: the last value of each key by ``order`` (the greatest value without one)."""
    pick = F.max(F.struct(*([order] if order else []), "value"))["value"].alias("value")
    last = rows.filter(text(F.col("key")) != "").groupBy(F.col(record).alias("record_id"), "key").agg(pick)
    return last.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def one_metadata(rows: DataFrame, metadata: DataFrame | None, key: str) -> DataFrame:
    """rows (with id) and the value of one metadata key (the greatest, as ``metadata_map``), in a column named like the key with _ for
    dots. Only rows of the key are aggregated and joined."""
    name = key.replace(".", "_")
    if metadata is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    last = metadata.filter(F.col("key") == key).groupBy(F.col("record_id").alias("__record")).agg(F.max("value").alias(name))
    return rows.join(last, rows["id"] == last["__record"], "left").drop("__record")


def tag_texts(record_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """record_id, tag_ids, tag_text (names in order of id, the id where it has no name), favorite."""
    named = record_tags.select("record_id", "tag_id").distinct().join(tags.select(F.col("id").alias("tag_id"), "name", "is_favorite"), "tag_id", "left")
    lists = named.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("tag_id", F.coalesce("name", "tag_id").alias("name")))).alias("t"), F.max(F.coalesce(F.col("is_favorite").cast("boolean"), F.lit(False))).alias("favorite"))
    return lists.select("record_id", F.col("t.tag_id").alias("tag_ids"), F.array_join("t.name", " ").alias("tag_text"), "favorite")


def group_texts(group_members: DataFrame, groups: DataFrame) -> DataFrame:
    """record_id, group_ids, group_text."""
    named = group_members.select("record_id", "group_id").distinct().join(groups.select(F.col("id").alias("group_id"), "name"), "group_id", "left")
    lists = named.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("group_id", F.coalesce("name", "group_id").alias("name")))).alias("t"))
    return lists.select("record_id", F.col("t.group_id").alias("group_ids"), F.array_join("t.name", " ").alias("group_text"))


def comment_texts(comments: DataFrame) -> DataFrame:
    """record_id, comment_text: bodies in order of creation, joined by a space."""
    lists = comments.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "body"))).alias("c"))
    return lists.select("record_id", F.array_join("c.body", " ").alias("comment_text"))


def mark_colors(marks: DataFrame) -> DataFrame:
    return marks.groupBy("record_id").agg(F.max("color").alias("mark_color"))


def message_counts(messages: DataFrame) -> DataFrame:
    """record_id, message_count, websocket."""
    return messages.groupBy(F.col("flow_id").alias("record_id")).agg(F.count("*").alias("message_count")).withColumn("websocket", F.lit(True))


def _join(rows: DataFrame, more: DataFrame | None, absent: dict[str, str], key: str = "record_id") -> DataFrame:
    if more is None:
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in absent.items()})
    more = more.select(F.col(key).alias("__record"), *absent)
    return rows.join(more, rows["id"] == more["__record"], "left").drop("__record")


def _body(rows: DataFrame, blobs: DataFrame | None, ref: str, name: str) -> DataFrame:
    if blobs is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    held = blobs.select(F.col("sha256").alias("__ref"), F.col("bytes").cast("string").alias(name)).dropDuplicates(["__ref"])
    return rows.join(held, rows[ref] == held["__ref"], "left").drop("__ref")


def attach(rows: DataFrame, t: SideTables, wanted: set[str]) -> DataFrame:
    """rows with the columns of the wanted side inputs."""
    if "marks" in wanted:
        rows = _join(rows, mark_colors(t.marks) if t.marks is not None else None, {"mark_color": "string"})
    if "tags" in wanted:
        rows = _join(rows, tag_texts(t.record_tags, t.tags) if t.record_tags is not None else None, {"tag_ids": "array<string>", "tag_text": "string", "favorite": "boolean"})
    if "groups" in wanted:
        rows = _join(rows, group_texts(t.group_members, t.groups) if t.group_members is not None else None, {"group_ids": "array<string>", "group_text": "string"})
    if "comments" in wanted:
        rows = _join(rows, comment_texts(t.comments) if t.comments is not None else None, {"comment_text": "string"})
    if "metadata" in wanted:
        rows = _join(rows, metadata_map(t.metadata) if t.metadata is not None else None, {"metadata": "map<string,string>"})
    if "messages" in wanted:
        rows = _join(rows, message_counts(t.messages) if t.messages is not None else None, {"message_count": "long", "websocket": "boolean"})
    if "headers" in wanted:
        lists = header_lists(t.headers).select("flow_id", header_text(F.col("request_headers")).alias("request_header_text"), header_text(F.col("response_headers")).alias("response_header_text")) if t.headers is not None else None
        rows = _join(rows, lists, {"request_header_text": "string", "response_header_text": "string"}, "flow_id")
    if "request_body" in wanted:
        rows = _body(rows, t.blobs, "req_body_ref", "request_body_text")
    if "response_body" in wanted:
        rows = _body(rows, t.blobs, "resp_body_ref", "response_body_text")
    if "payload" in wanted:
        rows = _body(rows, t.blobs, "payload_ref", "payload_text") if "payload_ref" in rows.columns and t.blobs is not None else rows.withColumn("payload_text", F.col("payload").cast("string"))
    return rows
