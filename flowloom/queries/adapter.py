"""The test tables as flows with side tables, and the same as SQL.

Annotations, bodies and messages have no tables of their own in the test data; they are derived by
rules on ts_micros that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.common import load, stamp
from flowloom.operators.versions import latest
from flowloom.plans import store
from flowloom.plans.side import FAVORITE, SideTables

FLOW_COLUMNS = [
    "session_id", "id", "analysis_id", "frame_number", "ts_micros", "method", "scheme", "authority", "path", "query", "protocol", "status", "src_addr", "dst_addr", "user_agent",
    "content_type", "request_bytes", "tls_decrypted", "connection_id", "stream_id", "proxy_addr", "proxy_user", "error", "duration_micros", "http2_fingerprint", "ja3", "ja4", "redirect_location", "req_content_encoding", "resp_content_encoding",
]


_PUBLISHED: dict[tuple, tuple[str, StructType]] = {}


def latest_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every flow, from all stored versions, with references to its bodies."""
    rows = latest(load(spark, sf_dir, "flows").filter("id <> ''"), ["id"], ["pushed_at"], FLOW_COLUMNS, ties=["content_type"])
    return rows.withColumns({"resp_body_ref": (F.col("ts_micros") % 40000).cast("string"), "req_body_ref": F.lit(None).cast("string")})


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every flow, from the table that is published when an application first reads the versions (and again when
    they have changed)."""
    path = f"{sf_dir}/flows.parquet"
    key = (spark.sparkContext.applicationId, path, *stamp(spark, path))
    if key not in _PUBLISHED:
        rows = latest_flows(spark, sf_dir)
        _PUBLISHED[key] = store.publish(rows), rows.schema
    where, schema = _PUBLISHED[key]
    return spark.read.schema(schema).parquet(where)


def tables(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> SideTables:
    ts = F.col("ts_micros")

    def f() -> DataFrame:
        return (base if base is not None else flows(spark, sf_dir)).select("id", "ts_micros", "duration_micros", "protocol")

    def pick(column: str, *cases: tuple) -> DataFrame:
        return f().select(F.col("id").alias("record_id"), F.explode(F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in cases]), lambda x: x.isNotNull())).alias(column))

    def metadata() -> DataFrame:
        return f().select(F.col("id").alias("record_id"), F.explode(F.filter(F.array(
            F.when(ts % 3 == 0, F.struct(F.lit("proxy_provider").alias("key"), F.when(ts % 2 == 0, "acme").otherwise("zeta").alias("value"))),
            F.when(ts % 37 == 0, F.struct(F.lit("conn.outcome").alias("key"), F.lit("tls_rejected").alias("value"))).when(ts % 41 == 0, F.struct(F.lit("conn.outcome").alias("key"), F.lit("tcp_passthrough").alias("value"))),
        ), lambda x: x.isNotNull())).alias("m")).select("record_id", "m.*")

    def comments() -> DataFrame:
        both = F.array(*[F.struct(F.lit(n).alias("created_at"), F.lit(b).alias("body")) for n, b in ((1, "first look"), (2, "second look"))])
        return f().filter(ts % 101 == 0).select(F.col("id").alias("record_id"), F.explode(both).alias("c")).select("record_id", "c.*")

    return SideTables(
        headers=lambda: load(spark, sf_dir, "flow_headers"),
        metadata=metadata,
        tags=lambda: spark.createDataFrame([("t-auth", "auth", False), ("t-slow", "slow", False), (FAVORITE, "Favorite", True)], "id string, name string, is_favorite boolean"),
        record_tags=lambda: pick("tag_id", (ts % 11 == 0, "t-auth"), (F.col("duration_micros") > 300_000, "t-slow"), (ts % 97 == 0, FAVORITE)),
        groups=lambda: spark.createDataFrame([("g-root", "root"), ("g-api", "api"), ("g-ui", "ui")], "id string, name string"),
        group_members=lambda: pick("group_id", (F.col("protocol") == "HTTP/2", "g-api"), (F.col("protocol") == "HTTP/3", "g-ui")),
        marks=lambda: f().filter((ts % 13 == 0) | (ts % 17 == 0)).select(F.col("id").alias("record_id"), F.when(ts % 13 == 0, "red").otherwise("green").alias("color")),
        comments=comments,
        blobs=lambda: load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sha256"), F.col("text").cast("binary").alias("bytes")),
        messages=lambda: messages(spark, sf_dir),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("m-"), F.col("event_id")).alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("flow_id"), F.col("event_id").alias("frame_number"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_micros"),
        F.col("event_type").isin("view", "click").alias("from_client"), F.when(F.col("event_type") == "error", "ping").otherwise("text").alias("opcode"), F.col("props").alias("payload"),
    )


def undecoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per connection of the flows without a decrypted exchange."""
    f = flows(spark, sf_dir).filter(~F.coalesce("tls_decrypted", F.lit(False)) & (F.coalesce("connection_id", F.lit("")) != ""))
    reasons = F.array(*[F.lit(r) for r in ("no_key", "handshake_incomplete", "unsupported", "unparsed", "udp")])
    g = f.groupBy("connection_id").agg(F.min("ts_micros").alias("first_ts"), F.max("ts_micros").alias("last_ts"), F.sum("request_bytes").alias("bytes_up"), F.count("*").alias("bytes_down"), F.min("dst_addr").alias("server"), F.min("authority").alias("sni"))
    return g.withColumn("reason", F.element_at(reasons, (F.col("first_ts") % 5 + 1).cast("int"))).withColumn("sni", F.when(F.col("first_ts") % 4 == 0, "").otherwise(F.col("sni")))


SQL_FLOWS = f"""cur AS (
  SELECT {", ".join(FLOW_COLUMNS)}, CAST(ts_micros % 40000 AS VARCHAR) AS resp_body_ref
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pushed_at DESC, content_type DESC NULLS LAST) AS rn FROM flows WHERE id <> '') WHERE rn = 1),
u AS (SELECT *, CASE WHEN coalesce(scheme, '') = '' THEN 'https' ELSE scheme END || '://' || coalesce(authority, '') || coalesce(path, '') || CASE WHEN coalesce(query, '') = '' THEN '' ELSE '?' || query END AS url FROM cur)"""
SQL_SIDE = """meta AS (
  SELECT id AS record_id, 'proxy_provider' AS key, CASE WHEN ts_micros % 2 = 0 THEN 'acme' ELSE 'zeta' END AS value FROM cur WHERE ts_micros % 3 = 0
  UNION ALL SELECT id, 'conn.outcome', CASE WHEN ts_micros % 37 = 0 THEN 'tls_rejected' ELSE 'tcp_passthrough' END FROM cur WHERE ts_micros % 37 = 0 OR ts_micros % 41 = 0),
marks AS (SELECT id AS record_id, CASE WHEN ts_micros % 13 = 0 THEN 'red' ELSE 'green' END AS color FROM cur WHERE ts_micros % 13 = 0 OR ts_micros % 17 = 0),
hd AS (SELECT DISTINCT flow_id, response, ord, coalesce(name, '') AS name, coalesce(value, '') AS value FROM flow_headers WHERE flow_id <> ''),
ht AS (SELECT flow_id, response, string_agg(name || ': ' || value || chr(10), '' ORDER BY ord, name, value) AS txt FROM hd GROUP BY flow_id, response)"""
SQL_MESSAGES = """msg AS (SELECT 'm-' || event_id AS id, 'u' || user_id AS flow_id, event_id AS frame_number, epoch_us(ts) AS ts_micros, event_type IN ('view', 'click') AS from_client,
  CASE WHEN event_type = 'error' THEN 'ping' ELSE 'text' END AS opcode, props AS payload FROM events)"""
SQL_UNDECODED = """und0 AS (SELECT connection_id, min(ts_micros) AS first_ts, max(ts_micros) AS last_ts, CAST(sum(request_bytes) AS BIGINT) AS bytes_up, count(*) AS bytes_down, min(dst_addr) AS server, min(authority) AS sni0
  FROM cur WHERE NOT coalesce(tls_decrypted, false) AND connection_id <> '' GROUP BY connection_id),
und AS (SELECT * EXCLUDE sni0, CASE first_ts % 5 WHEN 0 THEN 'no_key' WHEN 1 THEN 'handshake_incomplete' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unparsed' ELSE 'udp' END AS reason, CASE WHEN first_ts % 4 = 0 THEN '' ELSE sni0 END AS sni FROM und0)"""
