"""Queries of joins, aggregates, search and presentation."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import load
from flowloom.functions import flows as fx
from flowloom.operators import flow_joins as j
from flowloom.plans import paging, search, side
from flowloom.queries import adapter as a

SQL: dict[str, str] = {}
_W = f"WITH {a.SQL_FLOWS}"
_WS = f"WITH {a.SQL_FLOWS}, {a.SQL_SIDE}"


def F1_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    rows = side.attach(f.select("id"), a.tables(spark, sf_dir, f), {"tags", "groups", "marks", "comments"})
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tag_text", "group_text", "mark_color", "comment_text")], F.coalesce("favorite", F.lit(False)).alias("favorite"))


SQL["F1_annotations"] = f"""{_W} SELECT id, trim(CASE WHEN ts_micros % 97 = 0 THEN 'Favorite ' ELSE '' END || CASE WHEN ts_micros % 11 = 0 THEN 'auth ' ELSE '' END || CASE WHEN coalesce(duration_micros > 300000, false) THEN 'slow' ELSE '' END) AS tag_text,
CASE protocol WHEN 'HTTP/2' THEN 'api' WHEN 'HTTP/3' THEN 'ui' ELSE '' END AS group_text, CASE WHEN ts_micros % 13 = 0 THEN 'red' WHEN ts_micros % 17 = 0 THEN 'green' ELSE '' END AS mark_color,
CASE WHEN ts_micros % 101 = 0 THEN 'first look second look' ELSE '' END AS comment_text, ts_micros % 97 = 0 AS favorite FROM u"""


def F2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    rows = side.attach(f.select("id"), a.tables(spark, sf_dir, f), {"metadata"})
    return rows.select("id", F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("")).alias("metadata"))


SQL["F2_metadata"] = f"{_WS} SELECT id, coalesce((SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM meta WHERE record_id = u.id), '') AS metadata FROM u"


def F3_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    parents = m.select(F.col("flow_id").alias("id")).distinct().unionByName(spark.createDataFrame([("none",)], "id string"))
    return side.attach(parents, side.SideTables(messages=m), {"messages"}).select("id", F.coalesce("message_count", F.lit(0)).alias("message_count"), F.coalesce("websocket", F.lit(False)).alias("websocket"))


SQL["F3_message_counts"] = f"WITH {a.SQL_MESSAGES} SELECT flow_id AS id, count(*) AS message_count, true AS websocket FROM msg GROUP BY ALL UNION ALL SELECT 'none', 0, false"
SQL["G2_messages_per_flow"] = f"WITH {a.SQL_MESSAGES} SELECT flow_id AS record_id, count(*) AS message_count FROM msg GROUP BY ALL"


def G2_messages_per_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side.message_counts(a.messages(spark, sf_dir)).select("record_id", "message_count")


def F4_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = side.header_lists(load(spark, sf_dir, "flow_headers"))
    return h.select("flow_id", side.header_text(F.col("request_headers")).alias("request_text"), side.header_text(F.col("response_headers")).alias("response_text"))


SQL["F4_headers"] = f"{_WS} SELECT flow_id, coalesce(max(CASE WHEN response = 0 THEN txt END), '') AS request_text, coalesce(max(CASE WHEN response = 1 THEN txt END), '') AS response_text FROM ht GROUP BY flow_id"


def F5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return side.attach(f.select("id", "resp_body_ref"), a.tables(spark, sf_dir, f), {"response_body"}).select("id", F.coalesce(F.length("response_body_text"), F.lit(-1)).alias("n_chars"))


SQL["F5_bodies"] = f"{_W} SELECT u.id, coalesce(CAST(length(d.text) AS INTEGER), -1) AS n_chars FROM u LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = u.resp_body_ref"


def F6_messages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    t = side.SideTables(marks=m.filter("frame_number % 7 = 0").select(F.col("id").alias("record_id"), F.lit("red").alias("color")), metadata=m.filter("frame_number % 3 = 0").select(F.col("id").alias("record_id"), F.lit("seq").alias("key"), F.col("frame_number").cast("string").alias("value")))
    return side.attach(m.select("id"), t, {"marks", "metadata"}).select("id", F.coalesce("mark_color", F.lit("")).alias("mark"), F.coalesce(F.try_element_at("metadata", F.lit("seq")), F.lit("")).alias("seq"))


SQL["F6_messages_joined"] = f"WITH {a.SQL_MESSAGES} SELECT id, CASE WHEN frame_number % 7 = 0 THEN 'red' ELSE '' END AS mark, CASE WHEN frame_number % 3 = 0 THEN CAST(frame_number AS VARCHAR) ELSE '' END AS seq FROM msg"


def F7_session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = side.metadata_map(load(spark, sf_dir, "session_metadata"), "session_id", "merged_at")
    s = load(spark, sf_dir, "sessions").select("id").distinct()
    return s.join(m, s["id"] == m["record_id"], "left").select("id", F.coalesce(F.size(F.map_keys("metadata")), F.lit(0)).alias("n_keys"), F.coalesce(F.try_element_at("metadata", F.lit("capture.iface")), F.lit("")).alias("iface"))


SQL["F7_session_metadata"] = """WITH m AS (SELECT session_id, key, arg_max(value, (merged_at, value)) AS value FROM session_metadata WHERE key <> '' GROUP BY ALL)
SELECT s.id, CAST(count(m.key) AS INTEGER) AS n_keys, coalesce(max(CASE WHEN m.key = 'capture.iface' THEN m.value END), '') AS iface FROM (SELECT DISTINCT id FROM sessions) s LEFT JOIN m ON m.session_id = s.id GROUP BY s.id"""


def F8_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return j.redirect_sources(f).filter("redirected_from_id IS NOT NULL")


SQL["F8_redirects"] = f"""{_W}, src AS (SELECT redirect_location AS loc, arg_min(id, (ts_micros, coalesce(frame_number, 0), id)) AS src FROM u WHERE redirect_location <> '' GROUP BY ALL)
SELECT u.id, src AS redirected_from_id FROM u JOIN src ON loc = url WHERE src <> u.id"""


def F9_delete_by_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    pair = j.endpoint_pair(F.col("src_addr"), F.col("dst_addr"), F.col("proxy_addr"))
    gone = f.filter("protocol = 'TCP'").select(pair.alias("pair"))
    return j.delete_by_connection(f, gone).select("id")


_PAIR = "array_to_string(list_sort([coalesce(src_addr, ''), CASE WHEN coalesce(proxy_addr, '') <> '' THEN proxy_addr ELSE coalesce(dst_addr, '') END]), '|')"
SQL["F9_delete_by_connection"] = f"{_W}, p AS (SELECT id, protocol, {_PAIR} AS pair FROM u) SELECT id FROM p WHERE pair NOT IN (SELECT pair FROM p WHERE protocol = 'TCP')"


def F10_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).withColumn("pair", j.endpoint_pair(F.col("src_addr"), F.col("dst_addr"), F.col("proxy_addr")))
    return j.foreign_connections(f.filter("ts_micros % 2 = 0"), f.filter("ts_micros % 2 = 1"))


SQL["F10_foreign"] = f"{_W}, p AS (SELECT ts_micros, {_PAIR} AS pair FROM u) SELECT DISTINCT pair FROM p WHERE ts_micros % 2 = 0 AND pair NOT IN (SELECT pair FROM p WHERE ts_micros % 2 = 1)"


def F11_live_minus_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).select("id", "ts_micros")
    return j.not_stored(f, f.filter("ts_micros % 3 = 0")).select("id")


SQL["F11_live_minus_stored"] = f"{_W} SELECT id FROM u WHERE ts_micros % 3 <> 0"


def F12_asof_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that lookups gave the peer's address before a connection opened; a lookup's answer is the address it was sent to."""
    f = a.flows(spark, sf_dir).withColumn("address", fx.address_host(F.col("dst_addr")))
    answers = f.filter("protocol = 'DNS' AND authority <> ''").select("address", "ts_micros", F.col("authority").alias("name"))
    named = j.names_of_addresses(f.select("id", "address", "ts_micros"), answers)
    return named.select("id", F.coalesce("name", F.lit("")).alias("name"), F.array_join("candidates", ",").alias("candidates"))


SQL["F12_asof_names"] = rf"""{_W}, f AS (SELECT id, ts_micros, protocol, authority, regexp_replace(regexp_replace(coalesce(dst_addr, ''), ':(\d+)$', ''), '^\[|\]$', '', 'g') AS address FROM u),
k AS (SELECT DISTINCT address, ts_micros, authority AS name FROM f WHERE protocol = 'DNS' AND authority <> ''),
h AS (SELECT *, list(name) OVER (PARTITION BY address ORDER BY ts_micros, name ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS names FROM k),
n AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY address, ts_micros ORDER BY name DESC) = 1)
SELECT f.id, coalesce(n.name, '') AS name, coalesce(array_to_string(list_sort(list_distinct(list_filter(n.names, lambda x: x <> n.name))), ','), '') AS candidates FROM f ASOF LEFT JOIN n ON f.address = n.address AND f.ts_micros >= n.ts_micros"""


def F13_fifo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir).select("id", "flow_id", "ts_micros", "frame_number", "from_client")
    p = j.pair_in_order(m.filter("from_client"), m.filter("NOT from_client"), ["flow_id"], ["ts_micros", "frame_number"], "ts_micros", 86_400_000_000)
    return p.select("flow_id", "position", "id", F.coalesce("response_id", F.lit("")).alias("response_id"))


SQL["F13_fifo_pairs"] = f"""WITH {a.SQL_MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY flow_id, from_client ORDER BY ts_micros, frame_number) AS position FROM msg)
SELECT a.flow_id, a.position, a.id, coalesce(b.id, '') AS response_id FROM n a LEFT JOIN n b ON a.flow_id = b.flow_id AND a.position = b.position AND NOT b.from_client WHERE a.from_client"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the fingerprints of the data give rise to."""
    f = load(spark, sf_dir, "flows")
    ja4 = f.filter("ja4 <> ''").groupBy(F.trim("ja4").alias("ja4")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ja4").limit(8)
    exact = ja4.select(F.concat(F.lit("exact "), "ja4").alias("label"), F.lit(1).alias("load_order"), "ja4", F.lit("").alias("ja4_pre"), F.lit("").alias("ja4_b"), F.lit("").alias("ja3"), F.lit("").alias("sni"))
    fixed = spark.createDataFrame([("quic", 2, "", "q13d", "", "", ""), ("tls13 pair", 3, "", "t13d13", "", "", ""), ("market", 4, "", "t13d", "", "", "API.quillmarket.example"), ("by name", 5, "", "", "", "", "api.bepezi.example")], "label string, load_order int, ja4 string, ja4_pre string, ja4_b string, ja3 string, sni string")
    return exact.unionByName(fixed)


def F14_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.classify(a.flows(spark, sf_dir), _rules(spark, sf_dir))


def I19_fingerprint_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.rule_scores(_rules(spark, sf_dir))


SQL["F14_classify"] = rf"""{_W}, top AS (SELECT trim(ja4) AS ja4, count(*) AS n FROM flows WHERE ja4 <> '' GROUP BY trim(ja4) ORDER BY n DESC, ja4 LIMIT 8),
r AS (SELECT 'exact ' || ja4 AS label, 1 AS o, ja4, '' AS pre, '' AS sni FROM top UNION ALL SELECT * FROM (VALUES ('quic', 2, '', 'q13d', ''), ('tls13 pair', 3, '', 't13d13', ''), ('market', 4, '', 't13d', 'api.quillmarket.example'), ('by name', 5, '', '', 'api.bepezi.example')) AS t(label, o, ja4, pre, sni)),
m AS (SELECT u.id, label, o, sni <> '' AS named, CASE WHEN r.ja4 <> '' THEN 1100 ELSE 0 END + CASE WHEN pre <> '' THEN 1070 ELSE 0 END AS score FROM u JOIN r ON (r.ja4 <> '' OR pre <> '') AND (coalesce(u.ja4, '') <> '' OR coalesce(u.ja3, '') <> '') AND (r.ja4 = '' OR r.ja4 = coalesce(u.ja4, '')) AND (pre = '' OR starts_with(coalesce(u.ja4, ''), pre)) AND (sni = '' OR sni = lower(regexp_replace(coalesce(u.authority, ''), ':\d+$', ''))))
SELECT id, arg_max(label, (score, named, o)) AS label FROM m GROUP BY id"""
SQL["I19_fingerprint_score"] = """WITH top AS (SELECT trim(ja4) AS ja4, count(*) AS n FROM flows WHERE ja4 <> '' GROUP BY trim(ja4) ORDER BY n DESC, ja4 LIMIT 8)
SELECT 'exact ' || ja4 AS label, 1 AS load_order, 1100 AS score FROM top UNION ALL SELECT * FROM (VALUES ('quic', 2, 1070), ('tls13 pair', 3, 1070), ('market', 4, 1070)) AS t(label, load_order, score)"""


def F15_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return j.verify_counts(f, f.filter("ts_micros % 5 <> 0"), ["method", "authority", "path"])


def G8_natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.natural_key_counts(a.flows(spark, sf_dir))


SQL["F15_verify"] = f"{_W} SELECT method, authority, path, count(*) AS n_left, count(*) FILTER (WHERE ts_micros % 5 <> 0) AS n_right FROM u GROUP BY ALL HAVING n_left <> n_right"
SQL["G8_natural_keys"] = f"{_W} SELECT coalesce(method, '') AS method, coalesce(authority, '') AS authority, coalesce(path, '') AS path, count(*) AS n FROM u GROUP BY ALL"


def F16_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).withColumns({"tls_client_hello": F.lit(""), "tls_hrr": F.lit(False)})
    ids = [r.id for r in f.orderBy(*paging.timeline()).select("id").limit(2).collect()]
    return j.compare_flows(f, ids[0], ids[1])


_CMP = " UNION ALL ".join(f"SELECT '{c}' AS parameter, (SELECT coalesce(CAST({e} AS VARCHAR), '') FROM t WHERE n = 1) AS a, (SELECT coalesce(CAST({e} AS VARCHAR), '') FROM t WHERE n = 2) AS b" for c, e in [(c, {"tls_client_hello": "''", "tls_hrr": "false"}.get(c, c)) for c in j.COMPARED])
SQL["F16_compare"] = f"{_W}, t AS (SELECT *, row_number() OVER (ORDER BY ts_micros, coalesce(frame_number, 0), id) AS n FROM u) SELECT *, a = b AS equal FROM ({_CMP})"
def M1_compare_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two flows of the timeline that have headers, in full; ``identical`` is the report's verdict."""
    f, h = a.flows(spark, sf_dir), load(spark, sf_dir, "flow_headers")
    f = f.withColumn("tls_client_hello", F.lit(""))
    ids = [r.id for r in f.join(h.select(F.col("flow_id").alias("id")).distinct(), "id", "left_semi").orderBy(*paging.timeline()).select("id").limit(2).collect()]
    report = j.compare_report(f, h, *ids)
    summary = j.compare_summary(report)
    return report.crossJoin(F.broadcast(summary)).select("position", "parameter", "a", "b", "equal", F.array_join("differences", ",").alias("differences"), "identical")  # one row of summary


_M1 = {"url": "url", "status": "CASE WHEN coalesce(status, 0) <> 0 THEN CAST(status AS VARCHAR) END", "tls_client_hello": "''", "request_header_order": "ro", "response_header_order": "so"}
_M1_ROWS = " UNION ALL ".join(f"SELECT {n} AS position, '{c}' AS parameter, (SELECT coalesce({_M1.get(c, c)}, '') FROM t WHERE n = 1) AS a, (SELECT coalesce({_M1.get(c, c)}, '') FROM t WHERE n = 2) AS b" for n, c in enumerate([*j.PARAMETERS, "request_header_order", "response_header_order"]))
SQL["M1_compare_flows"] = f"""{_WS}, o AS (SELECT flow_id, string_agg(CASE WHEN response = 0 THEN lower(name) END, ',' ORDER BY ord, name, value) AS ro, string_agg(CASE WHEN response = 1 THEN lower(name) END, ',' ORDER BY ord, name, value) AS so FROM hd GROUP BY flow_id),
t AS (SELECT u.*, o.ro, o.so, row_number() OVER (ORDER BY ts_micros, coalesce(frame_number, 0), id) AS n FROM u JOIN o ON o.flow_id = u.id), r AS ({_M1_ROWS})
SELECT position, parameter, a, b, a = b AS equal, (SELECT coalesce(string_agg(parameter, ',' ORDER BY position), '') FROM r WHERE a <> b) AS differences, (SELECT bool_and(a = b) FROM r) AS identical FROM r"""


def G1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    h = paging.hidden_flows(f, a.tables(spark, sf_dir, f)).select("id", F.lit(1).alias("h"))
    return f.select("id").join(h, "id", "left").agg(F.count("*").alias("flows"), F.count("h").alias("hidden"))


SQL["G1_counts"] = f"{_W} SELECT count(*) AS flows, count(*) FILTER (WHERE coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0) AS hidden FROM u"


def G3_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.reason_counts(a.undecoded(spark, sf_dir).filter("reason <> 'udp'"))


_U = f"WITH {a.SQL_FLOWS}, {a.SQL_UNDECODED}"
SQL["G3_reason_counts"] = f"{_U} SELECT r.reason, count(und.reason) AS n FROM (VALUES ('no_key'), ('handshake_incomplete'), ('unsupported'), ('unparsed'), ('udp')) AS r(reason) LEFT JOIN und ON und.reason = r.reason AND und.reason <> 'udp' GROUP BY r.reason"


def G4_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.undecoded_page(a.undecoded(spark, sf_dir))[1]


SQL["G4_by_reason"] = f"{_U} SELECT reason, count(*) AS n FROM und GROUP BY reason"


def G5_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conn.undecoded.* and undecoded.* counters of sessions under one prefix, numbers only, zeros left out."""
    return j.outcome_totals(load(spark, sf_dir, "session_metadata"))


SQL["G5_outcomes"] = r"SELECT regexp_extract(key, '^(?:conn\.)?undecoded\.(.+)$', 1) AS outcome, count(*) AS n, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total FROM session_metadata WHERE regexp_matches(key, '^(conn\.)?undecoded\..+$') AND regexp_matches(value, '^[0-9]*[1-9][0-9]*$') GROUP BY ALL"


def G6_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    return j.connection_tally(m.select(F.col("flow_id").alias("connection_id"), "from_client", F.length("payload").alias("size"), "ts_micros"))


def A12_stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw stream for every user of the event table, its events the bytes that went by."""
    m = a.messages(spark, sf_dir)
    base = m.groupBy(F.col("flow_id").alias("id")).agg(F.min("ts_micros").alias("ts_micros")).withColumn("n", F.substring("id", 2, 20).cast("long"))
    streams = base.select("id", "ts_micros", F.when(F.col("n") % 3 == 0, "udp").otherwise("tcp").alias("transport"), F.lit("10.0.0.2:5000").alias("src_addr"), F.concat(F.lit("192.0.2.1:"), F.col("n").cast("string")).alias("dst_addr"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("h"), F.col("n").cast("string"), F.lit(".example"))).alias("sni"), (F.col("n") % 5 == 0).alias("tls_established"))
    flows = j.stream_flows(streams, m)
    meta = lambda k: F.col("metadata")[k]
    return flows.select("id", "protocol", "authority", "tls_decrypted", "request_bytes", meta("conn.outcome").alias("outcome"), meta("conn.bytes_up").alias("bytes_up"), meta("conn.bytes_down").alias("bytes_down"))


SQL["G6_tally"] = f"WITH {a.SQL_MESSAGES} SELECT flow_id AS connection_id, CAST(coalesce(sum(length(payload)) FILTER (WHERE from_client), 0) AS BIGINT) AS bytes_up, CAST(coalesce(sum(length(payload)) FILTER (WHERE NOT from_client), 0) AS BIGINT) AS bytes_down, min(ts_micros) AS first_ts, max(ts_micros) AS last_ts FROM msg GROUP BY flow_id"
SQL["A12_stream_records"] = f"""WITH {a.SQL_MESSAGES}, s AS (SELECT flow_id AS id, CAST(substr(flow_id, 2) AS BIGINT) AS n, CAST(coalesce(sum(length(payload)) FILTER (WHERE from_client), 0) AS BIGINT) AS up, CAST(coalesce(sum(length(payload)) FILTER (WHERE NOT from_client), 0) AS BIGINT) AS down FROM msg GROUP BY flow_id)
SELECT id, CASE WHEN n % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, CASE WHEN n % 2 = 0 THEN 'h' || n || '.example' ELSE '192.0.2.1:' || n END AS authority, n % 5 = 0 AS tls_decrypted, up AS request_bytes, CASE WHEN n % 3 = 0 THEN 'udp_undecoded' ELSE 'tcp_passthrough' END AS outcome, CAST(up AS VARCHAR) AS bytes_up, CAST(down AS VARCHAR) AS bytes_down FROM s"""


def G7_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.host_rollup(a.undecoded(spark, sf_dir))


def E11_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return search.session_overview(f, a.undecoded(spark, sf_dir), a.tables(spark, sf_dir, f))


SQL["G7_hosts"] = f"{_U} SELECT coalesce(nullif(sni, ''), server) AS host, count(*) AS connections, CAST(sum(bytes_up + bytes_down) AS BIGINT) AS bytes, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM und GROUP BY 1 ORDER BY bytes DESC, host LIMIT 15"
SQL["E11_overview"] = f"""{_U}, big AS (SELECT * FROM und ORDER BY bytes_up + bytes_down DESC, first_ts, connection_id LIMIT 2000)
SELECT 'flows' AS section, 'shown and hidden' AS name, count(*) AS n, NULL AS bytes, '' AS reasons FROM cur UNION ALL SELECT 'flows', 'hidden', count(*) FILTER (WHERE coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0), NULL, '' FROM cur
UNION ALL SELECT 'undecoded', reason, count(*), NULL, '' FROM und GROUP BY reason
UNION ALL (SELECT 'hosts', coalesce(nullif(sni, ''), server), count(*), CAST(sum(bytes_up + bytes_down) AS BIGINT), string_agg(DISTINCT reason, ',' ORDER BY reason) FROM big GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 15)"""


def G9_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return j.scan_counters(f, fx.has_response(F.col("status")), F.col("protocol") == "DNS")


SQL["G9_counters"] = f"{_W} SELECT count(*) AS scanned, count(*) FILTER (WHERE coalesce(status, 0) <> 0) AS matched, count(*) FILTER (WHERE coalesce(status, 0) <> 0 AND protocol = 'DNS') AS hidden_matched FROM u"


def G10_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.content_addressed(load(spark, sf_dir, "documents").select(F.col("text").alias("bytes")))


SQL["G10_blobs"] = "SELECT sha256(text) AS sha256, CAST(max(octet_length(encode(text))) AS INTEGER) AS size, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"


def _grepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("bytes"))
    return search.grep_bodies(b, r"memory|kernel", max_hits=1)


def E1_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grepped(spark, sf_dir).select("id", "size", "count", F.coalesce(F.get("hits", F.lit(0))["byte_offset"], F.lit(-1)).alias("first_offset"))


SQL["E1_grep"] = "SELECT doc_id AS id, coalesce(octet_length(encode(text)), 0) AS size, coalesce(len(regexp_extract_all(text, 'memory|kernel', 0, 'i')), 0) AS count, CASE WHEN regexp_matches(coalesce(text, ''), 'memory|kernel', 'i') THEN octet_length(encode(regexp_extract(text, '^((?s).*?)(?:memory|kernel)', 1, 'i'))) ELSE -1 END AS first_offset FROM documents"


def E1_grep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep_summary(_grepped(spark, sf_dir))


SQL["E1_grep_summary"] = "SELECT count(*) AS count, count(*) FILTER (WHERE m) AS with_hits, count(*) FILTER (WHERE NOT m) AS without_hits FROM (SELECT regexp_matches(coalesce(text, ''), 'memory|kernel', 'i') AS m FROM documents)"


def E1_grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep_counts(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("bytes")), r"v\d+\.\d+")


SQL["E1_grep_counts"] = r"SELECT doc_id AS id, len(regexp_extract_all(text, 'v\d+\.\d+', 0, 'i')) AS count FROM documents WHERE regexp_matches(text, 'v\d+\.\d+', 'i')"


def E2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return search.search(f, a.tables(spark, sf_dir, f), method="get", host="API.", status="2xx,404", header="accept", path="/").select("id")


SQL["E2_search"] = f"{_WS} SELECT id FROM u WHERE upper(method) = 'GET' AND contains(lower(authority), 'api.') AND (status BETWEEN 200 AND 299 OR status = 404) AND contains(path, '/') AND EXISTS (SELECT 1 FROM ht WHERE flow_id = u.id AND contains(lower(txt), 'accept'))"


def E3_status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows")
    return f.filter(search.in_status("401,403,500-503,30x", F.col("status"))).groupBy("status").agg(F.count("*").alias("n"))


SQL["E3_status_sets"] = "SELECT status, count(*) AS n FROM flows WHERE status IN (401, 403) OR status BETWEEN 500 AND 503 OR status BETWEEN 300 AND 309 GROUP BY status"


def E4_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = datetime(2026, 2, 3, 12, 30, tzinfo=UTC)
    specs = ["2026-02-01T00:00:00", "2026-02-01T00:00:00+02:00", "10:15", "-15m", "1770000000", "1770000000000", "1770000000000000"]
    return spark.createDataFrame([(s, search.time_micros(s, now)) for s in specs], "spec string, micros long")


SQL["E4_times"] = "SELECT * FROM (VALUES ('2026-02-01T00:00:00', 1769904000000000), ('2026-02-01T00:00:00+02:00', 1769896800000000), ('10:15', 1770113700000000), ('-15m', 1770120900000000), ('1770000000', 1770000000000000), ('1770000000000', 1770000000000000), ('1770000000000000', 1770000000000000)) AS t(spec, micros)"


def E5_cross_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_sessions(a.flows(spark, sf_dir), load(spark, sf_dir, "sessions"), host="quill")[1]


SQL["E5_cross_session"] = f"{_W} SELECT session_id, count(*) AS total FROM u WHERE contains(lower(authority), 'quill') GROUP BY ALL"


def E5_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows shown: newest session first, at most three of each."""
    rows = search.search_sessions(a.flows(spark, sf_dir), load(spark, sf_dir, "sessions"), limit=40, per_session=3, host="quill")[0]
    return rows.select("session_id", "id")


SQL["E5_session_rows"] = f"""{_W}, s AS (SELECT DISTINCT id, created_at FROM sessions), f AS (SELECT u.session_id, u.id, s.created_at, ts_micros, coalesce(frame_number, 0) AS fn, row_number() OVER (PARTITION BY session_id ORDER BY ts_micros, coalesce(frame_number, 0), u.id) AS n FROM u JOIN s ON s.id = u.session_id WHERE contains(lower(authority), 'quill'))
SELECT session_id, id FROM f WHERE n <= 3 ORDER BY created_at DESC, session_id, ts_micros, fn, id LIMIT 40"""


def E6_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "flows").filter("user_agent <> ''").select(fx.snippet(F.col("user_agent"), "MOBILE", 8).alias("snippet")).filter("snippet IS NOT NULL").distinct()


SQL["E6_snippets"] = r"""WITH x AS (SELECT user_agent AS h, instr(lower(user_agent), 'mobile') AS p FROM flows WHERE user_agent <> ''), y AS (SELECT h, p, greatest(p - 8, 1) AS s FROM x WHERE p > 0)
SELECT DISTINCT CASE WHEN s > 1 THEN '…' ELSE '' END || trim(regexp_replace(substring(h, s, p - s + 14), '\s+', ' ', 'g')) || CASE WHEN s + p - s + 14 <= length(h) THEN '…' ELSE '' END AS snippet FROM y"""


def E7_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    page = paging.query_flows(f, "~u edge", a.tables(spark, sf_dir, f), limit=50).rows
    return page.select("id", fx.snippet(fx.url(), "edge", 10).alias("url_snippet"))


SQL["E7_previews"] = f"""{_W}, p AS (SELECT *, lower(url) AS l FROM (SELECT * FROM u ORDER BY ts_micros, coalesce(frame_number, 0), id LIMIT 20000) WHERE regexp_matches(url, 'edge', 'i') AND NOT (coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0) ORDER BY ts_micros, coalesce(frame_number, 0), id LIMIT 50),
y AS (SELECT id, url, instr(l, 'edge') AS p, greatest(instr(l, 'edge') - 10, 1) AS s FROM p)
SELECT id, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(substring(url, s, p - s + 14)) || CASE WHEN p + 14 <= length(url) THEN '…' ELSE '' END AS url_snippet FROM y"""


def E7_match_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the criteria of a search matched: path, answer header and answer body."""
    f = a.flows(spark, sf_dir)
    t = a.tables(spark, sf_dir, f)
    page = paging.query_flows(f, "~bs memory ~hs server", t, limit=80).rows
    m = search.match_previews(page, t, path="a", response_header="server", response_body="Memory")
    none = lambda c: F.coalesce(c, F.lit(""))
    return m.select("id", none(F.col("path_match")).alias("path_match"), F.length("response_header_match").alias("n_header"), F.contains(F.lower("response_body_match"), F.lit("memory")).alias("in_body"), "response_body_byte_offset")


SQL["E7_match_previews"] = rf"""{_WS}, s AS (SELECT * FROM u ORDER BY ts_micros, coalesce(frame_number, 0), id LIMIT 20000),
p AS (SELECT s.*, d.text, ht.txt FROM s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.resp_body_ref JOIN ht ON ht.flow_id = s.id AND ht.response = 1 WHERE regexp_matches(d.text, 'memory', 'i') AND regexp_matches(ht.txt, 'server', 'i') AND NOT (coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0) ORDER BY ts_micros, coalesce(frame_number, 0), s.id LIMIT 80),
y AS (SELECT id, coalesce(path, '') AS h, instr(lower(coalesce(path, '')), 'a') AS p, greatest(instr(lower(coalesce(path, '')), 'a') - 60, 1) AS s, txt, text, instr(lower(txt), 'server') AS q, greatest(instr(lower(txt), 'server') - 60, 1) AS r FROM p)
SELECT id, CASE WHEN p > 0 THEN CASE WHEN s > 1 THEN '…' ELSE '' END || trim(regexp_replace(substring(h, s, p - s + 61), '\s+', ' ', 'g')) || CASE WHEN s + p - s + 61 <= length(h) THEN '…' ELSE '' END ELSE '' END AS path_match,
CAST(length(CASE WHEN r > 1 THEN '…' ELSE '' END || trim(regexp_replace(substring(txt, r, q - r + 66), '\s+', ' ', 'g')) || CASE WHEN r + q - r + 66 <= length(txt) THEN '…' ELSE '' END) AS INTEGER) AS n_header,
true AS in_body, octet_length(encode(substring(text, 1, instr(lower(text), 'memory') - 1))) AS response_body_byte_offset FROM y"""


def E8_unsearchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows").withColumn("resp_content_encoding", F.when(F.col("ts_micros") % 9 == 0, "lzma").otherwise(F.col("resp_content_encoding")))
    return search.unsearchable_bodies(f)


SQL["E8_unsearchable"] = "WITH e AS (SELECT lower(trim(coalesce(req_content_encoding, ''))) AS encoding FROM flows UNION ALL SELECT CASE WHEN ts_micros % 9 = 0 THEN 'lzma' ELSE lower(trim(coalesce(resp_content_encoding, ''))) END FROM flows) SELECT encoding, count(*) AS n FROM e WHERE encoding NOT IN ('', 'identity', 'gzip', 'x-gzip', 'br', 'deflate', 'zstd') GROUP BY ALL ORDER BY n DESC, encoding LIMIT 20"


def E9_file_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bodies_in_files(load(spark, sf_dir, "documents").select(F.col("text").alias("bytes")))


SQL["E9_file_bodies"] = "SELECT count(*) FILTER (WHERE text IS NULL) AS bodies_in_files FROM documents"


def E10_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return search.page_timeline(paging.query_flows(f, "~m put", a.tables(spark, sf_dir, f), limit=60).rows).select("seq", "id", "t_ms", "target", "kind")


SQL["E10_timeline"] = rf"""{_W}, p AS (SELECT *, coalesce(path, '') || CASE WHEN coalesce(query, '') = '' THEN '' ELSE '?' || query END AS t FROM (SELECT * FROM u ORDER BY ts_micros, coalesce(frame_number, 0), id LIMIT 20000) WHERE regexp_matches(coalesce(method, ''), 'put', 'i') AND NOT (coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0) ORDER BY ts_micros, coalesce(frame_number, 0), id LIMIT 60)
SELECT CAST(row_number() OVER (ORDER BY ts_micros, coalesce(frame_number, 0), id) AS INTEGER) AS seq, id, round((ts_micros - min(CASE WHEN ts_micros > 0 THEN ts_micros END) OVER ()) / 1000, 1) AS t_ms, CASE WHEN length(t) > 120 THEN substring(t, 1, 120) || '…' ELSE t END AS target, lower(regexp_extract(coalesce(content_type, ''), '^[^/]*/([^;\s]+)', 1)) AS kind FROM p"""


def E12_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gateway_status(load(spark, sf_dir, "sessions"))


SQL["E12_status"] = "SELECT status, count(*) AS n, CAST(coalesce(sum(flow_count), 0) AS BIGINT) AS flow_count, CAST(coalesce(sum(pcap_bytes), 0) AS BIGINT) AS pcap_bytes, CAST(coalesce(sum(keylog_bytes), 0) AS BIGINT) AS keylog_bytes FROM sessions GROUP BY status"


def E13_byte_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = search.byte_window(F.col("raw"), 4, 12, "hex")
    return load(spark, sf_dir, "flow_client_hellos").select("flow_id", "ord", w.alias("w")).select("flow_id", "ord", "w.data", F.col("w.truncated").alias("truncated"))


SQL["E13_byte_window"] = "SELECT flow_id, ord, lower(substring(hex(raw), 9, 24)) AS data, octet_length(raw) > 16 AS truncated FROM flow_client_hellos"


def E14_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.length(search.body_preview(F.col("text").cast("binary"))).alias("n"))


SQL["E14_preview"] = "SELECT doc_id, CAST(least(length(text), 4096) AS INTEGER) AS n FROM documents"


def M3_http2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "flows").filter("http2_fingerprint <> ''").select("http2_fingerprint", fx.http2_fingerprint_text(F.col("http2_fingerprint")).alias("shown")).distinct()


SQL["M3_http2_text"] = r"""
WITH f AS (SELECT DISTINCT http2_fingerprint AS x FROM flows WHERE http2_fingerprint <> ''), p AS (SELECT x, string_split(x, '|') AS p FROM f)
SELECT x AS http2_fingerprint, CASE WHEN len(p) <> 4 THEN '' ELSE array_to_string(list_transform(list_filter(string_split(p[1], ';'), lambda y: y <> ''), lambda y: CASE split_part(y, ':', 1) WHEN '1' THEN 'HEADER_TABLE_SIZE' WHEN '2' THEN 'ENABLE_PUSH' WHEN '3' THEN 'MAX_CONCURRENT_STREAMS' WHEN '4' THEN 'INITIAL_WINDOW_SIZE' WHEN '5' THEN 'MAX_FRAME_SIZE' WHEN '6' THEN 'MAX_HEADER_LIST_SIZE' WHEN '8' THEN 'ENABLE_CONNECT_PROTOCOL' WHEN '9' THEN 'NO_RFC7540_PRIORITIES' ELSE 'SETTING_' || split_part(y, ':', 1) END || '=' || split_part(y, ':', 2)), ', ')
 || '; window +' || p[2] || '; priority ' || p[3] || '; ' || array_to_string(list_transform(list_filter(string_split(p[4], ','), lambda y: y <> ''), lambda y: CASE y WHEN 'm' THEN ':method' WHEN 'a' THEN ':authority' WHEN 's' THEN ':scheme' WHEN 'p' THEN ':path' ELSE y END), ' ') END AS shown FROM p"""


def M4_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.flows(spark, sf_dir).select("id", fx.format_duration(F.col("duration_micros")).alias("took"), fx.format_bytes(F.col("request_bytes")).alias("size"), fx.status_class(F.col("status")).alias("class"))


SQL["M4_formats"] = f"""{_W}, x AS (SELECT id, coalesce(duration_micros, 0) AS m, coalesce(request_bytes, 0) AS b, coalesce(status, 0) AS s FROM u)
SELECT id, CASE WHEN m <= 0 THEN '' WHEN m < 1000 THEN m || 'us' WHEN m < 1000000 THEN (m // 1000) || 'ms' WHEN m < 60000000 THEN (m // 1000000) || '.' || ((m // 100000) % 10) || 's' ELSE (m // 60000000) || 'm' || lpad(CAST((m // 1000000) % 60 AS VARCHAR), 2, '0') || 's' END AS took,
CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN ((b * 10 // 1024) // 10) || '.' || ((b * 10 // 1024) % 10) || ' KiB' WHEN b < 1073741824 THEN ((b * 10 // 1048576) // 10) || '.' || ((b * 10 // 1048576) % 10) || ' MiB' ELSE ((b * 10 // 1073741824) // 10) || '.' || ((b * 10 // 1073741824) % 10) || ' GiB' END AS size,
CASE WHEN s = 0 THEN 'pending' WHEN s BETWEEN 100 AND 599 THEN (s // 100) || 'xx' ELSE 'other' END AS class FROM x"""


def M5_capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.flows(spark, sf_dir).select("id", fx.capture_filter(F.col("src_addr"), F.col("dst_addr"), F.col("protocol")).alias("display_filter"))


_END = lambda c: rf"""CASE WHEN coalesce({c}, '') = '' THEN NULL ELSE CASE WHEN contains(regexp_replace(regexp_replace({c}, ':(\d+)$', ''), '^\[|\]$', '', 'g'), ':') THEN 'ipv6' ELSE 'ip' END || '.addr == ' || regexp_replace(regexp_replace({c}, ':(\d+)$', ''), '^\[|\]$', '', 'g') || CASE WHEN regexp_matches({c}, ':(\d+)$') THEN ' && ' || CASE WHEN protocol IN ('HTTP/3', 'DNS') THEN 'udp' ELSE 'tcp' END || '.port == ' || regexp_extract({c}, ':(\d+)$', 1) ELSE '' END END"""
SQL["M5_capture_filter"] = f"{_W} SELECT id, concat_ws(' && ', {_END('src_addr')}, {_END('dst_addr')}) AS display_filter FROM u"


def M6_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = side.header_lists(load(spark, sf_dir, "flow_headers"))
    f = a.flows(spark, sf_dir)
    return f.join(h, f["id"] == h["flow_id"]).select("id", fx.curl(F.col("method"), fx.url(), F.col("request_headers")).alias("command"), fx.raw_request(F.col("method"), F.col("path"), F.col("query"), F.col("authority"), F.col("request_headers")).alias("raw"))


_QUOTE = "chr(39) || replace({0}, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39)"
_HL = "hl AS (SELECT flow_id, list({name: name, value: value} ORDER BY ord, name, value) FILTER (WHERE response = 0) AS q, list({name: name, value: value} ORDER BY ord, name, value) FILTER (WHERE response = 1) AS r FROM hd GROUP BY flow_id)"
_LINES = "coalesce(array_to_string(list_transform(list_filter({0}, lambda h: NOT starts_with(h.name, ':')), lambda h: h.name || ': ' || h.value), chr(13) || chr(10)), '')"
_TAIL = "CASE WHEN len(list_filter(coalesce({0}, []), lambda h: NOT starts_with(h.name, ':'))) > 0 THEN chr(13) || chr(10) ELSE '' END || chr(13) || chr(10)"
SQL["M6_curl"] = f"""{_WS}, {_HL}
SELECT id, concat_ws(' ', 'curl', CASE WHEN coalesce(method, '') NOT IN ('', 'GET') THEN '-X ' || method END, {_QUOTE.format("url")}, nullif(array_to_string(list_transform(list_filter(coalesce(q, []), lambda h: NOT starts_with(h.name, ':') AND lower(h.name) <> 'content-length'), lambda h: '-H ' || {_QUOTE.format("h.name || ': ' || h.value")}), ' '), '')) AS command,
concat_ws(' ', method, CASE WHEN coalesce(path, '') = '' THEN '/' ELSE path END || CASE WHEN coalesce(query, '') = '' THEN '' ELSE '?' || query END, 'HTTP/1.1') || chr(13) || chr(10) || CASE WHEN coalesce(authority, '') = '' OR len(list_filter(coalesce(q, []), lambda h: lower(h.name) = 'host')) > 0 THEN '' ELSE 'host: ' || authority || chr(13) || chr(10) END || {_LINES.format("q")} || {_TAIL.format("q")} AS raw
FROM u JOIN hl ON flow_id = id"""


def A20_export_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved of an answer: its head as text, and the display filter of its connection."""
    h = side.header_lists(load(spark, sf_dir, "flow_headers"))
    f = a.flows(spark, sf_dir)
    return f.join(h, f["id"] == h["flow_id"]).filter("status <> 0").select("id", fx.raw_response(F.col("status"), F.col("response_headers")).alias("raw"), fx.capture_filter(F.col("src_addr"), F.col("dst_addr"), F.col("protocol")).alias("display_filter"))


SQL["A20_export_texts"] = f"""{_WS}, {_HL} SELECT id, 'HTTP/1.1 ' || status || chr(13) || chr(10) || {_LINES.format("r")} || {_TAIL.format("r")} AS raw, concat_ws(' && ', {_END('src_addr')}, {_END('dst_addr')}) AS display_filter FROM u JOIN hl ON flow_id = id WHERE status <> 0"""


def M7_display_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows").filter("contains(lower(authority), 'xn--')").select("authority").distinct()
    return f.select("authority", fx.display_host(F.col("authority")).alias("shown"))


def M2_header_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flow's request headers against those of the next flow with headers in its session, in timeline order."""
    from pyspark.sql import Window

    h = side.header_lists(load(spark, sf_dir, "flow_headers")).select("flow_id", "request_headers")
    f = a.flows(spark, sf_dir).select("id", "session_id", "ts_micros", "frame_number")
    rows = f.join(h, f["id"] == h["flow_id"]).withColumn("next_headers", F.lead("request_headers").over(Window.partitionBy("session_id").orderBy(*paging.timeline())))
    return rows.filter("next_headers IS NOT NULL").select("id", j.header_order_diff(F.col("request_headers"), F.col("next_headers")).alias("d")).select("id", "d.same_order", "d.same_pseudo", "d.same_cookies", F.array_join(F.array_sort("d.only_a"), ",").alias("only_a"), F.array_join(F.array_sort("d.only_b"), ",").alias("only_b"), F.array_join("d.changed", ",").alias("changed"))


SQL["M2_header_diff"] = f"""{_WS}, l AS (SELECT flow_id, list(lower(name) ORDER BY ord, name, value) AS n, list(CASE WHEN lower(name) = 'cookie' THEN value END ORDER BY ord, name, value) AS c FROM hd WHERE response = 0 GROUP BY flow_id),
x AS (SELECT flow_id, n, list_filter(list_transform(string_split(array_to_string(list_filter(c, lambda v: v IS NOT NULL), ';'), ';'), lambda v: trim(split_part(v, '=', 1))), lambda v: v <> '') AS c FROM l),
every AS (SELECT DISTINCT flow_id FROM hd),
o AS (SELECT u.id, lead(every.flow_id) OVER (PARTITION BY session_id ORDER BY ts_micros, coalesce(frame_number, 0), id) AS b FROM u JOIN every ON every.flow_id = u.id),
v AS (SELECT flow_id, lower(name) AS name, arg_max(value, (ord, name, value)) AS value FROM hd WHERE response = 0 GROUP BY ALL),
d AS (SELECT o.id, string_agg(v.name, ',' ORDER BY v.name) AS changed FROM o JOIN v ON v.flow_id = o.id JOIN v w ON w.flow_id = o.b AND w.name = v.name AND w.value <> v.value GROUP BY o.id),
p AS (SELECT o.id, coalesce(x.n, []) AS a, coalesce(y.n, []) AS b, coalesce(x.c, []) AS ca, coalesce(y.c, []) AS cb FROM o LEFT JOIN x ON x.flow_id = o.id LEFT JOIN x y ON y.flow_id = o.b WHERE o.b IS NOT NULL)
SELECT p.id, a = b AS same_order, list_filter(a, lambda q: starts_with(q, ':')) = list_filter(b, lambda q: starts_with(q, ':')) AS same_pseudo, ca = cb AS same_cookies, array_to_string(list_sort(list_distinct(list_filter(a, lambda q: NOT list_contains(b, q)))), ',') AS only_a, array_to_string(list_sort(list_distinct(list_filter(b, lambda q: NOT list_contains(a, q)))), ',') AS only_b, coalesce(changed, '') AS changed FROM p LEFT JOIN d ON d.id = p.id"""


def M8_pretty_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").cast("binary").alias("bytes"), F.lit("application/json").alias("content_type"))
    return search.pretty_bodies(e)


SQL["M8_pretty_bodies"] = """SELECT event_id AS id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty FROM events"""


def E15_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("200", 0, 0, 10, False), ("~d x", 0, 3, 10, True), ("~d x", 5, 0, 10, False), ("~d x", 0, 0, 10, False)]
    return spark.createDataFrame([(i, len(search.advice(*c))) for i, c in enumerate(cases)], "case_no int, n_advice int")


SQL["E15_advice"] = "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 0), (3, 1)) AS t(case_no, n_advice)"


def E16_strict_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refused(**given: object) -> bool:
        try:
            search.criteria(**given)
        except TypeError:
            return True
        return False

    return spark.createDataFrame([("host", refused(host="a")), ("hots", refused(hots="a")), ("method", refused(method="", status=None))], "argument string, refused boolean")


SQL["E16_strict_arguments"] = "SELECT * FROM (VALUES ('host', false), ('hots', true), ('method', false)) AS t(argument, refused)"

QUERIES = {k: v for k, v in globals().items() if k[:1] in "AEFGIM" and k[1:2].isdigit() and callable(v)}
