"""Queries of sources and decoders: bytes are made from the stored flows and decoded again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import cut, load, present, shared_folder, text
from flowloom.decode.content import request_cookies, response_cookie
from flowloom.decode.hello import hello_fingerprints
from flowloom.decode.protocols import FramedSession
from flowloom.functions import flows as fx
from flowloom.operators.flow_joins import names_of_addresses, positions
from flowloom.plans import mutate
from flowloom.queries import adapter as a
from flowloom.sources import capture, files

SQL: dict[str, str] = {}
_W = f"WITH {a.SQL_FLOWS}"
_H1 = "protocol = 'HTTP/1.1' AND status BETWEEN 200 AND 599 AND method <> '' AND authority <> '' AND path <> ''"


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the stored HTTP/1.1 exchanges: a connection per session and connection id, requests one after the other."""
    f = a.flows(spark, sf_dir).filter(_H1)
    crlf = F.lit("\r\n")
    target = F.concat("path", F.when(text(F.col("query")) == "", "").otherwise(F.concat(F.lit("?"), "query")))
    ask = F.concat(F.col("method"), F.lit(" "), target, F.lit(" HTTP/1.1"), crlf, F.lit("Host: "), "authority", crlf, F.lit("X-Id: "), "id", crlf, F.lit("Content-Length: 0"), crlf, crlf)
    answer = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" ok"), crlf, F.lit("Content-Type: "), text(F.col("content_type")), crlf, F.when((F.col("status") == 204) | (F.col("status") == 304) | (F.col("method") == "HEAD"), crlf).otherwise(F.concat(F.lit("Content-Length: 2"), crlf, crlf, F.lit("ok"))))
    one = f.select("session_id", F.concat_ws(":", "session_id", "connection_id", "id").alias("conn"), "ts_micros", F.greatest(text(F.col("duration_micros").cast("string")).cast("long"), F.lit(0)).alias("took"), ask.cast("binary").alias("q"), answer.cast("binary").alias("r"))
    client, server = F.concat(F.lit("c:"), "conn"), F.concat(F.lit("s:"), "conn")
    both = F.array(F.struct(F.lit(0).alias("n"), client.alias("src"), server.alias("dst"), F.col("q").alias("payload"), F.col("ts_micros").alias("at")), F.struct(F.lit(1).alias("n"), server.alias("src"), client.alias("dst"), F.col("r").alias("payload"), (F.col("ts_micros") + F.col("took")).alias("at")))
    s = one.select("session_id", "ts_micros", "conn", F.explode(both).alias("x")).select("session_id", "ts_micros", "conn", "x.*")
    numbered = positions(s, ["session_id"], ["ts_micros", "conn", "n"], "ts_micros", 3_600_000_000, "packet_no")
    return numbered.select("session_id", "packet_no", F.col("at").alias("ts_micros"), F.lit("tcp").alias("transport"), "src", "dst", F.lit(1).cast("long").alias("seq"), F.lit(24).alias("flags"), "payload", F.lit(None).cast("long").alias("owner_pid"))


def I12_http1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = capture.decode_capture(_wire(spark, sf_dir))
    named = F.try_element_at(F.transform(F.filter("request_headers", lambda h: h["name"] == "X-Id"), lambda h: h["value"]), F.lit(1))
    return d.filter("reason IS NULL").select(named.alias("id"), "method", "authority", "path", "query", "status")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture, n, bytes: the segments of the stored exchanges as frames of classic captures, eight captures a session, in order.

    An exchange has a client address of its own by its place in the capture."""
    w = _wire(spark, sf_dir).withColumn("conn", F.when(F.col("src").startswith("c:"), F.col("src")).otherwise(F.col("dst")))
    first = w.groupBy("session_id", "conn").agg(F.min("ts_micros").alias("began"))
    first = first.withColumn("capture", F.concat("session_id", F.lit("-"), (F.col("began") % 8).cast("string")))
    placed = positions(first, ["capture"], ["began", "conn"], "began", 3_600_000_000, "k").select("session_id", "conn", "capture", "k")
    hex_ = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    client, server, up = F.concat(F.lit("0a"), hex_(F.col("k"), 3)), F.lit("c0000201"), F.col("src").startswith("c:")
    size = F.length("payload")
    src, dst = F.when(up, client).otherwise(server), F.when(up, server).otherwise(client)
    ports = F.when(up, F.lit("9c400050")).otherwise(F.lit("00509c40"))
    frame = F.concat(F.lit("00" * 12 + "0800"), F.lit("4500"), hex_(size + 40, 2), F.lit("00000000" + "40060000"), src, dst, ports, F.lit("00000001" + "00000001" + "5018ffff" + "00000000"), F.hex("payload"))
    record = F.concat(hex_(F.floor(F.col("ts_micros") / 1_000_000), 4), hex_(F.col("ts_micros") % 1_000_000, 4), hex_(size + 54, 4), hex_(size + 54, 4), frame)
    return w.join(placed, ["session_id", "conn"]).select("capture", "packet_no", F.unhex(record).alias("bytes"))


def A15_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of the stored exchanges imported as a run, with one that is no capture: the sessions it leaves."""
    frames = _packets(spark, sf_dir).groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("packet_no", "bytes"))).alias("p"))
    header = F.unhex(F.lit("a1b2c3d4" + "00020004" + "0" * 16 + "0000ffff" + "00000001"))
    body = F.aggregate("p", F.lit("").cast("binary"), lambda x, y: F.concat(x, y["bytes"]))
    captures = frames.select(F.concat(F.lit("/in/"), "capture").alias("path"), F.concat(header, body).alias("content"))
    broken = spark.range(1).select(F.lit("/in/broken").alias("path"), F.lit("no capture").cast("binary").alias("content"))
    out = capture.import_captures(cut(captures.unionByName(broken)), shared_folder(spark, "import"))
    sessions, analyses = spark.read.parquet(out["sessions"]), spark.read.parquet(out["analyses"])
    return sessions.join(analyses.select(F.col("session_id").alias("id"), "engine"), "id", "left").select("id", "status", "flow_count", F.coalesce("engine", F.lit("")).alias("engine"))


SQL["I12_http1"] = f"{_W} SELECT id, method, authority, path, coalesce(query, '') AS query, status FROM cur WHERE {_H1}"
SQL["A15_import"] = f"{_W} SELECT session_id || '-' || (ts_micros % 8) AS id, 'closed' AS status, count(*) AS flow_count, 'native' AS engine FROM cur WHERE {_H1} GROUP BY 1 UNION ALL SELECT 'broken', 'error', 0, ''"


def I2_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.with_connections(_wire(spark, sf_dir)).groupBy("session_id").agg(F.count_distinct("connection_id").alias("connections"), F.count("*").alias("packets"))


SQL["I2_connections"] = f"{_W} SELECT session_id, count(*) AS connections, 2 * count(*) AS packets FROM cur WHERE {_H1} GROUP BY session_id"


def I17_hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hello_fingerprints(load(spark, sf_dir, "flow_client_hellos").select("flow_id", "ord", "raw"))


# the hellos of the test data have one layout: three ciphers, the server's name and one version
_HELLO = """hx AS (SELECT flow_id, ord, hex(raw) AS x, octet_length(raw) AS n FROM flow_client_hellos),
hello AS (SELECT flow_id, ord, n >= 4 AND CAST('0x' || substr(x, 3, 6) AS BIGINT) + 4 = n AS whole, CASE WHEN n >= 4 AND CAST('0x' || substr(x, 3, 6) AS BIGINT) + 4 = n THEN decode(unhex(substr(x, 121, 2 * CAST('0x' || substr(x, 117, 4) AS INTEGER)))) END AS sni FROM hx)"""
SQL["I17_hellos"] = f"""WITH {_HELLO} SELECT flow_id, ord, sni, CASE WHEN whole THEN md5('771,4865-4866-4867,0-43,,') END AS ja3, CASE WHEN whole THEN 't13d030200_' || substr(sha256('1301,1302,1303'), 1, 12) || '_' || substr(sha256('002b'), 1, 12) END AS ja4,
CASE WHEN whole THEN '771,4865-4866-4867,0-43,, sni=' || sni END AS hello_text FROM hello"""


def I25_request_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "flow_headers").filter((F.lower("name") == "set-cookie") & present(F.col("value"))).select("flow_id", "ord", F.col("value"))
    first = F.split_part("value", F.lit(";"), F.lit(1))
    parts = F.filter(F.transform(F.split("value", ";"), F.trim), lambda x: x != "")
    return h.select("flow_id", "ord", F.trim(F.split_part(first, F.lit("="), F.lit(1))).alias("name"), F.trim(F.split_part(first, F.lit("="), F.lit(2))).alias("cookie_value"), (F.size(parts) - 1).alias("n_attributes"))


SQL["I25_request_cookies"] = "SELECT flow_id, ord, trim(split_part(split_part(value, ';', 1), '=', 1)) AS name, trim(split_part(split_part(value, ';', 1), '=', 2)) AS cookie_value, CAST(len(list_filter(string_split(value, ';'), lambda x: trim(x) <> '')) - 1 AS INTEGER) AS n_attributes FROM flow_headers WHERE lower(name) = 'set-cookie' AND value <> ''"


COOKIE = "flow_id string, ord long, request boolean, n int, name string, cookie_value string, attributes string"


def _cookies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COOKIE.split(", ")]
    for batch in batches:
        rows = []
        for flow, ord_, header, value in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if header == "cookie":
                rows += [(flow, ord_, True, n, name, v, "") for n, (name, v) in enumerate(request_cookies(value))]
            elif c := response_cookie(value):
                rows.append((flow, ord_, False, 0, c.pop("name"), c.pop("value"), ";".join(f"{k}={v}" for k, v in sorted(c.items()))))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def I25_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookies of all Cookie and Set-Cookie headers."""
    h = load(spark, sf_dir, "flow_headers").filter(F.lower("name").isin("cookie", "set-cookie") & present(F.col("value")))
    return h.select("flow_id", F.col("ord").cast("long").alias("ord"), F.lower("name").alias("name"), "value").mapInArrow(_cookies, COOKIE)


SQL["I25_cookies"] = """
WITH h AS (SELECT flow_id, ord, lower(name) AS header, value FROM flow_headers WHERE lower(name) IN ('cookie', 'set-cookie') AND value <> ''),
p AS (SELECT *, list_transform(string_split(value, ';'), lambda x: trim(x)) AS parts FROM h),
c AS (SELECT flow_id, ord, header, parts, CASE WHEN header = 'cookie' THEN list_filter(parts, lambda x: instr(x, '=') > 0 AND trim(split_part(x, '=', 1)) <> '') ELSE list_filter(parts[1:1], lambda x: instr(x, '=') > 0 AND trim(split_part(x, '=', 1)) <> '') END AS kept FROM p),
e AS (SELECT flow_id, ord, header, parts, unnest(kept) AS x, generate_subscripts(kept, 1) - 1 AS n FROM c)
SELECT flow_id, ord, header = 'cookie' AS request, n, trim(split_part(x, '=', 1)) AS name, trim(trim(substr(x, instr(x, '=') + 1)), '"') AS cookie_value,
CASE WHEN header = 'cookie' THEN '' ELSE array_to_string(list_sort(list_transform(list_filter(parts[2:], lambda y: y <> ''), lambda y: lower(trim(split_part(y, '=', 1))) || '=' || CASE WHEN instr(y, '=') > 0 THEN trim(substr(y, instr(y, '=') + 1)) ELSE '' END)), ';') END AS attributes FROM e"""


def _proxied(f: DataFrame) -> DataFrame:
    q = F.struct(F.col("ts_micros").alias("timestamp"), "method", "scheme", "authority", F.concat(text(F.col("path")), F.when(text(F.col("query")) == "", "").otherwise(F.concat(F.lit("?"), "query"))).alias("path"))
    return files.from_proxy(f.select("id", q.alias("request"), F.struct("status", (F.col("ts_micros") + F.col("duration_micros")).alias("timestamp")).alias("response"), "error")).select("id", "ts_micros", "path", "query", "status", "duration_micros")


def A10_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proxied(a.flows(spark, sf_dir))


def A8_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished exchanges pushed over stored ones: about half are stored as they began, without an answer, the others are new."""
    f = a.flows(spark, sf_dir)
    began = _proxied(f.filter(F.crc32("id") % 2 == 0)).withColumns({"status": F.lit(0), "duration_micros": F.lit(0).cast("long")})
    return mutate.upsert(began, _proxied(f), ["id"], ["ts_micros"])


SQL["A10_proxy"] = f"{_W} SELECT id, ts_micros, coalesce(path, '') AS path, coalesce(query, '') AS query, coalesce(status, 0) AS status, coalesce(duration_micros, 0) AS duration_micros FROM cur"
SQL["A8_pushed"] = SQL["A10_proxy"]


def A11_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).filter("protocol = 'DNS'")
    return files.from_dns(f.select("id", "ts_micros", F.lit("A").alias("qtype"), F.col("authority").alias("qname"), F.when(F.col("ts_micros") % 2 == 0, "NXDOMAIN").otherwise("NOERROR").alias("rcode"), F.array("dst_addr").alias("answers")))


SQL["A11_dns"] = f"""{_W} SELECT id, ts_micros, 'DNS' AS protocol, 'A' AS method, authority, '{{"answers":["' || dst_addr || '"]}}' AS body, CASE WHEN ts_micros % 2 = 0 THEN 'NXDOMAIN' ELSE '' END AS error FROM cur WHERE protocol = 'DNS'"""


def A13_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of all tables of a session and import under a new id."""
    folder = shared_folder(spark, "bundle")
    f = load(spark, sf_dir, "flows").select("session_id", "id", "method")
    files.export_bundle({"flows": f, "sessions": load(spark, sf_dir, "sessions")}, folder, "all")
    return files.import_bundle(spark, folder, "copy")["flows"].groupBy("session_id", "method").agg(F.count("*").alias("n"))


def A14_bundle_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's groups merged into a catalog that has half of them under other names."""
    folder = shared_folder(spark, "bundle")
    g = load(spark, sf_dir, "groups").groupBy("id").agg(F.max("name").alias("name"))
    files.export_bundle({"groups": g}, folder, "all")
    catalog = g.filter(F.length("name") % 2 == 0).withColumn("name", F.lit("mine"))
    return files.merge_definitions(catalog, files.import_bundle(spark, folder)["groups"])


SQL["A13_bundle"] = "SELECT 'copy' AS session_id, method, count(*) AS n FROM flows GROUP BY method"
SQL["A14_bundle_import"] = "SELECT id, CASE WHEN length(max(name)) % 2 = 0 THEN 'mine' ELSE max(name) END AS name FROM groups GROUP BY id"


def A16_redecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).select("id", "protocol", "method")
    return capture.replace_protocol(f, f.withColumn("method", F.lit("AGAIN")), ["TCP", "DNS"])


SQL["A16_redecode"] = f"{_W} SELECT id, protocol, CASE WHEN protocol IN ('TCP', 'DNS') THEN 'AGAIN' ELSE method END AS method FROM cur"


def A18_source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "sessions").select("id", F.when(F.col("created_at") % 3 == 0, F.concat(F.lit("SOURCE_KIND_"), F.upper("source_kind"))).when(F.col("created_at") % 3 == 1, F.lit("SOURCE_KIND_UNHEARD")).otherwise(F.col("source_kind")).alias("k"))
    return s.select("id", files.source_kind(F.col("k")).alias("source_kind"))


SQL["A18_source_kinds"] = "SELECT id, CASE WHEN created_at % 3 = 1 OR (created_at % 3 = 0 AND source_kind NOT IN ('chrome', 'mitmproxy')) THEN '' ELSE coalesce(source_kind, '') END AS source_kind FROM sessions"


def I28_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a connection and where it is from: authority, the hello's name, the last lookup's answer, the peer's address."""
    h = hello_fingerprints(load(spark, sf_dir, "flow_client_hellos").filter(present(F.col("flow_id"))).select("flow_id", "raw")).groupBy("flow_id").agg(F.max("sni").alias("sni"))
    f = a.flows(spark, sf_dir).select("id", "ts_micros", "protocol", "authority", fx.address_host(F.col("dst_addr")).alias("address"))
    answers = f.filter("protocol = 'DNS' AND authority <> ''").select("address", "ts_micros", F.col("authority").alias("name"))
    # the test data name nearly every connection, so that two of three count as unnamed here
    f = f.withColumn("authority", F.when(F.col("ts_micros") % 3 == 0, F.col("authority")))
    named = names_of_addresses(f, answers).join(h, F.col("id") == F.col("flow_id"), "left")
    return named.select("id", *fx.best_name(F.col("authority"), F.when(F.col("ts_micros") % 3 == 1, F.col("sni")), F.col("name"), F.col("address")))


SQL["I28_names"] = rf"""{_W}, {_HELLO}, s AS (SELECT flow_id, max(sni) AS sni FROM hello WHERE flow_id <> '' GROUP BY flow_id),
f AS (SELECT id, ts_micros, protocol, authority, regexp_replace(regexp_replace(coalesce(dst_addr, ''), ':(\d+)$', ''), '^\[|\]$', '', 'g') AS address FROM u),
n AS (SELECT address, ts_micros, max(authority) AS name FROM f WHERE protocol = 'DNS' AND authority <> '' GROUP BY ALL),
x AS (SELECT f.id, f.address, CASE WHEN f.ts_micros % 3 = 0 THEN authority END AS authority, CASE WHEN f.ts_micros % 3 = 1 THEN sni END AS sni, n.name FROM f ASOF LEFT JOIN n ON f.address = n.address AND f.ts_micros >= n.ts_micros LEFT JOIN s ON s.flow_id = f.id)
SELECT id, CASE WHEN coalesce(authority, '') <> '' THEN authority WHEN coalesce(sni, '') <> '' THEN sni WHEN coalesce(name, '') <> '' THEN name ELSE address END AS name, CASE WHEN coalesce(authority, '') <> '' THEN 'authority' WHEN coalesce(sni, '') <> '' THEN 'sni' WHEN coalesce(name, '') <> '' THEN 'dns' ELSE 'ip' END AS source FROM x"""


FRAMED = "id long, n int, from_client boolean, cmd string, seq string, opcode string, ver string, payload string"


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FRAMED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.string()] * 5]
    for batch in batches:
        rows = []
        for id_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            session = FramedSession({6: "Init", 19: "Auth"})
            # the stream arrives in two parts
            got = session.feed(True, data[: len(data) // 2]) + session.feed(True, data[len(data) // 2 :])
            rows += [(id_, n, m.from_client, *(m.metadata[k] for k in ("cmd", "seq", "opcode", "ver")), m.payload) for n, m in enumerate(got)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def I22_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames for every event: one with its type in MessagePack, one that acknowledges it; decoded from their bytes."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("long").alias("u"))
    hex_ = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    body = F.concat(F.lit("81a16b"), hex_(F.lit(0xA0) + F.length("event_type"), 1), F.hex("event_type"))
    opcode = F.element_at(F.array(*[F.lit(x) for x in (6, 19, 0xF001)]), (F.col("event_id") % 3 + 1).cast("int"))
    head = lambda cmd, size: F.concat(F.lit("0a"), hex_(cmd, 1), hex_(F.col("event_id") % 65536, 2), hex_(opcode, 2), F.lit("00"), hex_(size, 3))
    data = F.unhex(F.concat(head(F.col("u") % 5, F.length(body) / 2), body, head(F.lit(1), F.lit(0))))
    return e.select(F.col("event_id").cast("long").alias("event_id"), data).mapInArrow(_framed, FRAMED)


SQL["I22_framed"] = """
WITH e AS (SELECT event_id, event_type, user_id % 5 AS c, event_id % 65536 AS seq, CASE event_id % 3 WHEN 0 THEN 'Init(6)' WHEN 1 THEN 'Auth(19)' ELSE 'op0xf001' END AS op FROM events)
SELECT event_id AS id, 0 AS n, true AS from_client, CASE c WHEN 0 THEN 'Request(0)' WHEN 1 THEN 'Response(1)' WHEN 2 THEN 'Push(2)' WHEN 3 THEN 'Error(3)' ELSE 'cmd4' END AS cmd, CAST(seq AS VARCHAR) AS seq, op AS opcode, '10' AS ver, '{"k": "' || event_type || '"}' AS payload FROM e
UNION ALL SELECT event_id, 1, true, 'Response(1)', CAST(seq AS VARCHAR), op, '10', '"[empty / ack]"' FROM e"""


def I20_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.registry_rows([{"label": "one", "ja4": "x"}, {"label": "", "ja4": "y"}], {"b.json": '[{"label": "three", "ja3": "h"}, {"label": "four", "sni": "h"}]', "a.json": '{"fingerprints": [{"label": "two", "ja4_pre": "t13"}]}', "c.json": "not json"})
    return spark.createDataFrame([(r["label"], r["load_order"]) for r in rows], "label string, load_order int")


SQL["I20_registry"] = "SELECT * FROM (VALUES ('one', 0), ('two', 1), ('three', 2)) AS t(label, load_order)"


def I25_cookie_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a_, b_ = request_cookies('sid=abc; theme="dark"; =x; plain'), response_cookie("sid=1; Path=/; HttpOnly; SameSite=Lax")
    return spark.createDataFrame([(";".join(f"{k}={v}" for k, v in a_), ";".join(f"{k}={v}" for k, v in sorted(b_.items())))], "request string, response string")


SQL["I25_cookie_rules"] = "SELECT 'sid=abc;theme=dark' AS request, 'httponly=;name=sid;path=/;samesite=Lax;value=1' AS response"

QUERIES = {k: v for k, v in globals().items() if k[:1] in "AI" and k[1:2].isdigit() and callable(v)}
