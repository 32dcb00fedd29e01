"""Captures as DataFrames: packets, connections, and flows decoded from them.

Files are read with Spark's binary source, so they may lie on any file system; a file is one row, parsed
in one task. Connections are decoded whole, in a stream over a sorted partition: what a connection carries lies in
files beyond ``streams.MEMORY`` bytes, and exchanges leave as they are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.decode import capture, hello, http1, http2, http3, streams, tls
from flowloom.decode.protocols import Meta, Registry
from flowloom.operators.flow_joins import positions

CONNECTION_CAP = 64 << 20  # of a connection's bytes read back
BATCH_BYTES = 16 << 20
MAX_SECRETS = 1_000_000
NUMBERED_AT_ONCE = 100_000  # packets of a session whose connections one task numbers
SEGMENT = "session_id string, packet_no long, ts_micros long, transport string, src string, dst string, seq long, flags int, payload binary, owner_pid long"
FLOW = (
    "session_id string, id string, connection_id string, stream_id string, ts_micros long, duration_micros long, method string, scheme string, authority string, path string, query string, protocol string, status int, src_addr string, dst_addr string, "
    "proxy_addr string, proxy_type string, proxy_user string, proxy_pass string, error string, redirect_location string, req_content_encoding string, resp_content_encoding string, http2_fingerprint string, "
    "request_headers array<struct<name:string,value:string>>, response_headers array<struct<name:string,value:string>>, request_body binary, response_body binary, messages array<struct<from_client:boolean,opcode:string,payload:binary>>, "
    "tls_decrypted boolean, reason string, sni string, ja3 string, ja4 string, bytes_up long, bytes_down long, gaps int"
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all capture files under path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def segments_of(captures: DataFrame) -> DataFrame:
    """TCP and UDP segments of captures (path, content); session_id is the last part of the path. A capture that is none gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                session, rows = name.rsplit("/", 1)[-1], []
                for s in capture.segments(bytes(content)):
                    rows.append((session, s.number, s.ts_micros, s.transport, s.src, s.dst, s.seq, s.flags, s.payload, s.pid))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=_names(SEGMENT))
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_names(SEGMENT))

    return captures.select("path", "content").mapInPandas(run, SEGMENT)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """TCP and UDP segments of all captures under path; session_id is the file's name."""
    return segments_of(read_captures(spark, path))


def _names(ddl: str) -> list[str]:
    out, depth = [], 0
    for part in ddl.split(","):
        if depth == 0:
            out.append(part.split()[0])
        depth += part.count("<") - part.count(">")
    return out


def with_connections(segments: DataFrame) -> DataFrame:
    """segments with connection_id (a number in order of first packet, udp: before that of UDP), client (the side that began) and from_client."""
    pair = F.array_join(F.array_sort(F.array("src", "dst")), "|")
    s = segments.withColumn("pair", F.concat_ws("|", "transport", pair))
    # a SYN without ACK names the client even if a later packet was captured first
    first = s.groupBy("session_id", "transport", "pair").agg(F.min("packet_no").alias("first_no"), F.min_by("src", "packet_no").alias("first_src"), F.min_by("src", F.when(F.col("flags").bitwiseAND(F.lit(0x12)) == 2, F.col("packet_no"))).alias("syn_src"))
    numbered = positions(first, ["session_id"], ["first_no"], "first_no", NUMBERED_AT_ONCE, "n")
    known = numbered.select("session_id", "pair", F.concat(F.when(F.col("transport") == "udp", "udp:").otherwise(""), F.col("n").cast("string")).alias("connection_id"), F.coalesce("syn_src", "first_src").alias("client"))
    return s.join(known, ["session_id", "pair"]).withColumn("from_client", F.col("src") == F.col("client")).drop("pair")


def _reason(kind: str, client: bytes, server: bytes, transport: str, keyed: bool) -> str:
    """Why a connection has no flow."""
    if transport == "udp":
        return "udp"
    if kind == "tls":
        return "handshake_incomplete" if not server else "unsupported" if keyed else "no_key"
    if kind == "tls_midstream":
        return "handshake_incomplete"
    return "unparsed"


def decode_connection(session: str, connection: str, rows_in: Iterable[tuple], secrets: dict[tuple[str, str], str] | None = None, registry: Registry | None = None) -> Iterator[dict]:
    """Flows of one connection, or one row with the reason why it has none. rows_in: ts_micros, transport, src, dst, seq, flags, payload, client, from_client in order of packets."""
    for n, r in enumerate(_flows(session, connection, rows_in, secrets, registry)):
        yield r | {"id": f"{session}-{connection}-{n}"}


def _flows(session: str, connection: str, rows_in: Iterable[tuple], secrets: dict[tuple[str, str], str] | None, registry: Registry | None) -> Iterator[dict]:
    sides, ups, began, head = {True: streams.Segments(), False: streams.Segments()}, bytearray(), None, None
    times = array("q")
    for at, transport, src, dst, seq, _, payload, client, up in rows_in:
        head = head or (transport, client, dst if src == client else src)
        began = at if began is None else min(began, at)
        if transport == "tcp":
            sides[up].add(seq, payload, at)
        elif payload:
            sides[up].add(0, payload, at)
            ups.append(up)
            times.append(at)
    transport, src, dst = head
    client, server = (sides[up].stream() if transport == "tcp" else streams.Stream() for up in (True, False))
    blank = dict.fromkeys(_names(FLOW)) | {
        "session_id": session, "connection_id": connection, "stream_id": "", "src_addr": src, "dst_addr": dst, "ts_micros": began, "bytes_up": len(client.data) if transport == "tcp" else sides[True].size, "bytes_down": len(server.data) if transport == "tcp" else sides[False].size,
        "gaps": client.gaps + server.gaps, "error": "", "proxy_addr": "", "proxy_type": "", "proxy_user": "", "proxy_pass": "", "duration_micros": 0, "status": 0, "tls_decrypted": False,
    }
    some, a, b, proxy = False, 0, 0, {}
    near = lambda s, k: s.data[k : k + streams.HEADER_CAP]
    if transport == "tcp":
        for _ in range(4):  # proxies may be chained
            kind = streams.classify(near(client, a), near(server, b))
            tunnel = None
            if kind == "connect":
                tunnel = streams.connect_tunnel(near(client, a), near(server, b))
                if tunnel:
                    some = True
                    yield blank | proxy | {"method": "CONNECT", "scheme": "http", "authority": tunnel.target, "path": "", "query": "", "protocol": "HTTP/1.1", "status": 200 if tunnel.accepted else 0, "ts_micros": client.time_at(a), "error": "" if tunnel.accepted else "tunnel refused"}
            elif kind in ("socks4", "socks5"):
                tunnel = streams.socks_tunnel(near(client, a), near(server, b))
            if not tunnel:
                break
            proxy = {"proxy_addr": dst, "proxy_type": tunnel.proxy, "proxy_user": tunnel.user, "proxy_pass": tunnel.password, "dst_addr": tunnel.target or dst}
            a, b = a + tunnel.client_at, b + tunnel.server_at
            if not tunnel.accepted:
                break
        up, down, scheme, shown = client.after(a), server.after(b), "http", None
        kind = streams.classify(near(up, 0), near(down, 0))
        if kind == "tls":
            shown = hello.parse_hello(tls.handshake_start(up.data))
            if secrets and (opened := tls.open_tls(up, down, secrets)):
                (up, down), scheme = opened, "https"
                kind = streams.classify(near(up, 0), near(down, 0))
        found: Iterable[tuple[str, http1.Exchange]] = []
        fingerprint = ""
        if kind == "http2":
            got, fingerprint = http2.read_exchanges(up, down, scheme)
            found = ((str(n), e) for n, e in got)
        elif kind == "cleartext" and registry and (custom := registry.find(Meta((proxy.get("dst_addr") or dst).rpartition(":")[0], int((proxy.get("dst_addr") or dst).rpartition(":")[2] or 0)))):
            name, decoder = custom
            decoded = [m for side, t in ((True, up), (False, down)) for at in range(0, max(1, len(t.data)), streams.MEMORY) for m in decoder.feed(side, t.data[at : at + streams.MEMORY])]
            if decoded:
                e = http1.Exchange(scheme=name, authority=(proxy.get("dst_addr") or dst), ts_micros=up.time_at(0) or down.time_at(0))
                e.messages = [(m.from_client, m.opcode, m.payload.encode()) for m in decoded]
                found = [("", e)]
        elif kind in ("http1", "cleartext"):
            found = (("", e) for e in http1.read_exchanges(up, down, scheme))
        for stream, e in found:
            some = True
            pairs = lambda h: [{"name": x, "value": y} for x, y in h]
            yield blank | proxy | {
                "stream_id": stream, "ts_micros": e.ts_micros, "duration_micros": e.duration_micros, "method": e.method, "scheme": e.scheme, "authority": e.authority, "path": e.path, "query": e.query, "protocol": "HTTP/2" if kind == "http2" else e.scheme if e.messages and not e.method else "HTTP/1.1",
                "status": e.status, "error": e.error, "redirect_location": e.redirect_location, "req_content_encoding": e.request_encoding, "resp_content_encoding": e.response_encoding, "http2_fingerprint": fingerprint, "request_headers": pairs(e.request_headers),
                "response_headers": pairs(e.response_headers), "request_body": e.request_body, "response_body": e.response_body, "messages": [{"from_client": c, "opcode": o, "payload": p} for c, o, p in e.messages],
                "tls_decrypted": scheme == "https", "sni": shown.sni if shown else "", "ja3": hello.ja3(shown) if shown else "", "ja4": hello.ja4(shown) if shown else "",
            }
    if transport == "udp" and secrets and (opened := http3.quic_streams(_datagrams(sides, ups, times), secrets)):
        shown = tls.quic_hello(list(islice(sides[True].datagrams(), 16)))
        pairs = lambda h: [{"name": x, "value": y} for x, y in h]
        for number, e in http3.exchanges(*opened):
            some = True
            yield blank | {
                "connection_id": connection.replace("udp:", "quic:"), "stream_id": str(number), "ts_micros": e.ts_micros, "duration_micros": e.duration_micros, "method": e.method, "scheme": e.scheme, "authority": e.authority, "path": e.path, "query": e.query, "protocol": "HTTP/3", "status": e.status,
                "error": e.error, "redirect_location": e.redirect_location, "req_content_encoding": e.request_encoding, "resp_content_encoding": e.response_encoding, "request_headers": pairs(e.request_headers), "response_headers": pairs(e.response_headers),
                "request_body": e.request_body, "response_body": e.response_body, "messages": [], "tls_decrypted": True, "sni": shown.sni if shown else "", "ja3": hello.ja3(shown) if shown else "", "ja4": hello.ja4(shown, True) if shown else "",
            }
    if not some and (blank["bytes_up"] or blank["bytes_down"]):
        quic = transport == "udp"
        kind = "udp" if quic else streams.classify(near(client, a), near(server, b))
        h = tls.quic_hello(list(islice(sides[True].datagrams(), 16))) if quic else hello.parse_hello(tls.handshake_start(client.after(a).data)) if kind == "tls" else None
        yield blank | proxy | {"reason": _reason(kind, client.data[:1], server.data[:1], transport, bool(secrets)), "sni": h.sni if h else "", "ja3": hello.ja3(h) if h else "", "ja4": hello.ja4(h, quic) if h else ""}


def _datagrams(sides: dict[bool, streams.Segments], ups: bytearray, times: array) -> Iterator[tuple[bool, bytes, int]]:
    """(from_client, datagram, time) of both sides in order."""
    each = {up: side.datagrams() for up, side in sides.items()}
    for up, at in zip(ups, times):
        yield bool(up), next(each[bool(up)]), at


def _weight(row: dict) -> int:
    """About the bytes of a flow."""
    return 1000 + len(row["request_body"] or b"") + len(row["response_body"] or b"") + sum(len(m["payload"]) for m in row["messages"] or ())


def _decode(batches: Iterator[pa.RecordBatch], schema: pa.Schema, secrets: dict[tuple[str, str], str], registry: Registry | None) -> Iterator[pa.RecordBatch]:
    """Connections of a sorted partition one after the other."""
    rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))))
    out, size = [], 0
    for key, some in groupby(rows, lambda r: r[:2]):
        for row in decode_connection(*key, (r[2:] for r in some), secrets, registry):
            out.append(row)
            size += _weight(row)
            if len(out) >= 500 or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def decode_capture(segments: DataFrame, keylog: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Flows (reason NULL) and connections without flows (reason set) of the segments. keylog: label, client_random, secret of at most
    ``MAX_SECRETS`` rows, which all tasks get; with it TLS connections are opened. registry: decoders for
    cleartext that is neither HTTP/1 nor HTTP/2, by destination."""
    secrets: dict[tuple[str, str], str] = {}
    if keylog is not None:
        rows = keylog.select("label", "client_random", "secret").limit(MAX_SECRETS + 1).collect()
        if len(rows) > MAX_SECRETS:
            raise ValueError(f"more than {MAX_SECRETS} secrets: decode the sessions in parts")
        secrets = {(r.label, r.client_random): r.secret for r in rows}
    shared = segments.sparkSession.sparkContext.broadcast(secrets)
    c = with_connections(segments).select("session_id", "connection_id", "ts_micros", "transport", "src", "dst", "seq", "flags", "payload", "client", "from_client", "packet_no")
    placed = c.repartition("session_id", "connection_id").sortWithinPartitions("session_id", "connection_id", "packet_no").drop("packet_no")
    schema = to_arrow_schema(T.StructType.fromDDL(FLOW))
    return placed.mapInArrow(lambda batches: _decode(batches, schema, shared.value, registry), FLOW)


WINDOW = 256 << 10
SLACK_MICROS = 2_000_000


def connection_bytes(segments: DataFrame, src: str, dst: str, since: int, until: int, *, from_client: bool = True, offset: int = 0, length: int = WINDOW) -> DataFrame:
    """data, size, gaps, cut: a window of one direction of the connection between two addresses in a time span (with two seconds of
    slack). At most WINDOW bytes come back and CONNECTION_CAP are stitched."""
    a, b = (src, dst) if from_client else (dst, src)
    some = segments.filter((F.col("transport") == "tcp") & (F.col("src") == a) & (F.col("dst") == b) & F.col("ts_micros").between(since - SLACK_MICROS, until + SLACK_MICROS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held += len(row[3])
                if held <= 2 * CONNECTION_CAP:
                    rows.append(row)
        rows.sort(key=lambda r: r[0])
        first = next(((r[1] + 1) & 0xFFFFFFFF for r in rows if r[2] & 2), None)
        s = streams.stitch([(r[1], r[3], r[4]) for r in rows], CONNECTION_CAP, first)
        yield pa.RecordBatch.from_arrays([pa.array([s.data[offset : offset + min(length, WINDOW)]], pa.binary()), pa.array([len(s.data)], pa.int64()), pa.array([s.gaps], pa.int32()), pa.array([s.cut])], names=["data", "size", "gaps", "cut"])

    return some.select("packet_no", "seq", "flags", "payload", "ts_micros").repartition(1).mapInArrow(run, "data binary, size long, gaps int, cut boolean")


MAGICS = ("d4c3b2a1", "a1b2c3d4", "4d3cb2a1", "a1b23c4d", "0a0d0d0a")


def import_captures(captures: DataFrame, out: str, keylog: DataFrame | None = None, *, engine: str = "native") -> dict[str, str]:
    """Decode captures (path, content) and write what they hold below out: flows, undecoded, sessions, analyses; (table -> path).

    A session per capture, named by the last part of its path: closed with the number of its flows, or error where the bytes are no
    capture at all, in which case it has no analysis. Rows are decoded once and written before they are split. An empty table of
    captures gives empty tables.
    """
    spark = captures.sparkSession
    decode_capture(segments_of(captures), keylog).write.mode("overwrite").parquet(f"{out}/decoded")
    decoded = spark.read.schema(FLOW).parquet(f"{out}/decoded")
    heads = captures.select(F.regexp_extract("path", "[^/]+$", 0).alias("id"), F.length("content").cast("long").alias("pcap_bytes"), F.lower(F.hex(F.substring("content", 1, 4))).isin(*MAGICS).alias("readable"))
    counts = decoded.filter("reason IS NULL").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("flow_count"))
    ended = heads.join(counts, "id", "left").select("id", F.lit("import").alias("source_kind"), F.when(F.col("readable"), "closed").otherwise("error").alias("status"), "pcap_bytes", F.coalesce("flow_count", F.lit(0)).alias("flow_count"))
    ran = ended.filter("status = 'closed'").select(F.concat(F.lit("analysis-"), "id").alias("id"), F.col("id").alias("session_id"), F.lit(engine).alias("engine"), F.lit(keylog is not None).alias("tls_key_log_used"))
    paths = {}
    for name, part in (("flows", decoded.filter("reason IS NULL")), ("undecoded", decoded.filter("reason IS NOT NULL")), ("sessions", ended), ("analyses", ran)):
        paths[name] = f"{out}/{name}"
        part.write.mode("overwrite").parquet(paths[name])
    return paths


def replace_protocol(flows: DataFrame, fresh: DataFrame, protocols: list[str]) -> DataFrame:
    """Flows with those of the protocols replaced by newly decoded ones."""
    return flows.filter(~F.coalesce(F.col("protocol").isin(*protocols), F.lit(False))).unionByName(fresh.filter(F.col("protocol").isin(*protocols)), allowMissingColumns=True)


def redecode(flows: DataFrame, captures: DataFrame, registry: Registry, protocols: list[str], keylog: DataFrame | None = None) -> DataFrame:
    """Flows after the captures (path, content) were decoded again with a registry: those of the registry's ``protocols`` are the new
    ones, all others stay as they are."""
    fresh = decode_capture(segments_of(captures), keylog, registry).filter("reason IS NULL")
    return replace_protocol(flows, fresh, protocols)
