import gzip
import struct
import zlib

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.decode import capture, content, hello, http1, http2, protocols, streams
from flowloom.queries.decode_queries import QUERIES, SQL
from flowloom.sources import files
from flowloom.sources.capture import FLOW, _decode, decode_capture, read_segments


def tcp(src, dst, seq, payload, flags=24):
    body = struct.pack(">HHIIBBHHH", src[1], dst[1], seq, 0, 5 << 4, flags, 1000, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, 6, 0, bytes(src[0]), bytes(dst[0])) + body
    return b"\0" * 12 + b"\x08\x00" + ip


def pcap(frames, order="<"):
    magic = b"\xd4\xc3\xb2\xa1" if order == "<" else b"\xa1\xb2\xc3\xd4"
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1, k, len(f), len(f)) + f
    return out


def pcapng(frames, pids):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for pid in pids:
        out += block(0x80000001, struct.pack("<I", pid))
    for k, (f, owner) in enumerate(frames):
        option = struct.pack("<HHI", 0x8001, 4, owner) + struct.pack("<HH", 0, 0) if owner is not None else b""
        out += block(6, struct.pack("<IIIII", 0, 0, k, len(f), len(f)) + f + b"\0" * (-len(f) % 4) + option)
    return out


C, S = ((10, 0, 0, 1), 5000), ((10, 0, 0, 2), 80)
ASK = b"GET /a?x=1 HTTP/1.1\r\nHost: h.example\r\n\r\n"
ANSWER = b"HTTP/1.1 302 Found\r\nLocation: /b\r\nContent-Length: 2\r\n\r\nok"


@pytest.mark.parametrize("order", ["<", ">"])
def test_both_formats(order):
    frames = [tcp(C, S, 100, ASK), tcp(S, C, 500, ANSWER)]
    got = list(capture.segments(pcap(frames, order)))
    assert [(s.src, s.payload) for s in got] == [("10.0.0.1:5000", ASK), ("10.0.0.2:80", ANSWER)]
    assert list(capture.segments(pcap(frames, order)[:-3])) == got[:1]
    ng = list(capture.packets(pcapng([(frames[0], 0), (frames[1], None)], [42])))
    assert [p.pid for p in ng] == [42, None] and [p.data for p in ng] == frames
    assert list(capture.packets(b"")) == [] and list(capture.packets(b"junk" * 9)) == []
    huge = pcap([]) + struct.pack("<IIII", 1, 1, 1 << 30, 1 << 30)
    assert list(capture.packets(huge)) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(0, 2**32 - 1), st.data())
def test_stitch_gives_back_the_bytes(data, base, draw):
    cuts = sorted(draw.draw(st.sets(st.integers(1, max(1, len(data) - 1)), max_size=8)))
    edges = [0, *[c for c in cuts if c < len(data)], len(data)]
    parts = [((base + a) % 2**32, data[a : min(len(data), b + draw.draw(st.integers(0, 3)))], k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    shuffled = draw.draw(st.permutations(parts + parts[:1]))
    out = streams.stitch(list(shuffled), first=base)
    assert out.data == data and out.gaps == 0


def test_stitch_gap_and_cap():
    assert streams.stitch([(1, b"ab", 0), (9, b"z", 0)]).gaps == 1
    capped = streams.stitch([(1, b"abcdef", 0)], cap=3)
    assert capped.data == b"abc" and capped.cut


def test_classify_and_tunnels():
    assert streams.classify(b"\x16\x03\x01\0\x05\x01") == "tls" and streams.classify(b"\x17\x03\x03\0\x05") == "tls_midstream"
    assert streams.classify(http2.H2_PREFACE) == "http2" and streams.classify(ASK) == "http1" and streams.classify(b"", b"hi") == "cleartext"
    t = streams.connect_tunnel(b"CONNECT a.b:443 HTTP/1.1\r\nProxy-Authorization: Basic dTpw\r\n\r\nREST", b"HTTP/1.1 200 ok\r\n\r\n")
    assert (t.target, t.user, t.password, t.accepted) == ("a.b:443", "u", "p", True)
    five = streams.socks_tunnel(b"\x05\x01\x00" + b"\x05\x01\x00\x03\x03a.b\x01\xbb" + b"REST", b"\x05\x00" + b"\x05\x00\x00\x01\x01\x02\x03\x04\x00\x50")
    assert (five.target, five.accepted, five.client_at) == ("a.b:443", True, 13)
    four = streams.socks_tunnel(b"\x04\x01\x01\xbb\0\0\0\x01u\0a.b\0", b"\0\x5a" + b"\0" * 6)
    assert (four.target, four.user, four.accepted) == ("a.b:443", "u", True)
    assert streams.socks_tunnel(b"\x05\x01", b"") is None


@pytest.mark.parametrize(("name", "pack"), [("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda b: zlib.compress(b)[2:-4]), ("zstd", zstandard.ZstdCompressor().compress)])
def test_encodings(name, pack):
    body = b"some text " * 400
    assert content.decode_body(pack(body), name).data == body
    assert content.decode_body(body, name) == content.Body(body, name)
    if name == "gzip":
        part = content.decode_body(pack(body)[:-6], name)
        assert part.cut and body.startswith(part.data)
    assert content.decode_body(body, "br, gzip").encoding == "br, gzip"
    assert content.decode_body(pack(body), name, cap=10).truncated


@given(st.binary(max_size=300), st.booleans())
def test_websocket_frames(payload, masked):
    head = bytes([0x81]) + (bytes([len(payload) | 0x80 * masked]) if len(payload) < 126 else bytes([126 | 0x80 * masked]) + struct.pack(">H", len(payload)))
    key = b"\1\2\3\4" if masked else b""
    data = head + key + (bytes(b ^ key[i % 4] for i, b in enumerate(payload)) if masked else payload)
    frames, used = content.websocket_frames(data + b"\x81")
    assert [(f.opcode, f.payload) for f in frames] == [("text", payload)] and used == len(data)


def test_http1_details():
    c = streams.Stream(b"HEAD / HTTP/1.1\r\nHost: a\r\n\r\nGET /ws HTTP/1.1\r\nHost: a\r\nX-Long: 1\r\n  2\r\n\r\n\x81\x02hi", starts=[0], times=[1])
    s = streams.Stream(b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nHTTP/1.1 101 S\r\nUpgrade: websocket\r\n\r\n\x82\x01x", starts=[0], times=[3])
    a, b = http1.exchanges(c, s)
    assert (a.status, a.error, b.status) == (200, "", 101) and ("X-Long", "1 2") in b.request_headers
    assert b.messages == [(True, "text", b"hi"), (False, "binary", b"x")]
    cut = http1.exchanges(streams.Stream(ASK), streams.Stream(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc"))[0]
    assert cut.error == "body cut short" and cut.response_body == b"abc"


def test_header_compression_vectors():
    d = http2.HeaderDecoder()
    assert d.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))[3] == (":authority", "www.example.com")
    assert d.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[4] == ("cache-control", "no-cache")
    assert d.decode(bytes.fromhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"))[4] == ("custom-key", "custom-value")
    with pytest.raises(http2.CompressionError):
        d.decode(b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff")


def frame(kind, flags, stream, body):
    return len(body).to_bytes(3, "big") + bytes([kind, flags]) + struct.pack(">I", stream) + body


def test_http2_connection():
    client = http2.H2_PREFACE + frame(4, 0, 0, struct.pack(">HIHI", 1, 65536, 3, 100)) + frame(8, 0, 0, struct.pack(">I", 15663105)) + frame(1, 5, 1, bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) + frame(1, 5, 3, bytes.fromhex("828684be"))
    server = frame(4, 0, 0, b"") + frame(1, 4, 1, b"\x88") + frame(0, 1, 1, b"body") + frame(3, 0, 3, struct.pack(">I", 8))
    got, fp = http2.exchanges(streams.Stream(client, starts=[0], times=[1]), streams.Stream(server, starts=[0], times=[9]))
    assert [(n, e.status, e.response_body, e.error) for n, e in got] == [(1, 200, b"body", ""), (3, 0, b"", "stream reset by server: 8")]
    assert fp == "1:65536;3:100|15663105|0|m,s,p,a" and got[0][1].duration_micros == 8


def client_hello():
    ext = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    exts = ext(0x1A1A, b"") + ext(0, struct.pack(">HBH", 6, 0, 3) + b"a.b") + ext(10, struct.pack(">HHH", 4, 0x2A2A, 29)) + ext(11, b"\1\0") + ext(13, struct.pack(">HHH", 4, 0x0403, 0x0804)) + ext(16, struct.pack(">HB", 3, 2) + b"h2") + ext(43, b"\4" + struct.pack(">HH", 0x0A0A, 0x0304))
    body = struct.pack(">H", 0x0303) + b"r" * 32 + b"\0" + struct.pack(">HHHH", 6, 0x0A0A, 0x1301, 0x1302) + b"\1\0" + struct.pack(">H", len(exts)) + exts
    return b"\1" + len(body).to_bytes(3, "big") + body


def test_hello():
    h = hello.parse_hello(client_hello())
    assert hello.ja3_text(h) == "771,4865-4866,0-10-11-13-16-43,29,0" and h.sni == "a.b"
    assert hello.ja4(h).startswith("t13d0206h2_") and hello.ja4(h, quic=True)[0] == "q"
    assert hello.parse_hello(client_hello()[:-4]) is None and hello.parse_hello(b"") is None


def test_framed_protocol_and_registry():
    assert protocols.msgpack(b"\x82\xa1a\x01\xa1b\x92\xc3\xc0") == ({"a": 1, "b": [True, None]}, 9)
    assert protocols.lz4_block(b"\x44abcd\x04\x00\x10z") == b"abcdabcdabcdz"[:12] + b"z"
    for bad in (b"\xdd\xff\xff\xff\xff", b"\xc1", b""):
        with pytest.raises(ValueError):
            protocols.msgpack(bad)
    zstd = __import__("zstandard").ZstdCompressor().compress(b"\x81\xa1a\x02")
    frame = lambda cmd, op, body, comp=0, seq=7: struct.pack(">BBHHB", 10, cmd, seq, op, comp) + len(body).to_bytes(3, "big") + body
    s = protocols.FramedSession({19: "hello"})
    data = frame(1, 19, b"\x81\xa1a\x01") + frame(9, 0xF001, b"") + frame(0, 6, zstd, 0xFF) + frame(2, 6, b"\x44abcd", 1) + frame(3, 1, b"\xc1\xc1", 0, 4864) + frame(3, 1, b"\xc1", 0xFF)
    got = s.feed(True, data[:6]) + s.feed(True, data[6:17]) + s.feed(True, data[17:]) + s.feed(False, frame(1, 19, b"\xa1b", 0, 8))
    assert [(d.opcode, d.metadata["opcode"], d.metadata["seq"], d.metadata["ver"], d.payload) for d in got] == [
        ("Response(1)", "hello(19)", "7", "10", '{"a": 1}'), ("cmd9", "op0xf001", "7", "10", '"[empty / ack]"'), ("Request(0)", "op0x6", "7", "10", '{"a": 2}'),
        ("Push(2)", "op0x6", "7", "10", '{"raw": "YWJjZA=="}'), ("Error(3)", "op0x1", "4864", "10", '{"raw": "wcE="}'), ("Error(3)", "op0x1", "7", "10", '{"raw": "wQ=="}'), ("Response(1)", "hello(19)", "8", "10", '"b"'),
    ]
    assert [d.from_client for d in got] == [True] * 6 + [False]
    r = protocols.Registry()
    r.register("b", lambda m: True, protocols.FramedSession)
    r.register("a", lambda m: m.port == 1, protocols.FramedSession)
    assert r.find(protocols.Meta(port=1))[0] == "a" and r.find(protocols.Meta())[0] == "b"


def test_redirects_and_cookies():
    go = lambda loc, status=302: content.redirect_target(status, "https", "a.b", "/x/y", [("Location", loc)])
    assert go("/new") == "https://a.b/new" and go("z") == "https://a.b/x/z" and go("//c/d") == "https://c/d" and go("/n", 200) == ""
    assert content.request_cookies("a=1; b = 2;c") == [("a", "1"), ("b", "2")] and content.response_cookie("junk") is None


def test_pushed_exchanges_go_through_upsert(spark, agree, monkeypatch):
    from conftest import DATA

    from flowloom.plans import mutate

    seen, real = [], mutate.upsert
    monkeypatch.setattr(mutate, "upsert", lambda stored, pushed, *more: seen.append((stored.count(), pushed.count())) or real(stored, pushed, *more))
    agree(QUERIES["A8_pushed"](spark, DATA), SQL["A8_pushed"])
    assert len(seen) == 1 and 0 < seen[0][0] < seen[0][1]


def test_cookies_of_all_headers(spark, agree, tmp_path):
    from conftest import DATA

    agree(QUERIES["I25_cookies"](spark, DATA), SQL["I25_cookies"])
    rows = [("f", 0, "Cookie", 'a=1; b="x=y"; =n; plain'), ("f", 1, "Set-Cookie", "sid=q; Path=/; HttpOnly"), ("f", 2, "set-cookie", "junk"), ("g", 0, "cookie", None), ("g", 1, "host", "a=1")]
    spark.createDataFrame(rows, "flow_id string, ord int, name string, value string").write.parquet(f"{tmp_path}/flow_headers.parquet")
    got = sorted(tuple(r) for r in QUERIES["I25_cookies"](spark, str(tmp_path)).collect())
    assert got == [("f", 0, True, 0, "a", "1", ""), ("f", 0, True, 1, "b", "x=y", ""), ("f", 1, False, 0, "sid", "q", "httponly=;path=/")]


def test_capture_to_flows(spark, tmp_path):
    frames = [tcp(C, S, 99, b"", 2), tcp(S, C, 499, b"", 18), tcp(C, S, 100, ASK), tcp(S, C, 500, ANSWER[:30]), tcp(S, C, 530, ANSWER[30:]), tcp(S, C, 500, ANSWER[:30]), tcp(((10, 0, 0, 3), 7), S, 1, b"\x16\x03\x01" + struct.pack(">H", len(client_hello())) + client_hello())]
    (tmp_path / "one.pcap").write_bytes(pcap(frames))
    rows = {r.connection_id: r for r in decode_capture(read_segments(spark, str(tmp_path))).collect()}
    a, b = rows["1"], rows["2"]
    assert (a.method, a.authority, a.path, a.query, a.status, a.redirect_location, a.reason) == ("GET", "h.example", "/a", "x=1", 302, "http://h.example/b", None)
    assert (b.reason, b.sni, b.ja4[:4]) == ("handshake_incomplete", "a.b", "t13d")


def test_text_sources(spark, tmp_path):
    (tmp_path / "keys.log").write_text("# c\nCLIENT_RANDOM " + "AB" * 32 + " " + "cd" * 48 + "\nCLIENT_RANDOM 12 34\nOTHER a b\nCLIENT_RAN")
    assert [(r.label, r.client_random) for r in files.read_keylog(spark, str(tmp_path / "keys.log")).collect()] == [("CLIENT_RANDOM", "ab" * 32)]
    (tmp_path / "follow.txt").write_text("head\n6162\n\t6364\nzz\n")
    assert [(r.from_client, bytes(r.bytes)) for r in files.read_follow(spark, str(tmp_path / "follow.txt")).orderBy("line_no").collect()] == [(True, b"ab"), (False, b"cd")]
    layer = lambda n, s, fs: f'<packet><proto name="frame"><field name="frame.number" show="{n}"/></proto><proto name="tcp"><field name="tcp.stream" show="{s}"/></proto><proto name="http">' + "".join(f'<field name="{k}" show="{v}"/>' for k, v in fs) + "</proto></packet>"
    (tmp_path / "d.xml").write_text("<pdml>" + layer(1, 0, [("http.request.method", "GET"), ("http.request.uri", "/a")]) + layer(2, 0, [("http.request.method", "PUT"), ("http.request.uri", "/b")]) + layer(3, 0, [("http.file_data", "x")]) + layer(4, 0, [("http.response.code", "200")]) + layer(5, 0, [("http.response.code", "404")]) + "</pdml>")
    got = files.stitch_pdml(files.read_pdml(spark, str(tmp_path / "d.xml"))).orderBy("position").collect()
    assert [(r.method, r.uri, r.status) for r in got] == [("GET", "/a", 200), ("PUT", "/b", 404)]


def test_bundle_archive(tmp_path):
    import io
    import tarfile

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f").write_text("x")
    files.pack_bundle(str(tmp_path / "b"), str(tmp_path / "b.tgz"))
    assert (tmp_path / "out" / "f").exists() or files.unpack_bundle(str(tmp_path / "b.tgz"), str(tmp_path / "out"))
    with tarfile.open(tmp_path / "bad.tgz", "w:gz") as t:
        i = tarfile.TarInfo("../evil")
        i.size = 1
        t.addfile(i, io.BytesIO(b"x"))
    with pytest.raises(ValueError):
        files.unpack_bundle(str(tmp_path / "bad.tgz"), str(tmp_path / "out2"))


BODY = bytes(range(256)) * 8192


def wire(pieces, swap):
    """Packets of (from_client, bytes) in turn as record batches; sequence numbers wrap. swap: every 50th segment comes after its successor and twice."""
    names, seq, rows = "session_id connection_id ts_micros transport src dst seq flags payload client from_client".split(), {True: 2**32 - 99, False: 2**32 - 9999}, []
    for up, data in pieces:
        for at in range(0, len(data), 60_000):
            part = data[at : at + 60_000]
            a, b = ("c:1", "s:80") if up else ("s:80", "c:1")
            rows.append(("s", "1", len(rows), "tcp", a, b, seq[up], 24, part, "c:1", up))
            seq[up] = (seq[up] + len(part)) % 2**32
    if swap:
        for k in range(50, len(rows) - 1, 50):
            rows[k : k + 2] = [rows[k + 1], rows[k], rows[k]]
    for k in range(0, len(rows), 200):
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 200]])


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("kind", ["HTTP/1.1", "HTTP/2"])
def test_long_connections_are_decoded_whole(spark, kind, swap):
    """160 MiB of answers on one connection."""
    n = 80
    if kind == "HTTP/1.1":
        pieces = [x for k in range(n) for x in ((True, b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n" % k), (False, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(BODY) + BODY))]
    else:
        half = len(BODY) // 2
        pieces = [(True, http2.H2_PREFACE)] + [x for k in range(1, 2 * n, 2) for x in ((True, frame(1, 5, k, bytes.fromhex("828684") + b"\x41\x01h")), (False, frame(1, 4, k, b"\x88") + frame(0, 0, k, BODY[:half]) + frame(0, 8, k, b"\x00" + BODY[half:-1]) + frame(0, 1, k, BODY[-1:])))]
    schema = to_arrow_schema(StructType.fromDDL(FLOW))
    got = [r for b in _decode(wire(pieces, swap), schema, {}, None) for r in b.to_pylist()]
    assert len(got) == n and {(r["protocol"], r["status"], r["error"], r["reason"], r["gaps"]) for r in got} == {(kind, 200, "", None, 0)}
    assert all(r["response_body"] == BODY for r in got)
    assert {r["bytes_down"] for r in got} == {sum(len(d) for up, d in pieces if not up)} and [r["id"] for r in got] == [f"s-1-{k}" for k in range(n)]
