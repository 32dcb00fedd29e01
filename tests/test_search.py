import pytest

from flowloom.functions.regexes import PatternError
from flowloom.operators import flow_joins as j
from flowloom.plans import search
from flowloom.plans.sqlgate import glob_pattern, with_globs


def test_grep_tells_misses_and_takes_lookaround(spark):
    rows = spark.createDataFrame([(1, b"one two  one"), (2, b""), (3, None), (4, "Ünë".encode())], "id long, bytes binary")
    got = {r.id: (r["size"], r["count"], [h.byte_offset for h in r.hits]) for r in search.grep_bodies(rows, "(?<!x)ONE", max_hits=1).collect()}
    assert got == {1: (12, 2, [0]), 2: (0, 0, []), 3: (0, 0, []), 4: (5, 0, [])}
    assert tuple(search.grep_summary(search.grep_bodies(rows, "one")).first()) == (4, 1, 3)
    for bad in ("(", "*a"):
        with pytest.raises(PatternError):
            search.grep_bodies(rows, bad)


def test_pretty_bodies_are_whole():
    text = '{"k": "' + "x" * 70_000 + '"}'
    assert len(search.pretty_body(text.encode(), "application/json")) == len(text) + 4
    assert search.pretty_body(b"\0" * 70_000, "").endswith("4464 more bytes") and search.pretty_body(b"\0", "").count("\n") == 0
    assert search.pretty_body(b"[" * 100_000, "application/json") == "[" * 100_000


def test_globs():
    assert glob_pattern("/[a-m]*.j?") == r"(?s)^\/[a-m].*\.j.$".replace(r"\/", "/")
    assert with_globs("SELECT 'x GLOB ''y''' AS a FROM t WHERE p GLOB 'a*'") == "SELECT 'x GLOB ''y''' AS a FROM t WHERE p RLIKE '(?s)^a.*$'"


def test_names_of_addresses(spark):
    answers = spark.createDataFrame([("1.1.1.1", k, f"n{k % 20:02d}") for k in range(40)] + [("1.1.1.1", 39, "zz"), (None, 1, "x"), ("2.2.2.2", 5, None)], "address string, ts_micros long, name string")
    seen = spark.createDataFrame([(1, "1.1.1.1", 0), (2, "1.1.1.1", 100), (3, "2.2.2.2", 9), (4, None, 9), (5, "1.1.1.1", None)], "id long, address string, ts_micros long")
    got = {r.id: (r.name, r.candidates) for r in j.names_of_addresses(seen, answers, bucket=7).collect()}
    assert got[1] == ("n00", []) and got[2] == ("zz", [f"n{k:02d}" for k in range(5, 20)]) and got[3] == got[4] == got[5] == (None, [])


def test_compare_and_streams(spark):
    ddl = "id string, method string, scheme string, authority string, path string, query string, status int, protocol string, user_agent string, ja3 string, ja4 string, http2_fingerprint string, tls_client_hello string"
    f = spark.createDataFrame([("a", "GET", "", "h", "/", "", 200, "x", "", None, "j", "", ""), ("b", "GET", None, "h", "/", None, 200, "x", None, "", "j", None, "")], ddl)
    h = spark.createDataFrame([("a", 0, 0, "Host", "h"), ("a", 0, 1, "Accept", "*"), ("b", 0, 0, "host", "h"), ("b", 0, 1, "accept", "q"), ("b", 1, 0, "server", "s")], "flow_id string, response int, ord int, name string, value string")
    assert tuple(j.compare_summary(j.compare_report(f, h, "a", "b")).first()) == (["response_header_order"], False)
    assert tuple(j.compare_summary(j.compare_report(f, h, "a", "a")).first()) == ([], True)
    streams = spark.createDataFrame([("s", "udp", "1:1", "2:2", "", 5, None), ("t", None, "1:1", "2:2", "name", 5, True)], "id string, transport string, src_addr string, dst_addr string, sni string, ts_micros long, tls_established boolean")
    m = spark.createDataFrame([("s", True, b"abc"), ("s", False, b"de")], "flow_id string, from_client boolean, payload binary")
    got = {r.id: r for r in j.stream_flows(streams, m).collect()}
    assert (got["s"].protocol, got["s"].authority, got["s"].request_bytes, got["s"].metadata["conn.outcome"], got["s"].metadata["conn.bytes_down"]) == ("UDP", "2:2", 3, "udp_undecoded", "2")
    assert (got["t"].protocol, got["t"].authority, got["t"].request_bytes, got["t"].tls_decrypted) == ("TCP", "name", 0, True)


def test_sql_budgets(spark):
    from flowloom.plans.sqlgate import BYTES, SqlGate, SqlRefused, SqlTimeout

    g = SqlGate(spark, {"t": lambda s: s.range(5000).toDF("k")})
    r = g.query("SELECT repeat('x', 2000) AS x FROM t", limit=2000)
    assert r.truncated and sum(map(len, r.rows)) <= BYTES < sum(map(len, r.rows)) + 2100
    with pytest.raises(SqlTimeout):
        g.query("SELECT count(*) AS n FROM t a CROSS JOIN t b WHERE hash(a.k, b.k) = 5", timeout=0.05)
    for refused in ("SELECT reflect('java.lang.System', 'nanoTime') AS x FROM t", "SELECT java_method('java.lang.System', 'nanoTime') AS x"):
        with pytest.raises(SqlRefused):
            g.dataframe(refused)
    assert not g.query("SELECT k FROM t WHERE k < 3").truncated


def test_raw_members_of_a_bundle(spark, tmp_path):
    from flowloom.sources import files

    (tmp_path / "a.pcap").write_bytes(b"\0\1packets")
    (tmp_path / "k.log").write_bytes(b"keys")
    folder = str(tmp_path / "bundle")
    files.export_files(spark, {"capture.pcap": str(tmp_path / "a.pcap"), "key.log": str(tmp_path / "k.log")}, folder)
    assert {r.member: bytes(r.content) for r in files.import_files(spark, folder).collect()} == {"capture.pcap": b"\0\1packets", "key.log": b"keys"}
    with pytest.raises(ValueError):
        files.export_files(spark, {"../x": str(tmp_path / "k.log")}, folder)
