from datetime import UTC, datetime

import pytest

from flowloom.functions.flows import display_host
from flowloom.functions.regexes import PatternError, translate
from flowloom.plans import filters
from flowloom.plans.paging import Cursor, query_flows
from flowloom.plans.search import status_ranges, time_micros
from flowloom.plans.side import SideTables


def test_parse():
    t = filters.parse("~m get !~c 5 ! x !~q !")
    assert [(x.name, x.argument, x.negated) for x in t] == [("~m", "get", False), ("~c", "5", True), ("~u", "x", True), ("~q", "", True)]
    assert filters.parse("  ") == [] and filters.parse(None) == []
    assert filters.parse("~zz")[0].name == "~u"
    for bad, dialect in (("~m", "flow"), ("~zz", "message"), ("~meta", "flow")):
        with pytest.raises(filters.FilterError):
            filters.parse(bad, dialect)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"(a)\1", "a++", "(?>a)", r"\k<n>", "[a", "[[:nope:]]", "a\\"])
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


def test_translation(spark):
    rows = spark.createDataFrame([("abc\n",), ("ÄB",), ("a\rb",), ("a[b",), ("x&&y",)], "s string")
    hits = lambda p: [r.s for r in rows.filter(rows.s.rlike(translate(p))).collect()]
    assert hits("abc$") == [] and hits("äb") == ["ÄB"] and hits("a.b") == ["a\rb", "a[b"] and hits("[[]b") == ["a[b"] and hits("x[&]&y") == ["x&&y"]


FLOW = dict(id="1", scheme="https", method="GET", authority="api.example.com", path="/v1/things", query="page=2", status=200, content_type="application/json", connection_id="12", stream_id="3", protocol="HTTP/2", req_body_ref="q", resp_body_ref="r", ts_micros=5, frame_number=1)


@pytest.fixture(scope="module")
def one(spark):
    ddl = "id string, scheme string, method string, authority string, path string, query string, status int, content_type string, connection_id string, stream_id string, protocol string, req_body_ref string, resp_body_ref string, ts_micros long, frame_number long"
    df = spark.createDataFrame([FLOW], ddl)
    c = spark.createDataFrame
    return df, SideTables(
        headers=c([("1", 0, 0, "User-Agent", "probe"), ("1", 0, 1, "x-api-key", "secret"), ("1", 1, 0, "server", "nginx"), ("1", 1, 0, "server", "nginx")], "flow_id string, response int, ord int, name string, value string"),
        metadata=c([("1", "proxy_provider", "acme")], "record_id string, key string, value string"), tags=c([("t", "auth", True)], "id string, name string, is_favorite boolean"), record_tags=c([("1", "t"), ("1", "unknown")], "record_id string, tag_id string"),
        groups=c([("g", "api")], "id string, name string"), group_members=c([("1", "g")], "record_id string, group_id string"), marks=c([("1", "red")], "record_id string, color string"), comments=c([("1", 2, "b"), ("1", 1, "a")], "record_id string, created_at int, body string"),
        blobs=c([("q", b'{"user":"alice"}'), ("r", b"\xfftoken")], "sha256 string, bytes binary"),
    )


@pytest.mark.parametrize(
    ("expression", "held"),
    [
        ("", True), ("~m ^get$", True), ("~d EXAMPLE", True), ("~u things\\?page=2$", True), ("^https://api", True), ("~c 200", True), ("~t json$", True), ("~conn 12 ~stream 3", True), ("~proto http/2", True), ("~mark red", True), ("~tag auth.unknown", True), ("~group api", True), ("~comment ^a.b$", True), ("~fav", True),
        ("~meta proxy_provider=ACME", True), ("~meta proxy_provider", True), ("~meta other", False), ("~meta other=^$", True), ("~h secret", True), ("~hq ^user-agent", True), ("~hq ^x-api", False), ("~hs nginx$", False), ("~hs nginx", True), ("~b alice ~b token", True), ("~bs .token", True), ("~bq token", False), ("~s", True), ("~q", False), ("!~q !~m post", True), ("~c 404", False),
    ],
)
def test_terms(one, expression, held):
    assert filters.apply_filter(one[0], expression, one[1]).count() == int(held)


def test_bad_pattern_fails_before_a_job(one):
    with pytest.raises(filters.FilterError):
        filters.apply_filter(one[0], "~m (", one[1])


def test_hosts(spark):
    rows = spark.createDataFrame([("xn--mnchen-3ya.de:443",), ("plain.de",), ("a.XN--MNCHEN-3YA.xn--",), ("xn--99999999",), (None,), ("",)], "authority string")
    assert [r[0] for r in rows.select(display_host(rows.authority)).collect()] == ["münchen.de:443", None, "a.MüNCHEN.xn--", None, None, None]


def test_statuses_times_cursors():
    assert status_ranges("401,403,4xx,40x,500-503") == [(401, 401), (403, 403), (400, 499), (400, 409), (500, 503)]
    assert status_ranges(" 401 403,, 5XX,") == [(401, 401), (403, 403), (500, 599)] and status_ranges("") == []
    now = datetime(2026, 2, 3, 12, 30, tzinfo=UTC)
    assert time_micros("-15M", now) == time_micros("- 15 m", now) == time_micros("12:15", now)
    for bad in ("4", "abc", "500-400", "xx4", "4x"):
        with pytest.raises(ValueError):
            status_ranges(bad)
    assert time_micros("1770000000") == time_micros(1770000000000) == 1770000000000000
    with pytest.raises(ValueError):
        time_micros("yesterday")
    assert Cursor.of("5:6:a:b") == Cursor(5, 6, "a:b") and Cursor.of("5:6").id is None
    with pytest.raises(ValueError):
        Cursor.of("x")


def test_pages_cover_all_rows_once(spark):
    rows = [(f"f{k:03d}", k // 7, 0 if k % 3 else None, "GET", "HTTP/1.1") for k in range(60)]
    df = spark.createDataFrame(rows, "id string, ts_micros long, frame_number long, method string, protocol string")
    seen, after = [], None
    for _ in range(20):
        page = query_flows(df, "~m get", limit=13, after=after)
        seen += [r.id for r in page.rows.collect()]
        after = page.next
        if after is None:
            break
    assert sorted(seen) == [r[0] for r in rows] and len(seen) == 60
