"""Queries of the filter language (flows and messages) and of paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import load
from flowloom.functions.flows import hidden, url
from flowloom.functions.regexes import matches
from flowloom.operators.versions import latest
from flowloom.plans import filters, paging, side
from flowloom.queries import adapter as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _filter(name: str, expression: str, predicate: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = a.flows(spark, sf_dir)
        return filters.apply_filter(f, expression, a.tables(spark, sf_dir, f)).select("id")

    QUERIES[name] = run
    SQL[name] = f"WITH {a.SQL_FLOWS}, {a.SQL_SIDE} SELECT id FROM u WHERE {predicate}"


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({column}, ''), '{pattern}', 'i')"


def _exists(table: str, predicate: str, key: str = "record_id") -> str:
    return f"EXISTS (SELECT 1 FROM {table} WHERE {table}.{key} = u.id AND {predicate})"


_TAGS = {"auth": "ts_micros % 11 = 0", "slow": "coalesce(duration_micros > 300000, false)", "Favorite": "ts_micros % 97 = 0"}
_filter("B1_method", "~m ^(post|put)$", _re("method", "^(post|put)$"))
_filter("B2_domain", r"~d ^(api|cdn)\.", _re("authority", r"^(api|cdn)\."))
_filter("B3_url_bare", r"^https://[a-z]+\.[a-z]+\.test/ ~u a", f"{_re('url', r'^https://[a-z]+\.[a-z]+\.test/')} AND {_re('url', 'a')}")
_filter("B4_status", "~c ^4|^$", _re("CASE WHEN coalesce(status, 0) = 0 THEN '' ELSE CAST(status AS VARCHAR) END", "^4|^$"))
_filter("B5_content_type", "~t ^TEXT/", _re("content_type", "^TEXT/"))
_filter("B6_connection_stream", "~conn ^3 ~stream [13579]$", f"{_re('connection_id', '^3')} AND {_re('stream_id', '[13579]$')}")
_filter("B7_protocol", "~proto http/[23]", _re("protocol", "http/[23]"))
_filter("B8_mark", "~mark ^red$", "ts_micros % 13 = 0")
_filter("B9_tag_group", "~tag auth ~group ^api$", f"{_TAGS['auth']} AND protocol = 'HTTP/2'")
_filter("B10_comment", "~comment look.second", "ts_micros % 101 = 0")
_filter("B11_meta_pattern", "~meta proxy_provider=^acme$", _exists("meta", "key = 'proxy_provider' AND value = 'acme'"))
_filter("B11_meta_absent_matches_empty", "~meta conn.outcome=^(tcp.*)?$", "NOT " + _exists("meta", "key = 'conn.outcome' AND value = 'tls_rejected'"))
_filter("B12_meta_key", "~meta conn.outcome ~meta proxy_provider=", _exists("meta", "key = 'conn.outcome'") + " AND " + _exists("meta", "key = 'proxy_provider'"))
_filter("B13_headers", r"~h ^host|sid=0", _exists("ht", r"regexp_matches(txt, '^host|sid=0', 'i')", "flow_id"))
_filter("B13_request_headers", r"~hq accept-language:.en", _exists("ht", r"response = 0 AND regexp_matches(txt, 'accept-language:.en', 'i')", "flow_id"))
_filter("B13_response_headers_not", "! ~hs set-cookie ~hs .", "NOT " + _exists("ht", "response = 1 AND regexp_matches(txt, 'set-cookie', 'i')", "flow_id") + " AND " + _exists("ht", "response = 1 AND regexp_matches(txt, '.')", "flow_id"))
_filter("B14_body", r"~bs the.*memory", "EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = u.resp_body_ref AND regexp_matches(coalesce(d.text, ''), 'the.*memory', 'i'))")
_filter("B15_has_response", "~s", "coalesce(status, 0) <> 0")
_filter("B15_pending", "~q", "coalesce(status, 0) = 0")
_filter("B16_favorite", "~fav", _TAGS["Favorite"])
_filter("B17_negation", "!~c ^2 ! ~m get !", f"NOT {_re('CASE WHEN coalesce(status, 0) = 0 THEN chr(0) ELSE CAST(status AS VARCHAR) END', '^2')} AND NOT {_re('method', 'get')}")
_filter("B18_cost_order", "~bs data ~hs . ~mark . ~m GET", f"EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = u.resp_body_ref AND regexp_matches(coalesce(d.text, ''), 'data', 'i')) AND {_exists('ht', 'response = 1', 'flow_id')} AND {_exists('marks', 'true')} AND {_re('method', 'GET')}")


def B19_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return paging.hidden_flows(f, a.tables(spark, sf_dir, f))


SQL["B19_hidden"] = f"WITH {a.SQL_FLOWS}, {a.SQL_SIDE} SELECT id FROM u WHERE coalesce(protocol = 'DNS', false) OR {_exists('meta', "key = 'conn.outcome' AND value = 'tls_rejected'")}"

_HINTED = ["~d a & ~c 200", "(~d a)", "200", "~d 'example.com'", "~m", "~d ok"]


def B20_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e, len(filters.hints(e))) for e in _HINTED], "expression string, n_hints int")


SQL["B20_hints"] = "SELECT * FROM (VALUES ('~d a & ~c 200', 1), ('(~d a)', 1), ('200', 1), ('~d ''example.com''', 1), ('~m', 0), ('~d ok', 0)) AS t(expression, n_hints)"

_PATTERNS = [r"[[:digit:]]{3,}\.", r"^api\.", r"\.test$", r"(?P<x>zeb|quill)", r"\btelemetry\b", r"[^\s.]{12}", r"x*n--|\x2eedge\x2e", r"A.+Z"]


def B21_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows").select("authority")
    counts = f.agg(*[F.count_if(matches(F.col("authority"), p)).alias(f"n{i}") for i, p in enumerate(_PATTERNS)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n{i}").alias("n")) for i, p in enumerate(_PATTERNS)])).alias("x")).select("x.*")


SQL["B21_patterns"] = " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE regexp_matches(coalesce(authority, ''), '{p}', 'i')) AS n FROM flows" for p in _PATTERNS)


def B22_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    t = a.tables(spark, sf_dir, f)
    return side.tag_texts(t.record_tags, t.tags).select("record_id", "tag_text", "favorite")


SQL["B22_names"] = f"""WITH {a.SQL_FLOWS}, t AS (
  SELECT id, 't-auth' AS tag_id, 'auth' AS name FROM cur WHERE {_TAGS['auth']} UNION ALL SELECT id, 't-slow', 'slow' FROM cur WHERE {_TAGS['slow']} UNION ALL SELECT id, '__favorite__', 'Favorite' FROM cur WHERE {_TAGS['Favorite']})
SELECT id AS record_id, string_agg(name, ' ' ORDER BY tag_id) AS tag_text, bool_or(name = 'Favorite') AS favorite FROM t GROUP BY id"""


def _messages(name: str, expression: str, predicate: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.apply_filter(a.messages(spark, sf_dir), expression, None, "message").select("id", "flow_id")

    QUERIES[name] = run
    SQL[name] = f"WITH {a.SQL_MESSAGES} SELECT id, flow_id FROM msg WHERE {predicate}"


_messages("C1_payload", r'"k":.?1 ~b 3', f"""{_re("payload", '"k":.?1')} AND {_re("payload", "3")}""")
_messages("C2_opcode", "~op ^ping$", "opcode = 'ping'")
_messages("C3_from", "!~from client ~op text", "NOT from_client AND opcode = 'text'")


def C4_message_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    meta = m.select(F.col("id").alias("record_id"), F.lit("parity").alias("key"), (F.col("frame_number") % 2).cast("string").alias("value"))
    return filters.apply_filter(m, "~meta parity=1 ~meta parity", side.SideTables(metadata=meta), "message").select("id")


SQL["C4_message_meta"] = f"WITH {a.SQL_MESSAGES} SELECT id FROM msg WHERE frame_number % 2 = 1"


def C5_message_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.messages(spark, sf_dir)
    marks = m.filter("frame_number % 5 = 0").select(F.col("id").alias("record_id"), F.lit("red").alias("color"))
    return filters.apply_filter(m, "~mark red !~fav", side.SideTables(marks=marks), "message").select("id")


SQL["C5_message_annotations"] = f"WITH {a.SQL_MESSAGES} SELECT id FROM msg WHERE frame_number % 5 = 0"


def C6_unknown_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    def error(e: str, dialect: str) -> bool:
        try:
            filters.parse(e, dialect)
        except filters.FilterError:
            return True
        return False

    return spark.createDataFrame([(e, d, error(e, d)) for e, d in (("~zz x", "message"), ("~zz x", "flow"), ("~b", "message"), ("", "message"))], "expression string, dialect string, refused boolean")


SQL["C6_unknown_term"] = "SELECT * FROM (VALUES ('~zz x', 'message', true), ('~zz x', 'flow', false), ('~b', 'message', true), ('', 'message', false)) AS t(expression, dialect, refused)"


def C7_flow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.messages(spark, sf_dir).filter("flow_id = 'u7'").orderBy("ts_micros", "frame_number").select("id", "ts_micros", "from_client", "opcode", "payload")


SQL["C7_flow_messages"] = f"WITH {a.SQL_MESSAGES} SELECT id, ts_micros, from_client, opcode, payload FROM msg WHERE flow_id = 'u7'"


def C8_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side.message_counts(filters.apply_filter(a.messages(spark, sf_dir), "~op text", None, "message")).select("record_id", "message_count")


SQL["C8_message_counts"] = f"WITH {a.SQL_MESSAGES} SELECT flow_id AS record_id, count(*) AS message_count FROM msg WHERE opcode = 'text' GROUP BY ALL"

_ORDER = "ts_micros, coalesce(frame_number, 0), id"
_HIDDEN = "(coalesce(protocol = 'DNS', false) OR ts_micros % 37 = 0)"


def _page(spark: SparkSession, sf_dir: str, expression: str = "", **more: object) -> paging.Page:
    f = a.flows(spark, sf_dir)
    return paging.query_flows(f, expression, a.tables(spark, sf_dir, f), **more)


def D1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "~m get", limit=100).rows.select("id", "ts_micros", "authority")


SQL["D1_timeline"] = f"WITH {a.SQL_FLOWS} SELECT id, ts_micros, authority FROM (SELECT * FROM u ORDER BY {_ORDER} LIMIT 20000) WHERE {_re('method', 'get')} AND NOT {_HIDDEN} ORDER BY {_ORDER} LIMIT 100"


def D2_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _page(spark, sf_dir, "~s", limit=100)
    return _page(spark, sf_dir, "~s", limit=100, after=first.next).rows.select("id", "ts_micros")


_RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY {0}) AS rn FROM u), p1 AS (SELECT rn FROM r WHERE rn <= 20000 AND {1} ORDER BY rn LIMIT {2}), p2 AS (SELECT * FROM r WHERE rn > (SELECT max(rn) FROM p1) AND rn <= (SELECT max(rn) + 20000 FROM p1) AND {1} ORDER BY rn LIMIT {2})"
SQL["D2_keyset"] = f"WITH {a.SQL_FLOWS}, {_RANKED.format(_ORDER, f'coalesce(status, 0) <> 0 AND NOT {_HIDDEN}', 100)} SELECT id, ts_micros FROM p2"


def D3_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return f.filter(paging.in_window(1770700000000000, 1770900000000000)).select("id", "ts_micros")


SQL["D3_window"] = f"WITH {a.SQL_FLOWS} SELECT id, ts_micros FROM u WHERE ts_micros BETWEEN 1770700000000000 AND 1770900000000000"


def _counts(spark: SparkSession, p: paging.Page) -> DataFrame:
    return spark.createDataFrame([(p.matched, p.hidden_matched, p.scanned, p.capped, p.next is not None, p.prev is not None)], "matched long, hidden_matched long, scanned long, capped boolean, has_next boolean, has_prev boolean")


def D4_scan_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, _page(spark, sf_dir, "~c ^[345]", cap=500, limit=50))


SQL["D4_scan_cap"] = f"""WITH {a.SQL_FLOWS}, s AS (SELECT * FROM u ORDER BY {_ORDER} LIMIT 500), m AS (SELECT *, {_HIDDEN} AS h FROM s WHERE {_re('CASE WHEN coalesce(status, 0) = 0 THEN chr(0) ELSE CAST(status AS VARCHAR) END', '^[345]')})
SELECT (SELECT count(*) FROM m WHERE NOT h) AS matched, (SELECT count(*) FROM m WHERE h) AS hidden_matched, 500::BIGINT AS scanned, true AS capped, true AS has_next, false AS has_prev"""


def D5_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, _page(spark, sf_dir, "~d quill", since=1769900000000000, limit=10, cap=2_000_000))


SQL["D5_page_counts"] = f"""WITH {a.SQL_FLOWS}, s AS (SELECT * FROM u WHERE ts_micros >= 1769900000000000), m AS (SELECT *, {_HIDDEN} AS h FROM s WHERE {_re('authority', 'quill')})
SELECT (SELECT count(*) FROM m WHERE NOT h) AS matched, (SELECT count(*) FROM m WHERE h) AS hidden_matched, (SELECT count(*) FROM s) AS scanned, false AS capped, (SELECT count(*) FROM m WHERE NOT h) > 10 AS has_next, false AS has_prev"""


def D6_exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_page(spark, sf_dir, "", cap=100, limit=10).matched,)], "matched long")


SQL["D6_exact_count"] = f"WITH {a.SQL_FLOWS} SELECT count(*) AS matched FROM u WHERE NOT {_HIDDEN}"


def D7_include_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "~proto DNS", include_hidden=True, limit=200).rows.select("id", "protocol")


SQL["D7_include_hidden"] = f"WITH {a.SQL_FLOWS}, s AS (SELECT * FROM u ORDER BY {_ORDER} LIMIT 20000) SELECT id, protocol FROM s WHERE {_re('protocol', 'DNS')} ORDER BY {_ORDER} LIMIT 200"


def D8_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _page(spark, sf_dir, "~m get", last=True, limit=60)
    return _page(spark, sf_dir, "~m get", before=end.prev, limit=60).rows.select("id", "ts_micros")


_BACK = "ts_micros DESC, coalesce(frame_number, 0) DESC, id DESC"
SQL["D8_backward"] = f"WITH {a.SQL_FLOWS}, {_RANKED.format(_BACK, _re('method', 'get') + f' AND NOT {_HIDDEN}', 60)} SELECT id, ts_micros FROM p2"


def D9_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _page(spark, sf_dir, "~m post", limit=5)
    second = _page(spark, sf_dir, "~m post", limit=5, after=first.next)
    back = _page(spark, sf_dir, "~m post", limit=5, before=second.prev)
    end = _page(spark, sf_dir, "~m post", limit=5, last=True)
    rows = [("first", first), ("second", second), ("back", back), ("last", end)]
    return spark.createDataFrame([(n, p.prev.id if p.prev else None, p.next.id if p.next else None) for n, p in rows], "page string, prev_id string, next_id string")


SQL["D9_cursors"] = f"""WITH {a.SQL_FLOWS}, m AS (SELECT id, row_number() OVER (ORDER BY {_ORDER}) AS n, count(*) OVER () AS c FROM u WHERE {_re('method', 'post')} AND NOT {_HIDDEN}), w AS (SELECT * FROM m)
SELECT 'first' AS page, NULL AS prev_id, (SELECT id FROM w WHERE n = 5) AS next_id UNION ALL SELECT 'second', (SELECT id FROM w WHERE n = 6), (SELECT id FROM w WHERE n = 10)
UNION ALL SELECT 'back', NULL, (SELECT id FROM w WHERE n = 5) UNION ALL SELECT 'last', (SELECT id FROM w WHERE n = c - 4), NULL"""


def D10_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page(spark, sf_dir, "~tag slow", limit=50, hydrate=("tags", "marks", "metadata")).rows
    return rows.select("id", "tag_text", F.coalesce("mark_color", F.lit("")).alias("mark_color"), F.coalesce(F.try_element_at("metadata", F.lit("proxy_provider")), F.lit("")).alias("provider"))


SQL["D10_hydrated"] = f"""WITH {a.SQL_FLOWS} SELECT id, CASE WHEN ts_micros % 97 = 0 THEN 'Favorite ' ELSE '' END || CASE WHEN ts_micros % 11 = 0 THEN 'auth ' ELSE '' END || 'slow' AS tag_text,
CASE WHEN ts_micros % 13 = 0 THEN 'red' WHEN ts_micros % 17 = 0 THEN 'green' ELSE '' END AS mark_color, CASE WHEN ts_micros % 6 = 0 THEN 'acme' WHEN ts_micros % 3 = 0 THEN 'zeta' ELSE '' END AS provider
FROM (SELECT * FROM u ORDER BY {_ORDER} LIMIT 20000) WHERE coalesce(duration_micros > 300000, false) AND NOT {_HIDDEN} ORDER BY {_ORDER} LIMIT 50"""


def D11_tail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _page(spark, sf_dir, "~m get", limit=40).rows.select("id", "ts_micros", "frame_number", "method")
    tail = page.limit(40).select(F.when(F.col("ts_micros") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("live-"), "id")).alias("id"), (F.col("ts_micros") + 1).alias("ts_micros"), "frame_number", F.lit("LIVE").alias("method"))
    return paging.merge_tail(page, tail, 30)


SQL["D11_tail_merge"] = f"""WITH {a.SQL_FLOWS}, page AS (SELECT id, ts_micros, frame_number, method FROM (SELECT * FROM u ORDER BY {_ORDER} LIMIT 20000) WHERE {_re('method', 'get')} AND NOT {_HIDDEN} ORDER BY {_ORDER} LIMIT 40),
tail AS (SELECT 'live-' || id AS id, ts_micros + 1 AS ts_micros, frame_number, 'LIVE' AS method FROM page WHERE ts_micros % 2 = 1)
SELECT * FROM (SELECT * FROM page UNION ALL SELECT * FROM tail) ORDER BY {_ORDER} LIMIT 30"""


def D12_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return f.select("id", url().alias("url"), F.coalesce("request_bytes", F.lit(0)).alias("request_bytes"))


SQL["D12_summary"] = f"WITH {a.SQL_FLOWS} SELECT id, url, coalesce(request_bytes, 0) AS request_bytes FROM u"


def D13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paging.Cursor.of("12:3")
    s, d = paging.parse_session_token(paging.session_token("s1", paging.Cursor(5, 6, "x:y")))
    return spark.createDataFrame([(c.token(), s, d.token(), paging.clamp(0), paging.clamp(10**6))], "short string, session string, long_form string, least int, most int")


SQL["D13_tokens"] = "SELECT '12:3' AS short, 's1' AS session, '5:6:x:y' AS long_form, 100 AS least, 500 AS most"


def D14_undecoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.undecoded_page(a.undecoded(spark, sf_dir), "udp", "a", 50)[0].select("connection_id", "bytes_up", "bytes_down", "server", "sni", "reason", "first_ts")


SQL["D14_undecoded"] = f"WITH {a.SQL_FLOWS}, {a.SQL_UNDECODED} SELECT connection_id, bytes_up, bytes_down, server, sni, reason, first_ts FROM und WHERE reason = 'udp' AND (lower(coalesce(sni, '')) LIKE '%a%' OR lower(coalesce(server, '')) LIKE '%a%') ORDER BY bytes_up + bytes_down DESC, first_ts, connection_id LIMIT 50"


def D15_session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest(load(spark, sf_dir, "sessions"), ["id"], ["created_at"])
    return paging.sessions_by_group(s)


SQL["D15_session_groups"] = "SELECT nullif(trim(session_group), '') AS session_group, count(*) AS n_sessions FROM sessions GROUP BY ALL"


def A17_list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "sessions")
    live = a.flows(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("live_count"))
    return paging.list_sessions(s, live, 20, 10).select("id", "status", "created_at", "flow_count")


SQL["A17_list_sessions"] = f"WITH {a.SQL_FLOWS}, l AS (SELECT session_id, count(*) AS n FROM cur GROUP BY ALL) SELECT id, status, created_at, CASE WHEN status = 'open' AND n IS NOT NULL THEN n ELSE flow_count END AS flow_count FROM sessions LEFT JOIN l ON l.session_id = sessions.id ORDER BY created_at DESC, id LIMIT 20 OFFSET 10"

QUERIES |= {k: v for k, v in globals().items() if k[:1] in "ABCD" and k[1:2].isdigit() and callable(v)}
