"""Structured search, body grep, previews and overviews."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, tzinfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowloom.common import text
from flowloom.functions import flows as fx
from flowloom.functions.regexes import PatternError, check
from flowloom.plans import side
from flowloom.plans.paging import MOST, timeline

#: Encodings whose stored body is decoded text.
READABLE = ("", "identity", "gzip", "x-gzip", "br", "deflate", "zstd")


def status_ranges(spec: str) -> list[tuple[int, int]]:
    """'401,403', '400-499', '4xx', '40x', with commas or spaces between, as inclusive ranges; ValueError for anything else. Empty parts don't count."""
    out = []
    for part in re.split(r"[,\s]+", spec.strip().lower()):
        if not part:
            continue
        low, dash, high = part.partition("-")
        if re.fullmatch(r"\d{3}", low) and (not dash or re.fullmatch(r"\d{3}", high)):
            out.append((int(low), int(high or low)))
        elif re.fullmatch(r"\d(?:xx|\dx)", part):
            out.append((int(part.replace("x", "0")), int(part.replace("x", "9"))))
        else:
            raise ValueError(f"bad status {part!r}: 404, 400-499, 4xx or 40x")
        if out[-1][0] > out[-1][1]:
            raise ValueError(f"empty status range {part!r}")
    return out


def in_status(spec: str, status: Column) -> Column:
    """Whether a status is in the set; a blank set is no criterion."""
    ranges = status_ranges(spec)
    held = F.lit(not ranges)
    for low, high in ranges:
        held = held | status.between(low, high)
    return F.coalesce(held, F.lit(False))


def time_micros(value: str | float, now: datetime | None = None, zone: tzinfo = UTC) -> int:
    """Microseconds since the epoch of an ISO time, HH:MM[:SS] today, -15m (s, m, h, d in either case), or an epoch in s, ms or us by its
    size. Times without an offset are in ``zone``: UTC unless the caller names its own."""
    now = now or datetime.now(zone)
    s = str(value).strip()
    if re.fullmatch(r"\d+(\.\d+)?", s):
        x = float(s)
        return int(x * 1_000_000) if x < 1e11 else int(x * 1000) if x < 1e14 else int(s.partition(".")[0])
    if m := re.fullmatch(r"-\s*(\d+)\s*([smhd])", s.lower()):
        at = now - timedelta(seconds=int(m.group(1)) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)])
    elif m := re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", s):
        at = now.replace(hour=int(m.group(1)), minute=int(m.group(2)), second=int(m.group(3) or 0), microsecond=0)
    else:
        try:
            at = datetime.fromisoformat(s)
        except ValueError:
            raise ValueError(f"bad time {value!r}") from None
        at = at if at.tzinfo else at.replace(tzinfo=zone)
    d = at.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


CRITERIA = ("method", "host", "url", "path", "status", "content_type", "user_agent", "header", "body", "since", "until", "websocket", "protocol")


def criteria(unknown_ok: bool = False, **given: object) -> dict[str, object]:
    """The criteria that are set; an unknown name is an error that lists the known ones."""
    bad = sorted(set(given) - set(CRITERIA))
    if bad and not unknown_ok:
        raise TypeError(f"unknown parameter {', '.join(bad)}; accepted: {', '.join(CRITERIA)}")
    return {k: v for k, v in given.items() if v not in (None, "") and k in CRITERIA}


def search(flows: DataFrame, tables: side.SideTables | None = None, **given: object) -> DataFrame:
    """Flows that meet all criteria. Texts are substrings without regard to case; method is the whole word; status a set.
    Criteria on own columns are applied before headers, and these before bodies are joined."""
    want, t = criteria(**given), tables or side.SideTables()
    has = lambda c, k: F.contains(F.lower(text(c)), F.lit(str(want[k]).lower()))
    rows, columns = flows, flows.columns
    plain = {"host": "authority", "path": "path", "content_type": "content_type", "user_agent": "user_agent", "protocol": "protocol"}
    for k, c in plain.items():
        if k in want:
            rows = rows.filter(has(F.col(c), k))
    if "method" in want:
        rows = rows.filter(F.upper(text(F.col("method"))) == str(want["method"]).upper())
    if "url" in want:
        rows = rows.filter(has(fx.url(), "url"))
    if "status" in want:
        rows = rows.filter(in_status(str(want["status"]), F.col("status")))
    if "since" in want:
        rows = rows.filter(F.col("ts_micros") >= time_micros(want["since"]))
    if "until" in want:
        rows = rows.filter(F.col("ts_micros") <= time_micros(want["until"]))
    if "websocket" in want:
        rows = side.attach(rows, t, {"messages"}).filter(F.coalesce("websocket", F.lit(False)) == bool(want["websocket"]))
    if "header" in want:
        rows = side.attach(rows, t, {"headers"}).filter(has(F.col("request_header_text"), "header") | has(F.col("response_header_text"), "header"))
    if "body" in want:
        rows = side.attach(rows, t, {"request_body", "response_body"}).filter(has(F.col("request_body_text"), "body") | has(F.col("response_body_text"), "body"))
    return rows.select(*columns)


def search_sessions(flows: DataFrame, sessions: DataFrame, limit: int = 50, per_session: int = MOST, **given: object) -> tuple[DataFrame, DataFrame]:
    """Search over all sessions in one plan: (rows newest session first, exact totals per session). A session shows at most ``per_session`` rows,
    which are chosen in the timeline's order; totals count all."""
    found = search(flows, None, **given)
    totals = found.groupBy("session_id").agg(F.count("*").alias("total"))
    newest = sessions.select(F.col("id").alias("session_id"), F.col("created_at").alias("session_created"))
    if per_session < min(limit, MOST):  # else the limit alone bounds every session
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy("session_id").orderBy(*timeline()))).filter(F.col("__n") <= per_session).drop("__n")
    rows = found.join(newest, "session_id").orderBy(F.col("session_created").desc(), "session_id", *timeline()).limit(min(limit, MOST)).drop("session_created")
    return rows, totals


def grep_bodies(bodies: DataFrame, pattern: str, *, key: str = "id", column: str = "bytes", max_hits: int = 3, context: int = 80) -> DataFrame:
    """key, size, count, hits (array of byte_offset and text around it) of every body, also of those without a hit (count 0).

    The pattern is one of Python's ``re`` over the raw bytes, without regard to case, and is compiled before any job (PatternError).
    At most ``max_hits`` (0-50) hits of a body are shown, count is of all; ``context`` (0-2000) bytes on both
    sides, white space collapsed. Bodies reach Python in Arrow batches; a NULL body has size 0 and no hit.
    """
    source = pattern.encode()
    try:
        re.compile(source, re.I)
    except re.error as e:
        raise PatternError(f"bad pattern {pattern!r}: {e}") from None
    shown, around = min(max(max_hits, 0), 50), min(max(context, 0), 2000)
    kind = f"`{key}` {dict(bodies.dtypes)[key]}, size long, count long, hits array<struct<byte_offset:long,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(source, re.I)
        hit_type = pa.list_(pa.struct([("byte_offset", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            sizes, counts, hits = [], [], []
            for body in batch.column(1):
                data, n, some = body.as_py() or b"", 0, []
                for m in find.finditer(data):
                    n += 1
                    if len(some) < shown:
                        part = data[max(0, m.start() - around) : m.end() + around]
                        some.append({"byte_offset": m.start(), "text": re.sub(r"\s+", " ", part.decode("utf-8", "replace"))})
                sizes.append(len(data))
                counts.append(n)
                hits.append(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, hit_type)], names=[key, "size", "count", "hits"])

    return bodies.select(key, F.col(column).cast("binary")).mapInArrow(run, kind)


def grep_summary(found: DataFrame) -> DataFrame:
    """count, with_hits, without_hits of what ``grep_bodies`` gave."""
    return found.agg(F.count("*").alias("count"), F.count_if(F.col("count") > 0).alias("with_hits"), F.count_if(F.col("count") == 0).alias("without_hits"))


def grep_counts(bodies: DataFrame, pattern: str, key: str = "id", column: str = "bytes") -> DataFrame:
    """key, count without leaving the JVM, for patterns of the linear-time family (``regexes``), over text."""
    return bodies.select(key, F.regexp_count(F.col(column).cast("string"), F.lit(check(bodies.sparkSession, pattern))).cast("long").alias("count")).filter("count > 0")


def unsearchable_bodies(flows: DataFrame, limit: int = 20) -> DataFrame:
    """encoding, n of bodies kept in an encoding that search can't read."""
    both = flows.select(F.explode(F.array(F.lower(F.trim(text(F.col("req_content_encoding")))), F.lower(F.trim(text(F.col("resp_content_encoding")))))).alias("encoding"))
    return both.filter(~F.col("encoding").isin(*READABLE)).groupBy("encoding").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "encoding").limit(limit)


def bodies_in_files(bodies: DataFrame, column: str = "bytes") -> DataFrame:
    """bodies_in_files: how many bodies are held by reference only, so that their bytes aren't in the table."""
    return bodies.agg(F.count_if(F.col(column).isNull()).alias("bodies_in_files"))


def page_timeline(page: DataFrame, cut_at: int = 120) -> DataFrame:
    """seq, id, t_ms (since the earliest positive time of the page, to 0.1), target, kind. page: rows of one page."""
    first = F.min(F.when(F.col("ts_micros") > 0, F.col("ts_micros"))).over(Window.partitionBy())
    target = F.concat(text(F.col("path")), F.when(text(F.col("query")) == "", "").otherwise(F.concat(F.lit("?"), "query")))
    kind = F.lower(F.regexp_extract(text(F.col("content_type")), r"^[^/]*/([^;\s]+)", 1))
    return page.select(F.row_number().over(Window.orderBy(*timeline())).alias("seq"), "id", F.round((F.col("ts_micros") - first) / 1000, 1).alias("t_ms"), F.when(F.length(target) > cut_at, F.concat(F.substring(target, 1, cut_at), F.lit("…"))).otherwise(target).alias("target"), kind.alias("kind"))


PREVIEWED = ("url", "path", "request_header", "response_header", "request_body", "response_body")


def match_previews(page: DataFrame, tables: side.SideTables, **needles: str) -> DataFrame:
    """The rows of a page with a snippet of where each needle (of ``PREVIEWED``) was found, NULL where it wasn't, and for bodies the byte
    offset of its first occurrence, NULL where only letters beyond ASCII differ in case. Headers and bodies are joined only if asked for."""
    bad = sorted(set(needles) - set(PREVIEWED))
    if bad:
        raise TypeError(f"no preview of {', '.join(bad)}; there are {', '.join(PREVIEWED)}")
    want = {k: v for k, v in needles.items() if v}
    inputs = {"headers" if "header" in k else k for k in want if k not in ("url", "path")}
    rows, columns = side.attach(page, tables, inputs), page.columns
    hay = {"url": fx.url(), "path": F.col("path"), "request_header": F.col("request_header_text") if "headers" in inputs else None, "response_header": F.col("response_header_text") if "headers" in inputs else None}
    out = [F.col(c) for c in columns]
    for k, needle in want.items():
        text_ = hay[k] if k in hay else F.col(f"{k}_text")
        out.append(fx.snippet(text_, needle).alias(f"{k}_match"))
        if k.endswith("body"):
            # bytes before the first occurrence, with ASCII letters alone folded
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            at = F.locate(needle.translate(str.maketrans(upper, lower)), F.translate(text_, upper, lower))
            out.append(F.when(at > 0, F.octet_length(F.substring(text_, F.lit(1), at - 1))).alias(f"{k}_byte_offset"))
    return rows.select(*out)


OVERVIEW_CONNECTIONS, OVERVIEW_HOSTS = 2000, 15


def session_overview(flows: DataFrame, undecoded: DataFrame, tables: side.SideTables | None = None) -> DataFrame:
    """section, name, n, bytes, reasons: what a session holds (flows, hidden flows), what of it could not be decoded (by reason), and the
    hosts with most bytes among the ``OVERVIEW_CONNECTIONS`` largest undecoded connections, with their reasons."""
    from flowloom.operators.flow_joins import host_rollup

    h = side.one_metadata(flows.select("id", "protocol"), tables.metadata if tables else None, "conn.outcome")
    away = fx.hidden(F.col("protocol"), F.col("conn_outcome"))
    row = lambda df, section, name, n, size=F.lit(None), reasons=F.lit(""): df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"), size.cast("long").alias("bytes"), reasons.alias("reasons"))
    counts = h.agg(F.count("*").alias("flows"), F.count_if(away).alias("hidden"))
    both = counts.select(F.explode(F.array(F.struct(F.lit("shown and hidden").alias("k"), F.col("flows").alias("n")), F.struct(F.lit("hidden").alias("k"), F.col("hidden").alias("n")))).alias("x")).select("x.*")
    largest = undecoded.orderBy((F.col("bytes_up") + F.col("bytes_down")).desc(), "first_ts", "connection_id").limit(OVERVIEW_CONNECTIONS)
    hosts = host_rollup(largest, OVERVIEW_HOSTS)
    reasons = undecoded.groupBy("reason").agg(F.count("*").alias("n"))
    return row(both, "flows", F.col("k"), F.col("n")).unionByName(row(reasons, "undecoded", F.col("reason"), F.col("n"))).unionByName(row(hosts, "hosts", F.col("host"), F.col("connections"), F.col("bytes"), F.col("reasons")))


def gateway_status(sessions: DataFrame) -> DataFrame:
    """status, n, flows, pcap_bytes, keylog_bytes."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sessions.groupBy("status").agg(F.count("*").alias("n"), s("flow_count"), s("pcap_bytes"), s("keylog_bytes"))


def byte_window(body: Column, offset: int = 0, length: int = 262_144, encoding: str = "base64") -> Column:
    """Struct of data (base64, hex or utf-8 text), size, truncated: at most 256 KiB from offset on."""
    n = min(max(length, 0), 262_144)
    part = F.substring(body, offset + 1, n)
    data = {"base64": F.base64(part), "hex": F.lower(F.hex(part)), "utf-8": part.cast("string")}[encoding]
    return F.struct(data.alias("data"), F.length(body).alias("size"), (F.length(body) > offset + n).alias("truncated"))


def body_preview(body: Column) -> Column:
    """Up to 4096 characters of text, or 64 bytes in hex where the body isn't UTF-8."""
    is_text = F.is_valid_utf8(body.cast("string"))
    return F.when(is_text, F.substring(body.cast("string"), 1, 4096)).otherwise(F.lower(F.hex(F.substring(body, 1, 64))))


def advice(expression: str, matched: int, hidden_matched: int, scanned: int, capped: bool, unsearchable: list[tuple[str, int]] = ()) -> list[str]:
    """What a caller can try when nothing came back, the most likely cause first."""
    from flowloom.plans import filters

    out: list[str] = []
    if matched:
        return out
    if hidden_matched:
        out.append(f"{hidden_matched} hidden records match: include hidden ones to see them")
    out += filters.hints(expression)
    if capped:
        out.append(f"only {scanned} rows were examined: narrow the time window or go on from the cursor")
    terms = filters.parse(expression)
    if unsearchable and any(filters.FLOW_RULES[t.name].cost == filters.BODIES for t in terms):
        out.append("bodies can't be searched in these encodings: " + ", ".join(f"{e} ({n})" for e, n in unsearchable))
    if not out and scanned:
        out.append("no record matches: drop terms one by one, or negate one with ! to see what it excludes")
    return out


def pretty_body(body: bytes | None, content_type: str | None, width: int = 16, most: int = 65_536) -> str:
    """A body to read: JSON indented, forms one field a line, other text as it is, all of it; anything else as a hex dump, whose first
    ``most`` bytes are shown with a last line that tells how many follow."""
    import json
    from urllib.parse import parse_qsl

    if not body:
        return ""
    kind = (content_type or "").split(";")[0].strip().lower()
    try:
        shown = body.decode("utf-8")
    except UnicodeDecodeError:
        shown = None
    if shown is not None and (kind.endswith("json") or shown.lstrip()[:1] in ("{", "[")):
        try:
            return json.dumps(json.loads(shown), indent=2, ensure_ascii=False)
        except (ValueError, RecursionError):
            pass
    if shown is not None and kind == "application/x-www-form-urlencoded":
        return "\n".join(f"{k} = {v}" for k, v in parse_qsl(shown, keep_blank_values=True))
    if shown is not None and not re.search(r"[\x00-\x08\x0e-\x1f]", shown):
        return shown
    lines = []
    for at in range(0, min(len(body), most), width):
        row = body[at : at + width]
        lines.append(f"{at:08x}  {row.hex(' '):<{3 * width}} {''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}")
    if len(body) > most:
        lines.append(f"{len(body) - most} more bytes")
    return "\n".join(lines)


def pretty_bodies(bodies: DataFrame, key: str = "id", column: str = "bytes", kind: str = "content_type") -> DataFrame:
    """key and ``pretty`` of every body, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [pretty_body(b, k) for b, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=[key, "pretty"])

    return bodies.select(key, F.col(column).cast("binary"), kind).mapInArrow(run, f"`{key}` {dict(bodies.dtypes)[key]}, pretty string")
