"""Keyset paging over the timeline, with honest counts.

The timeline is ordered by (ts_micros, frame_number, id). A scan examines at most ``cap`` rows after
the cursor and inside the time window, before the filter; it is capped only if a further row
existed. Cursor and window are plain comparisons, which a scan pushes down, and the cap is a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowloom.functions.flows import hidden
from flowloom.plans import filters, side

DEFAULT_LIMIT, MOST, SCAN_CAP = 100, 500, 20_000

HEAVY = ("request_headers", "response_headers", "request_body_text", "response_body_text", "client_hellos")


def clamp(limit: int | None) -> int:
    return min(max(limit or DEFAULT_LIMIT, 1), MOST)


@dataclass(frozen=True, order=True)
class Cursor:
    ts_micros: int
    frame_number: int = 0
    id: str | None = None

    def token(self) -> str:
        return f"{self.ts_micros}:{self.frame_number}" + (f":{self.id}" if self.id is not None else "")

    @staticmethod
    def of(token: str) -> Cursor:
        """A token of two or three parts; the short form can't resume inside a tie."""
        parts = token.split(":", 2)
        if len(parts) < 2 or not all(p.lstrip("-").isdigit() for p in parts[:2]):
            raise ValueError(f"bad cursor {token!r}: ts:frame or ts:frame:id")
        return Cursor(int(parts[0]), int(parts[1]), parts[2] if len(parts) > 2 else None)


def session_token(session_id: str, cursor: Cursor) -> str:
    return f"{session_id}|{cursor.token()}"


def parse_session_token(token: str) -> tuple[str, Cursor]:
    session, bar, rest = token.partition("|")
    if not bar:
        raise ValueError(f"bad cursor {token!r}: session|ts:frame")
    return session, Cursor.of(rest)


def timeline() -> list[Column]:
    return [F.col("ts_micros"), F.coalesce(F.col("frame_number"), F.lit(0)), F.col("id")]


def beyond(cursor: Cursor, backward: bool = False) -> Column:
    """Strictly after (or before) the cursor; the first comparison alone can prune files."""
    ts, frame, id_ = timeline()
    more = (lambda a, b: a < b) if backward else (lambda a, b: a > b)
    tie = more(frame, F.lit(cursor.frame_number))
    if cursor.id is not None:
        tie = tie | ((frame == cursor.frame_number) & more(id_, F.lit(cursor.id)))
    edge = ts <= cursor.ts_micros if backward else ts >= cursor.ts_micros
    return edge & (more(ts, F.lit(cursor.ts_micros)) | ((ts == cursor.ts_micros) & tie))


def in_window(since: int = 0, until: int = 0) -> Column:
    """since <= ts_micros <= until, 0 meaning open."""
    c = F.lit(True)
    if since:
        c = c & (F.col("ts_micros") >= since)
    if until:
        c = c & (F.col("ts_micros") <= until)
    return c


def one_of(column: str, values: list[str]) -> Column:
    """column IN (values), as one expression."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"`{column}` IN ({', '.join(quoted)})")


@dataclass
class Page:
    rows: DataFrame
    matched: int
    hidden_matched: int
    scanned: int
    capped: bool
    next: Cursor | None
    prev: Cursor | None
    exact: bool = False
    hints: list[str] = field(default_factory=list)


def query_flows(
    flows: DataFrame, expression: str | None = "", tables: side.SideTables | None = None, *, after: Cursor | None = None, before: Cursor | None = None,
    last: bool = False, limit: int | None = None, cap: int = SCAN_CAP, since: int = 0, until: int = 0, include_hidden: bool = False, hydrate: tuple[str, ...] = (),
) -> Page:
    """One page of flows in timeline order.

    At most one of after, before and last. matched counts all matches of the scan that aren't hidden; without
    filter and window it is the exact count of the table instead, whatever the cursor. rows are
    the page's full rows without headers and bodies, with the side columns named by ``hydrate``. Matches are counted where they
    are found, in the job that picks the page, and only the page's ids reach the driver.
    """
    if (after is not None) + (before is not None) + last > 1:
        raise ValueError("give one of after, before and last")
    limit, tables, backward = clamp(limit), tables or side.SideTables(), last or before is not None
    terms = filters.parse(expression)
    lean = flows.filter(in_window(since, until))
    if after or before:
        lean = lean.filter(beyond(after or before, backward))
    order = [c.desc() for c in timeline()] if backward else timeline()
    scanned = lean.limit(cap + 1).count()
    capped = scanned > cap
    scan = lean.orderBy(*order).limit(cap) if capped else lean
    found = side.one_metadata(filters.apply_filter(scan, expression, tables), tables.metadata, "conn.outcome")
    marked = found.select("id", "ts_micros", "frame_number", F.coalesce("frame_number", F.lit(0)).alias("__frame"), hidden(F.col("protocol"), F.col("conn_outcome")).alias("__hidden"))
    counts = Observation()
    counted = marked.observe(counts, F.count("*").alias("n"), F.count_if("__hidden").alias("hidden"))
    picked = counted if include_hidden else counted.filter(~F.col("__hidden"))
    # another form of the same order: a scan that is sorted already would be read no further than the page, and the counts cut short
    place = F.struct("ts_micros", "__frame", "id")
    shown = picked.orderBy(place.desc() if backward else place).limit(limit + 1).collect()
    seen = counts.get
    matched = seen["n"] if include_hidden else seen["n"] - seen["hidden"]
    page = shown[:limit]
    more = len(shown) > limit or capped
    ends = [Cursor(r.ts_micros, r["__frame"], r.id) for r in (page[0], page[-1])] if page else [None, None]
    far = ends[1] if more and page and (len(page) == limit or capped) else None
    if backward:
        next_, prev = (None if last else ends[0]), far
    else:
        next_, prev = far, (ends[0] if after else None)
    # at most MOST ids, between the times of the page's ends
    times = sorted(r.ts_micros for r in page)
    rows = flows.filter(F.col("ts_micros").between(times[0], times[-1]) & one_of("id", [r.id for r in page])) if page else flows.filter(F.lit(False))
    rows = side.attach(rows, tables, set(hydrate)).drop(*HEAVY).orderBy(*timeline())
    exact = not terms and not since and not until
    if exact and (capped or after or before):
        matched = exact_count(flows, tables, include_hidden)
    return Page(rows, matched, seen["hidden"], min(scanned, cap), capped and not exact, next_, prev, exact, filters.hints(expression))


def exact_count(flows: DataFrame, tables: side.SideTables, include_hidden: bool = False) -> int:
    if include_hidden:
        return flows.count()
    away = hidden(F.col("protocol"), F.col("conn_outcome"))
    return side.one_metadata(flows.select("id", "protocol"), tables.metadata, "conn.outcome").agg(F.count_if(~away)).first()[0]


def hidden_flows(flows: DataFrame, tables: side.SideTables) -> DataFrame:
    rows = side.one_metadata(flows.select("id", "protocol"), tables.metadata, "conn.outcome")
    return rows.filter(hidden(F.col("protocol"), F.col("conn_outcome"))).select("id")


def merge_tail(stored: DataFrame, tail: DataFrame, limit: int, from_end: bool = False) -> DataFrame:
    """A stored page and live rows as one page: a stored row wins over a live one of its id, the order is the timeline,
    and the page is cut to ``limit`` rows at its head (or its end). Both inputs are pages of bounded size."""
    fresh = tail.join(stored.select("id"), "id", "left_anti")
    both = stored.unionByName(fresh, allowMissingColumns=True)
    if from_end:
        return both.orderBy(*[c.desc() for c in timeline()]).limit(limit).orderBy(*timeline())
    return both.orderBy(*timeline()).limit(limit)


def undecoded_page(undecoded: DataFrame, reason: str = "", host: str = "", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Connections without flows, largest first, and the counts by reason of the whole input before any filter."""
    size = F.col("bytes_up") + F.col("bytes_down")
    rows = undecoded
    if reason:
        rows = rows.filter(F.col("reason") == reason)
    if host:
        rows = rows.filter(F.lower(F.coalesce("sni", F.lit(""))).contains(host.lower()) | F.lower(F.coalesce("server", F.lit(""))).contains(host.lower()))
    return rows.orderBy(size.desc(), "first_ts", "connection_id").limit(limit or DEFAULT_LIMIT), undecoded.groupBy("reason").agg(F.count("*").alias("n"))


def list_sessions(sessions: DataFrame, live_counts: DataFrame | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; open sessions show their live flow count (session_id, live_count) where there is one."""
    if live_counts is not None:
        live = live_counts.select(F.col("session_id").alias("__s"), "live_count")
        sessions = sessions.join(live, sessions["id"] == live["__s"], "left").withColumn("flow_count", F.when((F.col("status") == "open") & F.col("live_count").isNotNull(), F.col("live_count")).otherwise(F.col("flow_count"))).drop("__s", "live_count")
    return sessions.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def sessions_by_group(sessions: DataFrame) -> DataFrame:
    """session_group, n_sessions: groups in alphabetical order without regard to case, those without a group last."""
    g = F.when(F.trim(F.coalesce("session_group", F.lit(""))) != "", F.trim("session_group"))
    return sessions.groupBy(g.alias("session_group")).agg(F.count("*").alias("n_sessions")).orderBy(F.col("session_group").isNull(), F.lower("session_group"), "session_group")
