"""Joins of the flow model, each as equi-joins on pre-aggregated sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowloom.common import text
from flowloom.functions.flows import url
from flowloom.plans.side import header_lists

REASONS = ("no_key", "handshake_incomplete", "unsupported", "unparsed", "udp")
MAX_RULES = 20_000


def redirect_sources(flows: DataFrame) -> DataFrame:
    """id, redirected_from_id: the first flow in timeline order whose redirect leads to this flow's URL; NULL where
    that flow is the row itself or there is none. Redirects are reduced to one source per URL before the join."""
    at = F.struct(F.col("ts_micros"), F.coalesce("frame_number", F.lit(0)), F.col("id"))
    first = flows.filter(text(F.col("redirect_location")) != "").groupBy(F.col("redirect_location").alias("__url")).agg(F.min_by("id", at).alias("__src"))
    joined = flows.select("id", url().alias("__u")).join(first, F.col("__u") == F.col("__url"), "left")
    return joined.select("id", F.when(F.col("__src") != F.col("id"), F.col("__src")).alias("redirected_from_id"))


def endpoint_pair(src: Column, dst: Column, proxy: Column) -> Column:
    """A key that is the same for both directions; the peer is the proxy where there is one."""
    peer = F.when(text(proxy) != "", proxy).otherwise(text(dst))
    return F.array_join(F.array_sort(F.array(text(src), peer)), "|")


def foreign_connections(dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """Endpoint pairs of dropped packets that no kept packet has."""
    return dropped.select("pair").distinct().join(kept.select("pair").distinct(), "pair", "left_anti")


def delete_by_connection(flows: DataFrame, connections: DataFrame) -> DataFrame:
    """Flows that don't run over one of the connections (column pair)."""
    keyed = flows.withColumn("__pair", endpoint_pair(F.col("src_addr"), F.col("dst_addr"), F.col("proxy_addr")))
    gone = connections.select(F.col("pair").alias("__pair")).distinct()
    return keyed.join(gone, "__pair", "left_anti").drop("__pair")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], bucket: int) -> DataFrame:
    """Left rows with the values of the last right row of their key at or before their time (NULL where none).

    Of right rows of one time the greatest values count. Times are cut into buckets: a row looks in its own
    bucket first and otherwise takes what was carried over the earlier buckets of its key, so a key with a large
    part of all rows is spread over its buckets; only one row per key and bucket is ever ordered per key.
    NULL keys match nothing; a NULL time has no match.
    """
    pay = F.struct(F.col("__t"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_time).alias("__t"), *values).filter(F.col("__t").isNotNull()).withColumn("__b", F.floor(F.col("__t") / F.lit(bucket)))
    rights = r.select(*keys, "__b", "__t", pay.alias("__p"), F.lit(0).alias("__side"), F.lit(None).cast(left_struct(left)).alias("__row"))
    lefts = left.select(*keys, F.floor(F.col(left_time) / F.lit(bucket)).alias("__b"), F.col(left_time).alias("__t"), F.lit(None).cast(rights.schema["__p"].dataType).alias("__p"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    both = rights.unionByName(lefts)
    seen = both.withColumn("__in", F.max("__p").over(Window.partitionBy(*keys, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))).filter("__side = 1")
    ends = rights.groupBy(*keys, "__b").agg(F.max("__p").alias("__end"))
    spots = ends.select(*keys, "__b", "__end").unionByName(lefts.select(*keys, "__b").distinct().withColumn("__end", F.lit(None).cast(rights.schema["__p"].dataType))).groupBy(*keys, "__b").agg(F.max("__end").alias("__end"))
    carried = spots.select(*keys, "__b", F.max("__end").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    joined = seen.join(carried, [*keys, "__b"], "left")
    best = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0, F.coalesce("__in", "__before"))
    return joined.select("__row.*", best.alias("__m")).select(*left.columns, *[F.col(f"__m.{v}").alias(v if v not in left.columns else f"{v}_asof") for v in values])


NAMES_KEPT = 16


def names_of_addresses(connections: DataFrame, answers: DataFrame, bucket: int = 3_600_000_000) -> DataFrame:
    """connections (address, ts_micros and any more columns) with the name that the last answer for their address at or before their time
    gave, and ``candidates``, the other different names of the last ``NAMES_KEPT`` answers, sorted.

    answers: address, ts_micros, name; of answers of one time the greatest name counts as the last. NULL addresses match nothing.
    """
    last = Window.partitionBy("address").orderBy("ts_micros", "name").rowsBetween(1 - NAMES_KEPT, 0)
    known = answers.select("address", "ts_micros", "name").filter(F.col("address").isNotNull() & F.col("name").isNotNull()).distinct()
    history = known.withColumn("__names", F.collect_list("name").over(last))
    joined = asof_join(connections, history, ["address"], "ts_micros", "ts_micros", ["name", "__names"], bucket)
    others = F.array_sort(F.array_distinct(F.filter("__names", lambda x: x != F.col("name"))))
    return joined.withColumn("candidates", F.coalesce(others, F.array().cast("array<string>"))).drop("__names")


def left_struct(df: DataFrame):  # noqa: ANN201
    """The type of a row."""
    return df.schema


def positions(rows: DataFrame, keys: list[str], order: list[str], spread: str, bucket: int, name: str = "position") -> DataFrame:
    """rows with their place (from 1) in each key by ``order``, whose first column is ``spread``. Rows are numbered within buckets of it
    and shifted by the counts of the buckets before, so one key isn't numbered in one task."""
    b = rows.withColumn("__b", F.floor(F.col(spread) / F.lit(bucket)))
    counts = b.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = b.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return numbered.join(before, [*keys, "__b"]).withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop("__b", "__k", "__before")


def pair_in_order(requests: DataFrame, responses: DataFrame, keys: list[str], order: list[str], spread: str, bucket: int, prefix: str = "response_") -> DataFrame:
    """The n-th request of a stream with its n-th response; requests without one keep NULLs."""
    a = positions(requests, keys, order, spread, bucket)
    b = positions(responses, keys, order, spread, bucket)
    b = b.select(*keys, "position", *[F.col(c).alias(prefix + c) for c in responses.columns if c not in keys])
    return a.join(b, [*keys, "position"], "left")


#: How tightly a key pins a client.
WEIGHTS = {"ja4": 100, "ja4_pre": 70, "ja4_b": 50, "ja3": 40}


def classify(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """id, label: the best fingerprint rule of each flow that has one.

    rules: label, load_order and the optional keys ja4, ja4_pre (a prefix), ja4_b (the middle part), ja3, sni; a rule holds if all
    keys it states do, sni without regard to case. Score: 1000 for each key stated plus the keys' weights;
    ties go to rules with sni, then to the later loaded. Each rule is reached by an equi-join on one of its keys; the
    rules are few (at most MAX_RULES, else an error) and broadcast. Rules without keys hold for nothing.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    has = {k: text(F.col(k)) != "" for k in ("ja4", "ja3", "ja4_b", "ja4_pre", "sni")}
    anchor = F.when(has["ja4"], F.concat(F.lit("ja4:"), "ja4")).when(has["ja3"], F.concat(F.lit("ja3:"), "ja3")).when(has["ja4_b"], F.concat(F.lit("b:"), "ja4_b")).when(has["ja4_pre"], F.concat(F.lit("p:"), "ja4_pre"))
    score = sum([F.when(has[k], 1000 + w).otherwise(0) for k, w in WEIGHTS.items()], F.lit(0))
    r = rules.select(anchor.alias("anchor"), score.alias("score"), has["sni"].cast("int").alias("named"), "load_order", "label", *[F.col(k).alias(f"r_{k}") for k in has]).filter(F.col("anchor").isNotNull())
    lengths = sorted(x[0] for x in rules.filter(has["ja4_pre"]).select(F.length("ja4_pre")).distinct().collect())
    host = F.lower(F.regexp_replace(text(F.col("authority")), r":\d+$", ""))
    parts = F.split(text(F.col("ja4")), "_")
    ja4_b = F.when(F.size(parts) == 3, parts[1]).otherwise("")
    distinct = flows.select(text(F.col("ja4")).alias("ja4"), text(F.col("ja3")).alias("ja3"), ja4_b.alias("ja4_b"), host.alias("host")).filter("ja4 <> '' OR ja3 <> ''").distinct()
    anchors = [F.concat(F.lit("ja4:"), "ja4"), F.concat(F.lit("ja3:"), "ja3"), F.concat(F.lit("b:"), "ja4_b"), *[F.concat(F.lit("p:"), F.substring("ja4", 1, n)) for n in lengths]]
    met = distinct.withColumn("anchor", F.explode(F.array_distinct(F.array(*anchors)))).join(F.broadcast(r), "anchor")
    holds = lambda k, c: (text(F.col(f"r_{k}")) == "") | c
    met = met.filter(holds("ja4", F.col("r_ja4") == F.col("ja4")) & holds("ja3", F.col("r_ja3") == F.col("ja3")) & holds("ja4_b", F.col("r_ja4_b") == F.col("ja4_b")) & holds("ja4_pre", F.col("ja4").startswith(F.col("r_ja4_pre"))) & holds("sni", F.lower("r_sni") == F.col("host")))
    best = met.groupBy("ja4", "ja3", "host").agg(F.max_by("label", F.struct("score", "named", "load_order")).alias("label"))
    keyed = flows.select("id", text(F.col("ja4")).alias("ja4"), text(F.col("ja3")).alias("ja3"), host.alias("host"))
    return keyed.join(best, ["ja4", "ja3", "host"]).select("id", "label")


def rule_scores(rules: DataFrame) -> DataFrame:
    """label, load_order, score of every rule that states a fingerprint key: 1000 for each key it states plus their weights."""
    has = [text(F.col(k)) != "" for k in WEIGHTS]
    score = sum([F.when(h, 1000 + w).otherwise(0) for h, w in zip(has, WEIGHTS.values())], F.lit(0))
    return rules.select("label", "load_order", score.alias("score")).filter("score > 0")


def natural_key_counts(flows: DataFrame, keys: tuple[str, ...] = ("method", "authority", "path")) -> DataFrame:
    """keys and n: how many flows share each natural key; '' and NULL are one value."""
    return flows.groupBy(*[text(F.col(k)).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def undecoded_index(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored connections without flows, and those that a live decode found and that aren't stored yet, by connection_id."""
    fresh = live.join(stored.select("connection_id"), "connection_id", "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def not_stored(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live rows whose id isn't stored."""
    return live.join(stored.select("id"), "id", "left_anti")


def scan_counters(rows: DataFrame, matched: Column, hidden: Column) -> DataFrame:
    """scanned, matched, hidden_matched of rows by two conditions, in one pass."""
    held, away = F.coalesce(matched, F.lit(False)), F.coalesce(hidden, F.lit(False))
    return rows.agg(F.count("*").alias("scanned"), F.count_if(held).alias("matched"), F.count_if(held & away).alias("hidden_matched"))


def outcome_totals(metadata: DataFrame, prefix: str = "undecoded.") -> DataFrame:
    """outcome, n, total: counters of sessions below a key prefix, with or without ``conn.`` before it; digits only, zeros left out."""
    pattern = r"^(?:conn\.)?" + prefix.replace(".", r"\.") + "(.+)$"
    m = metadata.select(F.regexp_extract("key", pattern, 1).alias("outcome"), "value")
    return m.filter((F.col("outcome") != "") & F.col("value").rlike(r"^[0-9]*[1-9][0-9]*$")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


#: Why a connection has no decoded exchange.
TCP_PASSTHROUGH, UDP_UNDECODED = "tcp_passthrough", "udp_undecoded"


def stream_flows(streams: DataFrame, messages: DataFrame) -> DataFrame:
    """A flow for every raw stream that was passed on undecoded.

    streams: id, transport (tcp or udp), src_addr, dst_addr, sni, ts_micros, tls_established; messages: flow_id, from_client, payload.
    Its authority is the name that the client gave, else the peer with its port; conn.outcome and the bytes of both directions are
    its metadata, and its messages are its timeline. Streams without messages have no bytes; NULL transports are TCP.
    """
    size = F.length(F.col("payload").cast("binary"))
    bytes_ = messages.groupBy(F.col("flow_id").alias("__flow")).agg(F.coalesce(F.sum(F.when(F.col("from_client"), size)), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(~F.col("from_client"), size)), F.lit(0)).alias("down"))
    s = streams.join(bytes_, streams["id"] == bytes_["__flow"], "left")
    udp, up, down = F.lower(text(F.col("transport"))) == "udp", F.coalesce("up", F.lit(0)).cast("long"), F.coalesce("down", F.lit(0)).cast("long")
    outcome = F.when(udp, UDP_UNDECODED).otherwise(TCP_PASSTHROUGH)
    return s.select(
        "id", F.when(udp, "UDP").otherwise("TCP").alias("protocol"), F.when(text(F.col("sni")) != "", F.col("sni")).otherwise(text(F.col("dst_addr"))).alias("authority"), "src_addr", "dst_addr", "ts_micros", F.coalesce("tls_established", F.lit(False)).alias("tls_decrypted"),
        F.lit(True).alias("websocket"), up.alias("request_bytes"), F.create_map(F.lit("conn.outcome"), outcome, F.lit("conn.bytes_up"), up.cast("string"), F.lit("conn.bytes_down"), down.cast("string")).alias("metadata"),
    )


def verify_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Natural keys whose counts differ between two inputs: keys, n_left, n_right."""
    one = lambda df, side: df.select(*keys, F.lit(side).alias("__side"))
    both = one(left, "l").unionByName(one(right, "r")).groupBy(*keys)
    return both.agg(F.count_if(F.col("__side") == "l").alias("n_left"), F.count_if(F.col("__side") == "r").alias("n_right")).filter("n_left <> n_right")


COMPARED = ("ja3", "ja4", "http2_fingerprint", "protocol", "user_agent", "tls_client_hello", "tls_hrr", "method", "authority")


def compare_flows(flows: DataFrame, a: str, b: str) -> DataFrame:
    """parameter, a, b, equal for two flows; '' and NULL are equal. A flow that isn't there compares as absent."""
    two = flows.filter(F.col("id").isin(a, b)).select("id", *[F.col(c).cast("string").alias(c) for c in COMPARED])
    one = two.agg(*[F.max(F.when(F.col("id") == i, F.col(c))).alias(f"{side}_{c}") for c in COMPARED for side, i in (("a", a), ("b", b))])
    rows = F.array(*[F.struct(F.lit(c).alias("parameter"), text(F.col(f"a_{c}")).alias("a"), text(F.col(f"b_{c}")).alias("b")) for c in COMPARED])
    return one.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.a") == F.col("r.b")).alias("equal"))


PARAMETERS = ("method", "url", "status", "protocol", "user_agent", "ja3", "ja4", "http2_fingerprint", "tls_client_hello")


def compare_report(flows: DataFrame, headers: DataFrame, a: str, b: str) -> DataFrame:
    """position, parameter, a, b, equal of two flows: request line and fingerprints, then the order of header names of both sides in
    lower case. '' and NULL are equal, and so is a status of 0. headers: as stored (flow_id, response, ord, name, value)."""
    shown = {c: F.col(c).cast("string") for c in PARAMETERS} | {"url": url(), "status": F.when(F.coalesce("status", F.lit(0)) != 0, F.col("status").cast("string"))}
    two = flows.filter(F.col("id").isin(a, b)).select("id", *[text(shown[c]).alias(c) for c in PARAMETERS])
    lists = header_lists(headers.filter(F.col("flow_id").isin(a, b)))
    order = lambda c: text(F.array_join(F.transform(c, lambda h: F.lower(h["name"])), ","))
    rows = two.join(lists, two["id"] == lists["flow_id"], "left").select("id", *PARAMETERS, order(F.col("request_headers")).alias("request_header_order"), order(F.col("response_headers")).alias("response_header_order"))
    names = [*PARAMETERS, "request_header_order", "response_header_order"]
    one = rows.agg(*[text(F.max(F.when(F.col("id") == i, F.col(c)))).alias(f"{side}_{c}") for c in names for side, i in (("a", a), ("b", b))])
    each = F.array(*[F.struct(F.lit(n).alias("position"), F.lit(c).alias("parameter"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"), (F.col(f"a_{c}") == F.col(f"b_{c}")).alias("equal")) for n, c in enumerate(names)])
    return one.select(F.explode(each).alias("r")).select("r.*")


def compare_summary(report: DataFrame) -> DataFrame:
    """differences (parameters that differ, in order), identical."""
    different = F.array_sort(F.collect_list(F.when(~F.col("equal"), F.struct("position", "parameter"))))
    return report.agg(F.transform(different, lambda x: x["parameter"]).alias("differences")).select("differences", (F.size("differences") == 0).alias("identical"))


def header_order_diff(headers_a: Column, headers_b: Column) -> Column:
    """Struct of what two header lists differ in: same_order (lower-case names), same_pseudo (names that begin with a colon), same_cookies
    (names of cookies), only_a, only_b (in their order), changed (names with another last value, sorted)."""
    names = lambda h: F.transform(h, lambda x: F.lower(x["name"]))
    pseudo = lambda h: F.filter(names(h), lambda n: n.startswith(":"))
    pairs = lambda h: F.split(F.array_join(F.transform(F.filter(h, lambda x: F.lower(x["name"]) == "cookie"), lambda x: text(x["value"])), ";"), ";")
    cookies = lambda h: F.filter(F.transform(pairs(h), lambda c: F.trim(F.split_part(c, F.lit("="), F.lit(1)))), lambda c: c != "")
    last = lambda h: F.aggregate(h, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(x["name"])), F.create_map(F.lower(x["name"]), text(x["value"]))))
    a, b = names(headers_a), names(headers_b)
    changed = F.array_sort(F.filter(F.array_intersect(a, b), lambda n: F.try_element_at(last(headers_a), n) != F.try_element_at(last(headers_b), n)))
    return F.struct((a == b).alias("same_order"), (pseudo(headers_a) == pseudo(headers_b)).alias("same_pseudo"), (cookies(headers_a) == cookies(headers_b)).alias("same_cookies"), F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"), changed.alias("changed"))


def reason_counts(undecoded: DataFrame) -> DataFrame:
    """reason, n for all five reasons, zeros included."""
    spark = undecoded.sparkSession
    known = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    return known.join(undecoded.groupBy("reason").agg(F.count("*").alias("c")), "reason", "left").select("reason", F.coalesce("c", F.lit(0)).alias("n"))


def connection_tally(packets: DataFrame) -> DataFrame:
    """connection_id, bytes_up, bytes_down, first_ts, last_ts from packets (connection_id, from_client, size, ts_micros)."""
    return packets.groupBy("connection_id").agg(
        F.coalesce(F.sum(F.when(F.col("from_client"), F.col("size"))), F.lit(0)).alias("bytes_up"), F.coalesce(F.sum(F.when(~F.col("from_client"), F.col("size"))), F.lit(0)).alias("bytes_down"), F.min("ts_micros").alias("first_ts"), F.max("ts_micros").alias("last_ts")
    )


def host_rollup(undecoded: DataFrame, top: int = 15) -> DataFrame:
    """The hosts (name, else server) with most bytes: host, connections, bytes, reasons."""
    host = F.coalesce(F.when(text(F.col("sni")) != "", F.col("sni")), F.col("server"))
    g = undecoded.groupBy(host.alias("host")).agg(F.count("*").alias("connections"), F.sum(F.col("bytes_up") + F.col("bytes_down")).alias("bytes"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return g.orderBy(F.col("bytes").desc(), "host").limit(top)


def content_addressed(bodies: DataFrame, column: str = "bytes") -> DataFrame:
    """sha256, size, copies of every distinct body that isn't NULL."""
    b = bodies.filter(F.col(column).isNotNull())
    return b.groupBy(F.sha2(F.col(column).cast("binary"), 256).alias("sha256")).agg(F.max(F.length(F.col(column).cast("binary"))).alias("size"), F.count("*").alias("copies"))
