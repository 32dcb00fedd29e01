"""Queries of mutations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import cut, load, present, shared_folder
from flowloom.operators.flow_joins import undecoded_index
from flowloom.operators.versions import latest
from flowloom.plans import mutate, store
from flowloom.plans.side import FAVORITE, SideTables
from flowloom.queries import adapter as a
from flowloom.streaming import changelog as live

SQL: dict[str, str] = {}
_W = f"WITH {a.SQL_FLOWS}"


def H1_latest_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.latest_flows(spark, sf_dir).select("id", "status", "duration_micros", "content_type")


SQL["H1_latest_flows"] = f"{_W} SELECT id, status, duration_micros, content_type FROM cur"


def H1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the versions published, the other half pushed over them."""
    f = load(spark, sf_dir, "flows").filter(present(F.col("id"))).select("id", "ts_micros", "frame_number", "status", "pushed_at", "content_type")
    later = F.crc32(F.concat("id", F.col("pushed_at").cast("string"))) % 2 == 0
    first = store.publish(latest(f.filter(~later), ["id"], ["pushed_at", "content_type"]))
    return spark.read.parquet(store.advance(first, spark, f.filter(later), ["id"], ["pushed_at", "content_type"])).select("id", "status", F.unix_micros("pushed_at").alias("pushed"))


SQL["H1_published"] = "SELECT id, status, epoch_us(pushed_at) AS pushed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pushed_at DESC, content_type DESC NULLS LAST, ts_micros DESC, frame_number DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM flows WHERE id <> '') WHERE rn = 1"


def H1_body_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "flows").filter(present(F.col("id"))).select("id", F.struct("pushed_at", "ts_micros").alias("version"), "resp_body_ref", F.coalesce(F.col("status"), F.lit(0)).alias("s")).select("id", "version", F.col("resp_body_ref").alias("body_ref"), F.when(F.col("s") == 0, "pending").otherwise("final").alias("body_state"))
    return mutate.body_refs(v.distinct()).select("id", F.coalesce("body_ref", F.lit("")).alias("body_ref"))


SQL["H1_body_refs"] = "WITH v AS (SELECT id, resp_body_ref, coalesce(status, 0) AS s, row_number() OVER (PARTITION BY id ORDER BY pushed_at DESC) AS n FROM flows WHERE id <> '') SELECT id, CASE WHEN s = 0 THEN '' ELSE coalesce(resp_body_ref, '') END AS body_ref FROM v WHERE n = 1"


def H1_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push of some flows replaces their headers as a whole."""
    h = load(spark, sf_dir, "flow_headers").select("flow_id", "name")
    parents = a.flows(spark, sf_dir).filter("ts_micros % 4 = 0").select("id")
    pushed = parents.select(F.col("id").alias("flow_id"), F.lit("x-new").alias("name"))
    return mutate.replace_children(h, pushed, parents, "flow_id").groupBy("flow_id", "name").agg(F.count("*").alias("n"))


SQL["H1_replace_children"] = f"{_W}, p AS (SELECT id FROM cur WHERE ts_micros % 4 = 0) SELECT flow_id, name, count(*) AS n FROM (SELECT flow_id, name FROM flow_headers WHERE flow_id IS NULL OR flow_id NOT IN (SELECT id FROM p) UNION ALL SELECT id, 'x-new' FROM p) GROUP BY ALL"


def H2_append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages pushed again over stored ones, and new ones: each id once, the pushed row in its place."""
    m = a.messages(spark, sf_dir).select("id", "opcode")
    return mutate.upsert(m.filter("length(id) % 2 = 0 OR opcode = 'ping'"), m.filter("length(id) % 2 = 1 OR opcode = 'ping'").withColumn("opcode", F.upper("opcode")), ["id"], [])


SQL["H2_append_messages"] = f"WITH {a.SQL_MESSAGES} SELECT id, CASE WHEN length(id) % 2 = 1 OR opcode = 'ping' THEN upper(opcode) ELSE opcode END AS opcode FROM msg"


def H3_undecoded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = a.undecoded(spark, sf_dir).select("connection_id", "reason", "first_ts")
    return mutate.upsert(u, u.filter("first_ts % 2 = 0").withColumn("reason", F.lit("pushed")), ["connection_id"], [])


def K14_undecoded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live decode found beside what is stored; of both the stored row counts."""
    u = a.undecoded(spark, sf_dir).select("connection_id", "reason", "first_ts")
    live = u.filter("first_ts % 3 <> 1").withColumn("reason", F.lit("live"))
    return undecoded_index(u.filter("first_ts % 3 <> 0"), live)


SQL["H3_undecoded_upsert"] = f"WITH {a.SQL_FLOWS}, {a.SQL_UNDECODED} SELECT connection_id, CASE WHEN first_ts % 2 = 0 THEN 'pushed' ELSE reason END AS reason, first_ts FROM und"
SQL["K14_undecoded_index"] = f"WITH {a.SQL_FLOWS}, {a.SQL_UNDECODED} SELECT connection_id, CASE WHEN first_ts % 3 = 0 THEN 'live' ELSE reason END AS reason, first_ts FROM und"


def H4_toggle_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    ids = f.filter("ts_micros % 50 = 0").select(F.col("id").alias("record_id"))
    return mutate.toggle_favorite(a.tables(spark, sf_dir, f).record_tags, ids).filter(F.col("tag_id") == FAVORITE)


SQL["H4_toggle_favorite"] = f"{_W} SELECT id AS record_id, '__favorite__' AS tag_id FROM cur WHERE ts_micros % 97 = 0 OR ts_micros % 50 = 0"


def H4_set_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    ids = f.filter("ts_micros % 50 = 0").select(F.col("id").alias("record_id"))
    return mutate.set_assignments(a.tables(spark, sf_dir, f).record_tags, ids, ["t-auth", "t-new"], "tag_id")


SQL["H4_set_tags"] = f"""{_W}, t AS (SELECT id, ts_micros, 't-auth' AS tag_id FROM cur WHERE ts_micros % 11 = 0 UNION ALL SELECT id, ts_micros, 't-slow' FROM cur WHERE duration_micros > 300000 UNION ALL SELECT id, ts_micros, '__favorite__' FROM cur WHERE ts_micros % 97 = 0)
SELECT id AS record_id, tag_id FROM t WHERE ts_micros % 50 <> 0 UNION ALL SELECT id, tag_id FROM cur, (VALUES ('t-auth'), ('t-new')) AS v(tag_id) WHERE ts_micros % 50 = 0"""


def H5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame([("g-root", "root", ""), ("g-api", "api", "g-root")], "id string, name string, parent_id string")
    return mutate.delete_definition(mutate.put_definition(mutate.put_definition(g, "g-api", name="gateway"), "g-ui", name="ui", parent_id="g-root"), "g-root")


SQL["H5_groups"] = "SELECT * FROM (VALUES ('g-root', 'root', '', true), ('g-api', 'gateway', 'g-root', false), ('g-ui', 'ui', 'g-root', false)) AS t(id, name, parent_id, deleted)"


def H6_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    t = a.tables(spark, sf_dir, f)
    some = f.filter("ts_micros % 26 = 0").select(F.col("id").alias("record_id"))
    return mutate.set_mark(mutate.set_mark(t.marks, some, "blue"), f.filter("ts_micros % 34 = 0").select(F.col("id").alias("record_id")), None)


SQL["H6_marks"] = f"{_W} SELECT id AS record_id, CASE WHEN ts_micros % 26 = 0 THEN 'blue' WHEN ts_micros % 13 = 0 THEN 'red' ELSE 'green' END AS color FROM cur WHERE (ts_micros % 13 = 0 OR ts_micros % 17 = 0) AND ts_micros % 34 <> 0"


def H6_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "sessions").filter("label <> ''").select("id", F.col("label").alias("body"))
    return mutate.edit_comments(c, c.filter("body LIKE 'k%'").withColumn("body", F.lit("edited")), c.filter("body LIKE 'n%'"))


SQL["H6_comments"] = "SELECT id, CASE WHEN label LIKE 'k%' THEN 'edited' ELSE label END AS body FROM sessions WHERE label <> '' AND label NOT LIKE 'n%'"


def H7_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "groups").groupBy("id").agg(F.max("name").alias("name"))
    mine = g.filter("name LIKE 'k%'").withColumn("name", F.lit("mine"))
    return mutate.mirror_definitions(mine, g)


SQL["H7_mirror"] = "SELECT id, CASE WHEN max(name) LIKE 'k%' THEN 'mine' ELSE max(name) END AS name FROM groups GROUP BY id"


def H8_merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "session_metadata").groupBy("session_id", "key").agg(F.max("value").alias("value"))
    return mutate.merge_metadata(m, m.filter("key LIKE 'undecoded%'").withColumn("value", F.lit("0")))


SQL["H8_merge_metadata"] = "SELECT session_id, key, CASE WHEN key LIKE 'undecoded%' THEN '0' ELSE max(value) END AS value FROM session_metadata GROUP BY session_id, key"


def H8_delete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first closed session goes with its rows in all tables."""
    s = load(spark, sf_dir, "sessions").filter("id <> ''")
    first = s.filter("status = 'closed'").orderBy("id").limit(1).collect()
    left, tables = mutate.delete_session(s, first[0].id, {"flows": load(spark, sf_dir, "flows"), "metadata": load(spark, sf_dir, "session_metadata")})
    counts = [t.groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_in"), "session_id", "n") for name, t in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(left.groupBy(F.col("id").alias("session_id")).agg(F.count("*").alias("n")).withColumn("kept_in", F.lit("sessions")))


SQL["H8_delete_session"] = """WITH f AS (SELECT min(id) AS gone FROM sessions WHERE status = 'closed' AND id <> '')
SELECT 'flows' AS kept_in, session_id, count(*) AS n FROM flows, f WHERE session_id IS DISTINCT FROM gone GROUP BY session_id
UNION ALL SELECT 'metadata', session_id, count(*) FROM session_metadata, f WHERE session_id IS DISTINCT FROM gone GROUP BY session_id
UNION ALL SELECT 'sessions', id, count(*) FROM sessions, f WHERE id <> '' AND id <> gone GROUP BY id"""


def H9_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "sessions").select("id", "status", "closed_at")
    first = s.filter("status = 'open'").orderBy("id").limit(1).collect()
    return mutate.finish_session(s, first[0].id if first else "", "error", 5)


SQL["H9_finish"] = "SELECT id, CASE WHEN id = f THEN 'error' ELSE status END AS status, CASE WHEN id = f THEN coalesce(closed_at, 5) ELSE closed_at END AS closed_at FROM (SELECT *, (SELECT min(id) FROM sessions WHERE status = 'open') AS f FROM sessions)"


def H10_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir)
    return mutate.delete_flows(f, F.col("protocol") == "HTTP/2", {"headers": (load(spark, sf_dir, "flow_headers"), "flow_id")})[1]["headers"].groupBy("flow_id").agg(F.count("*").alias("n"))


SQL["H10_delete_cascade"] = f"{_W} SELECT flow_id, count(*) AS n FROM flow_headers WHERE flow_id IS NULL OR flow_id NOT IN (SELECT id FROM cur WHERE protocol = 'HTTP/2') GROUP BY flow_id"


def H11_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5).alias("owner_pid"))
    return mutate.prune_packets(p, [1, 2])[0].select("event_id")


SQL["H11_prune"] = "SELECT event_id FROM events WHERE user_id % 5 IN (0, 1, 2)"


def A19_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "sessions")
    one = s.agg(F.min("id")).first()[0]
    return spark.createDataFrame([(mutate.resolve_prefix(s, one), mutate.resolve_prefix(s, one[:-1]))], "exact string, by_prefix string")


SQL["A19_prefix"] = "SELECT min(id) AS exact, min(id) AS by_prefix FROM sessions"


def _in_batches(spark: SparkSession, rows: DataFrame, order: str, n: int = 4) -> DataFrame:
    """rows as a stream of n batches in order of a column of microseconds: a folder that grows by a file, and is read a file at a time."""
    folder = shared_folder(spark, "pushes")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // n + 1
    rows = cut(rows)
    for k in range(n):
        part = rows.filter(F.floor((F.col(order) - F.lit(low or 0)) / step) == k)
        part.coalesce(1).write.mode("append").parquet(folder)
    return live.push_stream(spark, folder, files_at_once=1)


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows").filter("id <> ''").withColumn("pushed_micros", F.unix_micros("pushed_at"))
    return _in_batches(spark, f, "pushed_micros")


def _kinds(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count_if(F.col("op") == "added").alias("added"), F.count_if(F.col("op") == "updated").alias("updated"), F.count_if(F.col("op") == "unmatched").alias("unmatched"))


def K4_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(live.run_to_end(live.changelog(_pushes(spark, sf_dir), "~c ^[23]")), "id")


_CHANGES = """SELECT {0}id, count(*) FILTER (WHERE m AND NOT shown) AS added, count(*) FILTER (WHERE m AND shown) AS updated, count(*) FILTER (WHERE NOT m AND shown) AS unmatched
FROM (SELECT *, coalesce(lag(m) OVER (PARTITION BY id ORDER BY pushed_at), false) AS shown FROM (SELECT id, pushed_at, {1} AS m FROM flows WHERE id <> '')) WHERE m OR shown GROUP BY id"""
_23 = "coalesce(status, 0) BETWEEN 200 AND 399"
SQL["K4_changelog"] = _CHANGES.format("", _23)


def K4_hidden_and_side_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on headers, hidden records left out."""
    t = SideTables(headers=load(spark, sf_dir, "flow_headers"))
    return _kinds(live.run_to_end(live.changelog(_pushes(spark, sf_dir), "~s !~hq accept-language", t, include_hidden=False)), "id")


SQL["K4_hidden_and_side_terms"] = _CHANGES.format("", "coalesce(status, 0) <> 0 AND NOT coalesce(protocol = 'DNS', false) AND id NOT IN (SELECT flow_id FROM flow_headers WHERE flow_id <> '' AND response = 0 AND contains(lower(name || ': ' || coalesce(value, '')), 'accept-language'))")


def K1_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three subscribers with filters of their own on one stream."""
    changes = live.fan_out(_pushes(spark, sf_dir), {"good": "~c ^[23]", "all": "", "get": "~m ^get$"})
    return _kinds(live.run_to_end(changes), "subscriber", "id")


SQL["K1_fan_out"] = " UNION ALL ".join(_CHANGES.format(f"'{n}' AS subscriber, ", m) for n, m in (("good", _23), ("all", "true"), ("get", "lower(coalesce(method, '')) = 'get'")))


def K2_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = live.run_to_end(live.live_state(_pushes(spark, sf_dir)), "update")
    return last.groupBy("id").agg(F.max("versions").alias("versions"))


SQL["K2_live_state"] = "SELECT id, count(*) AS versions FROM flows WHERE id <> '' GROUP BY id"


def K3_message_bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages bump the counts of flows that were pushed with one; every bump sends the flow again."""
    m = a.messages(spark, sf_dir).select("flow_id", "ts_micros", F.lit(0).alias("pushed_count"))
    first = m.groupBy("flow_id").agg(F.min("ts_micros").alias("ts_micros")).select("flow_id", "ts_micros", F.lit(3).alias("pushed_count"))
    both = _in_batches(spark, m.unionByName(first), "ts_micros")
    pushes = both.filter("pushed_count > 0").select(F.col("flow_id").alias("id"), F.col("pushed_count").alias("message_count"))
    last = live.run_to_end(live.live_state(pushes, both.filter("pushed_count = 0").select("flow_id")), "update")
    return last.groupBy("id").agg(F.max("message_count").alias("message_count"), F.max("epoch").alias("last_epoch")).select("id", "message_count")


SQL["K3_message_bumps"] = "SELECT 'u' || user_id AS id, count(*) + 3 AS message_count FROM events GROUP BY user_id"


def K5_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as they were opened, then as they are now, as a stream: what a viewer is told."""
    s = load(spark, sf_dir, "sessions").dropDuplicates(["id"])
    versions = s.select("id", F.lit("open").alias("status"), F.col("created_at").alias("at")).unionByName(s.select("id", "status", (F.greatest(F.coalesce("closed_at", F.lit(0)), F.col("created_at")) + 1).alias("at")))
    return live.run_to_end(live.session_stream(_in_batches(spark, versions, "at"))).select("session_id", "event_no", "event", "status")


SQL["K5_session_events"] = """WITH s AS (SELECT DISTINCT id, status FROM sessions)
SELECT id AS session_id, 1 AS event_no, 'opened' AS event, 'open' AS status FROM s UNION ALL SELECT id, 2, CASE WHEN status IN ('closed', 'error') THEN 'ended' ELSE 'changed' END, status FROM s WHERE status <> 'open'"""


def K8_message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages first, then the live ones that aren't stored, each once though live batches repeat some."""
    m = a.messages(spark, sf_dir).select("id", "flow_id", "opcode", "ts_micros")
    stored = m.filter("length(id) % 2 = 0")
    pushed = _in_batches(spark, m.unionByName(m.filter("opcode = 'ping'")), "ts_micros")
    return live.run_to_end(live.message_stream(pushed, stored)).unionByName(stored).select("id", "flow_id", "opcode")


SQL["K8_message_stream"] = f"WITH {a.SQL_MESSAGES} SELECT id, flow_id, opcode FROM msg"


def K10_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions flushed by number of changed records and, at the end, the rest: the state that readers find."""
    f = load(spark, sf_dir, "flows").filter("id <> ''").select("id", (F.coalesce("status", F.lit(0)) != 0).alias("body_done"), "error", F.lit(False).alias("websocket"), F.col("ts_micros").cast("string").alias("body"), F.unix_micros("pushed_at").alias("pushed"), "content_type")
    table = live.FlushTable(spark, shared_folder(spark, "flushed"), ["id"], ["pushed", "content_type", "body"])
    table.run(_in_batches(spark, f, "pushed"))
    return table.read().select("id", "body", "body_state")


SQL["K10_flush"] = """SELECT id, CASE WHEN s THEN body END AS body, CASE WHEN s THEN 'final' ELSE 'pending' END AS body_state FROM (
SELECT id, CAST(ts_micros AS VARCHAR) AS body, coalesce(status, 0) <> 0 OR coalesce(error, '') <> '' AS s, row_number() OVER (PARTITION BY id ORDER BY pushed_at DESC, content_type DESC NULLS LAST, CASE WHEN coalesce(status, 0) <> 0 OR coalesce(error, '') <> '' THEN CAST(ts_micros AS VARCHAR) END DESC NULLS LAST) AS rn FROM flows WHERE id <> '') WHERE rn = 1"""


def K10_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.flows(spark, sf_dir).select("id", (F.coalesce("status", F.lit(0)) != 0).alias("body_done"), "error", (F.col("ts_micros") % 10 == 0).alias("websocket"), F.col("resp_body_ref").alias("body"))
    return live.settled_bodies(f).select("id", "body", "body_state")


SQL["K10_settled"] = f"{_W}, x AS (SELECT id, resp_body_ref, (coalesce(status, 0) <> 0 OR coalesce(error, '') <> '') AND ts_micros % 10 <> 0 AS s FROM cur) SELECT id, CASE WHEN s THEN resp_body_ref END AS body, CASE WHEN s THEN 'final' ELSE 'pending' END AS body_state FROM x"


def K12_late_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "flows").filter("id <> ''")
    late = F.unix_micros("pushed_at") - F.col("ts_micros") > 86_400_000_000
    return mutate.upsert(f.filter(~late), f.filter(late), ["id"], ["pushed_at"]).select("id", "status")


SQL["K12_late_upserts"] = f"{_W} SELECT id, status FROM cur"

QUERIES = {k: v for k, v in globals().items() if k[:1] in "AHK" and k[1:2].isdigit() and callable(v)}
