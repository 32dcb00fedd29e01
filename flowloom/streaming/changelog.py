"""Live streams of flows and messages.

A push stream carries versions of flows. Conditions of the filter language are evaluated in the JVM
before the stateful step, which keeps per flow only whether it is shown and what must be carried
forward (message count, websocket). Late versions need no watermark: a version is an upsert
whenever it comes; ``pushed_at`` orders those of one batch.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.common import ensure_checkpoint_dir
from flowloom.functions.flows import hidden
from flowloom.operators.versions import latest
from flowloom.plans import filters, side

FLUSH_SECONDS = 2
TERMINAL = ("closed", "error")


def push_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A parquet table (file or folder) as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if path.startswith("/") and os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def holds(rows: DataFrame, expression: str, tables: side.SideTables | None = None, include_hidden: bool = True, name: str = "matches") -> DataFrame:
    """rows with ``matches``: whether all terms hold and the record isn't hidden. Terms on side tables read ``tables`` as they are when a
    batch is processed; without them they are refused."""
    terms = filters.parse(expression)
    filters.validate(rows.sparkSession, terms)
    needed, columns = filters.needs(terms), rows.columns
    if needed and tables is None:
        raise filters.FilterError(f"this live filter needs {', '.join(sorted(needed))}")
    if needed:
        rows = side.attach(rows, tables, needed)
    held = F.lit(True)
    for t in terms:
        held = held & filters.condition(t)
    if not include_hidden:
        rows = side.one_metadata(rows, tables.metadata if tables else None, "conn.outcome")
        held = held & ~hidden(F.col("protocol"), F.col("conn_outcome"))
    return rows.select(*columns, held.alias(name))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown, n = state.get if state.exists else (False, 0)
    rows = pd.concat(list(batches)).sort_values("pushed_at", kind="stable")
    out = []
    for at, matches in zip(rows["pushed_at"], rows["matches"]):
        op = "added" if matches and not shown else "updated" if matches else "unmatched" if shown else None
        shown = bool(matches)
        if op:
            n += 1
            out.append((key[0], n, op, at))
    state.update((shown, n))
    yield pd.DataFrame(out, columns=["id", "change_no", "op", "pushed_at"])


def changelog(pushes: DataFrame, expression: str = "", tables: side.SideTables | None = None, include_hidden: bool = True) -> DataFrame:
    """id, change_no, op (added, updated, unmatched), pushed_at: what a viewer with this filter sees. pushes may be a stream or a batch."""
    rows = holds(pushes.filter("id <> ''"), expression, tables, include_hidden).select("id", "pushed_at", "matches")
    return rows.groupBy("id").applyInPandasWithState(_changes, "id string, change_no long, op string, pushed_at timestamp", "shown boolean, n long", "append", GroupStateTimeout.NoTimeout)


def _subscriber_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    for out in _changes(key[1:], batches, state):
        yield out.assign(subscriber=key[0])[["subscriber", *out.columns]]


def fan_out(pushes: DataFrame, subscribers: dict[str, str], tables: side.SideTables | None = None) -> DataFrame:
    """The changelogs of several subscribers (name -> filter) from one pass over the stream: subscriber, id, change_no, op, pushed_at. A
    record's state is kept for those that it matches or matched."""
    rows = pushes.filter("id <> ''")
    names = {n: f"__m{k}" for k, n in enumerate(subscribers)}
    for n, expression in subscribers.items():
        rows = holds(rows, expression, tables, name=names[n])
    each = F.array(*[F.struct(F.lit(n).alias("subscriber"), F.col(c).alias("matches")) for n, c in names.items()])
    told = rows.select("id", "pushed_at", F.explode(each).alias("__s")).select("__s.subscriber", "id", "pushed_at", "__s.matches")
    return told.groupBy("subscriber", "id").applyInPandasWithState(_subscriber_changes, "subscriber string, id string, change_no long, op string, pushed_at timestamp", "shown boolean, n long", "append", GroupStateTimeout.NoTimeout)


def _upserts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pushed, bumps, websocket, version = state.get if state.exists else (0, 0, False, 0)
    for pdf in batches:  # both parts are sums and maxima, so it doesn't matter how rows are cut into batches
        pushed = max(pushed, int(pdf["message_count"].max()) if len(pdf) else 0)
        bumps += int(pdf["new_messages"].sum())
        websocket = websocket or bool(pdf["websocket"].any())
        version += len(pdf)
    count = pushed + bumps
    state.update((pushed, bumps, websocket, version))
    yield pd.DataFrame([(key[0], count, websocket or count > 0, version)], columns=["id", "message_count", "websocket", "versions"])


def live_state(pushes: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Per flow and batch: id, message_count, websocket, versions. A push carries the greatest count pushed so far forward, a message
    adds one to its flow and sends it again."""
    known = pushes.columns
    rows = pushes.filter("id <> ''").select("id", (F.col("message_count") if "message_count" in known else F.lit(0)).cast("long").alias("message_count"), F.lit(0).cast("long").alias("new_messages"), (F.col("websocket") if "websocket" in known else F.lit(False)).alias("websocket"))
    if messages is not None:
        rows = rows.unionByName(messages.filter("flow_id <> ''").select(F.col("flow_id").alias("id"), F.lit(0).cast("long").alias("message_count"), F.lit(1).cast("long").alias("new_messages"), F.lit(True).alias("websocket")))
    return rows.groupBy("id").applyInPandasWithState(_upserts, "id string, message_count long, websocket boolean, versions long", "pushed long, bumps long, websocket boolean, versions long", "update", GroupStateTimeout.NoTimeout)


def message_stream(live: DataFrame, stored: DataFrame, late: str = "1 hour") -> DataFrame:
    """Live messages that aren't stored, each id once: what follows the backfill of the stored ones. Ids are remembered for as long as a
    repeat may be ``late`` by the messages' own times (ts_micros), so the state is bounded."""
    fresh = live.join(stored.select("id"), "id", "left_anti")
    if not live.isStreaming:
        return fresh.dropDuplicates(["id"])
    timed = fresh.withColumn("__at", F.timestamp_micros("ts_micros")).withWatermark("__at", late)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("__at")


def settled_bodies(rows: DataFrame) -> DataFrame:
    """rows whose body is written: done or failed, and never that of a websocket; others have no body yet."""
    settled = (F.coalesce("body_done", F.lit(False)) | (F.coalesce("error", F.lit("")) != "")) & ~F.coalesce("websocket", F.lit(False))
    return rows.withColumns({"body": F.when(settled, F.col("body")), "body_state": F.when(settled, "final").otherwise("pending")})


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out")
    return spark.read.parquet(f"{base}/out/*")


FLUSH_DIRTY = 128


class FlushTable:
    """Pushed versions written as they come, and the state that readers take.

    Every batch is written below its number, so a batch that runs again replaces itself. When ``dirty`` records are waiting or
    ``seconds`` have passed since the last flush, the waiting batches go over the last state into a new one, and a marker, written
    last, names it. ``close`` flushes the rest. A restart finds the marker and what was written after it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], dirty: int = FLUSH_DIRTY, seconds: float = FLUSH_SECONDS) -> None:
        self.spark, self.path, self.keys, self.order, self.dirty, self.seconds = spark, path, keys, order, dirty, seconds
        self.waiting: dict[int, int] = {}
        self.last, self.flushes = time.monotonic(), 0

    def _marker(self) -> tuple[int, str] | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/markers")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        row = self.spark.read.schema("epoch long, state string").json(f"{self.path}/markers").orderBy(F.col("epoch").desc()).first()
        return (row.epoch, row.state) if row else None

    def take(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch, for ``foreachBatch``."""
        settled_bodies(batch).write.mode("overwrite").parquet(f"{self.path}/batches/{epoch}")
        self.waiting[epoch] = self.spark.read.parquet(f"{self.path}/batches/{epoch}").select(*self.keys).distinct().count()
        if sum(self.waiting.values()) >= self.dirty or time.monotonic() - self.last >= self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            upto = max(self.waiting)
            rows = self.spark.read.parquet(*[f"{self.path}/batches/{e}" for e in sorted(self.waiting)])
            if (known := self._marker()) is not None:
                rows = self.spark.read.parquet(known[1]).unionByName(rows)
            state = f"{self.path}/state-{upto}-{uuid.uuid4()}"
            latest(rows, self.keys, self.order).write.parquet(state)
            self.spark.createDataFrame([(upto, state)], "epoch long, state string").coalesce(1).write.mode("append").json(f"{self.path}/markers")
            self.waiting.clear()
            self.flushes += 1
        self.last = time.monotonic()

    close = flush

    def read(self) -> DataFrame:
        """The last flushed state."""
        known = self._marker()
        if known is None:
            raise FileNotFoundError(f"nothing is flushed below {self.path}")
        return self.spark.read.parquet(known[1])

    def run(self, pushes: DataFrame) -> None:
        """Take all that a stream has now, and close."""
        query = pushes.writeStream.option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).foreachBatch(self.take).start()
        query.awaitTermination()
        self.close()

    def start(self, pushes: DataFrame):  # noqa: ANN201
        """Follow a stream; stop the query, then close."""
        return pushes.writeStream.option("checkpointLocation", f"{self.path}/progress").trigger(processingTime=f"{self.seconds} seconds").foreachBatch(self.take).start()


def wait_for_flows(pushes: DataFrame, expression: str, n: int, seconds: float, status: str = "open") -> tuple[list[str], str]:
    """(ids, note): waits until ``n`` flows were added or 1 to 300 seconds passed; a session that isn't open is answered at once.
    Only the first n ids are held."""
    if status != "open":
        return [], f"the session is {status}"
    spark = pushes.sparkSession
    ensure_checkpoint_dir(spark)
    ids: list[str] = []

    def take(batch: DataFrame, _: int) -> None:
        if len(ids) < n:
            ids.extend(r.id for r in batch.filter("op = 'added'").select("id").limit(n - len(ids)).collect())

    query = changelog(pushes, expression).writeStream.option("checkpointLocation", f"{spark.sparkContext.getCheckpointDir()}/wait-{uuid.uuid4()}").foreachBatch(take).start()
    end = time.monotonic() + min(max(seconds, 1), 300)
    try:
        while len(ids) < n and time.monotonic() < end and query.isActive:
            query.awaitTermination(0.2)
    finally:
        query.stop()
    return ids, "" if len(ids) >= n else "time is over"


def _session_events(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (status, n) = state.get if state.exists else ("", 0)
    out = []
    for new in pd.concat(list(batches)).sort_values("at", kind="stable")["status"]:
        if status in TERMINAL or new == status:
            continue
        n += 1
        out.append((key[0], n, "opened" if n == 1 and new not in TERMINAL else "ended" if new in TERMINAL else "changed", new))
        status = new
    state.update((status, n))
    yield pd.DataFrame(out, columns=["session_id", "event_no", "event", "status"])


def session_stream(versions: DataFrame) -> DataFrame:
    """session_id, event_no, event (opened, changed, ended), status: what a viewer of sessions is told, from versions (id, status, at in any
    growing unit). A status that doesn't change is no event, and nothing follows the end of a session."""
    return versions.select("id", "status", "at").groupBy("id").applyInPandasWithState(_session_events, "session_id string, event_no long, event string, status string", "status string, n long", "append", GroupStateTimeout.NoTimeout)


def until(condition: Callable[[], bool], seconds: float, first: float = 0.05, most: float = 1.0) -> bool:
    """Polls with growing pauses until the condition holds or time is over."""
    end, pause = time.monotonic() + seconds, first
    while not condition():
        if time.monotonic() >= end:
            return False
        time.sleep(pause)
        pause = min(pause * 2, most)
    return True
