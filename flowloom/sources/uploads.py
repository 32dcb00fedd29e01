"""Captures that arrive in pieces: landing of uploaded parts, and live decoding of what has landed.

A part is one file named by its session, kind and byte offset; parts may come twice or out of order. A session's
capture is what lies without a gap from offset 0 on.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.decode import capture
from flowloom.sources.capture import FLOW, SEGMENT, _names, decode_capture
from flowloom.sources.files import keylog_rows

KINDS = ("pcap", "keylog")
CEILING = 4 << 30
_SESSION = re.compile(r"[A-Za-z0-9_-]{1,80}")
_PART = r"/([A-Za-z0-9_-]+)\.(pcap|keylog)\.(\d{15})$"


class UploadRefused(ValueError):
    """A part that can't be taken."""


def land_part(folder: str, session: str, kind: str, offset: int, data: bytes, ceiling: int = CEILING) -> str:
    """Write a part under a temporary name, then give it its own; its path."""
    if not _SESSION.fullmatch(session) or kind not in KINDS or offset < 0:
        raise UploadRefused("bad session, kind or offset")
    if offset + len(data) > ceiling:
        raise UploadRefused(f"{kind} is larger than {ceiling} bytes")
    path = os.path.join(folder, f"{session}.{kind}.{offset:015d}")
    hidden = os.path.join(folder, f".{uuid.uuid4()}")
    with open(hidden, "wb") as f:
        f.write(data)
    os.replace(hidden, path)
    return path


def joined(parts: list[tuple[int, bytes]]) -> bytes:
    """The bytes without a gap from offset 0; of overlapping parts the earlier offset counts."""
    out = b""
    for offset, data in sorted(parts, key=lambda p: (p[0], -len(p[1]))):
        if offset > len(out):
            break
        out += data[len(out) - offset :] if offset + len(data) > len(out) else b""
    return out


def _landed(spark: SparkSession, folder: str, kind: str, sessions: list[str] | None) -> DataFrame:
    """session, at, content of the parts of a kind."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}.*").load(folder).select(F.regexp_extract("path", _PART, 1).alias("session"), F.regexp_extract("path", _PART, 3).cast("long").alias("at"), "content")
    return parts if sessions is None else parts.filter(F.col("session").isin(*sessions))


def landed_segments(spark: SparkSession, folder: str, sessions: list[str] | None = None) -> DataFrame:
    """Segments of what has landed of each session (or of some)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = joined([(int(a), bytes(c)) for a, c in zip(pdf["at"], pdf["content"])])
        return pd.DataFrame([(key[0], s.number, s.ts_micros, s.transport, s.src, s.dst, s.seq, s.flags, s.payload, s.pid) for s in capture.segments(data)], columns=_names(SEGMENT))

    return _landed(spark, folder, "pcap", sessions).groupBy("session").applyInPandas(run, SEGMENT)


def landed_keylog(spark: SparkSession, folder: str, sessions: list[str] | None = None) -> DataFrame:
    """Secrets of what has landed of the sessions' key logs; a line that isn't whole yet is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = joined([(int(a), bytes(c)) for a, c in zip(pdf["at"], pdf["content"])])
        return pd.DataFrame({"value": data[: data.rfind(b"\n") + 1].decode("utf-8", "replace").splitlines()}, dtype=object)

    return keylog_rows(_landed(spark, folder, "keylog", sessions).groupBy("session").applyInPandas(run, "value string"))


def decode_landing(spark: SparkSession, folder: str, out: str, checkpoint: str, *, available_now: bool = False, seconds: int = 2):  # noqa: ANN201
    """Follow the landing folder: each batch decodes the sessions that got new parts of their capture or key log, all of them in one plan,
    and replaces their rows below ``out`` (partitioned by session, so a replay of a batch gives the same rows). A session is decoded
    from its beginning: what a later secret opens is found in bytes that landed before it."""
    landed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{pcap,keylog}.*").load(folder)

    def write(batch: DataFrame, _: int) -> None:
        sessions = [r[0] for r in batch.select(F.regexp_extract("path", _PART, 1)).distinct().collect()]
        if sessions:
            rows = decode_capture(landed_segments(spark, folder, sessions), landed_keylog(spark, folder, sessions)).withColumn("session", F.col("session_id"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(out)

    writer = landed.select("path").writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"})).start()


def landed_flows(spark: SparkSession, out: str) -> DataFrame:
    """What ``decode_landing`` has decoded so far."""
    return spark.read.schema(FLOW).parquet(out)


STATES = {"open": ("decoding", "closed", "error"), "decoding": ("closed", "error"), "closed": (), "error": ()}


class SessionState:
    """The course of a session: open, then decoding or closed, ended once."""

    def __init__(self, status: str = "open") -> None:
        if status not in STATES:
            raise ValueError(f"unknown status {status!r}")
        self.status, self.finalized = status, status in ("closed", "error")

    def to(self, status: str, *, force: bool = False) -> bool:
        """Whether this call made the change; an ended session stays ended, force ends it from anywhere."""
        if self.finalized:
            return False
        if status not in STATES[self.status] and not (force and status in ("closed", "error")):
            raise ValueError(f"a session that is {self.status} can't become {status}")
        self.status = status
        self.finalized = status in ("closed", "error")
        return True


def batches_of(data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    for at in range(0, len(data), size):
        yield at, data[at : at + size]
