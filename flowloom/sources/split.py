"""Captures of any size, read in parts.

Planning walks over the heads of a file's records (not over their bytes) and cuts it at record borders about every ``split_bytes``, so that
parts are exact and a file is read by as many tasks as it has parts. What a part's packets refer to (the file's head; sections, interfaces and
processes of the newer format) is sent along as its prefix. Files must lie where the driver and all executors can open them; on
other file systems ``capture.read_segments`` reads a file in one task.
"""

from __future__ import annotations

import glob
import mmap
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowloom.decode import capture
from flowloom.sources.capture import SEGMENT

SPLIT_BYTES = 64 << 20
ROWS_AT_ONCE = 5000


class Part(InputPartition):
    """Bytes start to end of a file, behind a prefix; its first packet is number + 1."""

    def __init__(self, path: str, prefix: bytes, start: int, end: int, number: int) -> None:
        self.path, self.prefix, self.start, self.end, self.number = path, prefix, start, end, number


def _records(data: mmap.mmap) -> Iterator[tuple[int, int, bool, bool]]:
    """(begin, end, whether it is a packet, whether it opens a section) of every record up to the first that is broken or cut."""
    if data[:4] in capture.PCAP_MAGICS:
        order, at = capture.PCAP_MAGICS[data[:4]][0], 24
        while at + 16 <= len(data):
            size = struct.unpack_from(order + "I", data, at + 8)[0]
            if size > capture.MAX_BLOCK or at + 16 + size > len(data):
                return
            yield at, at + 16 + size, True, False
            at += 16 + size
        return
    order, at = "<", 0
    while at + 12 <= len(data):
        opens = data[at : at + 4] == b"\x0a\x0d\x0d\x0a"
        if opens:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size > capture.MAX_BLOCK or at + size > len(data):
            return
        long_ = not opens and kind in (capture.PACKET, capture.OLD_PACKET) and size >= 32
        if long_ and struct.unpack_from(order + "I", data, at + 20)[0] > size - 32:
            return
        yield at, at + size, long_ or not opens and kind == capture.SIMPLE_PACKET and size >= 16, opens
        at += size


def parts_of(path: str, split_bytes: int = SPLIT_BYTES) -> list[Part]:
    """Where to cut a file; a file that is no capture has no parts."""
    if os.path.getsize(path) < 12:
        return []
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        classic = data[:4] in capture.PCAP_MAGICS
        if not classic and data[:4] != b"\x0a\x0d\x0d\x0a" or classic and len(data) < 24:
            return []
        out: list[Part] = []
        known = data[:24] if classic else b""  # what packets from here on refer to
        prefix, start, number, first, end = known, 24 if classic else 0, 0, 0, 24 if classic else 0
        for begin, end_, packet, opens in _records(data):
            if begin - start >= split_bytes:
                out.append(Part(path, prefix, start, begin, first))
                prefix, start, first = known, begin, number
            if opens:
                known = b""
            if packet:
                number += 1
            elif not classic:
                known += data[begin:end_]
            end = end_
        if end > start:
            out.append(Part(path, prefix, start, end, first))
    return out


class CaptureReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int, schema: StructType) -> None:
        self.paths, self.split_bytes, self.schema = paths, split_bytes, to_arrow_schema(schema)

    def partitions(self) -> list[Part]:
        return [p for path in self.paths for p in parts_of(path, self.split_bytes)] or [Part("", b"", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = partition.prefix + f.read(partition.end - partition.start)
        session, schema = os.path.basename(partition.path), self.schema
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for s in capture.segments(data):
            rows.append((session, s.number + partition.number, s.ts_micros, s.transport, s.src, s.dst, s.seq, s.flags, s.payload, s.pid))
            if len(rows) == ROWS_AT_ONCE:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_parts"

    def schema(self) -> str:
        return SEGMENT

    def reader(self, schema: StructType) -> CaptureReader:
        where = self.options["path"]
        paths = sorted(glob.glob(os.path.join(where, "*")) if os.path.isdir(where) else glob.glob(where))
        return CaptureReader([p for p in paths if os.path.isfile(p)], int(self.options.get("split_bytes", SPLIT_BYTES)), schema)


def read_parts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """TCP and UDP segments of the captures at a path (a file, a folder or a pattern), as ``capture.read_segments`` gives them."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture_parts").option("path", path).option("split_bytes", str(split_bytes)).load()
