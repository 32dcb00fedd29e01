"""TLS ClientHello messages and their fingerprints."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extension numbers and version names of the fingerprint.
SNI, GROUPS, FORMATS, SIGNATURES, ALPN, VERSIONS = 0, 10, 11, 13, 16, 43
VERSION_NAMES = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2", 0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3"}


def grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


@dataclass
class Hello:
    version: int = 0
    ciphers: list[int] = field(default_factory=list)
    extensions: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    formats: list[int] = field(default_factory=list)
    signatures: list[int] = field(default_factory=list)
    versions: list[int] = field(default_factory=list)
    alpn: list[str] = field(default_factory=list)
    sni: str = ""


def _u16s(b: bytes) -> list[int]:
    return list(struct.unpack(f">{len(b) // 2}H", b[: len(b) // 2 * 2]))


def parse_hello(raw: bytes) -> Hello | None:
    """A handshake message of type 1, with or without its record header; None if it is cut or something else."""
    if len(raw) > 5 and raw[0] == 0x16 and raw[1] == 3:
        raw = raw[5:]
    if len(raw) < 42 or raw[0] != 1 or len(raw) < 4 + int.from_bytes(raw[1:4], "big"):
        return None
    h, at, end = Hello(struct.unpack_from(">H", raw, 4)[0]), 38, 4 + int.from_bytes(raw[1:4], "big")

    def take(width: int) -> bytes | None:
        nonlocal at
        if at + width > end:
            return None
        n = int.from_bytes(raw[at : at + width], "big")
        if at + width + n > end:
            return None
        part = raw[at + width : at + width + n]
        at += width + n
        return part

    if take(1) is None or (ciphers := take(2)) is None or take(1) is None:
        return None
    h.ciphers = _u16s(ciphers)
    if at == end:
        return h
    block = take(2)
    if block is None:
        return None
    k = 0
    while k + 4 <= len(block):
        kind, size = struct.unpack_from(">HH", block, k)
        body = block[k + 4 : k + 4 + size]
        if len(body) < size:
            return None
        k += 4 + size
        h.extensions.append(kind)
        if kind == SNI and len(body) >= 5:
            h.sni = body[5 : 5 + struct.unpack_from(">H", body, 3)[0]].decode("latin-1")
        elif kind == GROUPS:
            h.groups = _u16s(body[2:])
        elif kind == FORMATS:
            h.formats = list(body[1:])
        elif kind == SIGNATURES:
            h.signatures = _u16s(body[2:])
        elif kind == VERSIONS:
            h.versions = _u16s(body[1:])
        elif kind == ALPN:
            j = 2
            while j < len(body):
                h.alpn.append(body[j + 1 : j + 1 + body[j]].decode("latin-1"))
                j += 1 + body[j]
    return h


def ja3_text(h: Hello) -> str:
    join = lambda v: "-".join(str(x) for x in v if not grease(x))
    return f"{h.version},{join(h.ciphers)},{join(h.extensions)},{join(h.groups)},{'-'.join(map(str, h.formats))}"


def ja3(h: Hello) -> str:
    return hashlib.md5(ja3_text(h).encode(), usedforsecurity=False).hexdigest()


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12] if text else "0" * 12


def ja4(h: Hello, quic: bool = False) -> str:
    versions = [v for v in h.versions if not grease(v)]
    version = VERSION_NAMES.get(max(versions) if versions else h.version, "00")
    ciphers = [c for c in h.ciphers if not grease(c)]
    extensions = [e for e in h.extensions if not grease(e)]
    first = h.alpn[0] if h.alpn else ""
    alpn = "00" if not first else first[0] + first[-1] if first[0].isalnum() and first[-1].isalnum() else first.encode("latin-1").hex()[0] + first.encode("latin-1").hex()[-1]
    head = f"{'q' if quic else 't'}{version}{'d' if SNI in extensions else 'i'}{min(len(ciphers), 99):02d}{min(len(extensions), 99):02d}{alpn}"
    rest = ",".join(f"{e:04x}" for e in sorted(e for e in extensions if e not in (SNI, ALPN)))
    signatures = ",".join(f"{s:04x}" for s in h.signatures if not grease(s))
    return f"{head}_{_digest(','.join(f'{c:04x}' for c in sorted(ciphers)))}_{_digest(rest + ('_' + signatures if signatures else '') if rest else '')}"


def describe(h: Hello) -> str:
    """Readable form: version, ciphers, extensions, groups, formats, then names offered."""
    return ja3_text(h) + (f" alpn={','.join(h.alpn)}" if h.alpn else "") + (f" sni={h.sni}" if h.sni else "")


def hello_fingerprints(hellos: DataFrame, raw: str = "raw") -> DataFrame:
    """hellos with sni, ja3, ja4 and hello_text; NULL where the message is cut or none."""
    columns = [c for c in hellos.columns if c != raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_hello(r) if r else None for r in batch.column(raw).to_pylist()]
            more = [pa.array([f(h) if h else None for h in parsed], pa.string()) for f in (lambda h: h.sni, ja3, ja4, describe)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, "sni", "ja3", "ja4", "hello_text"])

    from pyspark.sql import types as T

    schema = T.StructType([hellos.schema[c] for c in columns] + [T.StructField(n, T.StringType()) for n in ("sni", "ja3", "ja4", "hello_text")])
    return hellos.mapInArrow(run, schema)


def ja3_hash(text_column: str):  # noqa: ANN201
    """md5 of a ja3 text inside the JVM."""
    return F.md5(F.col(text_column).cast("binary"))
