"""HTTP/2 connections: frames, header compression, exchanges and the settings fingerprint."""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

from flowloom.decode.content import decode_body, redirect_target
from flowloom.decode.http1 import Exchange
from flowloom.decode.streams import H2_PREFACE, Stream

TABLE_CEILING, FRAME_LIMIT, LIST_LIMIT = 65_536, 1 << 20, 1 << 20

# The static table of header compression, in order from 1.
STATIC = [
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"), (":status", "200"), (":status", "204"), (":status", "206"),
    (":status", "304"), (":status", "400"), (":status", "404"), (":status", "500"), ("accept-charset", ""), ("accept-encoding", "gzip, deflate"), ("accept-language", ""), ("accept-ranges", ""), ("accept", ""), ("access-control-allow-origin", ""),
    ("age", ""), ("allow", ""), ("authorization", ""), ("cache-control", ""), ("content-disposition", ""), ("content-encoding", ""), ("content-language", ""), ("content-length", ""), ("content-location", ""), ("content-range", ""),
    ("content-type", ""), ("cookie", ""), ("date", ""), ("etag", ""), ("expect", ""), ("expires", ""), ("from", ""), ("host", ""), ("if-match", ""), ("if-modified-since", ""),
    ("if-none-match", ""), ("if-range", ""), ("if-unmodified-since", ""), ("last-modified", ""), ("link", ""), ("location", ""), ("max-forwards", ""), ("proxy-authenticate", ""), ("proxy-authorization", ""), ("range", ""),
    ("referer", ""), ("refresh", ""), ("retry-after", ""), ("server", ""), ("set-cookie", ""), ("strict-transport-security", ""), ("transfer-encoding", ""), ("user-agent", ""), ("vary", ""), ("via", ""),
    ("www-authenticate", ""),
]

# The symbols of each code length. The code is canonical: lengths in order, symbols in order within one.
_ASCII_BY_LENGTH = {5: "012aceiost", 6: " %-./3456789=A_bdfghlmnpru", 7: ":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: "&*,;XZ", 10: '!"()?', 11: "'+|", 12: "#>", 13: "\x00$@[]~", 14: "^}", 15: "<`{", 19: "\\"}
_OTHERS_BY_LENGTH = {
    19: (195, 208), 20: (128, 130, 131, 162, 184, 194, 224, 226), 21: (153, 161, 167, 172, 176, 177, 179, 209, 216, 217, 227, 229, 230),
    22: (129, 132, 133, 134, 136, 146, 154, 156, 160, 163, 164, 169, 170, 173, 178, 181, 185, 186, 187, 189, 190, 196, 198, 228, 232, 233),
    24: (9, 142, 144, 145, 148, 159, 171, 206, 215, 225, 236, 237), 25: (199, 207, 234, 235), 26: (192, 193, 200, 201, 202, 205, 210, 213, 218, 219, 238, 240, 242, 243, 255),
    27: (203, 204, 211, 212, 214, 221, 222, 223, 241, 244, 245, 246, 247, 248, 250, 251, 252, 253, 254), 28: (*range(2, 9), 11, 12, *range(14, 22), *range(23, 32), 127, 220, 249), 30: (10, 13, 22, 256),
}


def _codes() -> dict[tuple[int, int], int]:
    """(length, code) -> symbol; length 23 has the symbols that no other has."""
    by = {n: [ord(c) for c in s] for n, s in _ASCII_BY_LENGTH.items()}
    for n, s in _OTHERS_BY_LENGTH.items():
        by.setdefault(n, []).extend(s)
    by[23] = sorted(set(range(257)) - {s for v in by.values() for s in v})
    out, code, last = {}, 0, 0
    for n in sorted(by):
        code <<= n - last
        for s in sorted(by[n]):
            out[n, code] = s
            code += 1
        last = n
    return out


CODES = _codes()


class CompressionError(ValueError):
    """A header block that can't be read."""


def huffman(data: bytes) -> bytes:
    out, code, n = bytearray(), 0, 0
    for byte in data:
        for bit in range(7, -1, -1):
            code, n = code << 1 | byte >> bit & 1, n + 1
            if (s := CODES.get((n, code))) is not None:
                if s == 256:
                    raise CompressionError("end of string inside a string")
                out.append(s)
                code = n = 0
            elif n > 30:
                raise CompressionError("bad Huffman code")
    if n > 7 or code != (1 << n) - 1:
        raise CompressionError("bad padding")
    return bytes(out)


def integer(data: bytes, at: int, prefix: int) -> tuple[int, int]:
    if at >= len(data):
        raise CompressionError("cut integer")
    most = (1 << prefix) - 1
    v, at = data[at] & most, at + 1
    if v < most:
        return v, at
    shift = 0
    while True:
        if at >= len(data) or shift > 56:
            raise CompressionError("bad integer")
        b, at = data[at], at + 1
        v += (b & 127) << shift
        shift += 7
        if not b & 128:
            return v, at


def string(data: bytes, at: int, prefix: int = 7) -> tuple[str, int]:
    coded = bool(data[at] >> prefix & 1) if at < len(data) else False
    n, at = integer(data, at, prefix)
    if at + n > len(data):
        raise CompressionError("cut string")
    raw = data[at : at + n]
    return (huffman(raw) if coded else raw).decode("latin-1"), at + n


@dataclass
class HeaderDecoder:
    """Header compression state of one direction."""

    limit: int = 4096
    entries: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0

    def _get(self, k: int) -> tuple[str, str]:
        if 1 <= k <= len(STATIC):
            return STATIC[k - 1]
        if len(STATIC) < k <= len(STATIC) + len(self.entries):
            return self.entries[k - len(STATIC) - 1]
        raise CompressionError(f"no entry {k}")

    def _fit(self) -> None:
        while self.size > self.limit and self.entries:
            n, v = self.entries.pop()
            self.size -= len(n) + len(v) + 32

    def _add(self, name: str, value: str) -> None:
        self.entries.insert(0, (name, value))
        self.size += len(name) + len(value) + 32
        self._fit()

    def decode(self, block: bytes) -> list[tuple[str, str]]:
        out, at, total = [], 0, 0
        while at < len(block):
            b = block[at]
            if b & 0x80:
                k, at = integer(block, at, 7)
                entry = self._get(k)
            elif b & 0xE0 == 0x20:
                k, at = integer(block, at, 5)
                if k > TABLE_CEILING:
                    raise CompressionError("table too large")
                self.limit = k
                self._fit()
                continue
            else:
                keep = bool(b & 0x40)
                k, at = integer(block, at, 6 if keep else 4)
                if k:
                    name = self._get(k)[0]
                else:
                    name, at = string(block, at)
                value, at = string(block, at)
                entry = (name, value)
                if keep:
                    self._add(name, value)
            out.append(entry)
            total += len(entry[0]) + len(entry[1]) + 32
            if total > LIST_LIMIT:
                raise CompressionError("header list too large")
        return out


@dataclass
class _Half:
    headers: list[tuple[str, str]] = field(default_factory=list)
    body: list[tuple[int, int]] = field(default_factory=list)  # from, to in the connection's bytes
    first: int = 0
    last: int = 0
    ended: bool = False


def _frames(s: Stream, at: int):  # noqa: ANN202
    d = s.data
    while at + 9 <= len(d):
        size = int.from_bytes(d[at : at + 3], "big")
        if size > FRAME_LIMIT or at + 9 + size > len(d):
            return
        yield d[at + 3], d[at + 4], struct.unpack_from(">I", d, at + 5)[0] & 0x7FFFFFFF, d[at + 9 : at + 9 + size], at + 9, s.time_at(at), s.time_at(at + 8 + size)
        at += 9 + size


def _unpadded(kind: int, flags: int, body: bytes) -> bytes:
    cut = 0
    if flags & 8:
        cut, body = (body[0], body[1:]) if body else (0, body)
    if kind == 1 and flags & 0x20:
        body = body[5:]
    return body[: len(body) - cut] if cut <= len(body) else b""


def exchanges(client: Stream, server: Stream, scheme: str = "https") -> tuple[list[tuple[int, Exchange]], str]:
    found, fingerprint = read_exchanges(client, server, scheme)
    return list(found), fingerprint


def read_exchanges(client: Stream, server: Stream, scheme: str = "https") -> tuple[Iterator[tuple[int, Exchange]], str]:
    """((stream, exchange) in order of first request, fingerprint settings|window|priority|order). Bodies are read from the connection's
    bytes when their exchange is taken."""
    streams: OrderedDict[int, list[_Half]] = OrderedDict()
    errors: dict[int, str] = {}
    settings, window, priorities, order, away = "", "00", "0", "", None
    for side, s in enumerate((client, server)):
        decoder, pending = HeaderDecoder(), None
        at = len(H2_PREFACE) if side == 0 and s.data[: len(H2_PREFACE)] == H2_PREFACE else 0
        for kind, flags, stream, body, place, first, last in _frames(s, at):
            if kind == 4 and side == 0 and not flags & 1 and not settings:
                settings = ";".join(f"{k}:{v}" for k, v in (struct.unpack_from(">HI", body, i) for i in range(0, len(body) // 6 * 6, 6)))
            elif kind == 8 and side == 0 and stream == 0 and window == "00" and len(body) >= 4:
                window = str(struct.unpack(">I", body[:4])[0] & 0x7FFFFFFF)
            elif kind == 2 and side == 0 and len(body) >= 5 and not streams:
                parent = struct.unpack(">I", body[:4])[0]
                one = f"{stream}:{parent >> 31}:{parent & 0x7FFFFFFF}:{body[4] + 1}"
                priorities = one if priorities == "0" else f"{priorities},{one}"
            elif kind in (1, 9):
                block = _unpadded(kind, flags, body) if kind == 1 else body
                pending = (stream, block, flags & 1, first) if kind == 1 else (pending[0], pending[1] + block, pending[2], pending[3]) if pending else None
                if pending and flags & 4:
                    stream, block, ended, first = pending
                    pending = None
                    if side == 1 and stream not in streams:
                        try:
                            decoder.decode(block)
                        except CompressionError:
                            break
                        continue
                    half = streams.setdefault(stream, [_Half(), _Half()])[side]
                    try:
                        got = decoder.decode(block)
                    except CompressionError as e:
                        errors[stream] = str(e)
                        break
                    if side == 1 and any(n == ":status" and v[:1] == "1" for n, v in got):
                        continue
                    half.first = half.first or first
                    half.headers += got
                    half.last, half.ended = last, half.ended or bool(ended)
                    if side == 0 and not order:
                        order = ",".join(n[1] for n, _ in got if n.startswith(":"))
            elif kind == 0 and stream in streams:
                half = streams[stream][side]
                start, kept = place + bool(flags & 8), len(_unpadded(0, flags, body))
                half.body.append((start, start + kept))
                half.last, half.ended = last, half.ended or bool(flags & 1)
            elif kind == 3 and len(body) >= 4:
                errors.setdefault(stream, f"stream reset by {'client' if side == 0 else 'server'}: {struct.unpack('>I', body[:4])[0]}")
            elif kind == 7 and len(body) >= 8 and side == 1:
                away = struct.unpack(">I", body[:4])[0] & 0x7FFFFFFF
    return _finished(client, server, streams, errors, away, scheme), f"{settings}|{window}|{priorities}|{order}"


def _finished(client: Stream, server: Stream, streams: dict[int, list[_Half]], errors: dict[int, str], away: int | None, scheme: str) -> Iterator[tuple[int, Exchange]]:
    whole = lambda s, half: b"".join(s.data[a:b] for a, b in half.body)
    for stream, (q, r) in streams.items():
        pseudo = dict(x for x in q.headers if x[0].startswith(":"))
        path, _, query = pseudo.get(":path", "").partition("?")
        status = next((v for n, v in r.headers if n == ":status"), "")
        get = lambda h, name: next((v for n, v in h if n == name), "")
        a, b = decode_body(whole(client, q), get(q.headers, "content-encoding")), decode_body(whole(server, r), get(r.headers, "content-encoding"))
        e = Exchange(
            pseudo.get(":method", ""), pseudo.get(":scheme", scheme), pseudo.get(":authority", "") or get(q.headers, "host"), path, query, int(status) if status.isdigit() else 0, q.first, max(0, r.last - q.first) if r.last else 0,
            q.headers, r.headers, a.data, b.data, a.encoding, b.encoding, error=errors.get(stream, ""),
        )
        if not e.status and away is not None and stream > away:
            e.error = e.error or "connection closed before the request was taken"
        if e.status and not r.ended and not e.error:
            e.error = "response cut short"
        e.redirect_location = redirect_target(e.status, e.scheme, e.authority, e.path, r.headers)
        yield stream, e
