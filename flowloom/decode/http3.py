"""QUIC connections with a key log, and the HTTP/3 exchanges in them."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from flowloom.decode import crypto
from flowloom.decode.content import decode_body, redirect_target
from flowloom.decode.http1 import Exchange
from flowloom.decode.http2 import CompressionError, integer, string
from flowloom.decode.streams import Stream
from flowloom.decode.tls import QUIC_SALTS, SUITES, Suite, _varint, initial_secret, server_choice

# The static table of header compression for HTTP/3, in order from 0.
STATIC = [
    (":authority", ""), (":path", "/"), ("age", "0"), ("content-disposition", ""), ("content-length", "0"), ("cookie", ""), ("date", ""), ("etag", ""), ("if-modified-since", ""), ("if-none-match", ""),
    ("last-modified", ""), ("link", ""), ("location", ""), ("referer", ""), ("set-cookie", ""), (":method", "CONNECT"), (":method", "DELETE"), (":method", "GET"), (":method", "HEAD"), (":method", "OPTIONS"),
    (":method", "POST"), (":method", "PUT"), (":scheme", "http"), (":scheme", "https"), (":status", "103"), (":status", "200"), (":status", "304"), (":status", "404"), (":status", "503"), ("accept", "*/*"),
    ("accept", "application/dns-message"), ("accept-encoding", "gzip, deflate, br"), ("accept-ranges", "bytes"), ("access-control-allow-headers", "cache-control"), ("access-control-allow-headers", "content-type"), ("access-control-allow-origin", "*"), ("cache-control", "max-age=0"), ("cache-control", "max-age=2592000"), ("cache-control", "max-age=604800"), ("cache-control", "no-cache"),
    ("cache-control", "no-store"), ("cache-control", "public, max-age=31536000"), ("content-encoding", "br"), ("content-encoding", "gzip"), ("content-type", "application/dns-message"), ("content-type", "application/javascript"), ("content-type", "application/json"), ("content-type", "application/x-www-form-urlencoded"), ("content-type", "image/gif"), ("content-type", "image/jpeg"),
    ("content-type", "image/png"), ("content-type", "text/css"), ("content-type", "text/html; charset=utf-8"), ("content-type", "text/plain"), ("content-type", "text/plain;charset=utf-8"), ("range", "bytes=0-"), ("strict-transport-security", "max-age=31536000"), ("strict-transport-security", "max-age=31536000; includesubdomains"), ("strict-transport-security", "max-age=31536000; includesubdomains; preload"), ("vary", "accept-encoding"),
    ("vary", "origin"), ("x-content-type-options", "nosniff"), ("x-xss-protection", "1; mode=block"), (":status", "100"), (":status", "204"), (":status", "206"), (":status", "302"), (":status", "400"), (":status", "403"), (":status", "421"),
    (":status", "425"), (":status", "500"), ("accept-language", ""), ("access-control-allow-credentials", "FALSE"), ("access-control-allow-credentials", "TRUE"), ("access-control-allow-headers", "*"), ("access-control-allow-methods", "get"), ("access-control-allow-methods", "get, post, options"), ("access-control-allow-methods", "options"), ("access-control-expose-headers", "content-length"),
    ("access-control-request-headers", "content-type"), ("access-control-request-method", "get"), ("access-control-request-method", "post"), ("alt-svc", "clear"), ("authorization", ""), ("content-security-policy", "script-src 'none'; object-src 'none'; base-uri 'none'"), ("early-data", "1"), ("expect-ct", ""), ("forwarded", ""), ("if-range", ""),
    ("origin", ""), ("purpose", "prefetch"), ("server", ""), ("timing-allow-origin", "*"), ("upgrade-insecure-requests", "1"), ("user-agent", ""), ("x-forwarded-for", ""), ("x-frame-options", "deny"), ("x-frame-options", "sameorigin"),
]


@dataclass
class FieldTable:
    """Entries that one side inserted. All stay reachable by their absolute number: the whole stream is at hand, so nothing waits
    for an insert; ``times`` say how many there were when a section was read."""

    capacity: int = 0
    entries: list[tuple[str, str]] = field(default_factory=list)
    times: list[int] = field(default_factory=list)

    def _static(self, k: int) -> tuple[str, str]:
        if k >= len(STATIC):
            raise CompressionError(f"no static entry {k}")
        return STATIC[k]

    def _entry(self, k: int) -> tuple[str, str]:
        if not 0 <= k < len(self.entries):
            raise CompressionError(f"no entry {k}")
        return self.entries[k]

    def inserts(self, s: Stream, at: int) -> None:
        """Read the encoder's stream."""
        d = s.data
        while at < len(d):
            try:
                b, start = d[at], at
                if b & 0x80:
                    k, at = integer(d, at, 6)
                    name = (self._static(k) if b & 0x40 else self._entry(len(self.entries) - 1 - k))[0]
                    value, at = string(d, at)
                elif b & 0x40:
                    name, at = string(d, at, 5)
                    value, at = string(d, at)
                elif b & 0x20:
                    _, at = integer(d, at, 5)
                    continue
                else:
                    k, at = integer(d, at, 5)
                    name, value = self._entry(len(self.entries) - 1 - k)
            except CompressionError:
                return
            self.entries.append((name, value))
            self.times.append(s.time_at(max(start, at - 1)))

    def section(self, block: bytes, time: int) -> list[tuple[str, str]]:
        encoded, at = integer(block, 0, 8)
        sign = bool(block[at] & 0x80) if at < len(block) else False
        delta, at = integer(block, at, 7)
        required = 0
        if encoded:
            most = self.capacity // 32
            if not most or encoded > 2 * most:
                raise CompressionError("bad insert count")
            highest = bisect_right(self.times, time) + most
            required = highest // (2 * most) * (2 * most) + encoded - 1
            if required > highest:
                required -= 2 * most
        base = required - delta - 1 if sign else required + delta
        out = []
        while at < len(block):
            b = block[at]
            if b & 0x80:
                k, at = integer(block, at, 6)
                out.append(self._static(k) if b & 0x40 else self._entry(base - k - 1))
            elif b & 0x40:
                k, at = integer(block, at, 4)
                name = (self._static(k) if b & 0x10 else self._entry(base - k - 1))[0]
                value, at = string(block, at)
                out.append((name, value))
            elif b & 0x20:
                name, at = string(block, at, 3)
                value, at = string(block, at)
                out.append((name, value))
            elif b & 0x10:
                k, at = integer(block, at, 4)
                out.append(self._entry(base + k))
            else:
                k, at = integer(block, at, 3)
                name = self._entry(base + k)[0]
                value, at = string(block, at)
                out.append((name, value))
        return out


@dataclass
class _Parts:
    """A stream's pieces by offset."""

    pieces: list[tuple[int, bytes, int]] = field(default_factory=list)
    size: int | None = None
    reset: int | None = None

    def stream(self) -> tuple[Stream, bool]:
        """(bytes without a gap from 0 on, whether that is all)."""
        out, length = Stream(), 0
        chunks = []
        for offset, data, at in sorted(self.pieces, key=lambda p: (p[0], -len(p[1]))):
            if offset > length:
                break
            part = data[length - offset :]
            if part:
                out.starts.append(length)
                out.times.append(at)
                chunks.append(part)
                length += len(part)
        out.data = b"".join(chunks)
        return out, self.size == length


class _Keys:
    def __init__(self, suite: Suite, secret: bytes) -> None:
        self.suite, self.secret = suite, secret
        name = suite.hash
        self.key, self.iv, self.mask_key = (crypto.expand_label(secret, x, n, name) for x, n in (("quic key", suite.key), ("quic iv", 12), ("quic hp", suite.key)))

    def next(self) -> _Keys:
        out = _Keys(self.suite, crypto.expand_label(self.secret, "quic ku", crypto.digest_size(self.suite.hash), self.suite.hash))
        out.mask_key = self.mask_key
        return out

    def mask(self, sample: bytes) -> bytes:
        if self.suite.cipher == "chacha":
            return crypto.chacha_stream(self.mask_key, sample[4:16], struct.unpack("<I", sample[:4])[0], 1)[:5]
        return crypto.aes_block(self.mask_key, sample)[:5]

    def open(self, number: int, head: bytes, body: bytes) -> bytes | None:
        nonce = crypto._xor(self.iv, struct.pack(">4xQ", number))
        return (crypto.chacha_open if self.suite.cipher == "chacha" else crypto.gcm_open)(self.key, nonce, body, head)


def _unmask(keys: _Keys, d: bytes, at: int, k: int, end: int, largest: int, low: int) -> tuple[bytes | None, int, int]:
    """(payload, packet number, first byte) of the packet whose number begins at k."""
    if k + 20 > end:
        return None, largest, d[at]
    mask = keys.mask(d[k + 4 : k + 20])
    lead = d[at] ^ mask[0] & low
    width = (lead & 3) + 1
    raw = bytes(a ^ b for a, b in zip(d[k : k + width], mask[1:]))
    window, number = 1 << (8 * width), int.from_bytes(raw, "big")
    number += (largest + 1) // window * window
    if number + window // 2 <= largest + 1:
        number += window
    elif number > largest + 1 + window // 2 and number >= window:
        number -= window
    return keys.open(number, bytes([lead]) + d[at + 1 : k] + raw, d[k + width : end]), number, lead


def _read_frames(payload: bytes, at_time: int, crypto_parts: _Parts, streams: dict[int, _Parts]) -> None:
    at = 0
    while at < len(payload):
        kind, at = _varint(payload, at)
        if kind in (0, 1, 0x1E):
            continue
        if 8 <= kind <= 15 or kind == 6:
            stream, offset, size = 0, 0, None
            if kind != 6:
                stream, at = _varint(payload, at)
            if kind == 6 or kind & 4:
                offset, at = _varint(payload, at)
            if kind == 6 or kind & 2:
                size, at = _varint(payload, at)
            data = payload[at:] if size is None else payload[at : at + size]
            at += len(data)
            parts = crypto_parts if kind == 6 else streams[stream]
            parts.pieces.append((offset, data, at_time))
            if kind != 6 and kind & 1:
                parts.size = offset + len(data)
            continue
        if kind in (2, 3):
            for _ in range(2):
                _, at = _varint(payload, at)
            count, at = _varint(payload, at)
            for _ in range(1 + 2 * count + 3 * (kind == 3)):
                _, at = _varint(payload, at)
        elif kind == 4:
            stream, at = _varint(payload, at)
            code, at = _varint(payload, at)
            _, at = _varint(payload, at)
            streams[stream].reset = code
        elif kind in (5, 0x11, 0x15):
            _, at = _varint(payload, at)
            _, at = _varint(payload, at)
        elif kind in (0x10, 0x12, 0x13, 0x14, 0x16, 0x17, 0x19):
            _, at = _varint(payload, at)
        elif kind == 7:
            size, at = _varint(payload, at)
            at += size
        elif kind == 0x18:
            _, at = _varint(payload, at)
            _, at = _varint(payload, at)
            at += 1 + payload[at] + 16
        elif kind in (0x1A, 0x1B):
            at += 8
        elif kind in (0x30, 0x31):
            if kind == 0x30:
                return
            size, at = _varint(payload, at)
            at += size
        else:
            return


def quic_streams(datagrams: Iterable[tuple[bool, bytes, int]], secrets: dict[tuple[str, str], str]) -> tuple[dict[int, _Parts], dict[int, _Parts]] | None:
    """Streams of both sides of a connection (from_client, datagram, time), or None where it can't be opened."""
    sides = {True: defaultdict(_Parts), False: defaultdict(_Parts)}
    hellos, ids, largest = {True: _Parts(), False: _Parts()}, {True: 0, False: 0}, defaultdict(lambda: -1)
    initial: dict[bool, _Keys] | None = None
    keys: dict[bool, list[_Keys]] = {}
    waiting: list[tuple[bool, bytes, int]] = []

    def short(up: bool, d: bytes, at: int, time: int) -> None:
        k = at + 1 + ids[not up]  # the receiver's own id, whose length it chose
        for turn, one in enumerate([*keys[up][-1:], keys[up][-1].next()]):
            got, number, _ = _unmask(one, d, at, k, len(d), largest[up], 0x1F)
            if got is not None:
                if turn:
                    keys[up].append(one)
                largest[up] = max(largest[up], number)
                _read_frames(got, time, _Parts(), sides[up])
                return

    for up, d, time in datagrams:
        at = 0
        try:
            while at < len(d):
                if not d[at] & 0x80:
                    if keys:
                        short(up, d, at, time)
                    elif len(waiting) < 10_000:
                        waiting.append((up, d[at:], time))
                    break
                version = struct.unpack_from(">I", d, at + 1)[0]
                if version != 1 or version not in QUIC_SALTS:
                    break
                destination = d[at + 6 : at + 6 + d[at + 5]]
                k = at + 6 + len(destination)
                ids[up] = d[k]
                k += 1 + d[k]
                kind = d[at] >> 4 & 3
                if kind == 0:
                    size, k = _varint(d, k)
                    k += size
                if kind == 3:
                    break
                length, k = _varint(d, k)
                if kind == 0:
                    if initial is None and up:
                        suite = Suite("gcm", 16, "sha256")
                        initial = {u: _Keys(suite, initial_secret(destination, 1, name)) for u, name in ((True, "client in"), (False, "server in"))}
                    if initial:
                        got, number, _ = _unmask(initial[up], d, at, k, k + length, largest["initial", up], 0x0F)
                        if got is not None:
                            largest["initial", up] = max(largest["initial", up], number)
                            _read_frames(got, time, hellos[up], defaultdict(_Parts))
                at = k + length
        except (IndexError, struct.error, ValueError):
            pass
        if not keys and initial:
            client, server = (hellos[u].stream()[0].data for u in (True, False))
            record = lambda b: b"\x16\x03\x03" + struct.pack(">H", len(b)) + b
            choice = server_choice(record(server[:16_000])) if server else None
            if choice and len(client) >= 38 and choice[2] in SUITES:
                names = [(f"{n}_TRAFFIC_SECRET_0", client[6:38].hex()) for n in ("CLIENT", "SERVER")]
                if any(n not in secrets for n in names):
                    return None
                keys = {u: [_Keys(SUITES[choice[2]], bytes.fromhex(secrets[n]))] for u, n in zip((True, False), names)}
                for u, rest, t in waiting:
                    try:
                        short(u, rest, 0, t)
                    except (IndexError, struct.error, ValueError):
                        continue
    return (sides[True], sides[False]) if keys else None


def exchanges(client: dict[int, _Parts], server: dict[int, _Parts]) -> list[tuple[int, Exchange]]:
    """((stream, exchange) in order of stream."""
    tables = {True: FieldTable(), False: FieldTable()}
    unidirectional = {True: client, False: server}
    encoders: dict[bool, tuple[Stream, int]] = {}
    for up, streams in unidirectional.items():
        for number, parts in streams.items():
            if number % 4 != (2 if up else 3):
                continue
            s, _ = parts.stream()
            try:
                kind, at = _varint(s.data, 0)
                if kind == 2:
                    encoders[up] = (s, at)
                elif kind == 0:
                    frame, at = _varint(s.data, at)
                    size, at = _varint(s.data, at)
                    end = at + size
                    while frame == 4 and at < min(end, len(s.data)):
                        name, at = _varint(s.data, at)
                        value, at = _varint(s.data, at)
                        if name == 1:  # what this side can hold bounds what the other side inserts
                            tables[not up].capacity = value
            except IndexError:
                continue
    for up, (s, at) in encoders.items():
        tables[up].inserts(s, at)
    out = []
    for number in sorted(n for n in client if n % 4 == 0):
        halves, error = {}, ""
        for up, parts in ((True, client[number]), (False, server.get(number, _Parts()))):
            s, whole = parts.stream()
            headers, body, at, first = [], b"", 0, s.times[0] if s.times else 0
            try:
                while at < len(s.data):
                    kind, at = _varint(s.data, at)
                    size, at = _varint(s.data, at)
                    data = s.data[at : at + size]
                    if kind == 0:
                        body += data
                    elif kind == 1 and len(data) == size:
                        got = tables[up].section(data, s.time_at(max(at + size - 1, 0)))
                        if not any(n == ":status" and v[:1] == "1" for n, v in got):
                            headers += got
                    at += size
            except (IndexError, CompressionError) as e:
                error = error or (str(e) if isinstance(e, CompressionError) else "frame cut short")
            if parts.reset is not None:
                error = error or f"stream reset by {'client' if up else 'server'}: {parts.reset}"
            halves[up] = (headers, body, first, s.times[-1] if s.times else 0, whole)
        (q, q_body, q_at, _, _), (r, r_body, _, r_end, r_whole) = halves[True], halves[False]
        if not q:
            continue
        get = lambda h, name: next((v for n, v in h if n == name), "")
        status = get(r, ":status")
        path, _, query = get(q, ":path").partition("?")
        a, b = decode_body(q_body, get(q, "content-encoding")), decode_body(r_body, get(r, "content-encoding"))
        if status and not r_whole and not error:
            error = "response cut short"
        e = Exchange(get(q, ":method"), get(q, ":scheme") or "https", get(q, ":authority") or get(q, "host"), path, query, int(status) if status.isdigit() else 0, q_at, max(0, r_end - q_at) if r_end else 0, q, r, a.data, b.data, a.encoding, b.encoding, error=error)
        e.redirect_location = redirect_target(e.status, e.scheme, e.authority, e.path, r)
        out.append((number, e))
    return out
