"""One direction of a TCP connection as bytes, and what a connection carries."""

from __future__ import annotations

import mmap
import re
import struct
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator, MutableSequence
from dataclasses import dataclass, field

import numpy as np

MEMORY = 16 << 20
PIECE = 1 << 20
HEADER_CAP = 64 << 10
SOCKS_CAP = 4096


class Spool:
    """Bytes that are written one after the other: in memory up to ``MEMORY``, beyond it in a file without a name."""

    def __init__(self) -> None:
        self.size, self._held, self._chunks, self._file = 0, 0, [], None

    def write(self, data: bytes) -> None:
        self._chunks.append(data)
        self._held += len(data)
        self.size += len(data)
        if self._held > MEMORY:
            self._flush()

    def _flush(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        self._file.writelines(self._chunks)
        self._file.flush()
        self._held, self._chunks = 0, []

    def data(self) -> bytes | mmap.mmap:
        """All of it. A mapped file gives bytes for a slice and can be searched as bytes can."""
        if self._file is None:
            self._chunks = [b"".join(self._chunks)]
            return self._chunks[0]
        self._flush()
        return mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)


@dataclass
class Stream:
    """Bytes in order, with the time at which each part arrived."""

    data: bytes | mmap.mmap = b""
    gaps: int = 0
    cut: bool = False
    starts: MutableSequence[int] = field(default_factory=list)
    times: MutableSequence[int] = field(default_factory=list)

    def time_at(self, offset: int) -> int:
        k = bisect_right(self.starts, offset) - 1
        return self.times[k] if k >= 0 else 0

    def after(self, k: int) -> Stream:
        """The stream without its first k bytes."""
        if not k:
            return self
        rest = Spool()
        for at in range(k, len(self.data), PIECE):
            rest.write(self.data[at : at + PIECE])
        return Stream(rest.data(), self.gaps, self.cut, array("q", (max(0, x - k) for x in self.starts)), self.times)


class Segments:
    """Payloads of one direction as they were captured. Sequence numbers may wrap any number of times: each counts from the one before."""

    def __init__(self, first: int | None = None) -> None:
        self._spool, self._last, self._offset, self._end, self._ordered = Spool(), first, 0, None, True
        self._offsets, self._sizes, self._times = array("q"), array("q"), array("q")

    def add(self, seq: int, payload: bytes, at: int) -> None:
        if not payload:
            return
        if self._last is not None:
            self._offset += (seq - self._last + 0x80000000) % 0x100000000 - 0x80000000
        self._last = seq
        self._ordered = self._ordered and (self._end is None or self._offset >= self._end)
        self._end = self._offset + len(payload)
        self._offsets.append(self._offset)
        self._sizes.append(len(payload))
        self._times.append(at)
        self._spool.write(payload)

    @property
    def size(self) -> int:
        return self._spool.size

    def datagrams(self) -> Iterator[bytes]:
        data, at = self._spool.data(), 0
        for n in self._sizes:
            yield data[at : at + n]
            at += n

    def _longest(self) -> Iterator[tuple[int, int, int, int]]:
        """(offset, size, time, place) in order of offset; of payloads at one offset the longest, at the time of the first."""
        places = np.cumsum([0, *self._sizes]) if len(self._sizes) < 1000 else np.r_[0, np.cumsum(np.frombuffer(self._sizes, np.int64))]
        last = None
        for k in np.argsort(np.frombuffer(self._offsets, np.int64), kind="stable"):
            offset, size, at, place = self._offsets[k], self._sizes[k], self._times[k], int(places[k])
            if last and last[0] == offset:
                at = min(at, last[2])
                last = (offset, size, at, place) if size > last[1] else (*last[:2], at, last[3])
                continue
            if last:
                yield last
            last = (offset, size, at, place)
        if last:
            yield last

    def stream(self, cap: int | None = None) -> Stream:
        """The bytes in order; overlaps are trimmed from the later; missing bytes are skipped and counted as a gap."""
        out, data = Stream(starts=array("q"), times=array("q")), self._spool.data()
        if self._ordered and (cap is None or self._spool.size <= cap):
            end, at = None, 0
            for offset, n in zip(self._offsets, self._sizes):
                out.gaps += end is not None and offset > end
                out.starts.append(at)
                end, at = offset + n, at + n
            out.data, out.times = data, self._times
            return out
        end, placed = None, Spool()
        for offset, n, at, place in self._longest():
            skip = 0
            if end is not None:
                if offset + n <= end:
                    continue
                out.gaps += offset > end
                skip = max(0, end - offset)
            end = offset + n
            payload = data[place + skip : place + n]
            if cap is not None and placed.size + len(payload) > cap:
                payload, out.cut = payload[: cap - placed.size], True
            if payload:
                out.starts.append(placed.size)
                out.times.append(at)
                placed.write(payload)
            if out.cut:
                break
        out.data = placed.data()
        return out


def stitch(parts: list[tuple[int, bytes, int]], cap: int | None = None, first: int | None = None) -> Stream:
    """Stream of (sequence number, payload, time), at most ``cap`` bytes of it. ``first``: the number of the first byte where it is known."""
    out = Segments(first)
    for part in parts:
        out.add(*part)
    return out.stream(cap)


# The beginnings by which protocols are told apart.
METHODS = (b"GET ", b"POST ", b"PUT ", b"HEAD ", b"DELETE ", b"OPTIONS ", b"PATCH ", b"TRACE ", b"CONNECT ")
H2_PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
_REQUEST = re.compile(rb"[A-Z][A-Z_-]{0,30} \S{1,8192} HTTP/1\.[01]\r?\n")


def classify(client: bytes, server: bytes = b"") -> str:
    """tls, tls_midstream, connect, socks4, socks5, http2, http1, cleartext or empty."""
    if not client and not server:
        return "empty"
    if len(client) >= 6 and client[0] == 0x16 and client[1] == 3 and client[5] == 1:
        return "tls"
    if client.startswith(b"CONNECT "):
        return "connect"
    if client[:1] == b"\x05" and len(client) >= 2 and client[1] and len(client) >= 2 + client[1] and (not server or server[:1] == b"\x05"):
        return "socks5"
    if client[:1] == b"\x04" and len(client) >= 9 and client[1:2] in (b"\x01", b"\x02") and (not server or server[:1] == b"\x00"):
        return "socks4"
    if client.startswith(H2_PREFACE):
        return "http2"
    if _REQUEST.match(client) or client.startswith(METHODS):
        return "http1"
    first = client or server
    if len(first) >= 5 and first[0] in (0x14, 0x15, 0x17) and first[1] == 3:
        return "tls_midstream"
    return "cleartext"


@dataclass(frozen=True)
class Tunnel:
    """A proxy handshake: where the tunnelled bytes begin, and to whom."""

    proxy: str
    target: str
    client_at: int
    server_at: int
    accepted: bool
    user: str = ""
    password: str = ""


def connect_tunnel(client: bytes, server: bytes) -> Tunnel | None:
    """The CONNECT request and its answer; None while either is incomplete."""
    a, b = client.find(b"\r\n\r\n", 0, HEADER_CAP), server.find(b"\r\n\r\n", 0, HEADER_CAP)
    if a < 0 or b < 0:
        return None
    target = client.split(b" ", 2)[1].decode("latin-1")
    status = server.split(b" ", 2)[1:2]
    user = password = ""
    if m := re.search(rb"(?im)^proxy-authorization:\s*basic\s+([A-Za-z0-9+/=]+)", client[:a]):
        import base64
        import binascii

        try:
            user, _, password = base64.b64decode(m.group(1)).decode("utf-8", "replace").partition(":")
        except (binascii.Error, ValueError):
            pass
    return Tunnel("http", target, a + 4, b + 4, bool(status) and status[0][:1] == b"2", user, password)


def _socks_address(kind: int, data: bytes, at: int) -> tuple[str, int] | None:
    sizes = {1: 4, 4: 16}
    if kind == 3:
        if at >= len(data):
            return None
        n, at = data[at], at + 1
    else:
        n = sizes.get(kind, 0)
    if not n or at + n + 2 > len(data):
        return None
    raw, port = data[at : at + n], struct.unpack_from(">H", data, at + n)[0]
    host = raw.decode("latin-1") if kind == 3 else ".".join(map(str, raw)) if kind == 1 else None
    if host is None:
        import ipaddress

        host = f"[{ipaddress.IPv6Address(raw)}]"
    return f"{host}:{port}", at + n + 2


def socks_tunnel(client: bytes, server: bytes) -> Tunnel | None:
    """A SOCKS 4, 4a or 5 handshake; None while it is incomplete or if it is none."""
    if client[:1] == b"\x04":
        end = client.find(b"\0", 8, SOCKS_CAP)
        if end < 0 or len(server) < 8:
            return None
        port, ip, user = struct.unpack_from(">H", client, 2)[0], client[4:8], client[8:end].decode("utf-8", "replace")
        at, host = end + 1, ".".join(map(str, ip))
        if ip[:3] == b"\0\0\0" and ip[3]:
            stop = client.find(b"\0", at, SOCKS_CAP)
            if stop < 0:
                return None
            host, at = client[at:stop].decode("latin-1"), stop + 1
        return Tunnel("socks4", f"{host}:{port}", at, 8, server[0] == 0 and server[1] == 90, user)
    if client[:1] != b"\x05" or len(client) < 2 or len(server) < 2:
        return None
    at, back, user, password = 2 + client[1], 2, "", ""
    if server[1] == 2:
        if at + 2 > len(client) or client[at] != 1:
            return None
        n = client[at + 1]
        m = client[at + 2 + n] if at + 2 + n < len(client) else None
        if m is None or at + 3 + n + m > len(client) or len(server) < 4:
            return None
        user, password = client[at + 2 : at + 2 + n].decode("utf-8", "replace"), client[at + 3 + n : at + 3 + n + m].decode("utf-8", "replace")
        at, back = at + 3 + n + m, 4
        if server[3]:
            return Tunnel("socks5", "", at, back, False, user, password)
    elif server[1] == 0xFF:
        return Tunnel("socks5", "", at, back, False)
    if at + 4 > len(client) or client[at] != 5:
        return None
    target = _socks_address(client[at + 3], client, at + 4)
    reply = _socks_address(server[back + 3], server, back + 4) if back + 4 <= len(server) else None
    if target is None or reply is None:
        return None
    return Tunnel("socks5", target[0], target[1], reply[1], server[back + 1] == 0, user, password)
