"""Packets of classic pcap and pcapng captures, and the segments in them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

MAX_BLOCK = 64 << 20
MAX_BAD = 10_000

# Fixed values of the formats.
PCAP_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET, PROCESS = 0x0A0D0D0A, 1, 2, 3, 6, 0x80000001
ETHERNET, RAW_IP, LOOP, NULL, COOKED, COOKED2, NFLOG, PKTAP, RAW4, RAW6 = 1, 101, 108, 0, 113, 276, 239, 258, 228, 229
OPTION_PROCESS, OPTION_TSRESOL = 0x8001, 9


@dataclass(frozen=True)
class Packet:
    number: int
    ts_micros: int
    link: int
    data: bytes
    pid: int | None = None


def packets(data: bytes) -> Iterator[Packet]:
    """Packets of a capture in either format; reading stops at a broken record, and a cut last one is left out."""
    if data[:4] in PCAP_MAGICS:
        yield from _classic(data)
    elif len(data) >= 12 and struct.unpack_from(">I", data)[0] == SECTION:
        yield from _blocks(data)


def _classic(data: bytes) -> Iterator[Packet]:
    order, nanos = PCAP_MAGICS[data[:4]]
    if len(data) < 24:
        return
    link, at, n = struct.unpack_from(order + "I", data, 20)[0] & 0x0FFFFFFF, 24, 0
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
        if size > MAX_BLOCK or at + 16 + size > len(data):
            return
        n += 1
        yield Packet(n, sec * 1_000_000 + (frac if nanos == 1000 else frac // 1000), link, data[at + 16 : at + 16 + size])
        at += 16 + size


def _options(data: bytes, at: int, end: int, order: str) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0 or at + 4 + size > end:
            return
        yield code, data[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _blocks(data: bytes) -> Iterator[Packet]:
    order, at, n = "<", 0, 0
    links: list[tuple[int, int]] = []
    pids: list[int | None] = []
    while at + 12 <= len(data):
        kind = struct.unpack_from(order + "I", data, at)[0]
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            magic = data[at + 8 : at + 12]
            order = "<" if magic == b"\x4d\x3c\x2b\x1a" else ">"
            kind, links, pids = SECTION, [], []
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if size < 12 or size > MAX_BLOCK or at + size > len(data):
            return
        body, end = at + 8, at + size - 4
        if kind == INTERFACE and size >= 20:
            resolution = 1_000_000
            for code, value in _options(data, body + 8, end, order):
                if code == OPTION_TSRESOL and value:
                    resolution = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
            links.append((struct.unpack_from(order + "H", data, body)[0], resolution))
        elif kind == PROCESS and size >= 16:
            pids.append(struct.unpack_from(order + "I", data, body)[0])
        elif kind in (PACKET, OLD_PACKET) and size >= 32:
            if kind == PACKET:
                interface, high, low, captured, _ = struct.unpack_from(order + "IIIII", data, body)
            else:
                interface, _, high, low, captured, _ = struct.unpack_from(order + "HHIIII", data, body)
            if captured > size - 32:
                return
            link, resolution = links[interface] if interface < len(links) else (ETHERNET, 1_000_000)
            owner = None
            for code, value in _options(data, body + 20 + (captured + 3) // 4 * 4, end, order):
                if code == OPTION_PROCESS and len(value) >= 4:
                    k = struct.unpack_from(order + "I", value)[0]
                    owner = pids[k] if k < len(pids) else None
            n += 1
            yield Packet(n, ((high << 32) | low) * 1_000_000 // resolution, link, data[body + 20 : body + 20 + captured], owner)
        elif kind == SIMPLE_PACKET and size >= 16:
            n += 1
            original = struct.unpack_from(order + "I", data, body)[0]
            yield Packet(n, 0, links[0][0] if links else ETHERNET, data[body + 4 : min(end, body + 4 + original)])
        at += size


@dataclass(frozen=True)
class Segment:
    number: int
    ts_micros: int
    transport: str
    src: str
    dst: str
    seq: int
    flags: int
    payload: bytes
    pid: int | None = None


def _ip_payload(link: int, d: bytes) -> bytes | None:
    """The IP packet inside a link frame."""
    if link == ETHERNET:
        at, kind = 14, d[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            at, kind = at + 4, d[at + 2 : at + 4]
        return d[at:] if kind in (b"\x08\x00", b"\x86\xdd") else None
    if link in (RAW_IP, RAW4, RAW6, 12, 14):
        return d
    if link in (NULL, LOOP):
        return d[4:]
    if link == COOKED:
        return d[16:] if d[14:16] in (b"\x08\x00", b"\x86\xdd") else None
    if link == COOKED2:
        return d[20:] if d[:2] in (b"\x08\x00", b"\x86\xdd") else None
    if link == NFLOG:
        at = 4
        while at + 4 <= len(d):
            size, kind = struct.unpack_from("<HH", d, at)
            if size < 4:
                return None
            if kind & 0x7FFF == 9:
                return d[at + 4 : at + size]
            at += (size + 3) // 4 * 4
        return None
    if link == PKTAP and len(d) >= 12:
        size, _, inner = struct.unpack_from("<III", d)
        return _ip_payload(inner, d[size:]) if 0 < size <= len(d) and inner != PKTAP else None
    return None


def address(ip: bytes, port: int) -> str:
    """host:port; IPv6 hosts in brackets."""
    if len(ip) == 4:
        return f"{'.'.join(map(str, ip))}:{port}"
    import ipaddress

    return f"[{ipaddress.IPv6Address(ip)}]:{port}"


def segment(p: Packet) -> Segment | None:
    """The TCP or UDP part of a packet, None where there is none or it is cut."""
    ip = _ip_payload(p.link, p.data)
    if not ip or len(ip) < 20:
        return None
    if ip[0] >> 4 == 4:
        head, total, kind = (ip[0] & 15) * 4, struct.unpack_from(">H", ip, 2)[0], ip[9]
        if head < 20 or struct.unpack_from(">H", ip, 6)[0] & 0x1FFF:
            return None
        src, dst, body = ip[12:16], ip[16:20], ip[head : max(total, head) if total else len(ip)]
    elif ip[0] >> 4 == 6 and len(ip) >= 40:
        kind, at = ip[6], 40
        end = 40 + struct.unpack_from(">H", ip, 4)[0]
        while kind in (0, 43, 60) and at + 8 <= len(ip):
            kind, at = ip[at], at + 8 + ip[at + 1] * 8
        src, dst, body = ip[8:24], ip[24:40], ip[at:end]
    else:
        return None
    if kind == 6 and len(body) >= 20:
        sport, dport, seq = struct.unpack_from(">HHI", body)
        head = (body[12] >> 4) * 4
        return Segment(p.number, p.ts_micros, "tcp", address(src, sport), address(dst, dport), seq, body[13], body[head:], p.pid) if head >= 20 else None
    if kind == 17 and len(body) >= 8:
        sport, dport, size = struct.unpack_from(">HHH", body)
        return Segment(p.number, p.ts_micros, "udp", address(src, sport), address(dst, dport), 0, 0, body[8 : size if size >= 8 else None], p.pid)
    return None


def segments(data: bytes) -> Iterator[Segment]:
    for p in packets(data):
        if s := segment(p):
            yield s
