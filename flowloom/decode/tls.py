"""Recorded TLS opened with a key log, and the hello inside QUIC Initial packets."""

from __future__ import annotations

import hmac
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from flowloom.decode import crypto
from flowloom.decode.hello import VERSIONS, Hello, parse_hello
from flowloom.decode.streams import Spool, Stream


@dataclass(frozen=True)
class Suite:
    cipher: str  # gcm, chacha, cbc
    key: int
    hash: str  # of the key schedule from TLS 1.2 on
    mac: str = ""  # cbc only


# Cipher suites by number.
SUITES = {
    0x1301: Suite("gcm", 16, "sha256"), 0x1302: Suite("gcm", 32, "sha384"), 0x1303: Suite("chacha", 32, "sha256"),
    0x009C: Suite("gcm", 16, "sha256"), 0x009D: Suite("gcm", 32, "sha384"), 0xC02B: Suite("gcm", 16, "sha256"), 0xC02C: Suite("gcm", 32, "sha384"), 0xC02F: Suite("gcm", 16, "sha256"), 0xC030: Suite("gcm", 32, "sha384"), 0x009E: Suite("gcm", 16, "sha256"), 0x009F: Suite("gcm", 32, "sha384"),
    0x00A8: Suite("gcm", 16, "sha256"), 0x00A9: Suite("gcm", 32, "sha384"), 0xCCA8: Suite("chacha", 32, "sha256"), 0xCCA9: Suite("chacha", 32, "sha256"), 0xCCAA: Suite("chacha", 32, "sha256"), 0xCCAB: Suite("chacha", 32, "sha256"), 0xCCAC: Suite("chacha", 32, "sha256"),
    0x002F: Suite("cbc", 16, "sha256", "sha1"), 0x0035: Suite("cbc", 32, "sha256", "sha1"), 0xC009: Suite("cbc", 16, "sha256", "sha1"), 0xC00A: Suite("cbc", 32, "sha256", "sha1"), 0xC013: Suite("cbc", 16, "sha256", "sha1"), 0xC014: Suite("cbc", 32, "sha256", "sha1"), 0x008C: Suite("cbc", 16, "sha256", "sha1"), 0x008D: Suite("cbc", 32, "sha256", "sha1"),
    0x003C: Suite("cbc", 16, "sha256", "sha256"), 0x003D: Suite("cbc", 32, "sha256", "sha256"), 0xC023: Suite("cbc", 16, "sha256", "sha256"), 0xC027: Suite("cbc", 16, "sha256", "sha256"), 0x00AE: Suite("cbc", 16, "sha256", "sha256"), 0xC024: Suite("cbc", 32, "sha384", "sha384"), 0xC028: Suite("cbc", 32, "sha384", "sha384"), 0x00AF: Suite("cbc", 32, "sha384", "sha384"),
}
CHANGE, ALERT, HANDSHAKE, DATA = 20, 21, 22, 23


def records(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(type, version, body, offset) of all complete records."""
    at = 0
    while at + 5 <= len(data):
        kind, version, size = struct.unpack_from(">BHH", data, at)
        if kind not in (CHANGE, ALERT, HANDSHAKE, DATA) or size > 18_432 or at + 5 + size > len(data):
            break
        yield kind, version, data[at + 5 : at + 5 + size], at
        at += 5 + size


def handshake_start(data: bytes) -> bytes:
    """Handshake bytes before the cipher changes."""
    out = b""
    for kind, _, body, _ in records(data):
        if kind != HANDSHAKE:
            break
        out += body
    return out


def server_choice(data: bytes) -> tuple[bytes, int, int, bool] | None:
    """(random, version, suite, encrypt-then-MAC) of the ServerHello."""
    h = handshake_start(data)
    if len(h) < 42 or h[0] != 2:
        return None
    version, random, at = struct.unpack_from(">H", h, 4)[0], h[6:38], 39 + h[38]
    if at + 3 > len(h):
        return None
    later_mac = False
    suite, end = struct.unpack_from(">H", h, at)[0], 4 + int.from_bytes(h[1:4], "big")
    at += 5
    while at + 4 <= min(end, len(h)):
        kind, size = struct.unpack_from(">HH", h, at)
        if kind == VERSIONS and size == 2:
            version = struct.unpack_from(">H", h, at + 4)[0]
        later_mac = later_mac or kind == 22
        at += 4 + size
    return random, version, suite, later_mac


VERSION_TEXT = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def describe_handshake(client: bytes, server: bytes) -> dict[str, object]:
    """What a recorded handshake says in the clear: hello (text), sni, version, cipher, and up to TLS 1.2 the SHA-256 of each certificate."""
    from hashlib import sha256

    from flowloom.decode.hello import describe

    hello, choice, certificates = parse_hello(handshake_start(client)), server_choice(server), []
    h, at = handshake_start(server), 0
    while at + 4 <= len(h):
        kind, size = h[at], int.from_bytes(h[at + 1 : at + 4], "big")
        if kind == 11 and at + 4 + size <= len(h):
            k = at + 7
            while k + 3 <= at + 4 + size:
                n = int.from_bytes(h[k : k + 3], "big")
                certificates.append(sha256(h[k + 3 : k + 3 + n]).hexdigest())
                k += 3 + n
        at += 4 + size
    version, cipher = (VERSION_TEXT.get(choice[1], f"0x{choice[1]:04x}"), f"0x{choice[2]:04x}") if choice else ("", "")
    return {"hello": describe(hello) if hello else "", "sni": hello.sni if hello else "", "version": version, "cipher": cipher, "certificates": certificates}


class _Aead:
    """One direction with counted nonces. explicit: 8 bytes of the nonce come with each record (TLS 1.2 GCM)."""

    def __init__(self, suite: Suite, key: bytes, iv: bytes, version: int) -> None:
        self.suite, self.key, self.iv, self.version, self.seq = suite, key, iv, version, 0

    def open(self, kind: int, version: int, body: bytes) -> tuple[int, bytes] | None:
        run = crypto.gcm_open if self.suite.cipher == "gcm" else crypto.chacha_open
        count = struct.pack(">Q", self.seq)
        if self.version >= 0x0304:
            got = run(self.key, crypto._xor(self.iv, b"\0" * 4 + count), body, struct.pack(">BHH", kind, version, len(body)))
            if got is None:
                return None  # a record of another epoch: the count stays
            got = got.rstrip(b"\0")
            self.seq += 1
            return (got[-1], got[:-1]) if got else None
        if self.suite.cipher == "gcm":
            nonce, body = self.iv + body[:8], body[8:]
        else:
            nonce = crypto._xor(self.iv, b"\0" * 4 + count)
        got = run(self.key, nonce, body, count + struct.pack(">BHH", kind, version, max(0, len(body) - 16)))
        self.seq += 1
        return None if got is None else (kind, got)


class _Cbc:
    """MAC then encrypt, or the other way round where both sides agreed on it."""

    def __init__(self, suite: Suite, key: bytes, iv: bytes, mac: bytes, version: int, later_mac: bool) -> None:
        self.suite, self.key, self.iv, self.mac, self.version, self.later_mac, self.seq = suite, key, iv, mac, version, later_mac, 0

    def open(self, kind: int, version: int, body: bytes) -> tuple[int, bytes] | None:
        if self.later_mac:
            size = crypto.digest_size(self.suite.mac)
            body, tag = body[:-size], body[-size:]
            if hmac.new(self.mac, struct.pack(">QBHH", self.seq, kind, version, len(body)) + body, self.suite.mac).digest() != tag:
                return None
        if len(body) < 32 and self.version > 0x0301 or not body or len(body) % 16:
            return None
        iv, data = (body[:16], body[16:]) if self.version > 0x0301 else (self.iv, body)
        self.iv = body[-16:]
        plain = crypto.cbc_open(self.key, iv, data)
        if self.later_mac:
            self.seq += 1
            return kind, plain[: len(plain) - plain[-1] - 1]
        size = crypto.digest_size(self.suite.mac)
        end = len(plain) - plain[-1] - 1 - size
        if end < 0:
            return None
        want = hmac.new(self.mac, struct.pack(">QBHH", self.seq, kind, version, end) + plain[:end], self.suite.mac).digest()
        self.seq += 1
        return (kind, plain[:end]) if want == plain[end : end + size] else None


def open_tls(client: Stream, server: Stream, secrets: dict[tuple[str, str], str]) -> tuple[Stream, Stream] | None:
    """Application data of both directions, or None where the hello is cut, the suite unknown or no secret there.
    secrets: (label, client random in hex) -> secret in hex."""
    hello_bytes, choice = handshake_start(client.data), server_choice(server.data)
    if len(hello_bytes) < 38 or choice is None or choice[2] not in SUITES:
        return None
    random, (server_random, version, number, later_mac) = hello_bytes[6:38], choice
    suite, out = SUITES[number], []
    sides = ((client, "CLIENT"), (server, "SERVER"))
    if version >= 0x0304:
        if any((f"{n}_TRAFFIC_SECRET_0", random.hex()) not in secrets for _, n in sides):
            return None
    elif ("CLIENT_RANDOM", random.hex()) not in secrets:
        return None
    for k, (stream, name) in enumerate(sides):
        if version >= 0x0304:
            secret = bytes.fromhex(secrets[f"{name}_TRAFFIC_SECRET_0", random.hex()])
            make = lambda s: _Aead(suite, crypto.expand_label(s, "key", suite.key, suite.hash), crypto.expand_label(s, "iv", 12, suite.hash), version)
            reader, changed = make(secret), True
        else:
            master = bytes.fromhex(secrets["CLIENT_RANDOM", random.hex()])
            mac = crypto.digest_size(suite.mac) if suite.mac else 0
            iv = {"gcm": 4, "chacha": 12, "cbc": 16}[suite.cipher]
            block = crypto.prf(master, b"key expansion", server_random + random, 2 * (mac + suite.key + iv), suite.hash if version >= 0x0303 else None)
            part = lambda size, at: block[at + k * size : at + (k + 1) * size]
            macs, keys, ivs = part(mac, 0), part(suite.key, 2 * mac), part(iv, 2 * (mac + suite.key))
            reader, changed = (_Cbc(suite, keys, ivs, macs, version, later_mac) if suite.cipher == "cbc" else _Aead(suite, keys, ivs, version)), False
        plain, opened = Stream(gaps=stream.gaps, starts=array("q"), times=array("q")), Spool()
        for kind, record_version, body, at in records(stream.data):
            if kind == CHANGE:
                changed = True
                continue
            if not changed or (version >= 0x0304 and kind != DATA):
                continue
            got = reader.open(kind, record_version, body)
            if got is None:
                continue
            if got[0] == DATA and got[1]:
                plain.starts.append(opened.size)
                plain.times.append(stream.time_at(at))
                opened.write(got[1])
            elif got[0] == HANDSHAKE and version >= 0x0304 and got[1][:1] == b"\x18":  # key update
                secret = crypto.expand_label(secret, "traffic upd", crypto.digest_size(suite.hash), suite.hash)
                reader = make(secret)
        plain.data = opened.data()
        out.append(plain)
    return out[0], out[1]


# Salts of the Initial secrets by version.
QUIC_SALTS = {1: bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"), 0x6B3343CF: bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9")}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    size = 1 << (data[at] >> 6)
    if at + size > len(data):
        raise IndexError
    return int.from_bytes(data[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


def initial_secret(destination: bytes, version: int = 1, side: str = "client in") -> bytes:
    return crypto.expand_label(crypto.extract(QUIC_SALTS[version], destination, "sha256"), side, 32, "sha256")


def _crypto_frames(payload: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(payload):
        kind, at = _varint(payload, at)
        if kind in (0, 1):
            continue
        if kind == 6:
            offset, at = _varint(payload, at)
            size, at = _varint(payload, at)
            out.append((offset, payload[at : at + size]))
            at += size
        elif kind in (2, 3):
            _, at = _varint(payload, at)
            _, at = _varint(payload, at)
            count, at = _varint(payload, at)
            for _ in range(2 * count + 1 + 3 * (kind == 3)):
                _, at = _varint(payload, at)
        else:
            break
    return out


def quic_hello(datagrams: list[bytes]) -> Hello | None:
    """The ClientHello of a client's Initial packets, in any order and number of datagrams."""
    parts: dict[int, bytes] = {}
    first: bytes | None = None
    for d in datagrams[:16]:
        at = 0
        try:
            while at + 7 < len(d) and d[at] & 0xC0 == 0xC0:
                version = struct.unpack_from(">I", d, at + 1)[0]
                if version not in QUIC_SALTS:
                    break
                n = d[at + 5]
                destination, k = d[at + 6 : at + 6 + n], at + 6 + n
                k += 1 + d[k]
                initial = (d[at] >> 4 & 3) == (0 if version == 1 else 1)
                if initial:
                    size, k = _varint(d, k)
                    k += size
                length, k = _varint(d, k)
                if initial:
                    first = first if first is not None else destination
                    secret = initial_secret(first, version)
                    names = ("quic key", "quic iv", "quic hp") if version == 1 else ("quicv2 key", "quicv2 iv", "quicv2 hp")
                    key, iv, hp = (crypto.expand_label(secret, x, s, "sha256") for x, s in zip(names, (16, 12, 16)))
                    mask = crypto.aes_block(hp, d[k + 4 : k + 20])
                    lead = d[at] ^ mask[0] & 0x0F
                    width = (lead & 3) + 1
                    number = bytes(a ^ b for a, b in zip(d[k : k + width], mask[1:]))
                    head = bytes([lead]) + d[at + 1 : k] + number
                    got = crypto.gcm_open(key, crypto._xor(iv, bytes(12 - width) + number), d[k + width : k + length], head)
                    for offset, data in _crypto_frames(got) if got else ():
                        parts[offset] = max(parts.get(offset, b""), data, key=len)
                at = k + length
        except (IndexError, struct.error, ValueError):
            continue
    whole = b""
    for offset in sorted(parts):
        if offset <= len(whole):
            whole = whole[:offset] + parts[offset] if offset + len(parts[offset]) > len(whole) else whole
    return parse_hello(whole)
