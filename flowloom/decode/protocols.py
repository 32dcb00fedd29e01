"""Decoders for other protocols: a registry, and a framed example protocol."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import zstandard

MAX_FRAME, MAX_DEPTH, MAX_ITEMS = 16 << 20, 64, 100_000


@dataclass(frozen=True)
class Meta:
    """What is known of a connection before its bytes are read."""

    host: str = ""
    port: int = 0
    transport: str = "tcp"


@dataclass
class Decoded:
    from_client: bool
    opcode: str
    payload: str
    metadata: dict[str, str] = field(default_factory=dict)


class Session(Protocol):
    def feed(self, from_client: bool, data: bytes) -> list[Decoded]: ...


class Registry:
    """Decoders by name; the last registration of a name counts, matches come in order of name."""

    def __init__(self) -> None:
        self._all: dict[str, tuple[Callable[[Meta], bool], Callable[[], Session]]] = {}

    def register(self, name: str, matches: Callable[[Meta], bool], new_session: Callable[[], Session]) -> None:
        self._all[name] = (matches, new_session)

    def find(self, meta: Meta) -> tuple[str, Session] | None:
        for name in sorted(self._all):
            if self._all[name][0](meta):
                return name, self._all[name][1]()
        return None


def lz4_block(data: bytes, limit: int = MAX_FRAME) -> bytes:
    """An LZ4 block; ValueError if it is damaged."""
    out, at = bytearray(), 0
    while at < len(data):
        token, at = data[at], at + 1
        n = token >> 4
        if n == 15:
            while True:
                if at >= len(data):
                    raise ValueError("cut literals")
                b, at = data[at], at + 1
                n += b
                if b != 255:
                    break
        if at + n > len(data):
            raise ValueError("cut literals")
        out += data[at : at + n]
        at += n
        if at == len(data):
            return bytes(out)
        if at + 2 > len(data):
            raise ValueError("cut offset")
        back, at = data[at] | data[at + 1] << 8, at + 2
        if not 0 < back <= len(out):
            raise ValueError("bad offset")
        n = token & 15
        if n == 15:
            while True:
                if at >= len(data):
                    raise ValueError("cut match")
                b, at = data[at], at + 1
                n += b
                if b != 255:
                    break
        n += 4
        if len(out) + n > limit:
            raise ValueError("too large")
        while n > 0:
            part = out[len(out) - back : len(out) - back + n]
            out += part
            n -= len(part)
    return bytes(out)


def msgpack(data: bytes, at: int = 0, depth: int = 0) -> tuple[Any, int]:
    """(value, end) of one MessagePack value; ValueError if it is damaged or too deep."""
    if depth > MAX_DEPTH or at >= len(data):
        raise ValueError("too deep or cut")
    b, at = data[at], at + 1

    def number(fmt: str) -> tuple[Any, int]:
        n = struct.calcsize(fmt)
        if at + n > len(data):
            raise ValueError("cut")
        return struct.unpack_from(fmt, data, at)[0], at + n

    def raw(n: int, k: int) -> tuple[bytes, int]:
        if k + n > len(data):
            raise ValueError("cut")
        return data[k : k + n], k + n

    def many(n: int, k: int, pairs: bool) -> tuple[Any, int]:
        if n > MAX_ITEMS or n > len(data) - k:
            raise ValueError("too many items")
        if not pairs:
            items = []
            for _ in range(n):
                v, k = msgpack(data, k, depth + 1)
                items.append(v)
            return items, k
        out = {}
        for _ in range(n):
            key, k = msgpack(data, k, depth + 1)
            out[key if isinstance(key, str) else json.dumps(key, default=str)], k = msgpack(data, k, depth + 1)
        return out, k

    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b < 0x90:
        return many(b & 15, at, True)
    if b < 0xA0:
        return many(b & 15, at, False)
    if b < 0xC0:
        v, at = raw(b & 31, at)
        return v.decode("utf-8", "replace"), at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if b in numbers:
        return number(numbers[b])
    sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I", 0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}
    if b in sizes:
        n, at = number(sizes[b])
        if b in (0xDC, 0xDD, 0xDE, 0xDF):
            return many(n, at, b >= 0xDE)
        if b in (0xC7, 0xC8, 0xC9):
            v, at = raw(n + 1, at)
            return {"ext": v[0], "data": base64.b64encode(v[1:]).decode()}, at
        v, at = raw(n, at)
        return (v.decode("utf-8", "replace") if b >= 0xD9 else {"bytes": base64.b64encode(v).decode()}), at
    if 0xD4 <= b <= 0xD8:
        v, at = raw((1 << (b - 0xD4)) + 1, at)
        return {"ext": v[0], "data": base64.b64encode(v[1:]).decode()}, at
    raise ValueError("unused byte")


#: What a frame's command says, and the compression byte of zstd (0 is none, any other an LZ4 block).
COMMANDS = {0: "Request", 1: "Response", 2: "Push", 3: "Error"}
ZSTD = 0xFF
HEAD = 10


def _label(names: dict[int, str], number: int, unknown: str) -> str:
    return f"{names[number]}({number})" if number in names else unknown.format(number)


@dataclass
class FramedSession:
    """Frames of a 10-byte big-endian head: version (1 byte), command (1), sequence (2), opcode (2), compression (1), length (3). The
    payload is MessagePack after 0 to 4 bytes, compressed as the head says.

    A message carries its command as opcode, and cmd, seq, opcode and ver as metadata; ``opcodes`` names some opcodes, others are shown in
    hex. A payload that can't be read is base64 of what it decompresses to, or of itself."""

    opcodes: dict[int, str] = field(default_factory=dict)
    rest: dict[bool, bytes] = field(default_factory=lambda: {True: b"", False: b""})

    def feed(self, from_client: bool, data: bytes) -> list[Decoded]:
        data, out, at = self.rest[from_client] + data, [], 0
        while at + HEAD <= len(data):
            version, command, sequence, opcode, compression = struct.unpack_from(">BBHHB", data, at)
            size = int.from_bytes(data[at + 7 : at + HEAD], "big")
            if at + HEAD + size > len(data):
                break
            payload = data[at + HEAD : at + HEAD + size]
            at += HEAD + size
            label = _label(COMMANDS, command, "cmd{}")
            fields = {"cmd": label, "seq": str(sequence), "opcode": _label(self.opcodes, opcode, "op0x{:x}"), "ver": str(version)}
            out.append(Decoded(from_client, label, framed_payload(payload, compression), fields))
        self.rest[from_client] = data[at:]
        return out


def framed_payload(payload: bytes, compression: int = 0) -> str:
    """JSON of the payload; of what can't be read, its base64."""
    if not payload:
        return '"[empty / ack]"'
    plain = payload
    try:
        if compression == ZSTD:
            plain = zstandard.ZstdDecompressor().decompress(payload, max_output_size=MAX_FRAME)
        elif compression:
            plain = lz4_block(payload)
    except (ValueError, zstandard.ZstdError):
        return json.dumps({"raw": base64.b64encode(payload).decode()})
    for skip in range(5):
        try:
            value, end = msgpack(plain, skip)
        except (ValueError, struct.error):
            continue
        if end == len(plain) and (isinstance(value, dict | list) or not skip):
            return json.dumps(value, ensure_ascii=False)
    return json.dumps({"raw": base64.b64encode(plain).decode()})
