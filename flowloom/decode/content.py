"""Content encodings undone, message framing of WebSocket, cookies and redirects."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from urllib.parse import urljoin

import zstandard

CAP = 256 << 20


@dataclass(frozen=True)
class Body:
    data: bytes
    encoding: str = ""  # what is still applied
    cut: bool = False
    truncated: bool = False  # longer than the cap


def _inflate(data: bytes, wbits: int, cap: int) -> tuple[bytes, bool, bool]:
    """(bytes, complete, capped); raises zlib.error if nothing can be read."""
    out, size, rest = [], 0, data
    while True:
        d = zlib.decompressobj(wbits)
        part = d.decompress(rest, cap - size + 1)
        out.append(part)
        size += len(part)
        if size > cap:
            return b"".join(out)[:cap], True, True
        if not d.eof:
            return b"".join(out), False, False
        rest = d.unused_data
        if wbits != 31 or rest[:2] != b"\x1f\x8b":
            return b"".join(out), True, False


def decode_body(data: bytes, encoding: str | None, cap: int = CAP) -> Body:
    """data without its content encoding. Chains and unknown encodings are kept as they are; mislabelled data too; a cut stream gives what
    could be read before the cut."""
    name = (encoding or "").strip().lower()
    if name in ("", "identity") or not data:
        return Body(data, "" if name == "identity" else name if not data else "")
    try:
        if name in ("gzip", "x-gzip"):
            out, whole, capped = _inflate(data, 31, cap)
        elif name == "deflate":
            try:
                out, whole, capped = _inflate(data, 15, cap)
            except zlib.error:
                out, whole, capped = _inflate(data, -15, cap)
                if not whole:
                    return Body(data, name)
        elif name == "zstd":
            reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            out, whole, capped = b"", True, False
            try:
                while part := reader.read(1 << 20):
                    out += part
                    if len(out) > cap:
                        out, capped = out[:cap], True
                        break
            except zstandard.ZstdError:
                whole = False
                if not out:
                    return Body(data, name)
        else:
            return Body(data, name)
    except zlib.error:
        return Body(data, name)
    if not out and not whole:
        return Body(data, name)
    return Body(out, "", not whole, capped)


# Frame opcodes.
OPCODES = {0: "continuation", 1: "text", 2: "binary", 8: "close", 9: "ping", 10: "pong"}


@dataclass(frozen=True)
class Frame:
    opcode: str
    payload: bytes
    final: bool
    offset: int


def websocket_frames(data: bytes) -> tuple[list[Frame], int]:
    """Complete frames and how many bytes they take; payloads unmasked."""
    out, at = [], 0
    while at + 2 <= len(data):
        a, b = data[at], data[at + 1]
        size, head = b & 0x7F, 2
        if size == 126:
            head = 4
        elif size == 127:
            head = 10
        if at + head > len(data):
            break
        if head > 2:
            size = int.from_bytes(data[at + 2 : at + head], "big")
        mask = data[at + head : at + head + 4] if b & 0x80 else b""
        start = at + head + (4 if b & 0x80 else 0)
        if start + size > len(data):
            break
        payload = data[start : start + size]
        if mask and payload:
            key = (mask * (size // 4 + 1))[:size]
            payload = (int.from_bytes(payload, "big") ^ int.from_bytes(key, "big")).to_bytes(size, "big")
        out.append(Frame(OPCODES.get(a & 15, f"op0x{a & 15:x}"), payload, bool(a & 0x80), at))
        at = start + size
    return out, at


def request_cookies(value: str) -> list[tuple[str, str]]:
    """name and value of a Cookie header, in order; parts without a name are left out."""
    out = []
    for part in value.split(";"):
        name, eq, v = part.strip().partition("=")
        if eq and name.strip():
            out.append((name.strip(), v.strip().strip('"')))
    return out


def response_cookie(value: str) -> dict[str, str] | None:
    """name, value and attributes (lower case) of a Set-Cookie header."""
    first, *rest = value.split(";")
    name, eq, v = first.strip().partition("=")
    if not eq or not name.strip():
        return None
    out = {"name": name.strip(), "value": v.strip().strip('"')}
    for part in rest:
        k, _, w = part.strip().partition("=")
        if k and k.lower() not in ("name", "value"):
            out[k.strip().lower()] = w.strip()
    return out


def redirect_target(status: int | None, scheme: str, authority: str, path: str, headers: list[tuple[str, str]]) -> str:
    """Absolute target of a 3xx response by its first Location; '' if there is none, the raw value if it can't be resolved."""
    if not status or not 300 <= status <= 399:
        return ""
    raw = next((v for k, v in headers if k.lower() == "location"), "")
    if not raw:
        return ""
    try:
        return urljoin(f"{scheme or 'https'}://{authority}{path or '/'}", raw)
    except ValueError:
        return raw
