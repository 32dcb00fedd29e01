"""HTTP/1 exchanges of a connection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from flowloom.decode.content import decode_body, redirect_target, websocket_frames
from flowloom.decode.streams import Stream

_START = re.compile(rb"(?:([A-Z][A-Z_-]*) (\S+) HTTP/(1\.[01])|HTTP/(1\.[01]) (\d{3})(?: ([^\r\n]*))?)\r?\n")


@dataclass
class Message:
    start: tuple
    headers: list[tuple[str, str]]
    body: bytes
    at: int
    end: int
    error: str = ""

    def header(self, name: str) -> str:
        return next((v for k, v in self.headers if k.lower() == name), "")


@dataclass
class Exchange:
    method: str = ""
    scheme: str = "http"
    authority: str = ""
    path: str = ""
    query: str = ""
    status: int = 0
    ts_micros: int = 0
    duration_micros: int = 0
    request_headers: list[tuple[str, str]] = field(default_factory=list)
    response_headers: list[tuple[str, str]] = field(default_factory=list)
    request_body: bytes = b""
    response_body: bytes = b""
    request_encoding: str = ""
    response_encoding: str = ""
    redirect_location: str = ""
    error: str = ""
    messages: list[tuple[bool, str, bytes]] = field(default_factory=list)


def _headers(block: bytes) -> list[tuple[str, str]]:
    """In wire order; folded lines belong to the header before."""
    out: list[tuple[str, str]] = []
    for line in re.split(rb"\r?\n", block):
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('latin-1')}".strip())
        elif b":" in line:
            name, _, value = line.partition(b":")
            out.append((name.strip().decode("latin-1"), value.strip().decode("latin-1")))
    return out


def _chunked(data: bytes, at: int) -> tuple[bytes, int, str]:
    out = []
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            return b"".join(out), len(data), "body cut short"
        try:
            size = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return b"".join(out), len(data), "bad chunk size"
        at = end + 1
        if size == 0:
            m = re.compile(rb"(?:[^\r\n]+\r?\n)*\r?\n").match(data, at)
            return b"".join(out), m.end() if m else len(data), ""
        if at + size > len(data):
            out.append(data[at:])
            return b"".join(out), len(data), "body cut short"
        out.append(data[at : at + size])
        at += size
        at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] == b"\n" else 0


def read_message(data: bytes, at: int, head_only: bool = False, open_end: bool = False) -> Message | None:
    """The message at ``at``. head_only: it has no body whatever it says; open_end: without a length the body lasts to the end."""
    while data[at : at + 2] == b"\r\n":
        at += 2
    m = _START.match(data, at)
    if not m:
        return None
    close = re.compile(rb"\r?\n\r?\n").search(data, m.end() - 2)
    if not close:
        return Message(m.groups(), _headers(data[m.end() :]), b"", at, len(data), "headers cut short")
    out = Message(m.groups(), _headers(data[m.end() : close.start()]) if close.start() > m.end() else [], b"", at, close.end())
    status = int(m.group(5)) if m.group(5) else 0
    if head_only or 100 <= status < 200 or status in (204, 304):
        return out
    if "chunked" in out.header("transfer-encoding").lower():
        out.body, out.end, out.error = _chunked(data, close.end())
    elif out.header("content-length").isdigit():
        size = int(out.header("content-length"))
        out.body = data[close.end() : close.end() + size]
        out.end = close.end() + len(out.body)
        if len(out.body) < size:
            out.error = "body cut short"
    elif open_end and status:
        out.body, out.end = data[close.end() :], len(data)
    return out


def exchanges(client: Stream, server: Stream, scheme: str = "http", client_at: int = 0, server_at: int = 0) -> list[Exchange]:
    return list(read_exchanges(client, server, scheme, client_at, server_at))


def read_exchanges(client: Stream, server: Stream, scheme: str = "http", client_at: int = 0, server_at: int = 0) -> Iterator[Exchange]:
    """Requests in order with their responses (n-th with n-th); interim responses are skipped; 101 turns the rest into WebSocket frames."""
    a, b = client_at, server_at
    while True:
        q = read_message(client.data, a)
        if q is None or not q.start[0]:
            break
        a = q.end
        e = Exchange(method=q.start[0].decode("latin-1"), scheme=scheme, ts_micros=client.time_at(q.at), request_headers=q.headers, error=q.error)
        target = q.start[1].decode("latin-1")
        if m := re.match(r"(?i)(https?)://([^/?#]*)(.*)", target):
            e.scheme, e.authority, target = m.group(1).lower(), m.group(2), m.group(3) or "/"
        e.path, _, e.query = target.partition("?")
        e.authority = e.authority or q.header("host")
        body = decode_body(q.body, q.header("content-encoding"))
        e.request_body, e.request_encoding = body.data, body.encoding
        r = read_message(server.data, b, e.method == "HEAD", True)
        while r and r.start[4] and r.start[4][:1] == b"1" and r.start[4] != b"101":
            b = r.end
            r = read_message(server.data, b, e.method == "HEAD", True)
        if r and r.start[4]:
            b = r.end
            e.status, e.response_headers = int(r.start[4]), r.headers
            body = decode_body(r.body, r.header("content-encoding"))
            e.response_body, e.response_encoding = body.data, body.encoding
            e.duration_micros = max(0, server.time_at(max(r.end - 1, 0)) - e.ts_micros)
            e.redirect_location = redirect_target(e.status, e.scheme, e.authority, e.path, r.headers)
            e.error = e.error or r.error
        if e.status == 101:
            if r.header("upgrade").lower() == "websocket":
                for from_client, data in ((True, client.data[a:]), (False, server.data[b:])):
                    e.messages += [(from_client, f.opcode, f.payload) for f in websocket_frames(data)[0]]
            yield e
            break
        yield e
