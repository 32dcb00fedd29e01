import struct

from test_decode import client_hello

from flowloom.decode import crypto, http3, tls
from flowloom.decode.http3 import FieldTable, _Keys
from flowloom.decode.streams import Stream

CLIENT_ID, SERVER_ID, FIRST_ID = b"ccccc", b"sssssss", b"\x83\x94\xc8\xf0\x3e\x51\x57\x08"


def v(n):
    return bytes([n]) if n < 64 else struct.pack(">H", 0x4000 | n)


def server_hello(suite=0x1301):
    ext = struct.pack(">HHH", 43, 2, 0x0304)
    body = struct.pack(">H", 0x0303) + b"S" * 32 + b"\0" + struct.pack(">HB", suite, 0) + struct.pack(">H", len(ext)) + ext
    return b"\2" + len(body).to_bytes(3, "big") + body


def seal(keys, lead, rest, number, payload, low, length):
    payload += b"\0" * max(0, 24 - len(payload))
    head = bytes([lead | 1]) + rest + (struct.pack(">H", 0x4000 | len(payload) + 18) if length else b"") + struct.pack(">H", number)
    run = crypto.chacha_seal if keys.suite.cipher == "chacha" else crypto.gcm_seal
    sealed = run(keys.key, crypto._xor(keys.iv, struct.pack(">4xQ", number)), payload, head)
    mask = keys.mask(sealed[2:18])
    return bytes([head[0] ^ mask[0] & low]) + head[1:-2] + bytes(a ^ b for a, b in zip(head[-2:], mask[1:])) + sealed


def connection(suite):
    first = tls.Suite("gcm", 16, "sha256")
    up, down = (_Keys(first, tls.initial_secret(FIRST_ID, 1, n)) for n in ("client in", "server in"))
    crypto_frame = lambda b: b"\6\0" + v(len(b)) + b
    out = [(True, seal(up, 0xC0, b"\0\0\0\1\x08" + FIRST_ID + b"\x05" + CLIENT_ID + b"\0", 0, crypto_frame(client_hello()), 0x0F, True), 1)]
    out.append((False, seal(down, 0xC0, b"\0\0\0\1\x05" + CLIENT_ID + b"\x07" + SERVER_ID + b"\0", 0, crypto_frame(server_hello(suite)), 0x0F, True), 2))
    secrets = {(f"{n}_TRAFFIC_SECRET_0", client_hello()[6:38].hex()): (n.encode() * 8)[: crypto.digest_size(tls.SUITES[suite].hash)].hex() for n in ("CLIENT", "SERVER")}
    keys = [_Keys(tls.SUITES[suite], bytes.fromhex(s)) for s in secrets.values()]
    stream = lambda n, offset, data, fin=0: bytes([0x0E | fin]) + v(n) + v(offset) + v(len(data)) + data
    inserts = b"\x02" + b"\x3f\xe1\x1f" + b"\xc0\x01a" + b"\x43abc\x01z"  # capacity, :authority a (static name), abc z
    settings = b"\0\x04\x04\x01" + b"\x50\x00\x00"[:1] + b"\x00"
    settings = b"\0\x04\x03\x01" + struct.pack(">H", 0x4000 | 4096)
    q = b"\1" + v(6) + b"\x03\x00\xd1\xd7\x81\x80"  # two inserts needed: GET, https, then entries 0 and 1
    r = b"\1" + v(3) + b"\0\0\xd9" + b"\0" + v(4) + b"body"
    one = lambda n, d: (True, seal(keys[0], 0x40, SERVER_ID, n, d, 0x1F, False), 10 + n)
    out += [one(1, stream(0, 3, q[3:], 1)), one(0, stream(2, 0, inserts) + stream(0, 0, q[:4])), (False, seal(keys[1], 0x40, CLIENT_ID, 0, stream(3, 0, settings) + b"\1" + stream(0, 0, r, 1), 0x1F, False), 30)]
    updated = keys[0].next()
    out.append((True, seal(updated, 0x44, SERVER_ID, 7, stream(4, 0, b"\1" + v(3) + b"\0\0\xd1", 1), 0x1F, False), 40))
    return out, secrets


def test_connections_are_opened():
    for suite in (0x1301, 0x1302, 0x1303):
        datagrams, secrets = connection(suite)
        opened = http3.quic_streams(datagrams, secrets)
        got = http3.exchanges(*opened)
        assert [(n, e.method, e.scheme, e.authority, e.status, e.response_body) for n, e in got] == [(0, "GET", "https", "a", 200, b"body"), (4, "GET", "https", "", 0, b"")]
        assert ("abc", "z") in got[0][1].request_headers and got[0][1].error == "" and got[0][1].duration_micros == 20
        assert http3.quic_streams(datagrams, {}) is None
    assert http3.quic_streams([(True, b"\xff" * 40, 1)], secrets) is None


def test_field_sections():
    t = FieldTable(4096)
    t.inserts(Stream(bytes.fromhex("3fbd01c00f7777772e6578616d706c652e636f6dc10c2f73616d706c652f70617468"), starts=[0], times=[0]), 0)
    assert t.entries == [(":authority", "www.example.com"), (":path", "/sample/path")]
    assert t.section(bytes.fromhex("03811011"), 1) == t.entries
    assert FieldTable().section(bytes.fromhex("0000510b2f696e6465782e68746d6c"), 0) == [(":path", "/index.html")]
