import ssl

import pytest

from flowloom.decode import crypto, tls
from flowloom.decode.http1 import exchanges
from flowloom.decode.streams import Stream

ASK = b"GET /secret HTTP/1.1\r\nHost: h.example\r\n\r\n"
ANSWER = b"HTTP/1.1 200 OK\r\nContent-Length: 40000\r\n\r\n" + b"x" * 40_000


def session(tmp_path, version, ciphers):
    """A real session by pre-shared key: bytes of both directions and the key log."""
    log = tmp_path / "keys.log"
    make = lambda side: ssl.SSLContext(side)
    c, s = make(ssl.PROTOCOL_TLS_CLIENT), make(ssl.PROTOCOL_TLS_SERVER)
    for ctx in (c, s):
        ctx.check_hostname = False
        ctx.verify_mode = ssl.CERT_NONE
        ctx.minimum_version = ctx.maximum_version = version
        ctx.set_ciphers(ciphers)
    c.keylog_filename = str(log)
    c.set_psk_client_callback(lambda hint: ("me", b"k" * 16))
    s.set_psk_server_callback(lambda identity: b"k" * 16)
    ci, co, si, so = (ssl.MemoryBIO() for _ in range(4))
    client, server = c.wrap_bio(ci, co, server_hostname="h.example"), s.wrap_bio(si, so, server_side=True)
    up, down = b"", b""

    def pump():
        nonlocal up, down
        data = co.read()
        up += data
        si.write(data)
        data = so.read()
        down += data
        ci.write(data)

    for _ in range(6):
        for side in (client, server):
            try:
                side.do_handshake()
            except ssl.SSLWantReadError:
                pass
            pump()
    client.write(ASK)
    pump()
    assert server.read(9999) == ASK
    server.write(ANSWER)
    pump()
    secrets = {}
    for line in log.read_text().splitlines():
        if not line.startswith("#"):
            label, random, secret = line.split()
            secrets[label, random] = secret
    return Stream(up, starts=[0], times=[5]), Stream(down, starts=[0], times=[9]), secrets


@pytest.mark.parametrize(
    ("version", "ciphers"),
    [(ssl.TLSVersion.TLSv1_3, "PSK"), (ssl.TLSVersion.TLSv1_2, "PSK-AES128-GCM-SHA256"), (ssl.TLSVersion.TLSv1_2, "PSK-AES256-GCM-SHA384"), (ssl.TLSVersion.TLSv1_2, "PSK-CHACHA20-POLY1305"), (ssl.TLSVersion.TLSv1_2, "PSK-AES128-CBC-SHA256"), (ssl.TLSVersion.TLSv1_2, "PSK-AES256-CBC-SHA:@SECLEVEL=0"), (ssl.TLSVersion.TLSv1_2, "PSK-AES128-CBC-SHA256:@SECLEVEL=0")],
)
def test_real_sessions_are_opened(tmp_path, version, ciphers):
    try:
        client, server, secrets = session(tmp_path, version, ciphers)
    except ssl.SSLError as e:
        pytest.skip(f"not offered here: {e}")
    opened = tls.open_tls(client, server, secrets)
    assert opened is not None
    assert opened[0].data == ASK and opened[1].data == ANSWER
    e = exchanges(*opened, scheme="https")[0]
    assert (e.path, e.status, len(e.response_body), e.duration_micros) == ("/secret", 200, 40_000, 4)
    assert tls.open_tls(client, server, {}) is None
    assert tls.open_tls(Stream(client.data[:20]), server, secrets) is None


def test_primitives():
    text = bytes(range(256)) * 3
    for seal, open_, size in ((crypto.gcm_seal, crypto.gcm_open, 32), (crypto.chacha_seal, crypto.chacha_open, 32)):
        sealed = seal(b"k" * size, b"n" * 12, text, b"aad")
        assert open_(b"k" * size, b"n" * 12, sealed, b"aad") == text
        assert open_(b"k" * size, b"n" * 12, sealed, b"other") is None and open_(b"k" * size, b"n" * 12, b"", b"") is None
    assert crypto.gcm_seal(bytes(16), bytes(12), bytes(16), b"").hex() == "0388dace60b6a392f328c2b971b2fe78ab6e47d42cec13bdf53a67b21257bddf"


def test_quic_hello():
    from test_decode import client_hello

    destination = bytes.fromhex("8394c8f03e515708")
    secret = tls.initial_secret(destination)
    key, iv, hp = (crypto.expand_label(secret, x, n, "sha256") for x, n in (("quic key", 16), ("quic iv", 12), ("quic hp", 16)))
    assert key.hex() == "1f369613dd76d5467730efcbe3b1a22d"
    hello, out = client_hello(), []
    for number, (a, b) in enumerate(((30, len(hello)), (0, 40))):
        part = hello[a:b]
        payload = b"\6" + bytes([a]) + (0x4000 | len(part)).to_bytes(2, "big") + part + b"\0" * 40
        head = b"\xc0\0\0\0\1\x08" + destination + b"\0\0" + (0x4000 | len(payload) + 17).to_bytes(2, "big") + bytes([number])
        sealed = crypto.gcm_seal(key, iv[:-1] + bytes([iv[-1] ^ number]), payload, head)
        mask = crypto.aes_block(hp, sealed[3:19])
        out.append(bytes([head[0] ^ mask[0] & 0x0F]) + head[1:-1] + bytes([number ^ mask[1]]) + sealed)
    got = tls.quic_hello(out)
    assert got and got.sni == "a.b" and tls.quic_hello(out[:1]) is None and tls.quic_hello([b"", b"\xff" * 30]) is None


def test_capture_with_a_key_log(spark, tmp_path):
    from test_decode import pcap, tcp

    from flowloom.sources.capture import import_captures, read_captures

    client, server, secrets = session(tmp_path, ssl.TLSVersion.TLSv1_3, "PSK")
    a, b = ((10, 0, 0, 1), 5000), ((10, 0, 0, 2), 443)
    frames = [tcp(a, b, 1, client.data[:300]), tcp(b, a, 1, server.data[:200]), tcp(a, b, 301, client.data[300:])] + [tcp(b, a, 1 + k, server.data[k : k + 30_000]) for k in range(200, len(server.data), 30_000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pcap").write_bytes(pcap(frames))
    log = spark.createDataFrame([(k, r, v) for (k, r), v in secrets.items()], "label string, client_random string, secret string")
    for keys, want in ((log, (1, 0)), (None, (0, 1))):
        paths = import_captures(read_captures(spark, str(tmp_path / "in")), str(tmp_path / f"out{want[0]}"), keys)
        assert tuple(spark.read.parquet(paths[n]).count() for n in ("flows", "undecoded")) == want
    row = spark.read.parquet(str(tmp_path / "out1" / "flows")).first()
    assert (row.scheme, row.path, row.status, row.tls_decrypted, row.sni) == ("https", "/secret", 200, True, "h.example")
    assert spark.read.parquet(str(tmp_path / "out0" / "undecoded")).first().reason == "no_key"
    from flowloom.sources.capture import connection_bytes, read_segments

    part = connection_bytes(read_segments(spark, str(tmp_path / "in")), "10.0.0.1:5000", "10.0.0.2:443", 0, 10**7, offset=4, length=50).first()
    assert (bytes(part.data), part.size, part.gaps) == (client.data[4:54], len(client.data), 0)
    told = tls.describe_handshake(client.data, server.data)
    assert (told["version"], told["sni"]) == ("TLS 1.3", "h.example") and int(told["cipher"], 16) in tls.SUITES and told["certificates"] == []


def test_live_decoding_with_a_key_log(spark, tmp_path):
    """The capture lands first; what the key log opens is found when it has landed, in two parts."""
    from test_decode import pcap, tcp

    from flowloom.sources.uploads import decode_landing, land_part

    client, server, secrets = session(tmp_path, ssl.TLSVersion.TLSv1_3, "PSK")
    a, b = ((10, 0, 0, 1), 5000), ((10, 0, 0, 2), 443)
    data = pcap([tcp(a, b, 1, client.data)] + [tcp(b, a, 1 + k, server.data[k : k + 30_000]) for k in range(0, len(server.data), 30_000)])
    log = "".join(f"{k} {r} {v}\n" for (k, r), v in secrets.items()).encode()
    folder, seen = tmp_path / "landing", []
    folder.mkdir()
    for kind, at, part in (("pcap", 0, data), ("keylog", 0, log[:-30]), ("keylog", len(log) - 30, log[-30:])):
        land_part(str(folder), "s1", kind, at, part)
        decode_landing(spark, str(folder), str(tmp_path / "live"), str(tmp_path / "state"), available_now=True).awaitTermination()
        seen.append([(r.reason, r.path) for r in spark.read.parquet(str(tmp_path / "live")).collect()])
    assert seen[0] == [("no_key", None)] and seen[2] == [(None, "/secret")]
