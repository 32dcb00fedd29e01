"""Ciphers and key schedules needed to open recorded TLS and QUIC, over numpy. Not for protecting anything: nothing here runs in constant time."""

from __future__ import annotations

import hashlib
import hmac
import struct
from functools import lru_cache

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Substitution box, its inverse and doubling, from the field's arithmetic."""
    power, log, x = [0] * 256, [0] * 256, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = [0] * 256
    for v in range(256):
        inverse = power[(255 - log[v]) % 255] if v else 0
        s = inverse
        for turn in range(1, 5):
            s ^= (inverse << turn | inverse >> (8 - turn)) & 0xFF
        box[v] = s ^ 0x63
    sbox = np.array(box, np.uint8)
    back = np.zeros(256, np.uint8)
    back[sbox] = np.arange(256, dtype=np.uint8)
    return sbox, back, np.array([(v << 1 ^ (0x1B if v & 0x80 else 0)) & 0xFF for v in range(256)], np.uint8)


SBOX, INVERSE, DOUBLE = _tables()
_ROWS = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_BACK = np.argsort(_ROWS)


@lru_cache(maxsize=256)
def round_keys(key: bytes) -> np.ndarray:
    words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    n, rcon = len(words), 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = [int(SBOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = int(DOUBLE[rcon])
        elif n > 6 and i % n == 4:
            w = [int(SBOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


def aes_encrypt(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """blocks: n x 16 bytes."""
    keys = round_keys(key)
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = SBOX[s][:, _ROWS].reshape(-1, 4, 4)
        every = s[:, :, 0] ^ s[:, :, 1] ^ s[:, :, 2] ^ s[:, :, 3]
        s = (s ^ every[:, :, None] ^ DOUBLE[s ^ np.roll(s, -1, axis=2)]).reshape(-1, 16) ^ k
    return SBOX[s][:, _ROWS] ^ keys[-1]


def aes_decrypt(key: bytes, blocks: np.ndarray) -> np.ndarray:
    keys = round_keys(key)
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = (INVERSE[s[:, _BACK]] ^ k).reshape(-1, 4, 4)
        a = DOUBLE[DOUBLE[s ^ np.roll(s, -2, axis=2)]]  # the inverse mix is the mix after this
        s = s ^ a
        every = s[:, :, 0] ^ s[:, :, 1] ^ s[:, :, 2] ^ s[:, :, 3]
        s = (s ^ every[:, :, None] ^ DOUBLE[s ^ np.roll(s, -1, axis=2)]).reshape(-1, 16)
    return INVERSE[s[:, _BACK]] ^ keys[0]


def aes_block(key: bytes, block: bytes) -> bytes:
    return aes_encrypt(key, np.frombuffer(block, np.uint8).reshape(1, 16)).tobytes()


def _xor(a: bytes, b: bytes) -> bytes:
    n = min(len(a), len(b))
    return (np.frombuffer(a[:n], np.uint8) ^ np.frombuffer(b[:n], np.uint8)).tobytes()


@lru_cache(maxsize=64)
def _multiples(h: int) -> tuple[tuple[int, ...], ...]:
    """h times every 4-bit value at each of the 32 places."""
    powers, v = [], h
    for _ in range(128):
        powers.append(v)
        v = v >> 1 ^ (0xE1 << 120 if v & 1 else 0)
    out = []
    for place in range(32):
        row = [0] * 16
        for value in range(16):
            for bit in range(4):
                if value >> (3 - bit) & 1:
                    row[value] ^= powers[4 * place + bit]
        out.append(tuple(row))
    return tuple(out)


def _ghash(h: int, data: bytes) -> int:
    table, y = _multiples(h), 0
    for i in range(0, len(data), 16):
        y ^= int.from_bytes(data[i : i + 16], "big")
        z = 0
        for place in range(32):
            z ^= table[place][y >> (124 - 4 * place) & 15]
        y = z
    return y


def _padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 16)


def _gcm(key: bytes, nonce: bytes, data: bytes, aad: bytes, encrypt: bool) -> tuple[bytes, bytes]:
    n = (len(data) + 15) // 16
    counters = np.zeros((n + 1, 16), np.uint8)
    counters[:, :12] = np.frombuffer(nonce, np.uint8)
    counters[:, 12:] = np.arange(1, n + 2, dtype=">u4").view(np.uint8).reshape(-1, 4)
    stream = aes_encrypt(key, counters)
    out = _xor(data, stream[1:].tobytes())
    sealed = out if encrypt else data
    h = int.from_bytes(aes_block(key, bytes(16)), "big")
    tag = _ghash(h, _padded(aad) + _padded(sealed) + struct.pack(">QQ", 8 * len(aad), 8 * len(sealed)))
    return out, _xor(tag.to_bytes(16, "big"), stream[0].tobytes())


def gcm_seal(key: bytes, nonce: bytes, data: bytes, aad: bytes) -> bytes:
    out, tag = _gcm(key, nonce, data, aad, True)
    return out + tag


def gcm_open(key: bytes, nonce: bytes, data: bytes, aad: bytes) -> bytes | None:
    if len(data) < 16:
        return None
    out, tag = _gcm(key, nonce, data[:-16], aad, False)
    return out if tag == data[-16:] else None


def chacha_stream(key: bytes, nonce: bytes, first: int, blocks: int) -> bytes:
    state = np.zeros((16, blocks), np.uint32)
    state[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(first, first + blocks, dtype=np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    s = state.copy()

    def quarter(a: list[int], b: list[int], c: list[int], d: list[int]) -> None:
        for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            s[x] += s[y]
            v = s[z] ^ s[x]
            s[z] = v << np.uint32(turn) | v >> np.uint32(32 - turn)

    with np.errstate(over="ignore"):
        for _ in range(10):
            quarter([0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15])
            quarter([0, 1, 2, 3], [5, 6, 7, 4], [10, 11, 8, 9], [15, 12, 13, 14])
        s += state
    return s.T.astype("<u4").tobytes()


def _poly1305(key: bytes, data: bytes) -> bytes:
    r, s, acc = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(key[16:32], "little"), 0
    for i in range(0, len(data), 16):
        acc = (acc + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % ((1 << 130) - 5)
    return ((acc + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def _chacha(key: bytes, nonce: bytes, data: bytes, aad: bytes, encrypt: bool) -> tuple[bytes, bytes]:
    stream = chacha_stream(key, nonce, 0, 1 + (len(data) + 63) // 64)
    out = _xor(data, stream[64:])
    sealed = out if encrypt else data
    return out, _poly1305(stream[:32], _padded(aad) + _padded(sealed) + struct.pack("<QQ", len(aad), len(sealed)))


def chacha_seal(key: bytes, nonce: bytes, data: bytes, aad: bytes) -> bytes:
    out, tag = _chacha(key, nonce, data, aad, True)
    return out + tag


def chacha_open(key: bytes, nonce: bytes, data: bytes, aad: bytes) -> bytes | None:
    if len(data) < 16:
        return None
    out, tag = _chacha(key, nonce, data[:-16], aad, False)
    return out if tag == data[-16:] else None


def cbc_open(key: bytes, iv: bytes, data: bytes) -> bytes:
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]])
    return (aes_decrypt(key, blocks) ^ before).tobytes()


def extract(salt: bytes, secret: bytes, name: str) -> bytes:
    return hmac.new(salt, secret, name).digest()


def expand_label(secret: bytes, label: str, size: int, name: str, context: bytes = b"") -> bytes:
    """Key derivation of TLS 1.3 and QUIC."""
    full = b"tls13 " + label.encode()
    info = struct.pack(">HB", size, len(full)) + full + bytes([len(context)]) + context
    out, block, k = b"", b"", 1
    while len(out) < size:
        block = hmac.new(secret, block + info + bytes([k]), name).digest()
        out, k = out + block, k + 1
    return out[:size]


def prf(secret: bytes, label: bytes, seed: bytes, size: int, name: str | None) -> bytes:
    """Key derivation of TLS up to 1.2; name None: the older split of MD5 and SHA-1."""

    def stretch(key: bytes, digest: str) -> bytes:
        out, a = b"", label + seed
        while len(out) < size:
            a = hmac.new(key, a, digest).digest()
            out += hmac.new(key, a + label + seed, digest).digest()
        return out[:size]

    if name:
        return stretch(secret, name)
    half = (len(secret) + 1) // 2
    return _xor(stretch(secret[:half], "md5"), stretch(secret[-half:], "sha1"))


def digest_size(name: str) -> int:
    return hashlib.new(name).digest_size
