"""Deletion vectors: 64-bit roaring bitmaps in the portable layout, and the Base85 they are written in (ZeroMQ's alphabet)."""

from __future__ import annotations

import struct

import numpy as np

_COOKIE, _COOKIE_RUNS, _MAGIC = 12346, 12347, 1681511377
#: The alphabet of ZeroMQ's Base85 (fixed values).
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
_PLACE = {c: i for i, c in enumerate(ALPHABET)}


def to_bytes(rows: np.ndarray) -> bytes:
    """Row numbers as a 64-bit bitmap, after its magic number."""
    rows = np.unique(np.asarray(rows, np.uint64))
    high = (rows >> np.uint64(32)).astype(np.uint32)
    out = [struct.pack("<IQ", _MAGIC, len(np.unique(high)))]
    for h in np.unique(high):
        out += [struct.pack("<I", int(h)), _small(rows[high == h].astype(np.uint32))]
    return b"".join(out)


def _small(values: np.ndarray) -> bytes:
    keys, first = np.unique(values >> 16, return_index=True)
    parts = np.split((values & 0xFFFF).astype("<u2"), first[1:])
    head, bodies = [struct.pack("<II", _COOKIE, len(keys))], []
    for k, p in zip(keys, parts):
        head.append(struct.pack("<HH", int(k), len(p) - 1))
        if len(p) <= 4096:
            bodies.append(p.tobytes())
        else:
            bits = np.zeros(65536, np.uint8)
            bits[p] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    at = 8 + 8 * len(keys)
    for b in bodies:
        head.append(struct.pack("<I", at))
        at += len(b)
    # keys and sizes of all containers come before their offsets
    return b"".join(head[:1] + head[1 : 1 + len(keys)] + head[1 + len(keys) :] + bodies)


def from_bytes(data: bytes) -> np.ndarray:
    magic, n = struct.unpack_from("<IQ", data)
    if magic != _MAGIC:
        raise ValueError("not a deletion vector")
    at, out = 12, [np.zeros(0, np.uint64)]
    for _ in range(n):
        high = struct.unpack_from("<I", data, at)[0]
        values, at = _read_small(data, at + 4)
        out.append(values.astype(np.uint64) | np.uint64(high) << np.uint64(32))
    return np.concatenate(out)


def _read_small(data: bytes, at: int) -> tuple[np.ndarray, int]:
    cookie = struct.unpack_from("<I", data, at)[0]
    runs = b""
    if cookie & 0xFFFF == _COOKIE_RUNS:
        n = (cookie >> 16) + 1
        runs, at = data[at + 4 : at + 4 + (n + 7) // 8], at + 4 + (n + 7) // 8
    elif cookie == _COOKIE:
        n, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
    else:
        raise ValueError("not a bitmap")
    heads = [struct.unpack_from("<HH", data, at + 4 * i) for i in range(n)]
    at += 4 * n + (4 * n if not runs or n >= 4 else 0)
    out = [np.zeros(0, np.uint32)]
    for i, (key, less) in enumerate(heads):
        if runs and runs[i // 8] >> i % 8 & 1:
            k = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(-1, 2).astype(np.uint32)
            low, at = np.concatenate([np.arange(s, s + c + 1, dtype=np.uint32) for s, c in pairs]), at + 2 + 4 * k
        elif less + 1 <= 4096:
            low, at = np.frombuffer(data, "<u2", less + 1, at).astype(np.uint32), at + 2 * (less + 1)
        else:
            low, at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little")).astype(np.uint32), at + 8192
        out.append(low | np.uint32(key << 16))
    return np.concatenate(out), at


def base85(data: bytes) -> str:
    data += b"\0" * (-len(data) % 4)
    out = []
    for (n,) in struct.iter_unpack(">I", data):
        out.append("".join(ALPHABET[n // 85**p % 85] for p in (4, 3, 2, 1, 0)))
    return "".join(out)


def from_base85(text: str, size: int) -> bytes:
    if len(text) % 5:
        raise ValueError("Base85 comes in fives")
    out = []
    for i in range(0, len(text), 5):
        n = 0
        for c in text[i : i + 5]:
            n = n * 85 + _PLACE[c]
        out.append(struct.pack(">I", n))
    return b"".join(out)[:size]
