"""Packed integer lists for shuffled payloads: seven bits a byte, then zstandard. Sent to workers by value."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^35, most small."""
    v = np.asarray(values, np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in (7, 14, 21, 28):
        sizes += v >= np.uint64(1 << k)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(5):
        has = sizes > k
        if not has.any():
            break
        part = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        part[sizes[has] > k + 1] |= 128
        out[first[has] + k] = part
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    at = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * at), first)


def pack_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
