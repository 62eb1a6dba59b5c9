"""Byte codecs for streams of integers: range coders and the general ones.

An empty stream is empty bytes for every codec. The range coders are carry-less:
the interval [low, low + range) shrinks by each symbol's share, and bytes that
are settled leave at the top.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable

import numpy as np


class _Coder:
    """Interval arithmetic of one width; top and bottom are its first and lowest settled places."""

    def __init__(self, bits: int):
        self.mask, self.top, self.bottom, self.shift = (1 << bits) - 1, 1 << bits - 8, 1 << bits - 16, bits - 8

    def settle(self, low: int, span: int) -> tuple[int, int, bool]:
        """The range to go on with, and whether the top byte can leave."""
        if (low ^ (low + span)) & self.mask < self.top and low + span <= self.mask:
            return low, span, True
        if span < self.bottom:
            return low, -low & (self.bottom - 1), True
        return low, span, False

    def encode(self, symbols: list[int], starts: list[int], sizes: list[int], total: int) -> bytes:
        low, span, out = 0, self.mask, bytearray()
        for s in symbols:
            span //= total
            low = (low + starts[s] * span) & self.mask
            span *= sizes[s]
            while True:
                low, span, leaves = self.settle(low, span)
                if not leaves:
                    break
                out.append(low >> self.shift)
                low, span = (low << 8) & self.mask, (span << 8) & self.mask
        for _ in range((self.shift + 8) // 8):
            out.append(low >> self.shift)
            low = (low << 8) & self.mask
        return bytes(out)

    def decode(self, data: bytes, n: int, starts: np.ndarray, sizes: list[int], total: int) -> list[int]:
        width = (self.shift + 8) // 8
        low, span, at = 0, self.mask, width
        code = int.from_bytes(data[:width], "big")
        first, out = starts.tolist(), []
        for _ in range(n):
            span //= total
            s = int(np.searchsorted(starts, ((code - low) & self.mask) // span, "right")) - 1
            out.append(s)
            low = (low + first[s] * span) & self.mask
            span *= sizes[s]
            while True:
                low, span, leaves = self.settle(low, span)
                if not leaves:
                    break
                code = (code << 8 | (data[at] if at < len(data) else 0)) & self.mask
                at += 1
                low, span = (low << 8) & self.mask, (span << 8) & self.mask
        return out


def _scaled(counts: np.ndarray, limit: int) -> np.ndarray:
    """Counts of at least one each, halved until their sum is under ``limit``."""
    while counts.sum() >= limit:
        counts = np.maximum(1, counts // 2)
    return counts


def encode_bytes(values: np.ndarray) -> bytes:
    """Bytes 0 to 255 with the 32-bit coder and a table of all 256 counts."""
    if not len(values):
        return b""
    counts = _scaled(np.maximum(1, np.bincount(values, minlength=256)), 1 << 16)
    starts = np.concatenate(([0], np.cumsum(counts)))
    body = _Coder(32).encode(list(map(int, values)), starts.tolist(), counts.tolist(), int(starts[-1]))
    return struct.pack("<q", len(values)) + starts.astype("<u4").tobytes() + body


def decode_bytes(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    (n,), starts = struct.unpack_from("<q", data), np.frombuffer(data, "<u4", 257, 8).astype(np.int64)
    return np.array(_Coder(32).decode(data[8 + 257 * 4 :], n, starts, np.diff(starts).tolist(), int(starts[-1])), np.int64)


def encode_ints(values: np.ndarray) -> bytes:
    """Integers with the 64-bit coder and a dictionary of those that occur."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return b""
    found, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    counts = _scaled(counts, 1 << 48)
    starts = np.concatenate(([0], np.cumsum(counts)))
    body = _Coder(64).encode(at.tolist(), starts.tolist(), counts.tolist(), int(starts[-1]))
    head = zlib.compress(np.diff(found, prepend=0).astype("<i8").tobytes() + counts.astype("<i8").tobytes(), 9)
    return struct.pack("<qii", len(values), len(found), len(head)) + head + body


def decode_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    n, k, size = struct.unpack_from("<qii", data)
    table = np.frombuffer(zlib.decompress(data[16 : 16 + size]), "<i8")
    found, starts = np.cumsum(table[:k]), np.concatenate(([0], np.cumsum(table[k:])))
    return found[_Coder(64).decode(data[16 + size :], n, starts, table[k:].tolist(), int(starts[-1]))]


def _raw_deflate(b: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15, 9)
    return c.compress(b) + c.flush()


def _general(pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> tuple[Callable, Callable]:
    enc = lambda v: pack(np.asarray(v).astype("<i4").tobytes()) if len(v) else b""
    dec = lambda b: np.frombuffer(unpack(b), "<i4").astype(np.int64) if b else np.empty(0, np.int64)
    return enc, dec


#: Codec name to (encode, decode); further codecs can be added.
REGISTRY: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes], np.ndarray]]] = {
    "arithmetic": (encode_ints, decode_ints),
    "deflate": _general(_raw_deflate, lambda b: zlib.decompress(b, -15)),
    "bzip2": _general(lambda b: bz2.compress(b, 9), bz2.decompress),
    "lzma": _general(lambda b: lzma.compress(b, preset=9, check=lzma.CHECK_CRC64), lzma.decompress),
}
