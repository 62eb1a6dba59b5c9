"""Small helpers on words that several text operators share."""

from __future__ import annotations

import re

import numpy as np

#: Fixed: a word is a run of anything but ASCII white space; A-Z alone are lower-cased.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text with A-Z lower-cased; null is like an empty text."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined windows of ``size`` words; a shorter sequence is one shingle, none gives none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1))
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def bit_majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a (shingles x 64-bit words) array of hashes: a bit is 1 if set in over half the rows."""
    rows, width = hashes.shape
    if not rows:
        return np.zeros(width, np.uint64)
    total = np.zeros(width * 64, np.int64)
    for at in range(0, rows, 255 * 256):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 255 * 256].astype(">u8").view(np.uint8), axis=1)
        for i in range(0, len(bits), 255):  # 255 rows fit the sums in a byte
            total += bits[i : i + 255].sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > rows).view(">u8").astype(np.uint64)
