"""Hashes of words, computed for a whole block of bytes at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True

#: Words of at most so many bytes are hashed side by side, eight bytes a step.
SIDE_BY_SIDE = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: bytes) -> bytes:
    """A-Z lower-cased."""
    return _LOWER[np.frombuffer(data, np.uint8)].tobytes()


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes other than ASCII blanks start and end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of lower-cased bytes: 64 bits, taken in eight bytes at a time."""
    start, end = word_spans(data)
    size = end - start
    words = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    on = np.flatnonzero(size <= SIDE_BY_SIDE)
    at = 0
    while len(on):
        left = size[on] - at
        bits = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (left.clip(0, 7) * 8).astype(np.uint64)) - np.uint64(1))
        out[on] = mix(out[on] ^ (words[start[on] + at] & bits)) + np.uint64(0x632BE59BD9B4E019)
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out, start, end
