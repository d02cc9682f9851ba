"""Words of UTF-8 bytes with numpy: places and 64-bit hashes, in pieces of bounded size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: White space between words: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of one piece; a piece ends at white space, or is longer where a word is.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def pieces(data: bytes, size: int = PIECE) -> Iterator[np.ndarray]:
    """data in pieces of about size bytes that no word crosses."""
    buf = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(buf):
        end = min(len(buf), at + size)
        while end < len(buf) and not SPACE[buf[end]]:
            step = SPACE[buf[end : end + size]]
            end = end + int(step.argmax()) if step.any() else min(len(buf), end + size)
        yield buf[at:end]
        at = end


def places(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of buf start and end."""
    ink = np.empty(len(buf) + 2, np.int8)
    ink[0] = ink[-1] = 0
    np.logical_not(SPACE[buf], out=ink[1:-1].view(bool))
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data, in order."""
    found = []
    for buf in pieces(data):
        start, end = places(buf)
        if not len(start):
            continue
        size = 1 << max(12, (len(buf) - 1).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * up[: len(buf)], out=total[1:])
        found.append(mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, in order; of all words where there are fewer, of none where there are none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * _ODD + words[j : len(words) - k + 1 + j]
    return mix64(out)


def occurrence(values: np.ndarray) -> np.ndarray:
    """For each value how often it stood before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    at = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = at - first[np.cumsum(new) - 1] if len(values) else at
    return out
