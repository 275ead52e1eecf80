"""Hashes of words and of runs of words, for whole Arrow batches at once in numpy.

Words are maximal runs of bytes other than the six white-space characters. A word's hash is a polynomial in
its bytes (each replaced by a random 64-bit number) modulo 2 ** 64, mixed; it is the same on every machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at once; longer words make longer blocks.
BLOCK = 1 << 21


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse ** k, for k < n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(data: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of each word. data starts and ends with a separator."""
    space = separator[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word of data, block by block."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK, side="right")))
        lo, hi = starts[k], ends[m - 1]
        up, down = powers(BLOCK if hi - lo <= BLOCK else int(hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[k:m] - lo, ends[k:m] - lo
        out[k:m] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        k = m
    return mix(out)


def joined(texts: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a separator before, between and after them; and the offset where each begins."""
    data = np.frombuffer(separator + separator.join(texts) + separator, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.cumsum(lengths) - lengths + 1


def run_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from each place on, for the places that have n words to follow."""
    base = int(mix(np.array([seed], np.uint64))[0]) | 1
    total, factor = np.zeros(max(len(words) - n + 1, 0), np.uint64), 1
    for k in range(n):
        total += words[k : k + len(total)] * np.uint64(factor)
        factor = factor * base % (1 << 64)
    return mix(total)
