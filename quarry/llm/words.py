"""Word and shingle hashes of whole texts, vectorised over bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
#: Whether a byte belongs to a word: all but the space and the controls from tab to carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False
#: Letters alone: A-Z, a-z and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans(data: np.ndarray, word: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = word[data]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, word: np.ndarray = PLAIN, prefix: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, A-Z lower-cased; prefix: of each word's first bytes alone.

    A word's hash is the sum of its bytes' numbers times powers of an odd multiplier, from running sums over the text; all arithmetic is modulo 2^64. Long texts go in pieces that end between words.
    """
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends = spans(data, word)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        n = int(ends[to - 1] - base)
        up, down = _powers(PIECE) if n <= PIECE else _powers.__wrapped__(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data[base : base + n]] * up[:n], out=sums[1:])
        s = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[s]) * down[s]
        at = to
    return _mixed(out + np.minimum(sizes, prefix or 1 << 40).astype(np.uint64))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words; of fewer words, of the whole sequence as one."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(MULTIPLIER) + hashes[k : k + len(out)]
    return np.unique(_mixed(out + np.uint64(n)))
