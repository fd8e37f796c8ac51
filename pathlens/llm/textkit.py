"""Whole texts as numpy arrays: words, their hashes, shingles.

All functions take lists of texts and work on at most ``BLOCK`` code points at
a time (or one longer text), so memory follows the block, not the batch.
A word is a run of letters, digits and underscores, in lower case. Hashes are
64-bit: a polynomial over the code points, mixed at the end; equal words have
equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
BLOCK = 1_000_000
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Whether each code point belongs to a word."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000) | (np.arange(0x110000) == ord("_"))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base=_BASE) -> np.ndarray:
    return _powers(1 << max(20, int(n).bit_length()), int(base))[:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together; where each starts, and the end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs where ``inside`` holds; no run crosses a text."""
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[starts] = True
    edges = np.flatnonzero(edge)
    first = edges[:-1]
    keep = inside[first]
    return first[keep], edges[1:][keep]


def span_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the code points of each span."""
    n = len(points)
    total = np.zeros(n + 1, U)
    np.cumsum((points.astype(U) + U(1)) * U(0xD6E8FEB86659FD93) * powers(n), out=total[1:])
    return mix((total[end] - total[begin]) * powers(n + 1, _INVERSE)[begin] + (end - begin).astype(U))


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` code points together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of a block of texts: hash, place in the lowered text, and ranges by text."""

    def __init__(self, texts: list[str]):
        self.points, self.starts = code_points([t.lower() for t in texts])
        if len(self.points):
            self.begin, self.end = spans(word_table()[self.points], self.starts[:-1][self.starts[:-1] < len(self.points)])
            self.hash = span_hashes(self.points, self.begin, self.end)
        else:
            self.begin = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
        self.first = np.searchsorted(self.begin, self.starts)

    def __len__(self) -> int:
        return len(self.starts) - 1


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (crossing texts too); the last k - 1 places are missing."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8:
        out = np.zeros(n, U)
        for i in range(k):
            out = out * U(0x2545F4914F6CDD1D) + words[i : i + n]
        return mix(out)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(len(words)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(n, _INVERSE))


def shingle_sets(texts: list[str], k: int = 5) -> Iterator[np.ndarray]:
    """Per text: its sorted distinct hashes of k words.

    A text with fewer than k words has one shingle of all its words; a text
    without any word has one of its whole string, so that only equal ones agree.
    """
    for a, b in blocks(texts):
        words = Words(texts[a:b])
        grams = windows(words.hash, k)
        for i in range(b - a):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield windows(words.hash[lo:hi], int(hi - lo)) ^ U(int(hi - lo))
            else:
                p = code_points([texts[a + i]])[0]
                yield mix((np.array([0], U) if not len(p) else span_hashes(p, np.array([0]), np.array([len(p)]))) + U(0xABCDEF))
