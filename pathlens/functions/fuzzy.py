"""Fuzzy scores: the best alignment of a pattern as a subsequence of a path.

The aligner is a local alignment with affine gaps (Gotoh 1982) over subsequence
matches: points per matched character, more at the start of a word, after a
separator and for neighbours; gaps cost. Case counts only as a small bonus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import quoted

MATCH, WORD_START, CAMEL, NEIGHBOUR, SAME_CASE = 16, 8, 7, 6, 1
GAP_OPEN, GAP_MORE = 3, 1


def _bonus(text: str) -> np.ndarray:
    out = np.zeros(len(text), int)
    for i, c in enumerate(text):
        before = text[i - 1] if i else "/"
        if not before.isalnum():
            out[i] = WORD_START
        elif c.isupper() and before.islower():
            out[i] = CAMEL
    return out


def score(text: str, pattern: str) -> int | None:
    """The best alignment's points; None if the pattern is no subsequence of the text."""
    low, want = text.lower(), pattern.lower()
    if len(low) != len(text):
        text = low
    at = -1
    for c in want:
        at = low.find(c, at + 1)
        if at < 0:
            return None
    bonus = _bonus(text)
    dead = -(10**9)
    ended = np.full(len(low) + 1, 0)  # best with the characters so far, the last of them anywhere before
    ended_here = np.full(len(low), dead)
    for j, c in enumerate(want):
        here = np.full(len(low), dead)
        after = np.full(len(low) + 1, dead)
        best = dead
        for i in range(len(low)):
            if low[i] == c and (j == 0 or ended[i] > dead // 2 or (i and ended_here[i - 1] > dead // 2)):
                gain = MATCH + bonus[i] + (SAME_CASE if j < len(pattern) and len(text) == len(low) and text[i] == pattern[min(j, len(pattern) - 1)] else 0)
                apart = ended[i] if j else 0
                together = ended_here[i - 1] + NEIGHBOUR if j and i else dead
                here[i] = gain + max(apart, together)
            best = max(best - GAP_MORE, here[i] - GAP_OPEN)
            after[i + 1] = best
        ended, ended_here = after, here
    return int(ended_here.max()) if want else 0


#: Characters that are scored together.
BLOCK = 1_000_000


def score_all(texts: list[str], pattern: str) -> np.ndarray:
    """``score`` of each text (-1 where it is None), a character of the pattern at a time for all texts together.

    Texts with other than ASCII characters are scored one by one.
    """
    out = np.full(len(texts), -1, np.int64)
    plain = sorted((i for i, t in enumerate(texts) if t and t.isascii()), key=lambda i: len(texts[i])) if pattern.isascii() and pattern else []
    first = 0
    while first < len(plain):
        last = first
        while last < len(plain) and (last == first or (last + 1 - first) * len(texts[plain[last]]) <= BLOCK):
            last += 1
        rows = plain[first:last]
        out[rows] = _block([texts[i] for i in rows], pattern)
        first = last
    done = set(plain)
    for i, t in enumerate(texts):
        if i not in done:
            found = score(t, pattern)
            out[i] = -1 if found is None else found
    return out


def _block(texts: list[str], pattern: str) -> np.ndarray:
    """Points of ASCII texts of about equal length, -1 for those without the pattern."""
    width = max(map(len, texts))
    points = np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int64)
    upper, small = (points >= 65) & (points <= 90), (points >= 97) & (points <= 122)
    word = upper | small | ((points >= 48) & (points <= 57))
    low = np.where(upper, points + 32, points)
    apart = np.ones_like(word)
    apart[:, 1:] = ~word[:, :-1]
    humps = np.zeros_like(word)
    humps[:, 1:] = upper[:, 1:] & small[:, :-1]
    bonus = np.where(apart, WORD_START, np.where(humps, CAMEL, 0))
    dead = -(10**9)
    at = np.arange(width)
    before = np.zeros((len(texts), width), np.int64)  # the best that ended before this place, less its gap
    beside = np.full((len(texts), width), dead)  # the best that ended at the place before
    for j, c in enumerate(pattern):
        hit = low == ord(c.lower())
        gain = MATCH + bonus + SAME_CASE * (points == ord(c))
        here = np.where(hit, gain + np.maximum(before, beside + (NEIGHBOUR if j else 0)), dead)
        here[here < dead // 2] = dead
        reach = np.maximum.accumulate(here + GAP_MORE * at, axis=1) - GAP_MORE * at - GAP_OPEN
        before = np.full_like(before, dead)
        before[:, 1:] = reach[:, :-1]
        beside = np.full_like(beside, dead)
        beside[:, 1:] = here[:, :-1]
    best = here.max(axis=1)
    return np.where(best > dead // 2, best, -1)


def may_match(pattern: str) -> Column:
    """A cheap test on the JVM: the pattern's characters in order."""
    return F.lower("path").rlike("(?s)" + ".*".join(quoted(c) for c in pattern.lower()))


def fuzzy_score(pattern: str) -> Column:
    @F.pandas_udf("long")
    def of(paths: pd.Series) -> pd.Series:
        found = pd.Series(score_all([p or "" for p in paths], pattern), dtype="Int64")
        return found.mask((found < 0) | paths.isna().reset_index(drop=True))

    return of("path")
