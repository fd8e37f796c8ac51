"""Byte ranges of a path that a query matches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import has_glob, has_separator

RANGES = "array<struct<start:int,end:int>>"


def _substrings(path: str, query: str) -> list[tuple[int, int]]:
    low, needle = path.lower().encode(), query.lower().encode()
    return [(m.start(), m.end()) for m in re.finditer(re.escape(needle), low)] if needle else []


def _initials(path: str, query: str) -> list[tuple[int, int]]:
    wanted = [p.lower() for p in re.split(r"[/\\]", query) if p]
    segments = [(m.group().lower(), len(path[: m.start()].encode())) for m in re.finditer(r"[^/\\]+", path)]
    out, at = [], 0
    for number, part in enumerate(wanted):
        last = number == len(wanted) - 1
        while at < len(segments):
            text, offset = segments[at]
            at += 1
            place = text.find(part) if last else (0 if text.startswith(part) else -1)
            if place >= 0:
                begin = offset + len(text[:place].encode())
                out.append((begin, begin + len(part.encode())))
                break
    return out


def ranges(path: str, query: str) -> list[tuple[int, int]]:
    """Half-open byte ranges: every occurrence, or for path initials the part of each segment that matched."""
    if not query:
        return []
    return _initials(path, query) if has_separator(query) and not has_glob(query) else _substrings(path, query)


def highlights(query: str) -> Column:
    @F.pandas_udf(RANGES)
    def of(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: [] if p is None else [{"start": a, "end": b} for a, b in ranges(p, query)])

    return of("path")
