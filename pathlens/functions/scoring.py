"""Relevance of a path for a query, as one expression.

The needle is the lower-case query after its last separator; filters in the
query are part of it. The weights are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import quoted
from .paths import fold_ascii

BASE = 100.0
IN_NAME, WHOLE_STEM, NAME_START = 60.0, 60.0, 40.0
NAME_FACTOR, CLEAN_START_FACTOR = 2.5, 2.0
AT_START, AFTER_MARK, AT_CAMEL = 15.0, 12.0, 8.0
PER_NAME_BYTE, PER_LEVEL = 0.1, 0.5
RECENT, RECENT_DAYS = 15.0, 7
HIDDEN, JUNK, NODE_FACTOR = 30.0, 200.0, 0.1
#: Directory names that count as noise (fixed values).
JUNK_NAMES = (
    "node_modules", ".node_modules", "target", "cache", ".cache", "__pycache__", ".tox", "dist", "build", ".build", "vendor",
    ".gradle", ".mvn", ".cargo", "bower_components", ".npm", ".yarn", ".pnpm-store", ".next", ".nuxt", "coverage", ".coverage",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "venv", ".venv", "env", ".env", ".eggs",
)
NODE_NAMES = ("node_modules", ".node_modules")


def _parts() -> Column:
    return F.split("path", r"[/\\]")


def hidden_dir() -> Column:
    """Whether a directory on the path begins with a dot."""
    return F.col("path").rlike(r"(?:^|[/\\])\.[^/\\]+[/\\]")


def _any_part(names: tuple[str, ...]) -> Column:
    return F.lower("path").rlike(r"(?:^|[/\\])(?:" + "|".join(quoted(n) for n in names) + r")(?:$|[/\\])")


def boundary(needle: str) -> tuple[Column, Column]:
    """(bonus of the best place of the needle in the path, whether it is a clean start)."""
    low = fold_ascii(needle)
    path, there = F.col("path_fold"), quoted(low)
    first, rest = low[0], quoted(low[1:])
    camel = F.col("path").rlike("[a-z]" + first.upper() + (f"(?i:{rest})" if rest else "")) if first.isascii() and first.isalpha() else F.lit(False)
    at_start = F.startswith(path, F.lit(low))
    bonus = F.when(at_start, AT_START).when(path.rlike(r"[/\\.\-_ ]" + there), AFTER_MARK).when(camel, AT_CAMEL).otherwise(0.0)
    return bonus, ~at_start & path.rlike(r"[./\\]" + there)


def score(query: str, as_of: Column | None = None, mtime: bool = True) -> Column:
    """The score of a normalised row; ``as_of`` is the time that counts as now."""
    needle = query.lower().replace("\\", "/").rpartition("/")[2]
    located = "/" in query or "\\" in query
    name, total = F.lower("name"), F.lit(BASE)
    in_name = F.contains(name, F.lit(needle)) if needle else F.lit(False)
    if needle:
        stem = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
        add = lambda c, v: F.when(c, v).otherwise(0.0)
        quality = add(in_name, IN_NAME) + add(stem == needle, WHOLE_STEM) + add(F.startswith(name, F.lit(needle)), NAME_START)
        bonus, clean = boundary(needle)
        quality = quality * F.when(in_name | F.contains("name_fold", F.lit(fold_ascii(needle))), NAME_FACTOR).otherwise(1.0) * F.when(clean, CLEAN_START_FACTOR).otherwise(1.0)
        total = total + quality + bonus
    total = total - F.col("name_len") * PER_NAME_BYTE
    if mtime:
        now = as_of if as_of is not None else F.current_timestamp()
        recent = (F.col("mtime") <= now) & (F.col("mtime") > now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
        total = total + F.when(F.coalesce(recent, F.lit(False)), RECENT).otherwise(0.0)
    if not located:
        if "." not in query:
            total = total - F.when(hidden_dir() & ~in_name, HIDDEN).otherwise(0.0)
        node, junk = _any_part(NODE_NAMES), _any_part(JUNK_NAMES)
        in_node = F.when(total > 0, total * NODE_FACTOR).otherwise(total)
        noisy = F.when(junk & ~node, total - JUNK).otherwise(total)
        total = noisy if "node" in query.lower() else F.when(node, in_node).otherwise(noisy)
        total = total - F.col("depth") * PER_LEVEL
    return F.round(total).cast("long")
