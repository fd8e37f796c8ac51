"""Directories that are left out by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names left out by default (fixed values).
DEFAULT_DIRS = (".git", ".hg", ".svn", ".cache", ".cargo", ".npm", ".pnpm-store", ".yarn", "node_modules", "target", "dist", "build", "vendor")


def clean_names(names: list[str]) -> list[str]:
    """Names without blanks and slashes around them, in order, each once."""
    return sorted({s for s in (n.strip().strip("/").strip("\\") for n in names) if s})


def excluded(segs: Column, names: list[str] | None = None) -> Column:
    """Whether any component of a path is one of the names; case counts."""
    listed = clean_names(list(DEFAULT_DIRS if names is None else names))
    return F.arrays_overlap(segs, F.array(*map(F.lit, listed))) if listed else F.lit(False)
