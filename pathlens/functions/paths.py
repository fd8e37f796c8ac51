"""Columns derived from a path; all JVM-side expressions.

Three foldings of case are kept apart: ASCII only (text terms, globs, whole
names, parents, extensions), full lower case (initials, scores, name order) and
none. Separators: components are cut at ``/``; depth, score zones and initials
count ``\\`` too.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def fold_ascii(text: str) -> str:
    return text.translate(_FOLD)


def fold(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def nfc_column(s: pd.Series) -> pd.Series:
    """NFC form; ASCII strings, nearly all, are passed on."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def components(path: Column) -> Column:
    """Names between slashes, without empty and ``.`` ones."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def name_of(path: Column) -> Column:
    """The last component; empty if there is none."""
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parent_of(path: Column) -> Column:
    """What stands before the last component, ``/`` for those of the root."""
    up = F.regexp_extract(path, r"^(.*?)/+[^/]+/*$", 1)
    return F.when(path.rlike(r"^/+[^/]+/*$"), "/").otherwise(up)


def extension_of(name: Column) -> Column:
    """What follows the last dot, in ASCII lower case; null where only a first dot or none is."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), fold(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def depth_of(path: Column) -> Column:
    return (F.length(path) - F.length(F.translate(path, "/\\", ""))).cast("int")


def is_under(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or lies below it."""
    base = root.rstrip("/")
    return (path == root) | path.startswith(base + "/")


def join_root(root: Column, relative: Column) -> Column:
    """Root and relative path with one slash between them; an unknown root is ``/``."""
    return F.concat(F.regexp_replace(F.coalesce(root, F.lit("/")), "/+$", ""), F.lit("/"), F.regexp_replace(relative, "^/+", ""))


def longest_root(path: Column, roots: list[str]) -> Column:
    """The longest of ``roots`` that holds the path."""
    ordered = sorted({nfc(r) for r in roots} | {"/"}, key=lambda r: (-len(r.encode()), r))
    return F.coalesce(*(F.when(is_under(path, r), F.lit(r)) for r in ordered))


DERIVED = ("path_fold", "name", "name_fold", "parent", "ext", "depth", "name_len", "segs")


def normalize(files: DataFrame, compose: bool = False) -> DataFrame:
    """``files`` with the derived columns that it lacks; unused ones cost nothing.

    ``compose`` brings paths to NFC first, for sources that have not done so.
    """
    out = files
    if compose:
        out = out.withColumn("path", nfc_column("path"))
    path = F.col("path")
    name = name_of(path)
    made = {
        "path_fold": fold(path), "name": name, "name_fold": fold(name), "parent": parent_of(path), "ext": extension_of(name),
        "depth": depth_of(path), "name_len": F.octet_length(name), "segs": components(path),
    }
    return out.withColumns({k: v for k, v in made.items() if k not in files.columns})
