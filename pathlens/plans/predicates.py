"""Query trees as columns over normalised files."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlens.functions import literals
from pathlens.functions.paths import fold_ascii, nfc

from .query import Query, Term

COMPARE = {"<": operator.lt, "<=": operator.le, "=": operator.eq, ">=": operator.ge, ">": operator.gt}


def text_term(pattern: str, sensitive: bool) -> Column:
    """A substring of the path, or a glob over names or the whole path."""
    p = nfc(pattern) if sensitive else fold_ascii(nfc(pattern))
    path = F.col("path" if sensitive else "path_fold")
    if not literals.has_glob(p):
        return F.contains(path, F.lit(p))
    like = literals.like_pattern(p)
    if literals.has_separator(p):
        return path.like(like)
    fold = (lambda s: s) if sensitive else (lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    root = F.startswith(F.col("path"), F.lit("/")) & F.lit("/").like(like)
    return F.col("name" if sensitive else "name_fold").like(like) | F.exists("segs", lambda s: fold(s).like(like)) | root


def whole_name(pattern: str, sensitive: bool) -> Column:
    p = nfc(pattern)
    column = "path" if literals.has_separator(p) else "name"
    return F.col(column) == p if sensitive else F.col(f"{column}_fold") == fold_ascii(p)


def regex_term(pattern: str, sensitive: bool) -> Column:
    valid = literals.regex_or_none(pattern)
    if valid is None:
        return text_term(pattern, sensitive)
    over = F.col("path" if "/" in pattern or "\\\\" in pattern else "name")
    return over.rlike(valid if sensitive else "(?iu)" + valid)


def initials_term(query: str) -> Column:
    regex = literals.initials_regex(nfc(query))
    return F.lit(True) if regex is None else F.lower("path").rlike("(?s)" + regex)


def condition(t: Term, sensitive: bool, types: dict[str, str], content: str | None) -> Column:
    if t.kind == "text":
        return text_term(t.args[0], sensitive)
    if t.kind == "wfn":
        return whole_name(t.args[0], sensitive)
    if t.kind == "regex":
        return regex_term(t.args[0], sensitive)
    if t.kind == "ext":
        return F.col("ext").isin(*t.args) if t.args else F.lit(False)
    if t.kind == "day":
        column, start, end = t.args
        if column not in types:
            return F.lit(False)
        kind = types[column] if types[column].startswith("timestamp") else "timestamp"
        at = lambda d: F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast(kind)
        return (F.col(column) >= at(start)) & (F.col(column) < at(end))
    if t.kind == "compare":
        column, op, value = t.args
        return COMPARE[op](F.col(column), F.lit(value)) if value < 2**63 else F.lit(op.startswith("<"))
    if t.kind == "parent":
        return F.translate("parent", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == fold_ascii(t.args[0])
    if t.kind == "constant":
        return F.lit(t.args[0])
    if t.kind == "content":
        return F.contains(F.lower(content), F.lit(t.args[0].lower())) if content else F.lit(False)
    if t.kind == "all":
        return reduce(operator.and_, (condition(x, sensitive, types, content) for x in t.args))
    raise ValueError(t.kind)


def compile_query(query: Query, files: DataFrame, content: str | None = None) -> Column:
    """The predicate of a query over normalised ``files``. Unknown (null) is false, also under ``!``.

    ``content`` names a text column that ``content:`` searches; without one it matches nothing.
    """
    types = dict(files.dtypes)
    each = lambda t: condition(t, query.sensitive, types, content)
    branches = [reduce(operator.and_, map(each, b)) if b else F.lit(True) for b in query.branches]
    if query.initials:
        branches.append(initials_term(query.raw))
    include = reduce(operator.or_, branches)
    return reduce(operator.and_, (~F.coalesce(each(t), F.lit(False)) for t in query.excludes), include)
