"""Searches over a file table: filter, rank, limit, render."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlens.functions import fuzzy, highlight, scoring
from pathlens.functions.paths import normalize
from pathlens.plans.predicates import compile_query
from pathlens.plans.query import parse_or_text

DEFAULT_LIMIT, MOST_LIMIT = 100, 10_000
LINE_LIMIT, LINE_MOST, LINE_BYTES = 2_000, 200_000, 8_192
FUZZY_LEAST, FUZZY_MOST, FUZZY_FACTOR = 512, 20_000, 20
SORTS = {
    "name": "name", "path": "path", "size": "size", "ext": "ext", "extension": "ext",
    "date_modified": "mtime", "dm": "mtime", "modified": "mtime", "date_created": "ctime", "dc": "ctime", "created": "ctime",
    "date_accessed": "atime", "da": "atime", "accessed": "atime",
}
EXACT, FUZZY = "exact", "fuzzy"


def mode_of(label: str | None) -> str:
    """The mode of a label; ``ValueError`` for an unknown one."""
    known = {"": EXACT, "exact": EXACT, "dsl": EXACT, "fuzzy": FUZZY, "fzf": FUZZY}
    mode = known.get((label or "").strip().lower())
    if mode is None:
        raise ValueError(f"unknown mode {label!r}")
    return mode


def sort_of(label: str | None) -> str:
    return SORTS.get((label or "").strip(), "score")


def path_key() -> Column:
    """Paths order by components, not by bytes."""
    return F.split("path", "/")


def ordering(sort: str, descending: bool) -> list[Column]:
    """The columns to sort by; scores always fall, and a falling order reverses the tie-break too."""
    if sort == "score":
        return [F.col("score").desc(), path_key().asc()]
    keys = {"name": F.lower("name"), "path": path_key(), "ext": F.coalesce("ext", F.lit(""))}
    key = keys.get(sort, F.col(sort))
    both = [key] if sort == "path" else [key, path_key()]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in both]


def matching(files: DataFrame, query: str, content: str | None = None) -> DataFrame:
    """The normalised rows that a query matches."""
    table = normalize(files)
    return table.where(compile_query(parse_or_text(query), table, content))


def search(
    files: DataFrame, query: str, limit: int | None = DEFAULT_LIMIT, mode: str | None = None, sort: str | None = None, order: str | None = None,
    as_of: Column | None = None, candidate_limit: bool = False, most: int = MOST_LIMIT, content: str | None = None,
) -> DataFrame:
    """path, size, score and highlights of the best ``limit`` matches, in order.

    The limit applies to the order asked for. ``candidate_limit`` first takes the
    first ``limit`` matches by path, and orders only those.
    """
    n = max(1, min(most, DEFAULT_LIMIT if limit is None else limit))
    by, descending = sort_of(sort), (order or "").strip() == "desc"
    scored = lambda df: df.withColumn("score", scoring.score(query, as_of, "mtime" in df.columns))
    for column in ("ctime", "atime"):
        if by == column and column not in files.columns:
            files = files.withColumn(column, F.lit(None).cast("timestamp"))
    if mode_of(mode) == FUZZY:
        found = _fuzzy(files, query, n, scored, candidate_limit)
    else:
        found = matching(files, query, content)
        found = scored(found.orderBy(path_key()).limit(n) if candidate_limit else found)
    best = found.orderBy(*ordering(by, descending)).limit(n)
    return best.select("path", "size", "score", highlight.highlights(query).alias("highlights"))


def _fuzzy(files: DataFrame, query: str, n: int, scored, candidate_limit: bool) -> DataFrame:
    """The n best by alignment and relevance, among exact matches, or all rows if there are none.

    Every match is ranked; ``candidate_limit`` takes the first matches by path only.
    """
    table = normalize(files)
    candidates = matching(files, query)
    if candidates.isEmpty():
        candidates = table
    elif candidate_limit:
        candidates = candidates.orderBy(path_key()).limit(max(n, min(max(FUZZY_FACTOR * n, FUZZY_LEAST), FUZZY_MOST)))
    ranked = scored(candidates.where(fuzzy.may_match(query))).withColumn("__fuzzy", fuzzy.fuzzy_score(query)).where("__fuzzy IS NOT NULL")
    return ranked.orderBy((F.col("__fuzzy") + F.col("score")).desc(), path_key()).limit(n).drop("__fuzzy")


@dataclass(frozen=True)
class Request:
    query: str
    limit: int
    mode: str


def line_request(text: str, default: int = LINE_LIMIT, most: int = LINE_MOST) -> Request | None:
    """A request of the line protocol; None if it asks for nothing."""
    query, limit, mode = None, None, EXACT
    for line in filter(None, map(str.strip, text.encode()[:LINE_BYTES].decode(errors="replace").splitlines())):
        key, value = line[:2], line[2:].strip()
        if key in ("q:", "q="):
            query = value
        elif line.startswith(("limit:", "limit=")):
            limit = int(line[6:].strip()) if line[6:].strip().isdecimal() else limit
        elif line.startswith(("mode:", "mode=")):
            mode = mode_of(line[5:])
        elif query is None:
            query = line.partition(":")[2].strip() if ":" in line else line
    if not (query or "").strip():
        return None
    return Request(query.strip(), max(1, min(limit or default, most)), mode)


def answer(files: DataFrame, text: str):
    """Paths of a line request, one after the other, by score."""
    if request := line_request(text):
        rows = search(files, request.query, request.limit, request.mode, most=LINE_MOST)
        yield from (r.path for r in rows.select("path").toLocalIterator())
