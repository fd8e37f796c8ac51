"""The search language: text to a tree.

``query := branch ('|' branch)*``; a branch is the conjunction of its terms;
``!term`` excludes from all branches. Blanks separate terms, ``|`` and ``!`` also
inside a word; double quotes protect all three, and ``\\`` protects inside
quotes. ``name:value`` is a filter if the name is known (case counts), else text.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pathlens.functions import literals
from pathlens.functions.literals import QueryError

#: Extensions by kind of medium (fixed values).
DOCUMENTS = ("txt", "md", "markdown", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "odt", "ods", "odp", "epub", "csv")
PICTURES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "heif", "svg", "ico")
VIDEOS = ("mp4", "mkv", "mov", "avi", "webm", "flv", "m4v", "mpg", "mpeg", "wmv", "3gp", "ts")
MEDIA = {"doc": DOCUMENTS, "pic": PICTURES, "video": VIDEOS}
DATES = {"dm": "mtime", "dc": "ctime", "datecreated": "ctime", "da": "atime", "dateaccessed": "atime"}
#: A query that begins so is never read as path initials (fixed values).
NO_INITIALS = ("ext:", "regex:", "wfn:", "pic:", "doc:", "dm:", "dc:", "da:", "size:", "parent:", "infolder:", "depth:", "len:", "type:", "case:", "content:")

TOKEN = re.compile(r'[ \t\n\f\r]*(?:([|!])|((?:"(?:\\.|[^"\\])*(?:"|\\?$)|[^ \t\n\f\r|!"])+))', re.S)


@dataclass(frozen=True)
class Term:
    """One condition: ``kind`` with its arguments."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class Query:
    raw: str
    branches: tuple[tuple[Term, ...], ...]
    excludes: tuple[Term, ...] = ()
    sensitive: bool = False
    initials: bool = False
    legacy: bool = False
    today: dt.date = field(default_factory=dt.date.today, compare=False)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while (m := TOKEN.match(text, at)) and m.end() > at:
        at = m.end()
        word = m[1] or m[2]
        if m[2]:
            quotes = re.sub(r'"(?:\\.|[^"\\])*"', "", word, flags=re.S)
            if '"' in quotes:
                raise QueryError("a quote is not closed")
            word = word.strip()
        if word:
            out.append(word)
    if text[at:].strip(" \t\n\f\r"):
        raise QueryError("a quote is not closed")
    return out


def unquote(value: str) -> str:
    """The content of a quoted value; others stay as they are."""
    v = value.strip()
    if len(v) >= 2 and v[0] == v[-1] == '"':
        known = {"\\": "\\", '"': '"', "n": "\n", "t": "\t"}
        return re.sub(r"\\(.)", lambda m: known.get(m[1], m[0]), v[1:-1], flags=re.S)
    return v


def is_sensitive(query: str) -> bool:
    return any(c.isupper() for c in query)


def term(word: str, today: dt.date) -> tuple[list[Term], bool]:
    """The conditions of a word, and whether it asks for case to count."""
    name, colon, tail = word.partition(":")
    name = name.strip()
    if not colon:
        return [Term("text", (unquote(word),))], False
    if name == "case":
        return [], unquote(tail).strip().lower() not in ("off", "0", "false", "insensitive")
    value = unquote(tail)
    if name in ("wfn", "regex"):
        return [Term(name, (value,))], False
    if name == "ext":
        return [Term("ext", tuple(literals.extensions(re.split("[;,]", value))))], False
    if name in MEDIA:
        return [Term("ext", MEDIA[name]), *([Term("text", (value,))] if value else [])], False
    if name in DATES:
        return [Term("day", (DATES[name], *literals.day_range(value, today)))], False
    if name == "size":
        return [Term("compare", ("size", *literals.size_filter(value)))], False
    if name in ("parent", "infolder"):
        return [Term("parent", (value,))], False
    if name in ("depth", "parents"):
        return [Term("compare", ("depth", *literals.whole_number(value)))], False
    if name in ("len", "namelength"):
        return [Term("compare", ("name_len", *literals.whole_number(value)))], False
    if name == "type":
        return [Term("constant", (value.lower() not in ("folder", "dir", "directory"),))], False
    if name == "content":
        if not value:
            raise QueryError("content: needs a keyword")
        return [Term("content", (value,))], False
    return [Term("text", (unquote(word),))], False


def parse(text: str, today: dt.date | None = None) -> Query:
    """The tree of a query; ``QueryError`` if it is not one."""
    today = today or dt.date.today()
    branches: list[list[Term]] = [[]]
    excludes: list[Term] = []
    sensitive, negate = False, False
    for token in tokens(text):
        if token in ("|", "!"):
            if negate:
                raise QueryError("'!' needs a term")
            if token == "|":
                branches.append([])
            negate = token == "!"
            continue
        found, ask = term(token, today)
        sensitive |= ask
        if negate and found:
            excludes.append(found[0] if len(found) == 1 else Term("all", tuple(found)))
        elif not negate:
            branches[-1] += found
        negate = False
    if negate:
        raise QueryError("'!' needs a term")
    if not all(branches) and (len(branches) > 1 or not excludes):
        raise QueryError("an empty branch")
    initials = literals.has_separator(text) and not literals.has_glob(text) and not text.startswith(NO_INITIALS)
    return Query(text, tuple(map(tuple, branches)), tuple(excludes), sensitive or is_sensitive(text), initials, today=today)


def parse_or_text(text: str, today: dt.date | None = None) -> Query:
    """The tree of a query, or the whole string as one text term."""
    try:
        return parse(text, today)
    except QueryError:
        return Query(text, ((Term("text", (text,)),),), sensitive="case:" in text or is_sensitive(text), legacy=True)
