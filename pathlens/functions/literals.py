"""Values inside query terms: sizes, dates, comparisons, patterns. Plain Python."""

from __future__ import annotations

import datetime as dt
import re

from .paths import fold_ascii, nfc


class QueryError(ValueError):
    """A query that does not follow the language; searches then take it as plain text."""


OPERATORS = (">=", "<=", ">", "<", "=")
#: Powers of 1024 by the first letter of a unit.
UNITS = {"": 0, "b": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def comparison(text: str, default: str) -> tuple[str, str]:
    raw = text.strip()
    for op in OPERATORS:
        if raw.startswith(op):
            return op, raw[len(op) :].strip()
    return default, raw


def whole_number(text: str) -> tuple[str, int]:
    op, rest = comparison(text, "=")
    if not re.fullmatch(r"\+?[0-9]+", rest):
        raise QueryError(f"not a whole number: {rest!r}")
    return op, int(rest)


def human_bytes(text: str) -> int:
    """Bytes of ``10``, ``1.5kb``, ``2 MiB`` and the like."""
    m = re.fullmatch(r"([0-9.]*)([^0-9.]*)", re.sub(r"\s", "", text))
    if not m or not re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", m[1]):
        raise QueryError(f"not a size: {text!r}")
    unit = m[2].lower()
    known = {"", "b", "byte", "bytes"} | {p + s for p in "kmgt" for s in ("", "b", "ib")}
    if unit not in known:
        raise QueryError(f"unknown unit: {unit!r}")
    value = float(m[1]) * 1024.0 ** UNITS[unit[:1]]
    whole = int(value)
    return whole + (value - whole >= 0.5)


def size_filter(text: str) -> tuple[str, int]:
    op, rest = comparison(text, ">=")
    return op, human_bytes(rest)


def format_bytes(n: int) -> str:
    value, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if value < 1024 or unit == "TB":
            break
        value /= 1024
    return f"{n} B" if unit == "B" else f"{value:.2f} {unit}"


def day_range(text: str, today: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """The half-open day of ``today`` or ``YYYY-MM-DD``; days past a month's end run on into the next."""
    v = text.strip()
    if v.lower() == "today" and v.isascii():
        start = dt.datetime.combine(today, dt.time())
    else:
        parts = v.split("-")
        if len(parts) != 3 or not all(re.fullmatch(r"\+?[0-9]+", p) for p in parts):
            raise QueryError(f"not a date: {text!r}")
        year, month, day = map(int, parts)
        if not (1 <= month <= 12 and 1 <= day <= 31 and 1 <= year <= 9999):
            raise QueryError(f"not a date: {text!r}")
        start = dt.datetime(year, month, 1) + dt.timedelta(days=day - 1)
    return start, start + dt.timedelta(days=1)


def extensions(values: list[str]) -> list[str]:
    stripped = (v.strip().lstrip(".") for v in values)
    return [fold_ascii(v) for v in stripped if v]


def has_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def has_separator(pattern: str) -> bool:
    return "/" in pattern or "\\" in pattern


def like_pattern(glob: str) -> str:
    """A glob as a LIKE pattern with ``\\`` as escape."""
    collapsed = re.sub(r"\*+", "*", nfc(glob))
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": "\\\\"}.get(c, c) for c in collapsed)


def quoted(text: str) -> str:
    """A literal inside a regular expression, for Java and RE2 alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-/#&~ ])", lambda m: "[ ]" if m[1] == " " else ("/" if m[1] == "/" else m[1] if m[1] in "#&~" else "\\" + m[1]), text)


#: Constructs that linear-time engines do not have.
_UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9kGZX]|[*+?}]\+")


def regex_or_none(pattern: str) -> str | None:
    """The pattern if it is valid in a linear-time dialect, else None."""
    plain = re.sub(r"\\\\", "", pattern)
    if _UNSUPPORTED.search(re.sub(r"\[[^\]]*\]", "", plain)):
        return None
    try:
        re.compile(re.sub(r"\\[pP](\{[^}]*\}|\w)", "x", pattern.replace("\\z", "\\Z").replace("(?P<", "(?P<")))
    except re.error:
        return None
    return pattern.replace("(?P<", "(?<")


def initials_regex(query: str) -> str | None:
    """One expression, for lower-case paths, that walks path segments by their beginnings; None matches all."""
    parts = [quoted(p) for p in re.split(r"[/\\]", query.lower()) if p]
    if not parts:
        return None
    *first, last = parts
    if not first:
        return last
    begin = r"(?:^|[/\\])" + first[0] + r"[^/\\]*[/\\]"
    middle = "".join(r"(?:.*[/\\])?" + p + r"[^/\\]*[/\\]" for p in first[1:])
    return begin + middle + r"(?:.*[/\\])?[^/\\]*" + last


def longest_literal(pattern: str) -> str | None:
    """The longest run of at least three bytes between separators and wildcards."""
    runs = [r for r in re.split(r"[/\\*?]", pattern) if len(r.encode()) >= 3]
    return max(runs, key=lambda r: len(r.encode()), default=None)
