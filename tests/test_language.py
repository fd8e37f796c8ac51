"""The search language without Spark: tokens, terms, literals, patterns."""

import datetime as dt
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathlens.functions import literals as L
from pathlens.functions.highlight import ranges
from pathlens.plans.query import QueryError, Term, parse, parse_or_text, tokens


def test_operators_split_words():
    assert tokens('a|b!c "d | e" x:"y z"') == ["a", "|", "b", "!", "c", '"d | e"', 'x:"y z"']


def test_unclosed_quote():
    with pytest.raises(QueryError):
        parse('a "b')
    assert parse_or_text('a "b').legacy


@pytest.mark.parametrize("text", ["", "  ", "a|", "|a", "a||b", "!", "a !", "a| !b", "size:x", "size:10mb20", "dm:2024-13-01", "depth:x", "content:", 'case:'])
def test_invalid(text):
    with pytest.raises(QueryError):
        parse(text)


def test_excludes_are_global():
    q = parse("a|b !c")
    assert len(q.branches) == 2 and q.excludes == (Term("text", ("c",)),)
    assert parse("!c").branches == ((),)


def test_smart_case():
    assert not parse("vcp").sensitive and parse("VCP").sensitive and parse("case: vcp").sensitive
    assert parse("parent:/Home").sensitive and not parse("case:off vcp").sensitive


def test_prefixes_are_case_sensitive_and_unknown_ones_are_text():
    assert parse("EXT:rs").branches[0][0].kind == "text"
    assert parse("C:foo").branches[0][0] == Term("text", ("C:foo",))


def test_quotes_unescape_only_inside():
    assert parse(r'regex:"a\\.b"').branches == parse(r"regex:a\.b").branches
    assert parse(r'"a\"b\n\q"').branches[0][0].args == ('a"b\n\\q',)


@pytest.mark.parametrize(("text", "value"), [("10", 10), ("1k", 1024), ("1.5 KB", 1536), ("2MiB", 2 << 20), ("1g", 1 << 30), ("1tb", 1 << 40), ("0.5b", 1), ("10b", 10)])
def test_sizes(text, value):
    assert L.human_bytes(text) == value


def test_size_default_operator():
    assert L.size_filter("10") == (">=", 10) and L.size_filter("<10b") == ("<", 10) and L.whole_number("3") == ("=", 3)


def test_days():
    assert L.day_range("2024-02-31", dt.date(2024, 1, 1))[0] == dt.datetime(2024, 3, 2)
    assert L.day_range("today", dt.date(2024, 5, 6)) == (dt.datetime(2024, 5, 6), dt.datetime(2024, 5, 7))


def test_extensions_and_like():
    assert L.extensions([".JPG", " png", ""]) == ["jpg", "png"]
    assert L.like_pattern("a**_b?%") == r"a%\_b_\%"
    assert L.longest_literal("/a/bcd*efghi?x") == "efghi"


@pytest.mark.parametrize("bad", ["(?=a)", "a(?!b)", "(a)\\1", "a++", "("])
def test_regex_dialect(bad):
    assert L.regex_or_none(bad) is None


def test_regex_kept():
    assert L.regex_or_none(r"^VCP.*\.(js|ts)$") and L.regex_or_none(r"[a-z+]+") and L.regex_or_none("a\\\\1")


def walk(path: str, query: str) -> bool:
    """Segments matched in order: each by its beginning, the last anywhere in it."""
    wanted = [p.lower() for p in re.split(r"[/\\]", query) if p]
    segments = [p.lower() for p in re.split(r"[/\\]", path) if p]
    at = 0
    for n, part in enumerate(wanted):
        last = n == len(wanted) - 1
        while at < len(segments) and not (part in segments[at] if last else segments[at].startswith(part)):
            at += 1
        if at == len(segments):
            return False
        at += 1
    return True


names = st.text("ab.C ", min_size=1, max_size=3)


@given(st.lists(names, min_size=1, max_size=5), st.lists(names, min_size=1, max_size=3))
def test_initials_regex_equals_walk(path, query):
    p, q = "/" + "/".join(path), "/".join(query)
    assert bool(re.search("(?s)" + L.initials_regex(q), p.lower())) == walk(p, q)


def test_initials_cases():
    assert walk("/home/user/documents/project/main.rs", "home/pro") and L.initials_regex("/") is None


@pytest.mark.parametrize(
    ("path", "query", "want"),
    [
        ("/tmp/中文文档.txt", "文档", [(11, 17)]), ("/tmp/test_data/newfile.txt", "tmp/tes/new", [(1, 4), (5, 8), (15, 18)]), ("/a/aba", "A", [(1, 2), (3, 4), (5, 6)]),
        ("/a", "", []), ("/x/y", "b", []), ("/tmp/myfile.rs", "t/file", [(1, 2), (7, 11)]), ("/aaa", "aa", [(1, 3)]),
    ],
)
def test_highlights(path, query, want):
    assert ranges(path, query) == want
