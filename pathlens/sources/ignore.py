"""Ignore files in the syntax of gitignore, as regular expressions."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd

IGNORE_FILES = (".gitignore", ".ignore", ".git/info/exclude")
#: Of one folder, in a scan: a later file's rules prevail.
SCAN_FILES = (".git/info/exclude", ".gitignore", ".ignore")


@lru_cache(maxsize=4096)
def _compiled(body: str) -> re.Pattern:
    return re.compile(body + r"\Z", re.S)


@dataclass(frozen=True)
class Rule:
    body: str
    negated: bool
    dirs_only: bool

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.body)


def _translate(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**":
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            body = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", i + end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def parse_rule(line: str) -> Rule | None:
    text = line.rstrip("\n\r")
    text = re.sub(r"(?<!\\)[ \t]+$", "", text)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    dirs_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    body = _translate(text.lstrip("/"))
    return Rule(("" if anchored else "(?:.*/)?") + body, negated, dirs_only)


@dataclass
class RuleSet:
    """The rules of one root; the last that matches decides."""

    root: str
    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def load(cls, root: str, names: tuple[str, ...] = IGNORE_FILES) -> RuleSet:
        rules = []
        for name in names:
            path = Path(root, name)
            if path.is_file():
                rules += [r for line in path.read_text(errors="replace").splitlines() if (r := parse_rule(line))]
        return cls(root.rstrip("/") or "/", rules)

    def at(self, root: str) -> RuleSet:
        """The same rules under another root."""
        return RuleSet(root.rstrip("/") or "/", self.rules)

    def pattern(self) -> str:
        """What ``ignores`` says of files as one regular expression, if no rule is negated."""
        base = re.escape(self.root.rstrip("/") + "/")
        return "(?s)^" + base + "(?:" + "|".join(f"(?:{r.body}){'/.' if r.dirs_only else '(?:/|$)'}" for r in self.rules) + ")"

    def verdict(self, relative: str, is_dir: bool) -> bool | None:
        for rule in reversed(self.rules):
            if (is_dir or not rule.dirs_only) and rule.regex.match(relative):
                return not rule.negated
        return None

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """Whether the path, or a directory above it below the root, is ignored."""
        base = self.root.rstrip("/") + "/"
        if not path.startswith(base):
            return False
        parts = path[len(base) :].split("/")
        return any(self.verdict("/".join(parts[:n]), is_dir or n < len(parts)) for n in range(1, len(parts) + 1))


def global_file() -> Path:
    """The user's own ignore file: ``core.excludesFile`` of their settings, else the usual place."""
    home, settings = Path.home(), os.environ.get("XDG_CONFIG_HOME")
    config = Path(settings) if settings else home / ".config"
    for place in (home / ".gitconfig", config / "git/config"):
        if place.is_file():
            section = ""
            for line in place.read_text(errors="replace").splitlines():
                if head := re.match(r"\s*\[\s*([^\]\s]+)", line):
                    section = head.group(1).lower()
                elif section == "core" and (found := re.match(r"\s*excludesfile\s*=\s*\"?([^\"]+?)\"?\s*$", line, re.I)):
                    return Path(found.group(1)).expanduser()
    return config / "git/ignore"


def global_rules(root: str) -> RuleSet:
    path = global_file()
    return RuleSet.load(str(path.parent), (path.name,)).at(root)


class Stack:
    """The rules that hold in a folder: its own, those of the folders above it up to the root, and the user's.

    The nearest folder whose rules say something decides.
    """

    def __init__(self, sets: tuple[RuleSet, ...]):
        self.sets = sets

    @classmethod
    def of(cls, root: str, folder: str) -> Stack:
        stack = cls((global_rules(root),)).into(root)
        below = folder[len(root.rstrip("/")) :].strip("/")
        at = root.rstrip("/")
        for name in filter(None, below.split("/")):
            at = f"{at}/{name}"
            stack = stack.into(at)
        return stack

    def into(self, folder: str) -> Stack:
        """With the rules of a folder right below."""
        own = RuleSet.load(folder, SCAN_FILES)
        return Stack((*self.sets, own)) if own.rules else self

    def ignores(self, path: str, is_dir: bool) -> bool:
        """Whether an entry is ignored, the folders above it not being so."""
        for rules in reversed(self.sets):
            said = rules.verdict(path[len(rules.root.rstrip("/")) + 1 :], is_dir)
            if said is not None:
                return said
        return False


class IgnoreFilter:
    """The user's rules, then those of several roots, deepest first."""

    def __init__(self, roots: list[str]):
        sets = [RuleSet.load(r) for r in roots]
        deepest = sorted((s for s in sets if s.rules), key=lambda s: -s.root.count("/"))
        self.sets = [s for r in roots if (s := global_rules(r)).rules] + deepest

    def ignores(self, path: str) -> bool:
        return any(s.ignores(path) for s in self.sets)

    def column(self):
        """The test on ``path``: one regular expression a root where no rule is negated, else, as
        the last rule that matches decides, an Arrow function."""
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        if not any(r.negated for s in self.sets for r in s.rules):
            out = F.lit(False)
            for s in self.sets:
                out = out | F.coalesce(F.col("path").rlike(s.pattern()), F.lit(False))
            return out

        @F.pandas_udf(T.BooleanType())
        def ignored(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: p is not None and self.ignores(p)).astype(bool)

        return ignored("path")
