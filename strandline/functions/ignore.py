"""Ignore rules in the manner of gitignore, as Columns on a path."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.model import IGNORE_FILE, STATE_DIR

GLOB = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
MEANING = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    pattern: str = ""
    rooted: bool = False


def _literal(text: str) -> str:
    """A Java and Python pattern for the text itself."""
    return "".join(c if c.isalnum() or c in "_/ " else f"\\{c}" if c.isascii() else c for c in text)


def compile_rule(line: str) -> Rule:
    """`!` negates, a leading `/` or any inner one ties to the root, and all below a match is matched."""
    negated = line.startswith("!")
    pattern = line.removeprefix("!")
    rooted = pattern.startswith("/")
    pattern = pattern.removeprefix("/").removesuffix("/")
    body = "".join(MEANING.get(part) or _literal(part) for part in GLOB.findall(pattern))
    start = "" if rooted or "/" in pattern else "(?:.*/)?"
    # (?s): a line feed is a character of a path like any other
    return Rule(f"(?s)^{start}{body}(?:/.*)?$", negated, pattern, rooted)


def parse_rules(text: str | None) -> list[Rule]:
    """One rule a line; blank lines and those that begin with `#` say nothing."""
    lines = (line.strip() for line in (text or "").splitlines())
    return [compile_rule(line) for line in lines if line and not line.startswith("#")]


def tested_path(path: Column, strict: bool = False) -> Column:
    """A path as rules see it: all dots and slashes at its start go, so `.env` is tested as `env`; `strict` keeps them."""
    tested = F.replace(path, F.lit("\\"), F.lit("/"))
    return tested if strict else F.regexp_replace(tested, r"\A[./]+", "")


def ignored(path: Column, rules: list[Rule], strict: bool = False) -> Column:
    """Whether the last rule that matches says so; for some hundred rules, more go through `operators.rules`."""
    tested, verdict = tested_path(path, strict), None
    for rule in reversed(rules):
        hit = tested.rlike(rule.regex)
        verdict = F.when(hit, F.lit(not rule.negated)) if verdict is None else verdict.when(hit, F.lit(not rule.negated))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))


def internal(path: Column) -> Column:
    """The engine's own files and those of git, never indexed."""
    names = "|".join(_literal(n) for n in (STATE_DIR, ".git"))
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(rf"(?s)^(?:\./)?(?:{_literal(IGNORE_FILE)}$|(?:{names})(?:$|/.*))")
