"""Ignore rules: the lines of ignore files, compiled to one pattern for each folder that has some."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files of rules, in the order in which they are read. Fixed values.
IGNORE_FILES = (".gitignore", ".quarryignore")


def rules_of(text: str | None) -> list[str]:
    """The rules of an ignore file: trimmed lines that are neither empty nor comments; negations (!) are left out."""
    lines = (x.strip() for x in re.split("\r?\n", text or ""))
    return [x for x in lines if x and x[0] not in "#!"]


_TOKEN = re.compile(r"\*\*/?|\*|\?|\[[^\]]*\]|[\s\S]")
#: Characters and stars of a rule; a longer or denser one fits nothing.
LENGTH, STARS = 512, 24


def translated(rule: str) -> str:
    """A rule as a regular expression: ** any characters (a slash after it is part of it), * and ? none but slashes, [..] a class."""
    rule = re.sub(r"(\*\*/)+\*\*", "**", re.sub(r"\*{2,}", "**", rule))
    if len(rule) > LENGTH or rule.count("*") > STARS:
        return "(?!)"
    kinds = {"*": "[^/]*", "?": "[^/]", "**": ".*", "**/": ".*"}
    return "".join(kinds.get(t) or (t if len(t) > 1 else re.escape(t)) for t in _TOKEN.findall(rule.removesuffix("/")))


def compiled(rules: Iterable[str], below: bool = False) -> str | None:
    """One regular expression that finds the relative paths which any of the rules fits; None without a rule that can fit.

    A rule fits a whole path, or what follows a slash in it unless the rule starts with **/. A rule that ends with a slash fits what is
    under such a folder at the root, too. below: so does every rule at any depth, as a crawl never enters an ignored folder. Rules
    that are too long, have too many stars or are no valid pattern fit nothing.
    """
    anywhere, whole, under = [], [], []
    for rule in rules:
        body = translated(rule)
        try:
            re.compile(body)
        except re.error:
            continue
        (whole if rule.startswith("**/") else anywhere).append(body)
        if rule.endswith("/"):
            under.append(body)
    end = "(?:/|$)" if below else "$"
    parts = [(r"(?:^|/)(?:%s)" + end, anywhere), ("^(?:%s)" + end, whole), ("^(?:%s)(?:/|$)", under)]
    found = [shape % "|".join(f"(?:{b})" for b in dict.fromkeys(bodies)) for shape, bodies in parts if bodies]
    return "|".join(found) or None


def ignored(path: Column, rules: Mapping[str, Iterable[str]], below: bool = True) -> Column:
    """Whether a path is ignored by rules, given by the folder ("" for the root) that their file lies in.

    Each folder's rules see the path from that folder on. One search a folder with rules; their number is that of a
    repository's ignore files, not of its files.
    """
    out = F.lit(False)
    for folder, lines in sorted(rules.items()):
        pattern = compiled(lines, below)
        if pattern is None:
            continue
        prefix = folder.strip("/")
        if prefix:
            out = out | (path.startswith(f"{prefix}/") & F.substring(path, len(prefix) + 2, 1 << 30).rlike(pattern))
        else:
            out = out | path.rlike(pattern)
    return F.coalesce(out, F.lit(False))
