"""Ignore rules of version control: ordered, anchored or not, for directories only, with negation; the last rule that matches decides.

A path below an ignored directory is ignored whatever later rules say. The rules are used in three forms: in Python while a tree is walked, as one column
expression of literal rules, and against a column that holds a repository's own rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A column of rules, in order.
RULES = "array<struct<regex:string,keep:boolean,directory:boolean>>"


@dataclass(frozen=True)
class Rule:
    """``regex`` fits a whole path, ``keep`` marks a negated rule, ``directory`` one that fits directories only."""

    regex: str
    keep: bool
    directory: bool


def _segment(glob: str) -> str:
    """The regular expression of a glob in which no wildcard crosses a slash; for Python and Java alike."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            chars = re.sub(r"([\[\]\\&~^])", r"\\\1", body[1:] if negated else body)
            out += f"(?!/)[{'^' if negated else ''}{chars}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def rule(line: str, base: str = "") -> Rule | None:
    """The rule of a line of an ignore file that lies in the folder ``base``; None for blank lines and comments."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    text = text[1:] if keep else text
    directory = text.endswith("/")
    text = text[:-1] if directory else text
    anchored = "/" in text
    parts = [p for p in text.split("/") if p]
    if not parts:
        return None
    out = "" if anchored else "(?:.*/)?"
    for i, p in enumerate(parts):
        last = i + 1 == len(parts)
        if p == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(p) + ("" if last else "/")
    prefix = re.escape(base.strip("/")) + "/" if base.strip("/") else ""
    return Rule(f"^{prefix}{out}$", keep, directory)


def rules(lines: Iterable[str], base: str = "") -> list[Rule]:
    return [r for r in (rule(x, base) for x in lines) if r]


def verdict(path: str, is_directory: bool, listed: Iterable[Rule]) -> bool:
    """Whether a path is ignored, given that the directories above it are not."""
    out = False
    for r in listed:
        if (is_directory or not r.directory) and re.search(r.regex, path, re.S):
            out = not r.keep
    return out


def is_ignored(path: str, listed: list[Rule]) -> bool:
    """Whether a file is ignored, by itself or with a directory above it."""
    parts = path.split("/")
    return any(verdict("/".join(parts[:i]), i < len(parts), listed) for i in range(1, len(parts) + 1))


def _levels(path: Column) -> Column:
    """Structs (path, directory) of the directories above a file, and of the file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("directory")))


def ignored(path: Column, listed: list[Rule]) -> Column:
    """Whether a file is ignored by literal rules; null for a null path."""

    def last(level: Column) -> Column:
        out = F.lit(False)
        for r in listed:
            fits = level["path"].rlike("(?s)" + r.regex)
            out = F.when(fits & level["directory"] if r.directory else fits, F.lit(not r.keep)).otherwise(out)
        return out

    return F.when(path.isNotNull(), F.exists(_levels(path), last))


def ignored_by(path: Column, listed: Column) -> Column:
    """Whether a file is ignored by the rules in a column of type RULES; null rules ignore nothing."""
    fits = lambda level, r: F.rlike(level["path"], F.concat(F.lit("(?s)"), r["regex"])) & (level["directory"] | ~r["directory"])
    last = lambda level: F.aggregate(listed, F.lit(False), lambda seen, r: F.when(fits(level, r), ~r["keep"]).otherwise(seen))
    return F.when(path.isNotNull(), F.coalesce(F.exists(_levels(path), last), F.lit(False)))


def parsed(text: str | Column) -> Column:
    """The rules, as RULES, of a column of ignore files; a null file has none."""

    @F.pandas_udf(RULES)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"regex": r.regex, "keep": r.keep, "directory": r.directory} for r in rules((t or "").split("\n"))])

    return parse(text)
