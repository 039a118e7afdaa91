"""Glob patterns as column predicates, translated when the plan is made; those of a column, once each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPECIAL = set("*?[\\")


def regex(pattern: str) -> str:
    """An anchored regular expression: ``*`` any run, ``?`` one character, ``[a-z]`` ``[^x]`` classes, ``\\x`` x itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            inside = []
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] == "\\" and end + 1 < len(pattern):
                    end += 1
                    inside.append("\\" + pattern[end])
                else:
                    inside.append(pattern[end] if pattern[end] == "-" else re.escape(pattern[end]))
                end += 1
            negated = "^" if pattern[i + 1 : i + 2] == "^" else ""
            out.append(f"[{negated}{''.join(inside)}]" if inside else ("." if negated else "(?!)"))
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches(column: Column | str, pattern: str) -> Column:
    """Whether the whole text matches; a literal before one last ``*`` becomes a prefix test that sources can use."""
    column = F.col(column) if isinstance(column, str) else column
    if not _SPECIAL & set(pattern):
        return column == pattern
    if pattern.endswith("*") and not _SPECIAL & set(pattern[:-1]):
        return column.startswith(pattern[:-1]) if len(pattern) > 1 else column.isNotNull()
    return column.rlike(regex(pattern))


def literal_prefix(pattern: str) -> str:
    """What every text that matches begins with: the characters before the first special one."""
    out, i = [], 0
    while i < len(pattern) and pattern[i] not in "*?[":
        i += pattern[i] == "\\" and i + 1 < len(pattern)
        out.append(pattern[i])
        i += 1
    return "".join(out)


def translated(patterns: DataFrame, column: str) -> DataFrame:
    """(pattern, _regex, _prefix) of the distinct patterns of a column: the only rows that Python sees."""

    def run(batches):
        for b in batches:
            b = b[["pattern"]].copy()
            b["_regex"], b["_prefix"] = b["pattern"].map(regex), b["pattern"].map(literal_prefix)
            yield b

    return patterns.where(F.col(column).isNotNull()).select(F.col(column).alias("pattern")).distinct().mapInPandas(run, "pattern string, _regex string, _prefix string")


#: Characters of a literal prefix that texts and patterns are joined by.
PREFIX = 8


def matched(texts: DataFrame, text: str, patterns: DataFrame, column: str, *more: str) -> DataFrame:
    """(text, pattern, more): distinct texts and patterns that match, joined by what patterns begin with before they are compared; ``more``: columns that must be equal."""
    known = translated(patterns, column)
    head = F.substring("_prefix", 1, PREFIX)
    globs = patterns.select(F.col(column).alias("pattern"), *more).distinct().join(known, "pattern").select("pattern", "_regex", head.alias("_head"), *more)
    heads = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length(text), F.lit(PREFIX))), lambda n: F.substring(F.col(text), F.lit(1), n)))
    names = texts.select(text, *more).distinct().withColumn("_head", heads)
    return names.join(globs, ["_head", *more]).where(F.regexp_like(F.col(text), F.col("_regex"))).select(text, "pattern", *more)
