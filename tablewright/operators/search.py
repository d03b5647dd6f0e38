"""Search in the cells of a selection, with one pattern or many; counts, breakdowns, replacements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udf
from ..functions.compiler import select_names
from .rows import context

MODES = ("substring", "exact", "regex", "url", "empty", "nonempty", "levenshtein", "damerau")


def _test(cell: Column, pattern: str, mode: str, fold: bool, distance: int) -> Column:
    text, p = (F.lower(cell), pattern.lower()) if fold and mode != "regex" else (cell, pattern)
    if mode == "substring":
        return text.contains(p)
    if mode == "exact":
        return text == p
    if mode == "regex":
        return text.rlike(("(?i)" if fold else "") + p)
    if mode == "url":
        return udf.lru(text).startswith(udf.lru_of(p))
    if mode == "levenshtein":
        return F.levenshtein(text, F.lit(p), distance) >= 0
    if mode == "damerau":
        return udf.damerau(text, F.lit(p)) <= distance
    raise ValueError(f"no search mode {mode!r}")


def _cells(df: DataFrame, spec: str | None) -> list[Column]:
    return [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in (select_names(df, spec) if spec else df.columns)]


def _plain(df: DataFrame, spec: str | None) -> list[Column]:
    """Texts as they are, so that tests reach the scan; a null fails every test of a pattern that empty text fails."""
    names = select_names(df, spec) if spec else df.columns
    return [F.col(f"`{n}`") if df.schema[n].dataType.simpleString() == "string" else F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]


def predicate(df: DataFrame, pattern: str | list[str], spec: str | None = None, mode: str = "substring", fold: bool = False, distance: int = 1, every: bool = False) -> Column:
    fixed = mode in ("exact", "substring") and all([pattern] if isinstance(pattern, str) else pattern)
    cells = _plain(df, spec) if fixed else _cells(df, spec)
    if mode in ("empty", "nonempty"):
        tests = [(c == "") if mode == "empty" else (c != "") for c in cells]
    else:
        patterns = [pattern] if isinstance(pattern, str) else pattern
        if mode == "exact" and not fold:
            tests = [c.isin(patterns) for c in cells]
        elif mode == "regex" and len(patterns) > 1:
            tests = [_test(c, "|".join(f"(?:{p})" for p in patterns), mode, fold, distance) for c in cells]
        elif mode == "substring" and len(patterns) > 8:  # one alternation instead of a scan for each
            tests = [_test(c, "|".join(re.escape(p) for p in patterns), "regex", fold, distance) for c in cells]
        else:
            tests = [reduce(lambda a, b: a | b, [_test(c, p, mode, fold, distance) for p in patterns]) for c in cells]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def search(df: DataFrame, pattern: str | list[str] = "", spec: str | None = None, mode: str = "substring", invert: bool = False, limit: int | None = None, before: int = 0, after: int = 0, order_by=None, **options) -> DataFrame:
    """Rows with a match in any selected cell (every=True: in each)."""
    test = predicate(df, pattern, spec, mode, **options)
    return context(df, ~F.coalesce(test, F.lit(False)) if invert else test, before, after, limit, order_by).select(*[F.col(f"`{c}`") for c in df.columns])


def _regex(pattern: str, mode: str, fold: bool, overlapping: bool = False) -> str:
    p = pattern if mode == "regex" else re.escape(pattern)
    p = f"^(?:{p})$" if mode == "exact" else p
    return ("(?i)" if fold else "") + (f"(?=({p}))" if overlapping else p)


def _matches(df: DataFrame, pattern: str, spec, mode, fold, overlapping=False) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(_regex(pattern, mode, fold, overlapping))) for c in _cells(df, spec)]).cast("long")


def count_matches(df: DataFrame, pattern: str | list[str], name: str = "matches", spec: str | None = None, mode: str = "substring", fold: bool = False, overlapping: bool = False, keep_all: bool = False) -> DataFrame:
    patterns = [pattern] if isinstance(pattern, str) else pattern
    total = reduce(lambda a, b: a + b, [_matches(df, p, spec, mode, fold, overlapping) for p in patterns])
    out = df.withColumn(name, total)
    return out if keep_all else out.filter(F.col(f"`{name}`") > 0)


def breakdown(df: DataFrame, patterns: list[tuple[str, str]], spec: str | None = None, mode: str = "substring", fold: bool = False, keep_all: bool = False) -> DataFrame:
    """A column of counts for each name of (name, pattern); patterns of one name add up."""
    by: dict[str, list[Column]] = {}
    for name, p in patterns:
        by.setdefault(name, []).append(_matches(df, p, spec, mode, fold))
    counts = {n: reduce(lambda a, b: a + b, cs) for n, cs in by.items()}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in counts.items()])
    return out if keep_all else out.filter(reduce(lambda a, b: a | b, [F.col(f"`{n}`") > 0 for n in counts]))


def unique_matches(df: DataFrame, patterns: list[tuple[str, str]], name: str = "matched", sep: str = "|", spec: str | None = None, mode: str = "substring", fold: bool = False, keep_all: bool = False) -> DataFrame:
    """The sorted distinct names of the patterns that match, joined."""
    hits = [F.when(_matches(df, p, spec, mode, fold) > 0, F.lit(n)) for n, p in patterns]
    out = df.withColumn(name, F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), sep))
    return out if keep_all else out.filter(F.col(f"`{name}`") != "")


def replace(df: DataFrame, patterns: list[tuple[str, str]], spec: str | None = None, mode: str = "substring", fold: bool = False) -> DataFrame:
    """Cells with each (pattern, replacement) applied; $1 stands for a group of a regular expression."""
    names = set(select_names(df, spec) if spec else df.columns)

    def replaced(n: str) -> Column:
        out = F.col(f"`{n}`").cast("string")
        for p, by in patterns:
            literal = by if mode == "regex" else by.replace("\\", "\\\\").replace("$", "\\$")
            out = F.regexp_replace(out, _regex(p, mode, fold), literal)
        return out.alias(n)

    return df.select(*[replaced(n) if n in names else F.col(f"`{n}`") for n in df.columns])
