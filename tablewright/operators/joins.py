"""Joins: equal keys, sorted keys, cross, and patterns in the right table (substring, regular expression, URL prefix)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udf
from ..functions.compiler import select_names
from ..storage import durable

HOW = ("inner", "left", "right", "full", "semi", "anti")
#: Bytes of patterns at most that every task gets a copy of; beyond, pattern joins run against the patterns in blocks.
PATTERN_BYTES = 8 << 20


def _keys(df: DataFrame, names: list[str], fold: bool, nulls: bool) -> list[Column]:
    """Key columns; unless nulls, rows whose keys are all empty have none, while partly empty keys do match."""
    cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    cells = [F.lower(c) for c in cells] if fold else cells
    if nulls:
        return cells
    some = reduce(lambda a, b: a | b, [c != "" for c in cells])
    return [F.when(some, c) for c in cells]


def join(left: DataFrame, right: DataFrame, on: str | tuple[str, str], how: str = "inner", fold: bool = False, nulls: bool = False, drop_key: str | None = None, left_prefix: str = "", right_prefix: str = "", merge: bool = False) -> DataFrame:
    """Join on selections of keys. drop_key: none, left, right or both; by default, keys of equal names stay once.

    Keys of the same type, without folding, are compared as they are, so that scans and exchanges are planned for them;
    others as text. merge: hint a sort-merge join.
    """
    if how not in HOW:
        raise ValueError(f"no join {how!r}")
    spec = on if isinstance(on, tuple) else (on, on)
    names = [select_names(d, s) for d, s in zip((left, right), spec, strict=True)]
    left, right = left.alias("l"), right.alias("r")
    same_types = all(left.schema[a].dataType == right.schema[b].dataType and left.schema[a].dataType.simpleString() != "string" for a, b in zip(*names, strict=True))
    a_keys = [left[f"`{n}`"] for n in names[0]] if same_types and not fold else None
    if a_keys is not None:
        pairs = list(zip(a_keys, [right[f"`{n}`"] for n in names[1]], strict=True))
        if len(pairs) > 1 or nulls:
            some = reduce(lambda x, y: x | y, [a.isNotNull() for a, _ in pairs])
            test = reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs])
            test = test if nulls else test & some
        else:
            test = pairs[0][0] == pairs[0][1]
    else:
        left = left.withColumns({f"_lk{i}": k for i, k in enumerate(_keys(left, names[0], fold, nulls))})
        right = right.withColumns({f"_rk{i}": k for i, k in enumerate(_keys(right, names[1], fold, nulls))})
        test = reduce(lambda x, y: x & y, [left[f"_lk{i}"] == right[f"_rk{i}"] for i in range(len(names[0]))])
    lc = [c for c in left.columns if not c.startswith("_lk")]
    rc = [c for c in right.columns if not c.startswith("_rk")]
    if how in ("semi", "anti"):
        return left.join(right, test, f"left_{how}").select(*[left[f"`{c}`"] for c in lc])
    joined = left.join(right.hint("merge") if merge else right, test, how)
    if drop_key is None:
        drop_key = "none" if names[0] != names[1] or fold or how == "full" else "left" if how == "right" else "right"
    skip_l = set(names[0]) if drop_key in ("left", "both") else set()
    skip_r = set(names[1]) if drop_key in ("right", "both") else set()
    return joined.select(*[left[f"`{c}`"].alias(left_prefix + c) for c in lc if c not in skip_l], *[right[f"`{c}`"].alias(right_prefix + c) for c in rc if c not in skip_r])


def cross(left: DataFrame, right: DataFrame, left_prefix: str = "", right_prefix: str = "") -> DataFrame:
    """Every pair of rows, as asked for."""
    return left.toDF(*[left_prefix + c for c in left.columns]).crossJoin(right.toDF(*[right_prefix + c for c in right.columns]))


def fuzzy(left: DataFrame, text: str, right: DataFrame, pattern: str, kind: str = "contains", how: str = "inner", fold: bool = False) -> DataFrame:
    """Rows of left with the rows of right whose pattern occurs in the text: contains, regex or url (prefix of its stems).

    A condition without equal keys: patterns are the small side. Where they exceed PATTERN_BYTES they are joined block by
    block, each small enough to be sent to all tasks.
    """
    cell, p = F.col(f"l.`{text}`"), F.col(f"r.`{pattern}`")
    if kind == "url":
        left, right = left.withColumn("_stems", udf.lru(F.col(f"`{text}`"))), right.withColumn("_prefix", udf.lru(F.col(f"`{pattern}`")))
        test = F.col("l._stems").startswith(F.col("r._prefix"))
    elif kind == "regex":
        test = F.rlike(cell, F.concat(F.lit("(?i)"), p) if fold else p)
    else:
        test = F.lower(cell).contains(F.lower(p)) if fold else cell.contains(p)
    columns = [c for c in left.columns if c != "_stems"], [c for c in right.columns if c != "_prefix"]
    out = [F.col(f"l.`{c}`") for c in columns[0]] + [F.col(f"w.`{c}`") for c in columns[1]]
    # only the patterns travel to all tasks, with a number; the rest of their rows is joined by it
    wide = durable(right.withColumn("_id", F.monotonically_increasing_id()))
    narrow = wide.select("_id", pattern, *(["_prefix"] if kind == "url" else []))
    size = narrow.agg(F.sum(F.octet_length(pattern) + 16)).first()[0] or 0
    blocks = -(-size // PATTERN_BYTES) or 1
    met, alone = None, left.alias("l")
    for k in range(blocks):
        part = F.broadcast((narrow if blocks == 1 else narrow.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == k)).alias("r"))
        one = left.alias("l").join(part, test).select("l.*", F.col("r._id").alias("_id"))
        met = one if met is None else met.union(one)
        if how == "left":
            alone = alone.join(part, test, "left_anti").alias("l")
    found = met.alias("l").join(wide.alias("w"), "_id").select(*out)
    if how == "left":
        empty = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns[1]]
        found = found.union(alone.select(*[F.col(f"l.`{c}`") for c in columns[0]], *empty))
    return found
