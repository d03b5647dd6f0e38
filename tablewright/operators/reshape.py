"""Shapes of tables: explode and implode, separate, pivot and unpivot, complete, transpose, concatenation and merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregation
from ..functions.compiler import select_names
from ..functions.syntax import parse_clauses
from .order import numbered, order_struct, ranged, window


#: Columns that a pivot makes at most.
MOST_COLUMNS = 10_000


def _at(name: str) -> Column:
    return F.col(f"`{name}`")


def explode(df: DataFrame, spec: str, sep: str = "|", rename: str | None = None, pad: bool = False, drop_empty: bool = False, keep: str | None = None) -> DataFrame:
    """A row for each part of the selected cells; several cells side by side, of as many parts unless pad; an empty cell gives
    one empty row, or none with drop_empty; keep: a column with the cell as it was."""
    names = select_names(df, spec)
    parts = [F.split(F.coalesce(_at(n).cast("string"), F.lit("")), re.escape(sep)) for n in names]
    zipped = F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    if len(parts) > 1 and not pad:
        same = F.size(parts[0]) == F.size(parts[1])
        for p in parts[2:]:
            same = same & (F.size(parts[0]) == F.size(p))
        zipped = F.when(F.assert_true(same, F.lit("cells of unequal numbers of parts")).isNull(), zipped)
    labels = dict(zip(names, rename.split(",") if rename else names, strict=True))
    kept = [_at(names[0]).alias(keep)] if keep else []
    out = df.select(*[_at(c) for c in df.columns], *kept, F.explode(zipped).alias("_part"))
    out = out.select(*[F.coalesce(F.col(f"_part.p{names.index(c)}"), F.lit("")).alias(labels[c]) if c in labels else _at(c) for c in df.columns], *([keep] if keep else []))
    if drop_empty:
        for n in names:
            out = out.filter(_at(labels[n]) != "")
    return out


def implode(df: DataFrame, column: str, order_by, sep: str = "|", group: list[str] | None = None, rename: str | None = None) -> DataFrame:
    """Cells of consecutive rows that agree on all other columns, joined. group: columns whose rows are runs of their own."""
    order_names = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [c for c in df.columns if c != column and (c not in order_names or c in (group or []))]
    w = window(group, order_by)
    key = F.struct(*[_at(c) for c in others])
    starts = F.when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    runs = df.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w))
    items = F.array_sort(F.collect_list(F.struct(order_struct(order_by).alias("o"), F.coalesce(_at(column).cast("string"), F.lit("")).alias("v"))))
    joined = F.array_join(F.transform(items, lambda s: s["v"]), sep)
    out = runs.groupBy(*[_at(g) for g in others], "_run").agg(joined.alias(rename or column), F.min(order_struct(order_by)).alias("_first"))
    return out.select(*[_at(rename or c) if c == column else _at(c) for c in df.columns if c == column or c in others])


def separate(df: DataFrame, column: str, sep: str | None = None, regex: str | None = None, match: str | None = None, captures: str | None = None, all_captures: str | None = None, widths: list[int] | None = None, cuts: list[int] | None = None, offsets: list[int] | None = None, into: list[str] | None = None, prefix: str | None = None, most: int | None = None, too_many: str = "error", keep: bool = False, trim: bool = False) -> DataFrame:
    """One column cut into several: by a separator, a regular expression, its matches or groups, or fixed places.

    The number of columns is that of `into`, else `most`, else the largest found (one aggregate over the column). Cells of
    more parts are an error, or their rest is dropped or merged into the last.
    """
    cell, names = F.coalesce(_at(column).cast("string"), F.lit("")), into
    if captures:
        compiled = re.compile(captures)
        n = compiled.groups
        named = {i: k for k, i in compiled.groupindex.items()}
        names = names or [named.get(i, f"{prefix or column}{i}") for i in range(1, n + 1)]
        java = re.sub(r"\(\?P<\w+>", "(", captures)
        parts = F.when(cell.rlike(java), F.array(*[F.regexp_extract(cell, java, i) for i in range(1, n + 1)])).otherwise(F.array().cast("array<string>"))
    elif widths or cuts or offsets:
        starts = offsets or (cuts and [0, *cuts]) or [sum(widths[:i]) for i in range(len(widths))]
        ends = [*starts[1:], None] if not widths else [s + w for s, w in zip(starts, widths, strict=True)]
        parts = F.array(*[F.substring(cell, s + 1, (e - s) if e is not None else 1 << 30) for s, e in zip(starts, ends, strict=True)])
    elif match or all_captures:
        parts = F.regexp_extract_all(cell, F.lit(match or all_captures), F.lit(0 if match else 1))
    else:
        pattern = regex if regex is not None else re.escape(sep)
        limit = (len(into) if into else most) if too_many == "merge" else None
        parts = F.split(cell, pattern, limit if limit else -1)
    if trim:
        parts = F.transform(parts, lambda x: F.trim(x))
    n = len(names) if names else most or (df.agg(F.max(F.size(parts))).first()[0] or 1)
    names = names or [f"{prefix or column}{i + 1}" for i in range(n)]
    if too_many == "error":
        parts = F.when(F.assert_true(F.size(parts) <= n, F.lit(f"a cell of {column} has more than {n} parts")).isNull(), parts)
    made = [F.coalesce(F.get(parts, i), F.lit("")).alias(name) for i, name in enumerate(names)]
    return df.select(*[x for c in df.columns for x in ([_at(c)] if c != column else [*([_at(c)] if keep else []), *made])])


def pivot(df: DataFrame, spec: str, clause: str, group: str | None = None, values: list | None = None, order_by=None) -> DataFrame:
    """Values of columns as columns, in the order in which they first occur (by order_by, else sorted), unless given."""
    names = select_names(df, spec)
    key = _at(names[0]) if len(names) == 1 else F.concat_ws("_", *[_at(n).cast("string") for n in names])
    (one,) = parse_clauses(clause)
    compiler = Aggregation(df, order=order_struct(order_by) if order_by else None)
    value = compiler.compile(one.tree).col
    used = {n for n in df.columns if re.search(rf"(?<![\w]){re.escape(n)}(?![\w])", one.source)}
    groups = select_names(df, group) if group else [c for c in df.columns if c not in names and c not in used]
    rows = df.withColumn("_pivot", key)
    if values is None:
        found = rows.groupBy("_pivot").agg(F.min(order_struct(order_by) if order_by else F.col("_pivot")).alias("_first"))
        values = [r[0] for r in found.orderBy("_first").limit(MOST_COLUMNS + 1).collect()]
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns: give values")
    return rows.groupBy(*[_at(g) for g in groups]).pivot("_pivot", values).agg(value)


def unpivot(df: DataFrame, spec: str, name: str = "name", value: str = "value") -> DataFrame:
    names = select_names(df, spec)
    ids = [c for c in df.columns if c not in names]
    kinds = {df.schema[n].dataType.simpleString() for n in names}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias(name), (_at(n) if len(kinds) == 1 else _at(n).cast("string")).alias(value)) for n in names])).alias("_cell")
    return df.select(*[_at(c) for c in ids], cells).select(*[_at(c) for c in ids], "_cell.*")


def transpose(df: DataFrame, index: str | None = None) -> DataFrame:
    """Rows as columns: for tables of few rows (Spark's limit of pivot values)."""
    names = df.columns
    return df.select(*[_at(n).cast("string").alias(n) for n in names]).transpose(F.col(f"`{index or names[0]}`"))


#: Missing values that are listed at a time.
LISTED = 4096


def complete(df: DataFrame, column: str, group: str | None = None, low=None, high=None, unit: str | None = None) -> DataFrame:
    """df with rows added for missing integers, or dates by year, month or day. Bounds are the table's, given ones clip it.

    Each value is looked at with the next one there is, and what is missing between the two is listed, in pieces: no task
    lists the whole range.
    """
    names = select_names(df, group) if group else []
    formats = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}

    def number(x: Column) -> Column:
        if not unit:
            return x.cast("long")
        d = F.to_date(F.concat(x.cast("string"), F.lit({"year": "-01-01", "month": "-01", "day": ""}[unit])))
        made = F.datediff(d, F.lit("1970-01-01")) if unit == "day" else F.year(d) * 12 + F.month(d) - 1 if unit == "month" else F.year(d)
        return made.cast("long")

    bound = lambda x, f: F.coalesce(number(F.lit(x)) if x is not None else F.lit(None).cast("long"), f("_key"))
    rows = df.withColumn("_key", number(_at(column))).filter("_key is not null")
    if low is not None:
        rows = rows.filter(F.col("_key") >= number(F.lit(low)))
    if high is not None:
        rows = rows.filter(F.col("_key") <= number(F.lit(high)))
    ends = rows.agg(bound(low, F.min).alias("a"), bound(high, F.max).alias("b")).filter("a is not null and b is not null")
    mark = F.explode(F.array(F.col("a") - 1, F.col("b") + 1)).alias("_key")
    keys = rows.select(*[_at(n) for n in names], "_key").distinct()
    if names:
        every = keys.union(keys.select(*[_at(n) for n in names]).distinct().crossJoin(F.broadcast(ends)).select(*[_at(n) for n in names], mark))
        every = every.withColumn("_next", F.lead("_key").over(Window.partitionBy(*[_at(n) for n in names]).orderBy("_key")))
    else:
        placed = ranged(keys.union(ends.select(mark)), "_key")
        firsts = placed.groupBy("_range").agg(F.min("_key").alias("_first"))
        after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
        inside = F.lead("_key").over(Window.partitionBy("_range").orderBy("_key"))
        every = placed.withColumn("_inside", inside).join(F.broadcast(after), "_range").withColumn("_next", F.coalesce("_inside", "_after"))
    gaps = every.filter("_next > _key + 1").withColumn("_low", F.explode(F.sequence(F.col("_key") + 1, F.col("_next") - 1, F.lit(LISTED).cast("long"))))
    absent = gaps.select(*[_at(n) for n in names], F.explode(F.sequence(F.col("_low"), F.least(F.col("_low") + LISTED, F.col("_next")) - 1)).alias("_key"))
    out = rows.unionByName(absent, allowMissingColumns=True)
    kind, key = df.schema[column].dataType, F.col("_key").cast("int")
    if not unit:
        shown = F.col("_key").cast(kind)
    else:
        date = F.date_add(F.lit("1970-01-01").cast("date"), key) if unit == "day" else F.make_date(F.expr("cast(_key div 12 as int)"), (key % 12) + 1, F.lit(1)) if unit == "month" else F.make_date(key, F.lit(1), F.lit(1))
        shown = date.cast(kind) if kind.simpleString() == "date" else F.date_format(date, formats[unit]).cast(kind)
    return out.select(*[shown.alias(c) if c == column else _at(c) for c in df.columns])


def missing(df: DataFrame, column: str, group: str | None = None, **options) -> DataFrame:
    """The rows that `complete` would add."""
    marked = df.withColumn("_there", F.lit(True))
    return complete(marked, column, group, **options).filter("_there is null").drop("_there")


def cat_rows(*tables: DataFrame, how: str = "same", source: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Tables below each other. how: same (headers must agree), union or intersection of headers; source: a column naming each."""
    if how == "same" and any(t.columns != tables[0].columns for t in tables):
        raise ValueError("headers differ")
    if how == "intersection":
        common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
        tables = tuple(t.select(*[_at(c) for c in common]) for t in tables)
    if source:
        tables = tuple(t.withColumn(source, F.lit(n)) for t, n in zip(tables, names, strict=True))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def cat_columns(left: DataFrame, right: DataFrame, left_order, right_order, pad: bool = False) -> DataFrame:
    """Tables side by side, row by row in their orders; pad: as long as the longer one."""
    a, b = numbered(left, left_order, "_place"), numbered(right, right_order, "_place")
    joined = a.alias("a").join(b.alias("b"), "_place", "full" if pad else "inner")
    return joined.select(*[F.col(f"a.`{c}`") for c in left.columns], *[F.col(f"b.`{c}`") for c in right.columns])


def merge(*tables: DataFrame, key: str, numeric: bool = False, reverse: bool = False, unique: bool = False, source: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Sorted tables as one sorted table; unique: one row of equal keys, from the first table that has it."""
    marked = cat_rows(*tables, source=source, names=names) if source else cat_rows(*tables)
    if unique:
        parts = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
        every = cat_rows(*parts)
        k = [_at(n) for n in select_names(tables[0], key)]
        place = F.row_number().over(Window.partitionBy(*k).orderBy("_table", *[_at(c) for c in tables[0].columns]))
        marked = every.withColumn("_place", place).filter("_place = 1").drop("_table", "_place")
    keys = [_at(n).try_cast("double") if numeric else _at(n) for n in select_names(tables[0], key)]
    return marked.orderBy(*[k.desc() if reverse else k.asc() for k in keys])


def flatten(df: DataFrame, order_by) -> DataFrame:
    """row, field, value: a row for each cell."""
    rows = numbered(df, order_by, "_place")
    cells = F.posexplode(F.array(*[F.struct(F.lit(n).alias("field"), _at(n).cast("string").alias("value")) for n in df.columns])).alias("_k", "_cell")
    return rows.select(F.col("_place").alias("row"), cells).select("row", "_cell.field", "_cell.value")
