"""Aggregation: agg, groupby, frequency, stats, bins, window, pivot aggregates and matrices."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, windows
from ..functions.aggregates import AGGREGATES, Aggregation
from ..functions.compiler import named, select_names
from ..functions.syntax import parse_clauses
from ..functions.values import Val, kind_of, number, present
from ..storage import durable
from .order import numbered, order_struct, runs


#: Columns that a matrix has at most.
MOST_COLUMNS = 10_000


def _at(name: str) -> Column:
    return F.col(f"`{name}`")


def _options(df: DataFrame, source: str, order_by) -> tuple[DataFrame, dict]:
    if not order_by:
        return df, {}
    if any(f in source for f in ("argmin", "argmax", "argtop", "row_index")):
        df = numbered(df, order_by, "_index")
        return df, {"order": order_struct(order_by), "row_index": F.col("_index")}
    return df, {"order": order_struct(order_by)}


def _spread(grouped, keys: list[str], made: list[tuple[str, Column]]) -> DataFrame:
    """Aggregates under their names. They are computed under others, lest a name be taken for a column of the table."""
    out = grouped.agg(*[c.alias(f"_made{i}") for i, (_, c) in enumerate(made)])
    return out.select(*[_at(k) for k in keys], *[F.col(f"_made{i}").alias(n) for i, (n, _) in enumerate(made)])


#: Aggregates that keep an object for each group, those among them whose state has many columns, and counts of distinct values.
OBJECTS, WIDE, DISTINCT = re.compile(r"percentile|median|collect_|mode\(|approx_"), re.compile("approx_count_distinct"), re.compile(r"(?i)(?<!approx_)(count\(distinct|count_distinct)")


def _grouped(rows: DataFrame, keys: list[str], names: list[str], made: list[tuple[str, Column]]) -> DataFrame:
    """Aggregates of the groups of keys, beside those keys that are named. Counts of distinct values, wide states and the others are
    made apart and joined by group if some keep objects: in one aggregation there would be objects for each distinct value."""
    kind = [1 if DISTINCT.search(str(c)) else 2 if WIDE.search(str(c)) else 0 for _, c in made]
    if len(set(kind)) < 2 or not any(OBJECTS.search(str(c)) for _, c in made):
        return _spread(rows.groupBy(*[_at(k) for k in keys]), names, made)
    out = None
    for part in sorted(set(kind)):
        ends = [_at(k).alias(k if out is None else f"_key{part}_{j}") for j, k in enumerate(keys)]
        columns = rows.groupBy(*ends).agg(*[c.alias(f"_made{i}") for i, (_, c) in enumerate(made) if kind[i] == part])
        same = [_at(k).eqNullSafe(F.col(f"_key{part}_{j}")) for j, k in enumerate(keys)]
        out = columns if out is None else out.join(columns, reduce(lambda a, b: a & b, same)) if keys else out.crossJoin(columns)
    return out.select(*[_at(k) for k in names], *[F.col(f"_made{i}").alias(n) for i, (n, _) in enumerate(made)])


def agg(df: DataFrame, source: str, order_by=None, along_rows: str | None = None, along_columns: str | None = None, pooled: str | None = None) -> DataFrame:
    """One row of aggregates. along_columns: the clauses for each column of a selection, as `_`, {} in names its name;
    along_rows: for each row, over the cells of a selection, as `_`; pooled: over all cells of a selection."""
    if along_rows:
        return _along_rows(df, source, along_rows)
    if pooled:
        cells = df.select(F.explode(F.array(*[_at(n) for n in select_names(df, pooled)])).alias("cell"))
        return _spread(cells.groupBy(), [], aggregates.pairs(cells, source, under="cell"))
    rows, options = _options(df, source, order_by)
    if along_columns:
        return _spread(rows.groupBy(), [], _along(rows, source, select_names(df, along_columns), options))
    return _grouped(rows, [], [], aggregates.pairs(rows, source, **options))


def _along(df: DataFrame, source: str, columns: list[str], options: dict) -> list[tuple[str, Column]]:
    out = []
    for name in columns:
        compiler = Aggregation(df, under=name, **options)
        for clause in parse_clauses(source):
            clause.names = [n.replace("{}", name) if "{}" in n else f"{n}_{name}" for n in clause.names]
            out += zip(clause.names, named(compiler.compile(clause.tree), clause), strict=True)
    return out


def _along_rows(df: DataFrame, source: str, spec: str) -> DataFrame:
    cells = F.array(*[_at(n) for n in select_names(df, spec)])
    item = F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("cell")
    keyed = durable(df.withColumn("_id", F.monotonically_increasing_id()))  # the numbers are read twice
    flat = keyed.select("_id", item)
    made = _spread(flat.groupBy("_id"), ["_id"], aggregates.pairs(flat, source, under="cell"))
    return keyed.join(made, "_id", "left").drop("_id")


def groupby(df: DataFrame, spec: str, source: str, order_by=None, keep: str | None = None, totals: bool = False, along_columns: str | None = None, in_runs: bool = False) -> DataFrame:
    """Aggregates by group, groups in the order in which they first occur if order_by is given. keep: columns of the group's
    first row; totals: the whole table's aggregates appended to each row; in_runs: of a table in order, a row for each run
    of equal keys, so that a key that comes again later has another."""
    names = select_names(df, spec)
    run = ["_run"] if in_runs else []
    df = runs(df, names, order_by) if in_runs else df
    rows, options = _options(df, source, order_by)
    made = _along(rows, source, select_names(df, along_columns), options) if along_columns else aggregates.pairs(rows, source, **options)
    extra = [(n, F.min_by(_at(n), order_struct(order_by))) for n in select_names(df, keep)] if keep else []
    first = [("_first", F.min(order_struct(order_by)))] if order_by else []
    out = _grouped(rows, [*run, *names], names, [*extra, *made, *first])
    if order_by:
        out = out.orderBy("_first").drop("_first")
    if totals:
        whole = _grouped(rows, [], [], made)
        out = out.crossJoin(F.broadcast(whole.toDF(*[f"total_{c}" for c in whole.columns])))
    return out


def window(df: DataFrame, source: str, order_by, group: str | None = None, overwrite: bool = False) -> DataFrame:
    """df with window functions and aggregates over the rows of each group, in order."""
    names = select_names(df, group) if group else []
    rows, options = df, {}
    if "row_index" in source and not group or any(f in source for f in ("argmin", "argmax", "argtop")):
        rows = numbered(df, order_by, "_index")
        options = {"row_index": F.col("_index")}
    made = windows.clauses(rows, source, names, order_struct(order_by), **options)
    labels = [n for clause in parse_clauses(source) for n in clause.names]
    kept = [n for n in df.columns if not (overwrite and n in labels)]
    return rows.select(*[_at(n) for n in kept], *made)


def frequency(df: DataFrame, spec: str | None = None, limit: int | None = 10, group: str | None = None, sep: str | None = None, no_extra: bool = False, approx: bool = False) -> DataFrame:
    """field, value, count of the most frequent values of each column, ties by value; empty cells as <empty>, what the limit
    leaves as <rest>. One pass: cells become (field, value) rows that are counted with map-side sums."""
    names = select_names(df, spec) if spec else [c for c in df.columns if c != group]
    groups = select_names(df, group) if group else []
    cell = lambda n: F.nullif(_at(n).cast("string"), F.lit(""))
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), cell(n).alias("value")) for n in names])).alias("cell")
    flat = df.select(*[_at(g) for g in groups], items).select(*groups, "cell.*") if len(names) > 1 else df.select(*[_at(g) for g in groups], F.lit(names[0]).alias("field"), cell(names[0]).alias("value"))
    if sep:
        flat = flat.select(*groups, "field", F.explode(F.coalesce(F.split("value", f"\\Q{sep}\\E"), F.array(F.lit(None).cast("string")))).alias("value"))
    if no_extra:
        flat = flat.filter("value is not null")
    keys = [*groups, "field"]
    if approx:
        return _approximate(flat, keys, limit or 10)
    counts = flat.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("value", F.coalesce("value", F.lit("<empty>")))
    if limit is None:
        return counts.select(*keys, "value", "count")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "value"))
    ranked = counts.withColumn("_place", place)
    best = ranked.filter(F.col("_place") <= limit).select(*keys, "value", "count")
    if no_extra:
        return best
    total = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
    kept = best.groupBy(*keys).agg(F.sum("count").alias("_kept"))
    rest = total.join(kept, keys).filter("_total > _kept").select(*keys, F.lit("<rest>").alias("value"), (F.col("_total") - F.col("_kept")).alias("count"))
    return best.union(rest)


def _approximate(flat: DataFrame, keys: list[str], limit: int) -> DataFrame:
    top = flat.groupBy(*keys).agg(F.expr(f"approx_top_k(value, {limit})").alias("_top"))
    item = top.select(*keys, F.explode("_top").alias("_item"))
    return item.select(*keys, F.coalesce("_item.item", F.lit("<empty>")).alias("value"), F.col("_item.count").alias("count"))


STATS = ("count", "count_empty", "type", "types", "sum", "mean", "variance", "stddev", "min", "max", "lex_first", "lex_last", "min_length", "max_length")


def stats(df: DataFrame, spec: str | None = None, quartiles: bool = False, cardinality: bool = False, approx: bool = False, group: str | None = None) -> DataFrame:
    """One row a column: field and its statistics. All columns in one aggregation; lengths are in bytes."""
    groups = select_names(df, group) if group else []
    names = select_names(df, spec) if spec else [c for c in df.columns if c not in groups]
    made, fields = [], []
    for name in names:
        cell = Val(_at(name), *kind_of(df.schema[name].dataType))
        n = Val(double_or_null(cell), "float")
        shown = present(Val(_at(name).cast("string"), "str"))
        values = {
            "count": F.count(shown), "count_empty": F.count_if(shown.isNull()), "type": AGGREGATES["type"](None, cell).col, "types": AGGREGATES["types"](None, cell).col,
            "sum": F.sum(n.col), "mean": F.avg(n.col), "variance": F.var_pop(n.col), "stddev": F.stddev_pop(n.col), "min": F.min(n.col), "max": F.max(n.col),
            "lex_first": F.min(shown), "lex_last": F.max(shown), "min_length": F.min(F.octet_length(shown)).cast("long"), "max_length": F.max(F.octet_length(shown)).cast("long"),
        }
        if quartiles:
            values |= {"q1": F.percentile(n.col, 0.25), "median": F.percentile(n.col, 0.5), "q3": F.percentile(n.col, 0.75)}
        if cardinality:
            values |= {"cardinality": F.count_distinct(shown), "mode": F.call_function("mode", shown, F.lit(True))}
        if approx:
            values |= {"approx_cardinality": F.approx_count_distinct(shown), "approx_q1": F.percentile_approx(n.col, 0.25), "approx_median": F.percentile_approx(n.col, 0.5), "approx_q3": F.percentile_approx(n.col, 0.75)}
        fields = list(values)
        made.append(F.struct(F.lit(name).alias("field"), *[v.alias(k) for k, v in values.items()]))
    rows = df.groupBy(*[_at(g) for g in groups]).agg(F.array(*made).alias("_stats"))
    return rows.select(*groups, F.explode("_stats").alias("_s")).select(*groups, "_s.field", *[f"_s.`{f}`" for f in fields])


def double_or_null(cell: Val) -> Column:
    if cell.kind in ("int", "float", "bool", "str"):
        return number(cell, lenient=True).col.cast("double")
    return F.lit(None).cast("double")


def nice_ticks(low: float, high: float, goal: int) -> tuple[float, float, int]:
    """(start, step, number of bins) with a step of 1, 2 or 5 times a power of ten, about `goal` bins."""
    if high <= low:
        return low, 1.0, 1
    raw = (high - low) / goal
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))
    start = math.floor(low / step) * step
    return start, step, max(1, math.floor((high - start) / step) + 1)


def bins(df: DataFrame, spec: str | None = None, goal: int = 10, exact: bool = False, low: float | None = None, high: float | None = None, no_extra: bool = False) -> DataFrame:
    """field, value (the bin's bounds) and count: bins at nice ticks, or exact equal widths. Bounds come from one aggregate."""
    names = select_names(df, spec) if spec else df.columns
    cells = {n: double_or_null(Val(_at(n), *kind_of(df.schema[n].dataType))) for n in names}
    ends = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cells.values()) for k, f in (("a", F.min), ("b", F.max))]).first()
    out = None
    for i, (name, x) in enumerate(cells.items()):
        a, b = (low if low is not None else ends[f"a{i}"]), (high if high is not None else ends[f"b{i}"])
        if a is None or b is None:
            continue
        if exact:
            start, n = a, goal
            step = (b - a) / goal or 1.0
            place = F.least(F.floor((x - start) / step), F.lit(n - 1))
        else:
            start, step, n = nice_ticks(a, b, goal)
            place = F.floor((x - start) / step)
        inside = (x >= a) & (x <= b)
        label = F.concat(F.format_string("%.6g", float(start) + F.col("_bin") * float(step)), F.lit(".."), F.format_string("%.6g", float(start) + (F.col("_bin") + 1) * float(step)))
        one = df.select(F.when(inside, place).cast("long").alias("_bin")).groupBy("_bin").agg(F.count(F.lit(1)).alias("count"))
        if no_extra:
            one = one.filter("_bin is not null")
        one = one.select(F.lit(name).alias("field"), F.when(F.col("_bin").isNull(), "<empty>").otherwise(label).alias("value"), (float(start) + F.col("_bin") * float(step)).alias("lower_bound"), "count")
        out = one if out is None else out.union(one)
    return out


def matrix_count(df: DataFrame, x: str, y: str, weight: str | None = None, labels: list | None = None) -> DataFrame:
    """Rows x by columns y, the number (or weight) of their pairs; absent pairs are empty."""
    value = F.sum(_at(weight)) if weight else F.count(F.lit(1))
    found = df.groupBy(_at(x).cast("string").alias(x)).pivot(y, labels) if labels else df.groupBy(_at(x).cast("string").alias(x)).pivot(y)
    return found.agg(value).orderBy(x)


def adjacency(df: DataFrame, source: str, target: str, weight: str | None = None, undirected: bool = False) -> DataFrame:
    """The square matrix of an edge list, with a row and a column for each node."""
    w = _at(weight) if weight else F.lit(1).cast("long")
    edges = df.select(_at(source).cast("string").alias("_a"), _at(target).cast("string").alias("_b"), w.alias("_w"))
    if undirected:
        edges = edges.union(edges.filter("_a <> _b").select("_b", "_a", "_w"))
    nodes = edges.select("_a").union(edges.select("_b")).distinct()
    labels = [r[0] for r in nodes.orderBy("_a").limit(MOST_COLUMNS + 1).collect()]
    if len(labels) > MOST_COLUMNS:
        raise ValueError(f"a matrix of more than {MOST_COLUMNS} nodes")
    made = edges.groupBy("_a").pivot("_b", labels).agg(F.sum("_w"))
    return nodes.join(made, "_a", "left").orderBy("_a").withColumnRenamed("_a", "node")


def correlations(df: DataFrame, spec: str | None = None, diagonal: bool = True) -> DataFrame:
    """Pearson correlations of all pairs of columns, in one aggregate."""
    names = select_names(df, spec) if spec else df.columns
    one = lambda a, b: F.when(F.lit(a != b) | F.lit(diagonal), F.corr(_at(a).cast("double"), _at(b).cast("double"))).alias(b)
    rows = df.agg(F.array(*[F.struct(F.lit(a).alias("column"), *[one(a, b) for b in names]) for a in names]).alias("_m"))
    return rows.select(F.explode("_m").alias("_r")).select("_r.*")
