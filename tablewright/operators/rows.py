"""Columns and rows: selection, computed columns, filters, slices, samples, order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compiler import Compiler, expression, named, predicate, select_names, selection
from ..functions.syntax import parse, parse_clauses
from ..functions.values import TypeProblem, Val, kind_of, number
from .order import numbered, order_struct, ranged, window


#: Rows of a slice up to which the first ones are fetched in order instead of numbering all.
FETCHED = 10_000


def _at(name: str) -> Column:
    return F.col(f"`{name}`")


def _indexed(df: DataFrame, source: str, order_by) -> tuple[DataFrame, Column | None]:
    """df with places if the expression asks for them."""
    if "row_index" in source and order_by:
        return numbered(df, order_by, "_index"), F.col("_index")
    return df, None


def select(df: DataFrame, spec: str, evaluate: bool = False, order_by=None) -> DataFrame:
    """Columns of a selection; with evaluate, expressions `expr as name`."""
    if not evaluate:
        return df.select(*[_at(n) for n in select_names(df, spec)])
    rows, index = _indexed(df, spec, order_by)
    return rows.select(*selection(df, spec, row_index=index))


def drop(df: DataFrame, spec: str) -> DataFrame:
    out = set(select_names(df, spec))
    return df.select(*[_at(n) for n in df.columns if n not in out])


def map_columns(df: DataFrame, source: str, overwrite: bool = False, only_filled: bool = False, over: str | None = None, order_by=None) -> DataFrame:
    """df with computed columns. overwrite: replace those of the same names; only_filled: drop rows whose results are all
    empty; over: repeat for each column of a selection, as `_`, with {} in names standing for its name."""
    rows, index = _indexed(df, source, order_by)
    made: dict[str, Column] = {}
    for under in select_names(df, over) if over else [None]:
        compiler = Compiler(df, index, under)
        for clause in parse_clauses(source):
            names = [n.replace("{}", under) if under else n for n in clause.names]
            clause.names = names
            for name, column in zip(names, named(compiler.compile(clause.tree), clause), strict=True):
                made[name] = column
    clash = [n for n in made if n in df.columns]
    if clash and not overwrite:
        raise TypeProblem(f"there are columns {', '.join(clash)} already")
    out = rows.select(*[made.get(n, _at(n)).alias(n) for n in df.columns], *[c.alias(n) for n, c in made.items() if n not in df.columns])
    if only_filled:
        out = out.filter(F.coalesce(*[F.nullif(_at(n).cast("string"), F.lit("")) for n in made]).isNotNull())
    return out


def transform(df: DataFrame, spec: str, source: str, rename: str | None = None, order_by=None) -> DataFrame:
    """The selected columns, each replaced by an expression of `_`."""
    rows, index = _indexed(df, source, order_by)
    chosen = select_names(df, spec)
    names = dict(zip(chosen, rename.split(",") if rename else chosen, strict=True))
    return rows.select(*[Compiler(df, index, n).compile(parse(source)).col.alias(names[n]) if n in names else _at(n) for n in df.columns])


def filter_rows(df: DataFrame, source: str, invert: bool = False, limit: int | None = None, before: int = 0, after: int = 0, order_by=None) -> DataFrame:
    """Rows for which the expression is truthy; before, after: with so many rows around each."""
    rows, index = _indexed(df, source, order_by)
    test = predicate(df, source, row_index=index)
    test = ~test if invert else test
    return context(rows, test, before, after, limit, order_by).select(*[_at(n) for n in df.columns])


def context(df: DataFrame, test: Column, before: int, after: int, limit: int | None, order_by) -> DataFrame:
    if before or after:
        place = numbered(df, order_by, "_place").withColumn("_hit", test)
        hits = place.filter("_hit").select(F.explode(F.sequence(F.col("_place") - before, F.col("_place") + after)).alias("_place")).distinct()
        df = place.join(hits, "_place", "left_semi")
    else:
        df = df.filter(test)
    if limit is not None:
        df = df.orderBy(order_struct(order_by)).limit(limit) if order_by else df.limit(limit)
    return df


def head(df: DataFrame, order_by, n: int = 10) -> DataFrame:
    return df.orderBy(order_struct(order_by)).limit(n)


def tail(df: DataFrame, order_by, n: int = 10) -> DataFrame:
    return df.orderBy(order_struct(order_by).desc()).limit(n).orderBy(order_struct(order_by))


def slice_rows(df: DataFrame, order_by, start: int = 0, end: int | None = None, length: int | None = None, indices: list[int] | None = None, last: int | None = None, start_when: str | None = None, end_when: str | None = None) -> DataFrame:
    """Rows by place; last: the last n; start_when, end_when: from the first truthy row on, up to before the first truthy."""
    if last is not None:
        return tail(df, order_by, last)
    if start_when or end_when:
        order, keep = order_struct(order_by), F.lit(True)
        first = df
        if start_when:
            at = df.filter(predicate(df, start_when)).agg(F.min(order).alias("_from"))
            first = first.crossJoin(F.broadcast(at))
            keep = keep & F.coalesce(order >= F.col("_from"), F.lit(False))
        if end_when:
            hits = first.filter(keep & predicate(df, end_when)).agg(F.min(order).alias("_to"))
            first = first.crossJoin(F.broadcast(hits))
            keep = keep & F.coalesce(order < F.col("_to"), F.lit(True))
        return first.filter(keep).select(*[_at(n) for n in df.columns])
    if indices is None and start == 0 and (end is not None or length is not None):
        return head(df, order_by, end if end is not None else length)
    stop = end if end is not None else start + length if length is not None else None
    if indices is None and stop is not None and stop <= FETCHED:
        return df.orderBy(order_struct(order_by)).offset(start).limit(max(0, stop - start))
    rows = numbered(df, order_by, "_place")
    if indices is not None:
        return rows.filter(F.col("_place").isin(indices)).drop("_place")
    rows = rows.filter(F.col("_place") >= start)
    return (rows if stop is None else rows.filter(F.col("_place") < stop)).drop("_place")


def bisect(df: DataFrame, column: str, value, exact: bool = False, upper: bool = False, reverse: bool = False, numeric: bool = False) -> DataFrame:
    """Rows from the lower bound of a value on (exact: equal to it; upper: above it): a range filter, pushed to the scan."""
    x = number(Val(_at(column), *kind_of(df.schema[column].dataType))).col if numeric else _at(column)
    if exact:
        return df.filter(x == value)
    if reverse:
        return df.filter(x < value if upper else x <= value)
    return df.filter(x > value if upper else x >= value)


def drawn(df: DataFrame, seed: int, key: str | None = None) -> Column:
    """A number in (0, 1) for each row, that depends on the seed and the cells of the key alone: 48 bits of an MD5."""
    cells = [F.coalesce(_at(n).cast("string"), F.lit("")) for n in (select_names(df, key) if key else df.columns)]
    text = F.concat_ws("|", F.lit(str(seed)), *cells)
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def sample(df: DataFrame, k: int, seed: int = 0, weight: str | None = None, group: str | None = None, key: str | None = None) -> DataFrame:
    """k uniform rows, or weighted without replacement, or k of each group. The draw is that of the key's cells, by default of
    all: it is the same however the table is split, and rows that agree in the key are drawn one after the other."""
    u = drawn(df, seed, key)
    key = F.when(_at(weight) > 0, -F.pow(u, 1.0 / _at(weight).cast("double"))).otherwise(F.lit(0.0)) if weight else u
    keyed = df.withColumn("_key", key)
    if not group:
        return keyed.orderBy("_key").limit(k).drop("_key")
    place = F.row_number().over(Window.partitionBy(*[_at(n) for n in select_names(df, group)]).orderBy("_key"))
    return keyed.withColumn("_place", place).filter(F.col("_place") <= k).drop("_key", "_place")


def shuffle(df: DataFrame, seed: int = 0, key: str | None = None) -> DataFrame:
    return df.orderBy(drawn(df, seed, key))


def enum(df: DataFrame, order_by, name: str = "index", start: int = 0) -> DataFrame:
    rows = numbered(df, order_by, "_place")
    return rows.select((F.col("_place") + start).alias(name), *[_at(n) for n in df.columns])


def reverse(df: DataFrame, order_by) -> DataFrame:
    return df.orderBy(order_struct(order_by).desc())


def rename(df: DataFrame, names: str | None = None, spec: str | None = None, prefix: str = "", suffix: str = "", slugify: bool = False, pattern: tuple[str, str] | None = None) -> DataFrame:
    chosen = select_names(df, spec) if spec else df.columns
    given = iter(names.split(",")) if names else None

    def new(n: str) -> str:
        if given:
            return next(given)
        if slugify:
            return re.sub(r"[^a-z0-9]+", "_", n.lower()).strip("_")
        return re.sub(pattern[0], pattern[1], n) if pattern else f"{prefix}{n}{suffix}"

    return df.toDF(*[new(n) if n in chosen else n for n in df.columns])


def count(df: DataFrame, approx: bool = False, fraction: float = 0.01) -> int:
    return round(df.sample(fraction, 0).count() / fraction) if approx else df.count()


def sort(df: DataFrame, spec: str, order_by=None, numeric: bool = False, reverse: bool = False, unique: bool = False, counted: bool = False) -> DataFrame:
    """Rows by the selected columns, ties by order_by; numeric: unreadable numbers first; unique: one row of equal keys."""
    names = select_names(df, spec)
    keys = [number(Val(_at(n), *kind_of(df.schema[n].dataType)), lenient=True).col if numeric else _at(n) for n in names]
    if unique or counted:
        agg = [F.min_by(F.struct(*[_at(n) for n in df.columns]), order_struct(order_by or names)).alias("_row")]
        agg += [F.count(F.lit(1)).alias("count")] if counted else []
        df = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*agg).select("_row.*", *(["count"] if counted else []))
    ordering = [k.desc_nulls_last() if reverse else k.asc_nulls_first() for k in keys]
    return df.orderBy(*ordering, *([order_struct(order_by)] if order_by else []))


def sort_cells(df: DataFrame, spec: str) -> DataFrame:
    """The selected columns' cells in order within each row."""
    names = select_names(df, spec)
    cells = F.array_sort(F.array(*[_at(n).cast("string") for n in names]))
    place = {n: i for i, n in enumerate(names)}
    return df.select(*[F.get(cells, place[n]).alias(n) if n in place else _at(n) for n in df.columns])


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*[_at(n) for n in sorted(df.columns)])


def top(df: DataFrame, column: str, k: int = 10, order_by=None, smallest: bool = False, lexicographic: bool = False, group: str | None = None, rank: str | None = None, ties: bool = False) -> DataFrame:
    """The k rows of largest (smallest) score, of each group; ties: all rows that tie with the k-th; unreadable scores dropped."""
    score = _at(column).cast("string") if lexicographic else number(Val(_at(column), *kind_of(df.schema[column].dataType)), lenient=True).col
    df2 = df.withColumn("_score", score).filter(F.col("_score").isNotNull())
    direction = F.col("_score").asc() if smallest else F.col("_score").desc()
    then = [order_struct(order_by)] if order_by else []
    columns = [_at(n) for n in df.columns]
    if not (group or rank or ties):
        return df2.orderBy(direction, *then).limit(k).select(*columns)
    if not group:  # the rows that can be in the result, without a global window
        kth = df2.orderBy(direction, *then).limit(k).agg((F.max if smallest else F.min)("_score").alias("_kth"))
        df2 = df2.crossJoin(F.broadcast(kth)).filter((F.col("_score") <= F.col("_kth")) if smallest else (F.col("_score") >= F.col("_kth")))
    spec = Window.partitionBy(*[_at(n) for n in select_names(df, group)]) if group else Window.partitionBy()
    place = F.rank().over(spec.orderBy(direction)) if ties else F.row_number().over(spec.orderBy(direction, *then))
    out = df2.withColumn("_place", place).filter(F.col("_place") <= k)
    return out.select(*([F.col("_place").cast("long").alias(rank)] if rank else []), *columns)


def dedup(df: DataFrame, spec: str | None = None, order_by=None, last: bool = False, only_repeated: bool = False, flag: str | None = None, choose: str | None = None) -> DataFrame:
    """One row of equal keys: the first, the last, or the one that `choose`, an expression of current_ and new_ columns, prefers.

    only_repeated: the rows whose key others share; flag: all rows, with whether they would stay.
    """
    names = select_names(df, spec) if spec else df.columns
    keys = [_at(n) for n in names]
    columns = [_at(n) for n in df.columns]
    if only_repeated:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        same = F.lit(True)
        for i, k in enumerate(names):
            n = n.withColumnRenamed(k, f"_k{i}")
            same = same & _at(k).eqNullSafe(F.col(f"_k{i}"))
        return df.join(n, same, "left_semi")
    order = order_struct(order_by or df.columns)
    if choose:
        return _chosen(df, names, order, choose)
    if flag:
        spec_ = Window.partitionBy(*keys).orderBy(order.desc() if last else order)
        return df.select(*columns, (F.row_number().over(spec_) == 1).alias(flag))
    best = (F.max_by if last else F.min_by)(F.struct(*columns), order).alias("_row")
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_row.*")


def _chosen(df: DataFrame, names: list[str], order: Column, choose: str) -> DataFrame:
    """A fold over the rows of a key, in order: the new row replaces the current one where the expression is truthy."""
    row = F.struct(*[_at(n) for n in df.columns])
    groups = df.groupBy(*[_at(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))).alias("_rows"))
    pairs = df.select(*[_at(n).alias(f"current_{n}") for n in df.columns], *[_at(n).alias(f"new_{n}") for n in df.columns])

    def step(current: Column, item: Column) -> Column:
        names_ = {f"{side}_{n}": Val(v[n], *kind_of(df.schema[n].dataType)) for side, v in (("current", current), ("new", item["r"])) for n in df.columns}
        from ..functions.values import truthy

        return F.when(truthy(Compiler(pairs.select(), names=names_).compile(parse(choose))), item["r"]).otherwise(current)

    rows = F.col("_rows")
    return groups.select(F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), F.get(rows, 0)["r"], step).alias("_row")).select("_row.*")


def _filled(df: DataFrame, n: str) -> Column:
    return F.nullif(_at(n), F.lit("")) if df.schema[n].dataType.simpleString() == "string" else _at(n)


def fill(df: DataFrame, spec: str | None = None, value=None, order_by=None, group: list[str] | None = None) -> DataFrame:
    """Empty cells filled with a constant, or with the last filled cell before.

    Without groups, rows are filled within ranges of the order, then from the last filled cell of the ranges before: those
    are a small table of one row a range.
    """
    chosen = select_names(df, spec) if spec else df.columns
    if value is not None:
        return df.select(*[F.coalesce(_filled(df, n), F.lit(value)).alias(n) if n in chosen else _at(n) for n in df.columns])
    placed = df if group else ranged(df, order_by)
    before = window(group or ["_range"], order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select(*[F.last(_filled(df, n), ignorenulls=True).over(before).alias(n) if n in chosen else _at(n) for n in df.columns], *([] if group else ["_range"]))
    if group:
        return rows
    # filled downwards, a range's last filled cell is that of its last row
    order = order_struct(order_by)
    ends = placed.groupBy("_range").agg(*[F.max_by(_at(n), F.when(_filled(df, n).isNotNull(), order)).alias(f"_end{i}") for i, n in enumerate(chosen)])
    carry = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", *[F.last(f"_end{i}", ignorenulls=True).over(carry).alias(f"_from{i}") for i in range(len(chosen))])
    joined = rows.join(F.broadcast(carried), "_range", "left")
    return joined.select(*[F.coalesce(_at(n), F.col(f"_from{chosen.index(n)}")).alias(n) if n in chosen else _at(n) for n in df.columns])


def blank(df: DataFrame, order_by, spec: str | None = None, text: str = "", group: list[str] | None = None) -> DataFrame:
    """Cells equal to the one in the row before, replaced by a text."""
    names = set(select_names(df, spec) if spec else df.columns)
    w = window(group, order_by)
    first = F.row_number().over(w) == 1
    same = lambda n: ~first & _at(n).eqNullSafe(F.lag(_at(n)).over(w))
    return df.select(*[F.when(same(n), F.lit(text)).otherwise(_at(n).cast("string")).alias(n) if n in names else _at(n) for n in df.columns])


def evaluate(spark, source: str):
    """The value of an expression without columns."""
    return spark.range(1).select(expression(spark.range(1), source).col.alias("value")).first()[0]


def headers(*tables: DataFrame) -> list[tuple[str, list[int]]]:
    """Each header's name with the numbers of the tables that have it, in the order in which they first occur."""
    names = dict.fromkeys(n for t in tables for n in t.columns)
    return [(n, [i for i, t in enumerate(tables) if n in t.columns]) for n in names]


def is_sorted(df: DataFrame, spec: str, order_by, numeric: bool = False) -> bool:
    """Whether rows, in their order, ascend by the selected columns: only neighbours and ends of ranges are compared."""
    names = select_names(df, spec)
    keys = [number(Val(_at(n), *kind_of(df.schema[n].dataType)), lenient=True).col if numeric else _at(n) for n in names]
    rows, key = ranged(df, order_by), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    within = key < F.lag(key).over(window(["_range"], order_by))
    bad = rows.select("_range", order_struct(order_by).alias("o"), key.alias("k"), within.alias("bad"))
    ends = bad.groupBy("_range").agg(F.bool_or("bad").alias("bad"), F.min_by("k", "o").alias("first"), F.max_by("k", "o").alias("last"))
    across = ends.select("bad", (F.col("first") < F.lag("last").over(Window.orderBy("_range"))).alias("step"))
    return across.filter("coalesce(bad, false) or coalesce(step, false)").isEmpty()


def is_unique(df: DataFrame, spec: str) -> bool:
    """Whether no two rows share the selected columns' cells."""
    return df.groupBy(*[_at(n) for n in select_names(df, spec)]).count().filter("count > 1").isEmpty()
