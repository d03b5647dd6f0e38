"""Aggregate functions of the expression language: clauses such as `sum(a) as s, mean(b) / count() as r`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiler import Compiler, named
from .syntax import parse_clauses
from .values import TypeProblem, Val, double, number, present, temporal, text, truthy

AGGREGATES: dict[str, Callable[..., Val]] = {}
BARS = "▁▂▃▄▅▆▇█"


def aggregate(*names: str):
    def add(f):
        for n in names:
            AGGREGATES[n] = f
        return f

    return add


class Aggregation(Compiler):
    """Compiles clauses: an aggregate's arguments are row expressions, what stands around it an expression of aggregates.

    order: a Column by which rows are in order (a struct of the order's columns), which first, last, values, argmin and
    argmax need; row_index: their 0-based place.
    """

    def __init__(self, df: DataFrame, order: Column | None = None, row_index: Column | None = None, **options):
        super().__init__(df, row_index=row_index, **options)
        self.order = order

    def rows(self) -> Compiler:
        return Compiler(self.df, self.row_index, self.under, self.lenient, self.names)

    def ordered(self) -> Column:
        if self.order is None:
            raise TypeProblem("this aggregate depends on the order of rows: give order_by")
        return self.order

    def _name(self, name: str, optional: bool) -> Val:
        raise TypeProblem(f"{name!r} stands outside of an aggregate")

    def _call(self, name: str, arguments: list[tuple], named: dict[str, tuple]) -> Val:
        if name in AGGREGATES:
            rows = self.rows()
            return AGGREGATES[name](self, *[rows.compile(a) for a in arguments])
        return super()._call(name, arguments, named)


def pairs(df: DataFrame, source: str, **options) -> list[tuple[str, Column]]:
    """(name, aggregate) of clauses."""
    compiler = Aggregation(df, **options)
    return [x for clause in parse_clauses(source) for x in zip(clause.names, named(compiler.compile(clause.tree), clause), strict=True)]


def clauses(df: DataFrame, source: str, **options) -> list[Column]:
    return [c for _, c in pairs(df, source, **options)]


def _const(v: Val | None, default):
    return default if v is None else v.const


def _joined(items: Column, sep: Val | None) -> Column:
    return F.array_join(items, _const(sep, "|"))


def _simple(names: str, kind: str | None, build: Callable[[Column], Column]) -> None:
    for n in names.split():
        def run(c, x: Val, build=build) -> Val:
            v = number(x, c.lenient)
            return Val(build(v.col), kind or v.kind)

        AGGREGATES[n] = run


_simple("min", None, F.min)
_simple("max", None, F.max)
_simple("mean avg", "float", F.avg)
_simple("var var_pop", "float", F.var_pop)
_simple("stddev stddev_pop", "float", F.stddev_pop)
_simple("var_sample", "float", lambda x: F.when(F.count(x) > 1, F.var_samp(x)))
_simple("stddev_sample", "float", lambda x: F.when(F.count(x) > 1, F.stddev_samp(x)))
_simple("rms", "float", lambda x: F.sqrt(F.avg(x.cast("double") * x)))
_simple("median", "float", F.median)
_simple("q1", "float", lambda x: F.when(F.count(x) > 1, F.percentile(x, 0.25)))
_simple("q2", "float", lambda x: F.when(F.count(x) > 1, F.percentile(x, 0.5)))
_simple("q3", "float", lambda x: F.when(F.count(x) > 1, F.percentile(x, 0.75)))
_simple("median_low", None, lambda x: _at_rank(x, F.ceil(F.count(x) / 2)))
_simple("median_high", None, lambda x: _at_rank(x, F.floor(F.count(x) / 2) + 1))


def _at_rank(x: Column, rank: Column) -> Column:
    """The value at a 1-based rank. Exact, so all values of a group meet, as for Spark's own percentile."""
    return F.get(F.sort_array(F.collect_list(x)), rank.cast("int") - 1)


@aggregate("quantile")
def _quantile(c, x: Val, p: Val) -> Val:
    v, q = number(x, c.lenient), float(_const(p, 0.5))
    items, n = F.sort_array(F.collect_list(v.col.cast("double"))), F.count(v.col)
    if q <= 0 or q >= 1:
        return Val((F.min if q <= 0 else F.max)(v.col.cast("double")), "float")
    at = n * F.lit(q)
    whole = at == F.floor(at)
    low, high = F.get(items, at.cast("int") - 1), F.get(items, at.cast("int"))
    mean = F.when(n % 2 == 0, (low + high) / 2).otherwise(high)
    return Val(F.when(n > 0, F.when(whole, mean).otherwise(F.get(items, F.ceil(at).cast("int") - 1))), "float")


@aggregate("approx_quantile")
def _approx_quantile(c, x: Val, p: Val) -> Val:
    return Val(F.percentile_approx(double(x, c.lenient), float(p.const), 10000), "float")


AGGREGATES["approx_cardinality"] = lambda c, x: Val(F.approx_count_distinct(present(x), 0.01), "int")
AGGREGATES["cardinality"] = lambda c, x: Val(F.count_distinct(present(x)).alias("count(distinct)"), "int")  # a name by which it is told from count
AGGREGATES["count"] = lambda c, x=None: Val(F.count(F.lit(1)) if x is None else F.count_if(truthy(x)), "int")
AGGREGATES["all"] = lambda c, x: Val(F.bool_and(truthy(x)), "bool")
AGGREGATES["any"] = lambda c, x: Val(F.bool_or(truthy(x)), "bool")


@aggregate("sum")
def _sum(c, x: Val) -> Val:
    v = number(x, c.lenient)
    zero = F.lit(0).cast("long") if v.kind == "int" else F.lit(0.0)
    return Val(F.when(F.count(v.col) == 0, zero).otherwise(F.try_sum(v.col) if v.kind == "int" else F.sum(v.col)), v.kind)


@aggregate("ratio")
def _ratio(c, x: Val, decimals: Val | None = None) -> Val:
    r = F.avg(truthy(x).cast("double"))
    return Val(F.round(r, decimals.const) if decimals else r, "float")


@aggregate("percentage")
def _percentage(c, x: Val, decimals: Val | None = None) -> Val:
    r = F.avg(truthy(x).cast("double")) * 100
    shown = F.format_string(f"%.{decimals.const}f", r) if decimals else r.cast("long").cast("string")
    return Val(F.concat(shown, F.lit("%")), "str")


def _two(names: str, build) -> None:
    for n in names.split():
        AGGREGATES[n] = lambda c, x, y: Val(build(double(x, c.lenient), double(y, c.lenient)), "float")


_two("correlation", F.corr)
_two("covariance covariance_pop", F.covar_pop)
_two("covariance_sample", lambda x, y: F.when(F.count(x + y) > 1, F.covar_samp(x, y)))


def _edge(name: str, first: bool) -> None:
    def run(c, x: Val) -> Val:
        v, order = present(x), F.when(present(x).isNotNull(), c.ordered())
        return Val((F.min_by if first else F.max_by)(v, order), x.kind, x.inner)

    AGGREGATES[name] = run


_edge("first", True)
_edge("last", False)


def _arg(name: str, least: bool) -> None:
    def run(c, x: Val, ret: Val | None = None) -> Val:
        v = number(x, c.lenient)
        out = ret or Val(c.row_index if c.row_index is not None else c.ordered(), "int")
        key = F.when(v.col.isNotNull(), F.struct(v.col if least else -v.col, c.ordered()))
        return Val(F.min_by(out.col, key), out.kind, out.inner)

    AGGREGATES[name] = run


_arg("argmin", True)
_arg("argmax", False)


@aggregate("argtop")
def _argtop(c, k: Val, x: Val, ret: Val | None = None, sep: Val | None = None) -> Val:
    v = number(x, c.lenient)
    out = text(ret) if ret else c.row_index.cast("string")
    items = F.array_sort(F.collect_list(F.when(v.col.isNotNull(), F.struct((-v.col).alias("v"), c.ordered().alias("o"), out.alias("r")))))
    return Val(_joined(F.transform(F.slice(items, 1, k.const), lambda s: s["r"]), sep), "str")


@aggregate("top")
def _top(c, k: Val, x: Val, sep: Val | None = None) -> Val:
    v = number(x, c.lenient)
    return Val(_joined(F.slice(F.sort_array(F.collect_list(v.col), False), 1, k.const).cast("array<string>"), sep), "str")


AGGREGATES["lex_first"] = lambda c, x: Val(F.min(F.nullif(text(x), F.lit(""))), "str")
AGGREGATES["lex_last"] = lambda c, x: Val(F.max(F.nullif(text(x), F.lit(""))), "str")
AGGREGATES["earliest"] = lambda c, x: (lambda t: Val(F.min(t.col), t.kind))(temporal(x))
AGGREGATES["latest"] = lambda c, x: (lambda t: Val(F.max(t.col), t.kind))(temporal(x))


def _elapsed(name: str, unit: float) -> None:
    def run(c, x: Val) -> Val:
        t = temporal(x).col
        micros = F.unix_micros(F.max(t).cast("timestamp")) - F.unix_micros(F.min(t).cast("timestamp"))
        return Val(micros / unit, "float")

    AGGREGATES[name] = run


_elapsed("count_seconds", 1e6)
_elapsed("count_hours", 3.6e9)
_elapsed("count_days", 8.64e10)


@aggregate("count_years")
def _count_years(c, x: Val) -> Val:
    """Whole years from the earliest, then the share of the year begun."""
    t = temporal(x).col.cast("timestamp_ntz")
    first, last = F.min(t), F.max(t)
    whole = F.floor(F.months_between(last, first) / 12).cast("int")
    begin, end = first + F.make_ym_interval(whole), first + F.make_ym_interval(whole + 1)
    micros = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))).cast("double")
    return Val(whole + micros(begin, last) / micros(begin, end), "float")


def _counts(x: Val) -> Column:
    """[(count, value)] of the group's distinct values, most frequent first, ties by value."""
    items = F.array_sort(F.collect_list(F.nullif(text(x), F.lit(""))))

    def runs(sorted_items: Column) -> Column:
        # where equal items begin, each up to where the next begins
        begins = F.filter(F.sequence(F.lit(0), F.size(sorted_items)), lambda i: (i < F.size(sorted_items)) & ((i == 0) | (F.get(sorted_items, i) != F.get(sorted_items, i - 1))))
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct((i - F.coalesce(F.get(b, k + 1), F.size(sorted_items))).alias("n"), F.get(sorted_items, i).alias("v"))))[0]

    return F.array_sort(F.transform(F.array(items), runs)[0])


# ties go to the smallest value; a map of counts, merged from tasks
AGGREGATES["mode"] = lambda c, x: Val(F.call_function("mode", F.nullif(text(x), F.lit("")), F.lit(True)), "str")
AGGREGATES["modes"] = lambda c, x, sep=None: (lambda n: Val(_joined(F.transform(F.filter(n, lambda s: s["n"] == F.get(n, 0)["n"]), lambda s: s["v"]), sep), "str"))(_counts(x))
AGGREGATES["most_common"] = lambda c, k, x, sep=None: Val(_joined(F.transform(F.slice(_counts(x), 1, k.const), lambda s: s["v"]), sep), "str")
AGGREGATES["most_common_counts"] = lambda c, k, x, sep=None: Val(_joined(F.transform(F.slice(_counts(x), 1, k.const), lambda s: (-s["n"]).cast("string")), sep), "str")
AGGREGATES["distinct_values"] = lambda c, x, sep=None: Val(_joined(F.array_sort(F.collect_set(F.nullif(text(x), F.lit("")))), sep), "str")


@aggregate("values")
def _values(c, x: Val, sep: Val | None = None) -> Val:
    t = F.nullif(text(x), F.lit(""))
    items = F.array_sort(F.collect_list(F.when(t.isNotNull(), F.struct(c.ordered().alias("o"), t.alias("v")))))
    return Val(_joined(F.transform(items, lambda s: s["v"]), sep), "str")


def cell_type(x: Val) -> Column:
    """The class of a cell: int, float, url, date, datetime, zoned_datetime, time, string; null if empty."""
    fixed = {"int": "int", "float": "float", "date": "date", "datetime": "datetime", "zoned": "zoned_datetime", "time": "time"}
    if x.kind in fixed:
        return F.when(x.col.isNotNull(), F.lit(fixed[x.kind]))
    t = F.nullif(text(x), F.lit(""))
    day, clock = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    kinds = ((r"[-+]?\d+", "int"), (r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", "float"), (r"https?://\S+", "url"), (rf"{day}[T ]{clock}(Z|[-+]\d{{2}}:?\d{{2}}|\[.+\])+", "zoned_datetime"), (rf"{day}[T ]{clock}", "datetime"), (day, "date"), (clock, "time"))
    out = F.when(t.isNull(), F.lit(None))
    for shape, kind in kinds:
        out = out.when(t.rlike(f"^(?:{shape})$"), F.lit(kind))
    return out.otherwise(F.lit("string"))


TYPE_ORDER = ("string", "float", "int", "url", "zoned_datetime", "datetime", "date", "time")


@aggregate("types")
def _types(c, x: Val) -> Val:
    seen, nothing = F.collect_set(cell_type(x)), F.count_if(cell_type(x).isNull()) > 0
    order = F.filter(F.array(*[F.lit(t) for t in TYPE_ORDER]), lambda t: F.array_contains(seen, t))
    return Val(F.array_join(F.concat(order, F.when(nothing, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>"))), "|"), "str")


@aggregate("type")
def _type(c, x: Val) -> Val:
    seen = F.collect_set(cell_type(x))
    number_mix = F.forall(seen, lambda t: t.isin("int", "float"))
    return Val(F.when(F.size(seen) == 0, "empty").when(F.size(seen) == 1, F.get(seen, 0)).when(number_mix, "float").otherwise("mixed"), "str")


def _bars(name: str, log: bool) -> None:
    def run(c, x: Val, bins: Val | None = None) -> Val:
        n = _const(bins, 10)
        v = double(x, c.lenient)
        v = F.log1p(v) if log else v
        items, low, high = F.collect_list(v), F.min(v), F.max(v)
        place = lambda y: F.least(F.floor((y - low) / F.nullif(high - low, F.lit(0.0)) * n), F.lit(n - 1))
        counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.size(F.filter(items, lambda y: F.coalesce(place(y), F.lit(0)) == b)))
        shown = F.transform(counts, lambda k: F.call_function("substring", F.lit(BARS), (F.ceil(k * len(BARS) / F.greatest(F.array_max(counts), F.lit(1)))).cast("int"), F.lit(1)))
        return Val(F.array_join(F.transform(shown, lambda s: F.when(s == "", F.lit(BARS[0])).otherwise(s)), ""), "str")

    AGGREGATES[name] = run


_bars("dist", False)
_bars("log_dist", True)

