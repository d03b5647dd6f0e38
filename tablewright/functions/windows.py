"""Window functions of the expression language, with the frames that they imply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import AGGREGATES, Aggregation
from .compiler import named
from .syntax import parse_clauses
from .values import Val, number, unified

WINDOWS: dict[str, Callable[..., Val]] = {}


class Windowed(Aggregation):
    """Compiles window clauses over rows of `group` in the order `order`."""

    def __init__(self, df: DataFrame, group: list[str], order: Column, **options):
        super().__init__(df, order=order, **options)
        self.all = Window.partitionBy(*[F.col(f"`{g}`") for g in group])
        self.rows_in_order = self.all.orderBy(order)
        self.upto = self.rows_in_order.rowsBetween(Window.unboundedPreceding, 0)

    def _name(self, name: str, optional: bool) -> Val:
        return self.rows()._name(name, optional)

    def _call(self, name: str, arguments: list[tuple], named: dict[str, tuple]) -> Val:
        rows = self.rows()
        if name in WINDOWS:
            return WINDOWS[name](self, *[rows.compile(a) for a in arguments])
        if name in AGGREGATES:
            v = AGGREGATES[name](self, *[rows.compile(a) for a in arguments])
            return Val(_over(v.col, self.all), v.kind, v.inner)
        return super()._call(name, arguments, named)

    def by(self, x: Column) -> Window:
        return self.all.orderBy(x.asc_nulls_first())

    def by_then_order(self, x: Column) -> Window:
        return self.all.orderBy(x.asc_nulls_first(), self.order)


def _over(column: Column, spec: Window) -> Column:
    return column.over(spec)


def clauses(df: DataFrame, source: str, group: list[str], order: Column, **options) -> list[Column]:
    compiler = Windowed(df, group, order, **options)
    return [c for clause in parse_clauses(source) for c in named(compiler.compile(clause.tree), clause)]


WINDOWS["row_number"] = lambda c: Val(F.row_number().over(c.rows_in_order).cast("long"), "int")
WINDOWS["row_index"] = lambda c: Val((F.row_number().over(c.rows_in_order) - 1).cast("long"), "int")


def _shift(name: str, build) -> None:
    def run(c, x: Val, steps: Val | None = None, default: Val | None = None) -> Val:
        n = steps.const if steps else 1
        out = build(x.col, n).over(c.rows_in_order)
        if default is None:
            return Val(out, x.kind, x.inner)
        a, d = unified(Val(out, x.kind, x.inner), default)
        beyond = build(F.lit(1), n).over(c.rows_in_order).isNull()
        return Val(F.when(beyond, d.col).otherwise(a.col), a.kind, a.inner)

    WINDOWS[name] = run


_shift("lag", F.lag)
_shift("lead", F.lead)


def _running(name: str, build) -> None:
    def run(c, x: Val) -> Val:
        v = number(x, c.lenient)
        return Val(build(v.col).over(c.upto), v.kind)

    WINDOWS[name] = run


_running("cumsum", F.sum)
_running("cummin", F.min)
_running("cummax", F.max)


def _rolling(names: str, build, kind: str | None) -> None:
    def run(c, n: Val, x: Val) -> Val:
        v, k = number(x, c.lenient), n.const
        full = F.row_number().over(c.rows_in_order) >= k
        return Val(F.when(full, build(v.col).over(c.rows_in_order.rowsBetween(1 - k, 0))), kind or v.kind)

    for name in names.split():
        WINDOWS[name] = run


_rolling("rolling_sum", F.sum, None)
_rolling("rolling_mean rolling_avg", F.avg, "float")
_rolling("rolling_var", F.var_pop, "float")
_rolling("rolling_stddev", F.stddev_pop, "float")


@(lambda f: WINDOWS.__setitem__("front_coding", f))
def _front_coding(c, x: Val) -> Val:
    """Length of the prefix shared with the row before, a space, and the rest."""
    s = F.coalesce(x.col, F.lit(""))
    before = F.coalesce(F.lag(s).over(c.rows_in_order), F.lit(""))
    ends = F.sequence(F.lit(0), F.least(F.length(s), F.length(before)))
    shared = F.array_max(F.filter(ends, lambda n: F.call_function("left", s, n) == F.call_function("left", before, n)))
    return Val(F.concat(shared.cast("string"), F.lit(" "), F.call_function("substring", s, shared + 1)), "str")


@(lambda f: WINDOWS.__setitem__("frac", f))
def _frac(c, x: Val, decimals: Val | None = None) -> Val:
    v = number(x, c.lenient).col
    out = v / F.nullif(F.sum(v).over(c.all), F.lit(0))
    return Val(F.round(out, decimals.const) if decimals else out, "float")


def _ranks(name: str, build, kind: str, ties: bool) -> None:
    def run(c, x: Val) -> Val:
        v = number(x, c.lenient).col
        return Val(build().over(c.by(v) if ties else c.by_then_order(v)).cast("long" if kind == "int" else "double"), kind)

    WINDOWS[name] = run


_ranks("dense_rank", F.dense_rank, "int", True)
_ranks("rank", F.row_number, "int", False)
_ranks("cume_dist", F.cume_dist, "float", True)
_ranks("percent_rank", F.percent_rank, "float", True)
WINDOWS["ntile"] = lambda c, k, x: Val(F.ntile(k.const).over(c.by_then_order(number(x, c.lenient).col)).cast("long"), "int")


