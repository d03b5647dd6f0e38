"""Trees of the expression language, compiled to Columns against a schema."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars
from .syntax import Clause, parse, parse_clauses, replace_under, uses_under
from .values import TypeProblem, Val, kind_of, literal, text, truthy, unified

_number = iter(range(10**12))


class Compiler:
    """Compiles against the columns of df. row_index: a Column of 0-based places, if rows have an order.

    under: what `_` stands for; lenient: unreadable values are none instead of errors (inside `try`).
    """

    def __init__(self, df: DataFrame, row_index: Column | None = None, under: str | None = None, lenient: bool = False, names: dict[str, Val] | None = None):
        self.df, self.row_index, self.under, self.lenient, self.names = df, row_index, under, lenient, names or {}
        self.fields = {f.name: f.dataType for f in df.schema.fields}

    def column(self, name: str) -> Val:
        return Val(F.col(f"`{name}`"), *kind_of(self.fields[name]))

    def with_names(self, **names: Val) -> Compiler:
        return Compiler(self.df, self.row_index, self.under, self.lenient, self.names | names)

    def compile(self, tree: tuple) -> Val:
        return getattr(self, f"_{tree[0]}")(*tree[1:])

    def _lit(self, value) -> Val:
        return literal(value)

    _bytes = _lit

    def _regex(self, pattern: str, flags: str) -> Val:
        prefix = f"(?{flags})" if flags else ""
        return Val(F.lit(prefix + pattern), "regex", None, prefix + pattern, True)

    def _under(self) -> Val:
        if "_" in self.names:
            return self.names["_"]
        if self.under is None:
            raise TypeProblem("_ stands for nothing here")
        return self.column(self.under)

    def _name(self, name: str, optional: bool) -> Val:
        if name in self.names:
            return self.names[name]
        if name in self.fields:
            return self.column(name)
        if optional:
            return literal(None)
        raise TypeProblem(f"no column {name!r}; there are {', '.join(self.df.columns)}")

    def _list(self, items: list[tuple]) -> Val:
        vals = [self.compile(x) for x in items]
        if not vals:
            return Val(F.array().cast("array<string>"), "list", Val(None, "str"))
        kind = vals[0]
        for v in vals[1:]:
            kind = unified(kind, v)[0]
        vals = [unified(v, kind)[0] for v in vals]
        return Val(F.array(*[v.col for v in vals]), "list", Val(None, kind.kind, kind.inner), [v.const for v in vals], all(v.is_const for v in vals))

    def _map(self, pairs: list[tuple]) -> Val:
        vals = {k: self.compile(x) for k, x in pairs}
        kind = None
        for v in vals.values():
            kind = v if kind is None else unified(kind, v)[0]
        if kind is None:
            return Val(F.create_map().cast("map<string,string>"), "map", Val(None, "str"))
        return Val(F.create_map(*[x for k, v in vals.items() for x in (F.lit(k), unified(v, kind)[0].col)]), "map", Val(None, kind.kind, kind.inner))

    def _pipe(self, left: tuple, right: tuple) -> Val:
        if right[0] == "name" and right[1] not in self.fields and right[1] in scalars.FUNCTIONS:
            return self.compile(("call", right[1], [left], {}))
        return self.compile(replace_under(right, left) if uses_under(right) else right)

    def _lambda(self, parameters: list[str], body: tuple) -> Val:
        return Val(None, "lambda", None, (parameters, body))

    def apply(self, function: Val, *arguments: Val) -> Val:
        """A lambda's body with values for its parameters."""
        if function.kind != "lambda":
            raise TypeProblem("a function `x => ..` is expected")
        parameters, body = function.const
        return self.with_names(**dict(zip(parameters, arguments, strict=True))).compile(body)

    def higher(self, items: Val, function: Val, build: Callable[[Column, Callable[[Column], Column]], Column], test: bool = False) -> tuple[Column, Val]:
        """build(items, column function), and the type of the function's results."""
        seen: list[Val] = []

        def run(x: Column) -> Column:
            seen.append(self.apply(function, Val(x, items.inner.kind, items.inner.inner)))
            return truthy(seen[-1]) if test else seen[-1].col

        return build(items.col, run), seen[0]

    def _call(self, name: str, arguments: list[tuple], named: dict[str, tuple]) -> Val:
        name = name.lower()
        if name in ("try", "warn"):
            lenient = Compiler(self.df, self.row_index, self.under, True, self.names)
            try:
                return lenient.compile(arguments[0])
            except TypeProblem:
                return literal(None)
        if name in ("col", "col?", "header", "header?", "col_index", "col_index?"):
            return self._located(name, arguments)
        if name in ("cols", "headers"):
            bounds = [self.place(self.compile(a).const) for a in arguments]
            names = self.df.columns[bounds[0] if bounds else 0 : bounds[1] + 1 if len(bounds) > 1 else None]
            return self._list([("lit", n) if name == "headers" else ("name", n, False) for n in names])
        if name in ("prev_col", "next_col"):
            offset = self.compile(arguments[0]).const if arguments else 1
            at = self.df.columns.index(self.under) + (offset if name == "next_col" else -offset)
            return self.column(self.df.columns[at]) if 0 <= at < len(self.df.columns) else literal(None)
        if name == "row_index":
            if self.row_index is None:
                raise TypeProblem("row_index() needs rows in an order: give order_by")
            return Val(self.row_index, "int")
        if name in ("if", "unless"):
            test = truthy(self.compile(arguments[0]))
            then, other = self.compile(arguments[1]), self.compile(arguments[2]) if len(arguments) > 2 else literal(None)
            then, other = unified(then, other)
            return Val(F.when(test if name == "if" else ~test, then.col).otherwise(other.col), then.kind, then.inner)
        if name in ("and", "or"):
            out = self.compile(arguments[-1])
            for a in reversed(arguments[:-1]):
                left, right = unified(self.compile(a), out)
                test = truthy(left)
                out = Val(F.when(test if name == "or" else ~test, left.col).otherwise(right.col), left.kind, left.inner)
            return out
        if name not in scalars.FUNCTIONS:
            raise TypeProblem(f"no function {name!r}")
        vals = [self.compile(a) for a in arguments]
        return scalars.FUNCTIONS[name](self, *vals, **{k: self.compile(v) for k, v in named.items()})

    def place(self, which: int | str, nth: int = 0) -> int | None:
        columns = self.df.columns
        if isinstance(which, int):
            at = which + len(columns) if which < 0 else which
            return at if 0 <= at < len(columns) else None
        places = [i for i, c in enumerate(columns) if c == which]
        return places[nth] if nth < len(places) else None

    def _located(self, name: str, arguments: list[tuple]) -> Val:
        given = [self.compile(a).const for a in arguments]
        at = self.place(*given)
        if at is None:
            if name.endswith("?"):
                return literal(None)
            raise TypeProblem(f"no column {given[0]!r}")
        found = self.df.columns[at]
        return {"col": lambda: self.column(found), "header": lambda: literal(found), "col_index": lambda: literal(at)}[name.rstrip("?")]()


def expression(df: DataFrame, source: str, **options) -> Val:
    return Compiler(df, **options).compile(parse(source))


def predicate(df: DataFrame, source: str, **options) -> Column:
    return truthy(expression(df, source, **options))


def selection(df: DataFrame, source: str, **options) -> list[Column]:
    """Columns of `expression as name, expression as (a, b), ..`."""
    out = []
    compiler = Compiler(df, **options)
    for clause in parse_clauses(source):
        out += named(compiler.compile(clause.tree), clause)
    return out


def named(v: Val, clause: Clause) -> list[Column]:
    if len(clause.names) == 1:
        return [v.col.alias(clause.names[0])]
    if v.kind != "list":
        raise TypeProblem(f"{clause.source} gives one value for {len(clause.names)} names")
    return [F.get(v.col, i).alias(n) for i, n in enumerate(clause.names)]


def resolve(columns: list[str], spec: str) -> list[int]:
    """Places of a selection: names, indices from 0 or from the end, ranges a:b, globs, name[n], ! for all others."""
    spec = spec.strip()
    if spec.startswith("!"):
        out = set(resolve(columns, spec[1:]))
        return [i for i in range(len(columns)) if i not in out]
    out: list[int] = []
    for part in _parts(spec):
        out += _part(columns, part)
    return out


def _parts(spec: str) -> list[str]:
    parts, held, quote = [], "", ""
    for ch in spec:
        if quote:
            quote = "" if ch == quote else quote
            held += ch
        elif ch in "\"'":
            quote, held = ch, held + ch
        elif ch == ",":
            parts.append(held)
            held = ""
        else:
            held += ch
    return [p.strip() for p in [*parts, held] if p.strip()]


def _one(columns: list[str], part: str) -> int:
    if part[:1] in "\"'" and part[-1:] == part[:1]:
        return columns.index(part[1:-1])
    if part in columns:
        return columns.index(part)
    if part.endswith("]") and "[" in part:
        name, _, n = part[:-1].rpartition("[")
        return [i for i, c in enumerate(columns) if c == name.strip("\"'")][int(n)]
    try:
        at = int(part)
    except ValueError:
        raise TypeProblem(f"no column {part!r}; there are {', '.join(columns)}") from None
    at += len(columns) if at < 0 else 0
    if not 0 <= at < len(columns):
        raise TypeProblem(f"no column at {part}")
    return at


def _part(columns: list[str], part: str) -> list[int]:
    if part in columns:
        return [columns.index(part)]
    if ":" in part and part[:1] not in "\"'":
        left, _, right = part.partition(":")
        a, b = _one(columns, left) if left else 0, _one(columns, right) if right else len(columns) - 1
        return list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
    if "*" in part:
        return [i for i, c in enumerate(columns) if fnmatch.fnmatchcase(c, part.replace("[", "[[]"))]
    return [_one(columns, part)]


def select_names(df: DataFrame, spec: str | list[str]) -> list[str]:
    if isinstance(spec, list):
        return spec
    return [df.columns[i] for i in resolve(df.columns, spec)]


def as_text(v: Val) -> Column:
    return text(v)
