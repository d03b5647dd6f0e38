"""Columns with the language's static types, and its coercions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("int", "float")
TEMPORAL = ("date", "datetime", "zoned", "time")


class TypeProblem(ValueError):
    """An expression whose types don't fit."""


@dataclass
class Val:
    """kind: int float bool str bytes list map date datetime zoned time span null any regex lambda; inner: the Val kind of items."""

    col: Column | None
    kind: str
    inner: Val | None = None
    const: Any = None
    is_const: bool = False


def kind_of(t: T.DataType) -> tuple[str, Val | None]:
    if isinstance(t, T.ArrayType):
        return "list", Val(None, *kind_of(t.elementType))
    if isinstance(t, T.MapType):
        return "map", Val(None, *kind_of(t.valueType))
    simple = {
        "StringType": "str", "BooleanType": "bool", "ByteType": "int", "ShortType": "int", "IntegerType": "int", "LongType": "int", "FloatType": "float",
        "DoubleType": "float", "DecimalType": "float", "DateType": "date", "TimestampNTZType": "datetime", "TimestampType": "zoned", "TimeType": "time",
        "BinaryType": "bytes", "NullType": "null",
    }
    return simple.get(type(t).__name__, "any"), None


def literal(value: Any) -> Val:
    kind = {bool: "bool", int: "int", float: "float", str: "str", bytes: "bytes", type(None): "null"}[type(value)]
    column = F.lit(value).cast("long") if kind == "int" else F.lit(value).cast("string") if kind == "null" else F.lit(value)
    return Val(column, kind, None, value, True)


def number(v: Val, lenient: bool = False) -> Val:
    """As a number: text is a float, empty text none, text that is no number an error (or none, if lenient)."""
    if v.kind in NUMBERS:
        return v
    if v.kind == "bool":
        return Val(v.col.cast("long"), "int")
    if v.kind == "null":
        return Val(F.lit(None).cast("double"), "float")
    if v.kind == "str":
        text = F.nullif(v.col, F.lit(""))
        return Val(text.try_cast("double") if lenient else text.cast("double"), "float")
    if v.kind == "any":
        return Val(F.try_variant_get(v.col, "$", "double"), "float")
    raise TypeProblem(f"a {v.kind} is no number")


def double(v: Val, lenient: bool = False) -> Column:
    return number(v, lenient).col.cast("double")


def integer(v: Val) -> Column:
    n = number(v)
    return n.col if n.kind == "int" else n.col.cast("long")


def text(v: Val) -> Column:
    if v.kind == "str":
        return v.col
    if v.kind == "any":
        return F.coalesce(F.try_variant_get(v.col, "$", "string"), F.to_json(v.col))
    if v.kind in ("list", "map"):
        return F.to_json(v.col)
    if v.kind == "time":
        return F.date_format(v.col, "HH:mm:ss")
    return v.col.cast("string")


def truthy(v: Val) -> Column:
    """False: none, empty text, 0, false, empty lists and maps."""
    c = v.col
    tests = {"int": lambda: c != 0, "float": lambda: c != 0.0, "bool": lambda: c, "str": lambda: c != "", "bytes": lambda: F.octet_length(c) > 0, "list": lambda: F.size(c) > 0, "map": lambda: F.size(c) > 0, "null": lambda: F.lit(False)}
    return F.coalesce(tests.get(v.kind, lambda: c.isNotNull())(), F.lit(False))


def present(v: Val) -> Column:
    """The value, or null if it is empty text."""
    return F.nullif(v.col, F.lit("")) if v.kind == "str" else v.col


def temporal(v: Val) -> Val:
    if v.kind in TEMPORAL:
        return v
    if v.kind in ("str", "null"):
        return Val(F.nullif(v.col, F.lit("")).cast("timestamp_ntz"), "datetime")
    raise TypeProblem(f"a {v.kind} is no date or time")


def unified(a: Val, b: Val) -> tuple[Val, Val]:
    """Both in the type that holds either."""
    if a.kind == b.kind:
        return a, b
    if a.kind == "null":
        return Val(F.lit(None), b.kind, b.inner), b
    if b.kind == "null":
        return a, Val(F.lit(None), a.kind, a.inner)
    if {a.kind, b.kind} <= {"int", "float"}:
        return Val(a.col.cast("double"), "float"), Val(b.col.cast("double"), "float")
    if {a.kind, b.kind} <= {"date", "datetime"}:
        return Val(a.col.cast("timestamp_ntz"), "datetime"), Val(b.col.cast("timestamp_ntz"), "datetime")
    return Val(text(a), "str"), Val(text(b), "str")
