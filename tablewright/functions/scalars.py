"""Scalar functions of the expression language, each from typed values to a typed value.

All are built of Spark's own functions but for those of the `udf` module, which run vectorised in Python.
Functions that run programs or change files (cmd, shell, write, copy, move) are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udf
from .values import NUMBERS, TEMPORAL, TypeProblem, Val, double, integer, literal, number, present, temporal, text, truthy, unified

FUNCTIONS: dict[str, Callable[..., Val]] = {}


def function(*names: str):
    def add(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def _simple(name: str, kind: str, build: Callable[..., Column]) -> None:
    """A function of text arguments."""
    FUNCTIONS[name] = lambda c, *a: Val(build(*[text(x) for x in a]), kind)


def _constant(v: Val, what: str):
    if not v.is_const:
        raise TypeProblem(f"{what} must be constant")
    return v.const


# comparison

_COMPARE = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def _typed_comparison(op: str):
    def run(c, x: Val, y: Val) -> Val:
        if x.kind in TEMPORAL or y.kind in TEMPORAL:
            x, y = unified(temporal(x), temporal(y))
            return Val(_compared(op, x.col, y.col), "bool")
        a, b = number(x, c.lenient).col, number(y, c.lenient).col
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        test = _compared(op, a, b)
        return Val(test if x.kind == y.kind == "int" else test & ~nan if op != "ne" else test, "bool")

    return run


for _op, _word in _COMPARE.items():
    FUNCTIONS[_op] = _typed_comparison(_word)
    FUNCTIONS[_word] = lambda c, x, y, w=_word: Val(_compared(w, text(x), text(y)), "bool")


# arithmetic

def _span(v: Val) -> Column | None:
    return v.col if v.kind == "span" else None


def _shifted(t: Val, span: Val, sign: int) -> Val:
    months, micros = span.const
    at = t.col.cast("timestamp_ntz") if t.kind == "date" else t.col
    moved = at + F.make_ym_interval(F.lit(0), F.lit(sign * months)) + F.make_dt_interval(secs=F.lit(sign * micros / 1e6).cast("decimal(18,6)"))
    if t.kind == "date" and micros % 86_400_000_000 == 0:
        return Val(moved.cast("date"), "date")
    return Val(moved, "datetime" if t.kind == "date" else t.kind)


def _fold(name: str, op: Callable[[Column, Column], Column], sign: int = 0):
    def run(c, *xs: Val) -> Val:
        out = xs[0]
        for y in xs[1:]:
            if sign and y.kind == "span":
                out = _shifted(temporal(out), y, sign)
            elif sign == 1 and out.kind == "span":
                out = _shifted(temporal(y), out, 1)
            else:
                a, b = number(out, c.lenient), number(y, c.lenient)
                kind = "int" if a.kind == b.kind == "int" else "float"
                out = Val(op(a.col, b.col), kind)
        return out

    FUNCTIONS[name] = run


_fold("add", lambda a, b: a + b, 1)
_fold("sub", lambda a, b: a - b, -1)
_fold("mul", lambda a, b: a * b)
NAN, INF = float("nan"), float("inf")


def divided(a: Column, b: Column) -> Column:
    """Division of floats as the IEEE has it: by zero an infinity, or no number."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


@function("div")
def _div(c, *xs: Val) -> Val:
    out = double(xs[0], c.lenient)
    for y in xs[1:]:
        out = divided(out, double(y, c.lenient))
    return Val(out, "float")


@function("idiv")
def _idiv(c, x: Val, y: Val) -> Val:
    a, b = number(x, c.lenient), number(y, c.lenient)
    if a.kind == b.kind == "int":
        return Val(F.call_function("div", a.col, F.nullif(b.col, F.lit(0)) if c.lenient else b.col), "int")
    p, q = a.col.cast("double"), b.col.cast("double")
    return Val(F.when(q > 0, F.floor(divided(p, q))).otherwise(F.ceil(divided(p, q))).cast("long"), "int")


@function("mod")
def _mod(c, x: Val, y: Val) -> Val:
    a, b = number(x, c.lenient), number(y, c.lenient)
    if a.kind == b.kind == "int":
        return Val(F.try_mod(a.col, b.col) if c.lenient else a.col % b.col, "int")
    p, q = a.col.cast("double"), b.col.cast("double")
    return Val(F.when(q == 0, F.lit(NAN)).otherwise(F.try_mod(p, q)), "float")


@function("pow")
def _pow(c, x: Val, y: Val) -> Val:
    a, b = number(x, c.lenient), number(y, c.lenient)
    if a.kind == b.kind == "int" and y.is_const and y.const is not None and y.const >= 0:
        return Val(_whole_power(a.col.cast("long"), int(y.const), c.lenient), "int")
    return Val(F.pow(a.col, b.col), "float")


def _whole_power(x: Column, n: int, lenient: bool) -> Column:
    """x to the n as a product of whole numbers: a double is exact up to 2 ** 53 only. Beyond 64 bits an error, or none if lenient."""
    n = n if n <= 65 else 64 + n % 2  # only 0, 1 and -1 have such powers, and those repeat
    times = F.try_multiply if lenient else lambda a, b: a * b
    one = F.when(x.isNotNull(), F.lit(1).cast("long"))
    if n <= 3:
        return reduce(times, [x] * n) if n else one
    return F.aggregate(F.array_repeat(x, n), one, times)


@function("abs")
def _abs(c, x: Val) -> Val:
    v = number(x, c.lenient)
    return Val(F.abs(v.col), v.kind)


@function("neg")
def _neg(c, x: Val) -> Val:
    v = number(x, c.lenient)
    return Val(-v.col, v.kind)


FUNCTIONS["not"] = lambda c, x: Val(~truthy(x), "bool")
FUNCTIONS["sqrt"] = lambda c, x: Val(F.sqrt(double(x, c.lenient)), "float")
FUNCTIONS["log2"] = lambda c, x: Val(_logarithm(c, "log2", double(x, c.lenient)), "float")
FUNCTIONS["log10"] = lambda c, x: Val(_logarithm(c, "log10", double(x, c.lenient)), "float")
FUNCTIONS["int"] = lambda c, x: Val((F.nullif(x.col, F.lit("")) if x.kind == "str" else x.col).try_cast("long") if c.lenient else (F.nullif(x.col, F.lit("")) if x.kind == "str" else x.col).cast("long"), "int")
FUNCTIONS["float"] = lambda c, x: Val(double(x, c.lenient), "float")
FUNCTIONS["random"] = lambda c: Val(F.rand(), "float")


def _logarithm(c, name: str, x: Column) -> Column:
    """As SQL has it, to the last bit. Inside lambdas, where no Python runs, Spark's own, which is off by some last bits."""
    if c.names:
        return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(getattr(F, name)(x))
    return udf.logarithm(name, x)


@function("log")
def _log(c, x: Val, base: Val | None = None) -> Val:
    n = _logarithm(c, "ln", double(x, c.lenient))
    return Val(n / _logarithm(c, "ln", double(base)) if base else n, "float")


def _rounding(name: str, build: Callable[[Column], Column]) -> None:
    def run(c, x: Val, unit: Val | None = None) -> Val:
        v = number(x, c.lenient)
        if unit is None:
            return v if v.kind == "int" else Val(build(v.col).cast("long"), "int")
        u = number(unit)
        q = v.col.cast("double") / u.col.cast("double")
        if v.kind == u.kind == "int":
            return Val((build(q) * u.col).cast("long"), "int")
        # Spark rounds doubles to 64 bits, without a signed zero; from 2 ** 53 on they are whole already, or infinite, or no number
        return Val(F.when((q != 0) & (F.abs(q) < 2.0**53), build(q).cast("double")).otherwise(q) * u.col.cast("double"), "float")

    FUNCTIONS[name] = run


_rounding("ceil", F.ceil)
_rounding("floor", F.floor)
_rounding("round", lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))
_rounding("trunc", lambda x: F.signum(x) * F.floor(F.abs(x)))


def _extreme(name: str, of_many, of_list, temporal_only: bool) -> None:
    def run(c, *xs: Val) -> Val:
        if len(xs) == 1 and xs[0].kind == "list":
            return Val(of_list(xs[0].col), xs[0].inner.kind)
        vals = [temporal(x) if temporal_only else x if x.kind in TEMPORAL else number(x, c.lenient) for x in xs]
        kind = vals[0]
        for v in vals[1:]:
            kind = unified(kind, v)[0]
        return Val(of_many(*[unified(v, kind)[0].col for v in vals]) if len(vals) > 1 else vals[0].col, kind.kind)

    FUNCTIONS[name] = run


_extreme("max", F.greatest, F.array_max, False)
_extreme("min", F.least, F.array_min, False)
_extreme("latest", F.greatest, F.array_max, True)
_extreme("earliest", F.least, F.array_min, True)


def _arg(name: str, best) -> None:
    def run(c, items: Val, labels: Val | None = None) -> Val:
        at = F.nullif(F.array_position(items.col, best(items.col)), F.lit(0)) - 1
        return Val(F.get(labels.col, at.cast("int")), labels.inner.kind) if labels else Val(at.cast("long"), "int")

    FUNCTIONS[name] = run


_arg("argmax", F.array_max)
_arg("argmin", F.array_min)


def _numbers(items: Val) -> Val:
    if items.kind != "list":
        raise TypeProblem("a list is expected")
    if items.inner.kind in NUMBERS:
        return items
    return Val(F.transform(items.col, lambda x: F.nullif(x, F.lit("")).cast("double")), "list", Val(None, "float"))


@function("sum")
def _sum(c, items: Val) -> Val:
    v = _numbers(items)
    zero = F.lit(0).cast("long") if v.inner.kind == "int" else F.lit(0.0)
    return Val(F.aggregate(v.col, zero, lambda a, x: a + F.coalesce(x, zero)), v.inner.kind)


@function("mean")
def _mean(c, items: Val) -> Val:
    v = _numbers(items)
    return Val(F.aggregate(v.col, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))) / F.nullif(F.size(v.col), F.lit(0)), "float")


# text

for _n, _k, _f in (
    ("lower", "str", F.lower), ("upper", "str", F.upper), ("startswith", "bool", lambda s, p: s.startswith(p)), ("endswith", "bool", lambda s, p: s.endswith(p)), ("md5", "str", F.md5),
    ("escape_regex", "str", lambda s: F.regexp_replace(s, r"([\\.+*?()|\[\]{}^$#&\-~/])", r"\\$1")),
    ("soundex", "str", F.soundex), ("basename", "str", lambda s, *suffix: (lambda b: F.when(b.endswith(suffix[0]), F.left(b, F.length(b) - F.length(suffix[0]))).otherwise(b) if suffix else b)(F.regexp_extract(s, r"([^/]*)/*$", 1))),
    ("dirname", "str", lambda s: F.when(F.instr(s, "/") > 0, F.regexp_replace(s, r"/+[^/]*/*$", "")).otherwise(F.lit(""))),
    ("ext", "str", lambda s: F.regexp_extract(s, r"[^/]\.([^./]+)$", 1)),
    ("hostname", "str", lambda s: F.regexp_replace(F.lower(F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")),
    ("s_stemmer", "str", lambda s: F.when(s.rlike("[^ea]ies$"), F.regexp_replace(s, "ies$", "y")).when(s.rlike("[^aeo]es$"), F.regexp_replace(s, "es$", "e")).when(s.rlike("[^us]s$"), F.regexp_replace(s, "s$", "")).otherwise(s)),
    ("fingerprint", "str", lambda s: F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(udf.unidecode(F.lower(F.trim(s))), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda t: t != ""))), " ")),
    ("unidecode", "str", udf.unidecode), ("html_unescape", "str", udf.html_unescape), ("urljoin", "str", udf.urljoin), ("lru", "str", udf.lru), ("carry_stemmer", "str", udf.carry_stemmer),
    ("refined_soundex", "str", udf.refined_soundex), ("phonogram", "str", udf.phonogram), ("parse_py_literal", "any", lambda s: F.try_parse_json(udf.py_literal(s))), ("parse_json", "any", F.try_parse_json),
    ("abspath", "str", udf.abspath), ("isfile", "bool", udf.isfile), ("filesize", "int", udf.filesize), ("read", "str", udf.read_text), ("mime_ext", "str", udf.mime_ext),
):
    _simple(_n, _k, _f)

FUNCTIONS["shlex_split"] = lambda c, s: Val(udf.shlex_split(text(s)), "list", Val(None, "str"))
FUNCTIONS["parse_dataurl"] = lambda c, s: Val(F.array(F.regexp_extract(text(s), r"^data:([^;,]*)", 1), F.when(text(s).rlike(r"^data:[^,]*;base64,"), F.decode(F.unbase64(F.regexp_extract(text(s), r",(.*)$", 1)), "UTF-8")).otherwise(F.url_decode(F.regexp_extract(text(s), r",(.*)$", 1)))), "list", Val(None, "str"))


def pattern(v: Val) -> Column:
    """As a regular expression: a regex as it is, text literally."""
    return v.col if v.kind == "regex" else F.concat(F.lit(r"\Q"), F.replace(text(v), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


FUNCTIONS["regex"] = lambda c, s: Val(text(s), "regex", None, s.const, s.is_const)
FUNCTIONS["count"] = lambda c, s, p: Val(F.regexp_count(text(s), pattern(p)).cast("long"), "int")


@function("split")
def _split(c, s: Val, sep: Val, most: Val | None = None) -> Val:
    limit = integer(most).cast("int") + 1 if most else F.lit(-1)
    return Val(F.call_function("split", text(s), pattern(sep), limit), "list", Val(None, "str"))


@function("join")
def _join(c, items: Val, sep: Val) -> Val:
    strings = items.col if items.inner.kind == "str" else items.col.cast("array<string>")
    return Val(F.array_join(strings, _constant(sep, "a separator"), ""), "str")


@function("match")
def _match(c, s: Val, p: Val, group: Val | None = None) -> Val:
    n = group.const if group else 0
    return Val(F.when(F.rlike(text(s), p.col), F.call_function("regexp_extract", text(s), p.col, F.lit(n))), "str")


@function("replace")
def _replace(c, s: Val, old: Val, new: Val) -> Val:
    if old.kind == "regex":
        return Val(F.regexp_replace(text(s), old.col, text(new)), "str")
    return Val(F.replace(text(s), text(old), text(new)), "str")


for _n, _f in (("trim", "both"), ("ltrim", "left"), ("rtrim", "right")):

    def _trimmed(c, s: Val, chars: Val | None = None, side=_f) -> Val:
        some = r"\s" if chars is None else "[" + re.sub(r"([\\\]\[^-])", r"\\\1", _constant(chars, "trimmed characters")) + "]"
        ends = {"left": f"^{some}+", "right": f"{some}+$", "both": f"^{some}+|{some}+$"}
        return Val(F.regexp_replace(text(s), ends[side], ""), "str")

    FUNCTIONS[_n] = _trimmed


def _pads(name: str, build) -> None:
    def run(c, s: Val, width: Val, char: Val | None = None) -> Val:
        t, w, ch = text(s), integer(width).cast("int"), char.const if char else " "
        return Val(F.when(F.length(t) >= w, t).otherwise(build(t, w, ch)), "str")

    FUNCTIONS[name] = run


_pads("lpad", lambda t, w, ch: F.lpad(t, w, ch))
_pads("rpad", lambda t, w, ch: F.rpad(t, w, ch))
_pads("pad", lambda t, w, ch: F.rpad(F.lpad(t, (F.length(t) + F.floor((w - F.length(t)) / 2)).cast("int"), ch), w, ch))


@function("fmt")
def _fmt(c, template: Val, *args: Val) -> Val:
    pieces, out, at = re.split(r"(\{\w*\})", _constant(template, "a template")), [], 0
    for p in pieces:
        if re.fullmatch(r"\{\w*\}", p):
            name = p[1:-1]
            if name and args and args[0].kind == "map":
                out.append(text(Val(F.try_element_at(args[0].col, F.lit(name)), args[0].inner.kind)))
            else:
                out.append(text(args[int(name) if name.isdigit() else at]))
                at += 1
        elif p:
            out.append(F.lit(p))
    return Val(F.concat(*[F.coalesce(x, F.lit("")) for x in out]) if out else F.lit(""), "str")


@function("printf")
def _printf(c, template: Val, *args: Val) -> Val:
    shape = _constant(template, "a format")
    if len(args) == 1 and args[0].kind == "list":
        n = len(re.findall(r"%[^%]", shape))
        args = tuple(Val(F.get(args[0].col, i), args[0].inner.kind) for i in range(n))
    kinds = re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z])", shape)
    cols = [integer(a) if k in "dxXo" else double(a) if k in "feEgG" else text(a) for k, a in zip(kinds, args, strict=True)]
    return Val(F.format_string(shape, *cols), "str")


@function("numfmt")
def _numfmt(c, n: Val, thousands_sep: Val | None = None, comma: Val | None = None, significance: Val | None = None) -> Val:
    v = number(n, c.lenient)
    digits = significance.const if significance else 0 if v.kind == "int" else 2
    out = F.format_number(v.col, digits)
    sep, point = thousands_sep.const if thousands_sep else ",", "," if comma and comma.const else "."
    if (sep, point) != (",", "."):
        out = F.replace(F.replace(F.replace(out, F.lit(","), F.lit("\u0001")), F.lit("."), F.lit(point)), F.lit("\u0001"), F.lit(sep))
    return Val(out, "str")


FUNCTIONS["to_fixed"] = lambda c, n, digits: Val(F.format_string(f"%.{_constant(digits, 'digits')}f", double(n, c.lenient)), "str")


@function("bytesize")
def _bytesize(c, n: Val) -> Val:
    v, out = double(n), None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        shown = F.concat(F.format_string("%.0f" if not k else "%.1f", v / 1000**k), F.lit(f" {unit}"))
        out = F.when(v >= 1000**k, shown).otherwise(out) if out is not None else shown
    return Val(out, "str")


# sequences and maps

def _is_text(v: Val) -> bool:
    return v.kind in ("str", "int", "float", "bool", "bytes")


FUNCTIONS["len"] = lambda c, s: Val((F.length(text(s)) if _is_text(s) else F.size(s.col)).cast("long"), "int")
FUNCTIONS["first"] = lambda c, s: Val(F.left(text(s), F.lit(1)), "str") if _is_text(s) else Val(F.get(s.col, 0), s.inner.kind, s.inner.inner)
FUNCTIONS["last"] = lambda c, s: Val(F.right(text(s), F.lit(1)), "str") if _is_text(s) else Val(F.try_element_at(s.col, F.lit(-1)), s.inner.kind, s.inner.inner)


@function("concat")
def _concat(c, *xs: Val) -> Val:
    if any(x.kind == "list" for x in xs):
        lists = [x if x.kind == "list" else Val(F.array(x.col), "list", x) for x in xs]
        return Val(F.concat(*[x.col for x in lists]), "list", lists[0].inner)
    return Val(F.concat(*[F.coalesce(text(x), F.lit("")) for x in xs]), "str")


@function("contains")
def _contains(c, where: Val, what: Val) -> Val:
    """Numbers are found among numbers only, other items as texts."""
    if where.kind == "map":
        return Val(F.map_contains_key(where.col, text(what)), "bool")
    if where.kind == "list":
        if (where.inner.kind in NUMBERS) != (what.kind in NUMBERS):
            return Val(F.lit(False), "bool")
        item = text(what) if where.inner.kind == "str" else what.col
        return Val(F.coalesce(F.array_contains(where.col, item), F.lit(False)), "bool")
    if what.kind == "regex":
        return Val(F.rlike(text(where), what.col), "bool")
    return Val(text(where).contains(text(what)), "bool")


@function("get")
def _get(c, where: Val, key: Val, default: Val | None = None) -> Val:
    if where.kind == "any":
        path = key.const if isinstance(key.const, list) else [key.const]
        steps = "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in path)
        out = Val(F.try_variant_get(where.col, f"${steps}", "variant"), "any")
    elif where.kind == "map":
        out = Val(F.try_element_at(where.col, text(key)), where.inner.kind, where.inner.inner)
    else:
        at = integer(key).cast("int")
        at = F.when(at >= 0, at + 1).otherwise(at)
        if _is_text(where):
            out = Val(F.nullif(F.call_function("substring", text(where), at, F.lit(1)), F.lit("")), "str")
        else:
            out = Val(F.try_element_at(where.col, at), where.inner.kind, where.inner.inner)
    if default is None:
        return out
    a, b = unified(out, default)
    return Val(F.coalesce(a.col, b.col), a.kind, a.inner)


@function("slice")
def _slice(c, s: Val, start: Val, stop: Val | None = None) -> Val:
    n = F.length(text(s)) if _is_text(s) else F.size(s.col)
    bound = lambda v: F.greatest(F.lit(0), F.when(integer(v) < 0, integer(v) + n).otherwise(integer(v))).cast("int")
    a = bound(start)
    b = F.least(bound(stop), n) if stop else n
    size = F.greatest(F.lit(0), b - a)
    if _is_text(s):
        return Val(F.call_function("substring", text(s), a + 1, size), "str")
    return Val(F.slice(s.col, a + 1, size), "list", s.inner)


@function("repeat")
def _repeat(c, s: Val, n: Val) -> Val:
    times = integer(n).cast("int")
    return Val(F.repeat(text(s), times), "str") if _is_text(s) else Val(F.flatten(F.array_repeat(s.col, times)), "list", s.inner)


FUNCTIONS["compact"] = lambda c, s: Val(F.filter(s.col, lambda x: truthy(Val(x, s.inner.kind, s.inner.inner))), "list", s.inner)
FUNCTIONS["dedup"] = lambda c, s: Val(F.array_distinct(s.col), "list", s.inner)
FUNCTIONS["flatten"] = lambda c, s: Val(F.flatten(s.col), "list", s.inner.inner)
FUNCTIONS["keys"] = lambda c, m: Val(F.map_keys(m.col), "list", Val(None, "str"))
FUNCTIONS["values"] = lambda c, m: Val(F.map_values(m.col), "list", m.inner)


@function("sort")
def _sort(c, s: Val, reverse: Val | None = None, dedup: Val | None = None) -> Val:
    out = F.sort_array(s.col, not (reverse and reverse.const))
    return Val(F.array_distinct(out) if dedup and dedup.const else out, "list", s.inner)


@function("range")
def _range(c, a: Val, b: Val | None = None, step: Val | None = None) -> Val:
    start, stop = (integer(a), integer(b)) if b else (F.lit(0).cast("long"), integer(a))
    by = integer(step) if step else F.lit(1).cast("long")
    some = F.when(by > 0, start < stop).otherwise(start > stop)
    last = stop - F.when(by > 0, 1).otherwise(-1)
    return Val(F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.when(some, by).otherwise(F.lit(0)))).otherwise(F.array().cast("array<bigint>")), "list", Val(None, "int"))


@function("index_by")
def _index_by(c, items: Val, key: Val) -> Val:
    return Val(F.map_from_entries(F.transform(items.col, lambda m: F.struct(F.try_element_at(m, text(key)).cast("string"), m))), "map", items.inner)


def _higher(name: str, kind, build, test: bool) -> None:
    def run(c, items: Val, f: Val) -> Val:
        column, result = c.higher(items, f, build, test)
        if kind == "same":
            return Val(column, "list", items.inner)
        if kind == "item":
            return Val(column, items.inner.kind, items.inner.inner)
        if kind == "list":
            return Val(column, "list", result.inner if name == "flat_map" else Val(None, result.kind, result.inner))
        return Val(column, kind)

    FUNCTIONS[name] = run


_higher("map", "list", F.transform, False)
_higher("flat_map", "list", lambda a, f: F.flatten(F.transform(a, f)), False)
_higher("filter", "same", F.filter, True)
_higher("find", "item", lambda a, f: F.get(F.filter(a, f), 0), True)
_higher("find_index", "int", lambda a, f: (F.nullif(F.array_position(F.transform(a, f), True), F.lit(0)) - 1).cast("long"), True)
_higher("all", "bool", F.forall, True)
_higher("any", "bool", F.exists, True)

# dates and times

#: Strftime directives and Spark's pattern letters for them.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "e": "d", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "Z": "zzz", "%": "%",
}


def java_pattern(shape: str) -> str:
    out, plain = [], ""
    for p in re.split(r"(%[A-Za-z%])", shape):
        if p.startswith("%") and len(p) == 2:
            if p[1] not in STRFTIME:
                raise TypeProblem(f"no directive {p}")
            out.append(("'" + plain.replace("'", "''") + "'" if plain else "") + STRFTIME[p[1]])
            plain = ""
        else:
            plain += p
    return "".join(out) + ("'" + plain.replace("'", "''") + "'" if plain else "")


def _parsed(name: str, kind: str, cast: str) -> None:
    def run(c, s: Val, shape: Val | None = None) -> Val:
        if s.kind in TEMPORAL:
            return Val(s.col.cast(cast), kind)
        t = F.nullif(text(s), F.lit(""))
        if shape is not None:
            t = F.try_to_timestamp(t, F.lit(java_pattern(shape.const))) if c.lenient else F.to_timestamp(t, java_pattern(shape.const))
            return Val(t.cast("timestamp_ntz").cast(cast), kind)
        return Val(t.try_cast(cast) if c.lenient else t.cast(cast), kind)

    FUNCTIONS[name] = run


_parsed("datetime", "datetime", "timestamp_ntz")
_parsed("date", "date", "date")


@function("time")
def _time(c, s: Val, shape: Val | None = None) -> Val:
    """A time of day, kept as that time on 1970-01-01, as Spark's own type for it is not on in every session."""
    if s.kind in TEMPORAL:
        at = s.col.cast("timestamp_ntz")
    elif shape is not None:
        at = FUNCTIONS["datetime"](c, s, shape).col
    else:
        day = F.concat(F.lit("1970-01-01T"), F.regexp_replace(F.nullif(text(s), F.lit("")), "^.*[T ]", ""))
        at = day.try_cast("timestamp_ntz") if c.lenient else day.cast("timestamp_ntz")
    return Val(F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), F.date_format(at, "HH:mm:ss.SSSSSS"))), "time")

#: Units of spans, in months or microseconds.
SPAN_MONTHS = {"y": 12, "year": 12, "years": 12, "mo": 1, "mos": 1, "month": 1, "months": 1}
SPAN_MICROS = {"w": 604800, "week": 604800, "weeks": 604800, "d": 86400, "day": 86400, "days": 86400, "h": 3600, "hour": 3600, "hours": 3600, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1}


@function("span")
def _span_of(c, s: Val) -> Val:
    given = _constant(s, "a span").strip()
    months = micros = 0
    if m := re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?", given, re.I):
        y, mo, w, d, h, mi, sec = (float(x or 0) for x in m.groups()[1:])
        months, micros = int(y * 12 + mo), int((w * 604800 + d * 86400 + h * 3600 + mi * 60 + sec) * 1_000_000)
        months, micros = (-months, -micros) if m[1] else (months, micros)
    else:
        for n, unit in re.findall(r"(-?[\d.]+)\s*([a-z]+)", given.lower()):
            if unit in SPAN_MONTHS:
                months += int(n) * SPAN_MONTHS[unit]
            elif unit in SPAN_MICROS:
                micros += int(float(n) * SPAN_MICROS[unit] * 1_000_000)
            else:
                raise TypeProblem(f"no unit {unit!r} in the span {given!r}")
    return Val(F.lit(given), "span", None, (months, micros), True)


def _formatted(*names: str, shape: str) -> None:
    for n in names:
        FUNCTIONS[n] = lambda c, t: Val(F.date_format(temporal(t).col, shape), "str")


_formatted("year", shape="yyyy")
_formatted("month", shape="MM")
_formatted("month_day", shape="MM-dd")
_formatted("year_month", "ym", shape="yyyy-MM")
_formatted("year_month_day", "ymd", shape="yyyy-MM-dd")
FUNCTIONS["strftime"] = lambda c, t, shape: Val(F.date_format(temporal(t).col, java_pattern(_constant(shape, "a format"))), "str")
FUNCTIONS["now"] = lambda c: Val(F.current_timestamp(), "zoned")
FUNCTIONS["from_timestamp"] = lambda c, n: Val(F.timestamp_seconds(number(n).col), "zoned")
FUNCTIONS["from_timestamp_ms"] = lambda c, n: Val(F.timestamp_millis(integer(n)), "zoned")


def _zoned(v: Val) -> Column:
    if v.kind != "zoned":
        raise TypeProblem("a time with its zone is expected")
    return v.col


FUNCTIONS["to_timestamp"] = lambda c, t: Val(F.unix_micros(_zoned(t)) / 1e6, "float")
FUNCTIONS["to_timestamp_ms"] = lambda c, t: Val(F.unix_millis(_zoned(t)), "int")
FUNCTIONS["fractional_days"] = lambda c, a, b: Val((F.unix_micros(temporal(b).col.cast("timestamp")) - F.unix_micros(temporal(a).col.cast("timestamp"))) / 86_400_000_000.0, "float")
# an instant has no zone of its own here: it is shown in the session's, and moves to another zone only as civil time
for _n in ("to_timezone", "to_tz", "to_local_timezone", "to_local_tz"):
    FUNCTIONS[_n] = lambda c, t, zone=None: Val(_zoned(t), "zoned")
for _n in ("with_timezone", "with_tz"):
    FUNCTIONS[_n] = lambda c, t, zone: Val(F.convert_timezone(text(zone), F.lit("UTC"), temporal(t).col.cast("timestamp_ntz")).cast("timestamp"), "zoned")
for _n in ("with_local_timezone", "with_local_tz"):
    FUNCTIONS[_n] = lambda c, t: Val(temporal(t).col.cast("timestamp"), "zoned")
for _n in ("without_timezone", "without_tz"):
    FUNCTIONS[_n] = lambda c, t: Val(_zoned(t).cast("timestamp_ntz"), "datetime")

# the rest

FUNCTIONS["typeof"] = lambda c, v: literal({"str": "string", "zoned": "datetime", "null": "none", "bool": "boolean"}.get(v.kind, v.kind))
FUNCTIONS["err"] = lambda c, m: literal(None) if c.lenient else Val(F.raise_error(text(m)).cast("string"), "str")
FUNCTIONS["uuid"] = lambda c: Val(F.call_function("uuid"), "str")


@function("pathjoin", "pjoin")
def _pathjoin(c, *parts: Val) -> Val:
    out = text(parts[0])
    for p in parts[1:]:
        t = text(p)
        out = F.when(t.startswith("/"), t).when((out == "") | out.endswith("/"), F.concat(out, t)).otherwise(F.concat(out, F.lit("/"), t))
    return Val(out, "str")


@function("read_json", "read_csv")
def _read_constant(c, path: Val) -> Val:
    import csv
    import json

    where = _constant(path, "a path")
    with open(where, newline="") as f:
        data = list(csv.DictReader(f)) if where.endswith(".csv") else json.load(f)
    return Val(F.parse_json(F.lit(json.dumps(data))), "any")


@function("cmd", "shell", "write", "copy", "move")
def _refused(c, *xs: Val) -> Val:
    raise TypeProblem("functions that run programs or change files are refused")


def is_empty(v: Val) -> Column:
    return present(v).isNull()
