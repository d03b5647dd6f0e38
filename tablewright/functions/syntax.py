"""The expression language: text to tree.

Trees are tuples: ("lit", value), ("bytes", value), ("regex", pattern, flags), ("name", name, optional), ("list", items),
("map", pairs), ("call", function, arguments, named), ("lambda", parameters, body), ("pipe", left, right), ("under",).
Operators are calls of the functions they stand for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
  | (?P<number>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+)?)
  | (?P<string>b?"(?:\\.|[^"\\])*"|b?'(?:\\.|[^'\\])*')
  | (?P<quoted>`[^`]*`)
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*\??)
  | (?P<op>=>|\*\*|\+\+|==|!=|<=|>=|&&|\|\||//|[-+*/%<>!|()\[\]{},.:=?])""",
    re.X,
)
REGEX = re.compile(r"/((?:\\.|[^/\\\n])+)/([imsx]*)")

#: Binary operators: (precedence, right-associative, function).
BINARY = {
    "|": (1, False, "pipe"), "or": (2, False, "or"), "||": (2, False, "or"), "and": (3, False, "and"), "&&": (3, False, "and"),
    "==": (4, False, "=="), "!=": (4, False, "!="), "eq": (4, False, "eq"), "ne": (4, False, "ne"),
    "in": (5, False, "in"), "not in": (5, False, "not in"), "<": (5, False, "<"), "<=": (5, False, "<="), ">": (5, False, ">"), ">=": (5, False, ">="),
    "lt": (5, False, "lt"), "le": (5, False, "le"), "gt": (5, False, "gt"), "ge": (5, False, "ge"),
    "+": (6, False, "add"), "-": (6, False, "sub"), "++": (6, False, "concat"),
    "*": (7, False, "mul"), "/": (7, False, "div"), "//": (7, False, "idiv"), "%": (7, False, "mod"), "**": (8, True, "pow"),
}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}


class SyntaxProblem(ValueError):
    """An expression that can't be read."""


@dataclass
class Clause:
    tree: tuple
    names: list[str]
    source: str


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.peeked = text, 0, None

    def peek(self) -> tuple[str, str]:
        if self.peeked is None:
            at = self.at
            while True:
                m = TOKEN.match(self.text, at)
                if not m:
                    if at >= len(self.text):
                        self.peeked = ("end", "", at, at)
                        break
                    raise SyntaxProblem(f"unexpected {self.text[at : at + 20]!r} in {self.text!r}")
                if m.lastgroup != "space":
                    self.peeked = (m.lastgroup, m[0], m.start(), m.end())
                    break
                at = m.end()
        return self.peeked[:2]

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at, self.peeked = self.peeked[3], None
        return token

    def take(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.next()
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SyntaxProblem(f"{op!r} expected at {self.text[self.at :][:20]!r} in {self.text!r}")

    def operator(self) -> str | None:
        kind, text = self.peek()
        if kind == "name" and text == "not" and re.match(r"\s*not\s+in\b", self.text[self.at :]):
            return "not in"
        return text if text in BINARY and kind in ("op", "name") else None

    def expression(self, least: int = 0) -> tuple:
        left = self.unary()
        while (op := self.operator()) and BINARY[op][0] >= max(least, 1):
            rank, right_first, function = BINARY[op]
            self.next()
            if op == "not in":
                self.next()
            right = self.expression(rank if right_first else rank + 1)
            if function == "pipe":
                left = ("pipe", left, right)
            elif function in ("in", "not in"):
                left = ("call", "contains", [right, left], {})
                left = ("call", "not", [left], {}) if function == "not in" else left
            else:
                left = ("call", function, [left, right], {})
        return left

    def unary(self) -> tuple:
        if self.take("!"):
            return ("call", "not", [self.unary()], {})
        if self.take("-"):
            inner = self.expression(BINARY["**"][0])
            return ("lit", -inner[1]) if inner[0] == "lit" and type(inner[1]) in (int, float) else ("call", "neg", [inner], {})
        return self.postfix(self.primary())

    def postfix(self, left: tuple) -> tuple:
        while True:
            if self.take("["):
                start = None if self.peek() == ("op", ":") else self.expression()
                if self.take(":"):
                    stop = None if self.peek() == ("op", "]") else self.expression()
                    left = ("call", "slice", [left, start or ("lit", 0), *([stop] if stop else [])], {})
                else:
                    left = ("call", "get", [left, start], {})
                self.need("]")
            elif self.take("."):
                kind, name = self.next()
                if kind not in ("name", "quoted"):
                    raise SyntaxProblem(f"a name expected after '.' in {self.text!r}")
                if self.peek() == ("op", "("):
                    arguments, named = self.arguments()
                    left = ("call", name, [left, *arguments], named)
                else:
                    left = ("call", "get", [left, ("lit", name.strip("`"))], {})
            else:
                return left

    def arguments(self) -> tuple[list[tuple], dict[str, tuple]]:
        self.need("(")
        arguments, named = [], {}
        while not self.take(")"):
            m = re.match(r"\s*([A-Za-z_]\w*)\s*=(?![=>])", self.text[self.at :])
            if m:
                self.at, self.peeked = self.at + m.end(), None
                named[m[1]] = self.expression()
            else:
                arguments.append(self.expression())
            if not self.take(","):
                self.need(")")
                break
        return arguments, named

    def primary(self) -> tuple:
        rest = self.text[self.at :].lstrip()
        if rest.startswith("/") and (m := REGEX.match(rest)):
            self.at, self.peeked = len(self.text) - len(rest) + m.end(), None
            return ("regex", m[1].replace(r"\/", "/"), m[2])
        if m := re.match(r"\(\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*\)\s*=>", rest):
            self.at, self.peeked = len(self.text) - len(rest) + m.end(), None
            return ("lambda", [x.strip() for x in m[1].split(",")], self.expression())
        kind, text = self.next()
        if kind == "number":
            digits = text.replace("_", "")
            return ("lit", int(digits) if digits.isdigit() else float(digits))
        if kind == "string":
            plain = re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text.lstrip("b")[1:-1], flags=re.S)
            return ("bytes", plain.encode()) if text[0] == "b" else ("lit", plain)
        if kind == "quoted":
            return ("name", text[1:-1], False)
        if kind == "name":
            if text in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[text])
            if text == "_":
                return ("under",)
            if self.peek() == ("op", "("):
                arguments, named = self.arguments()
                return ("call", text, arguments, named)
            if self.take("=>"):
                return ("lambda", [text], self.expression())
            return ("name", text.rstrip("?"), text.endswith("?"))
        if text == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if text == "[":
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.take(","):
                    self.need("]")
                    break
            return ("list", items)
        if text == "{":
            pairs = []
            while not self.take("}"):
                kind, key = self.next()
                if kind not in ("name", "string", "quoted"):
                    raise SyntaxProblem(f"a key expected in {self.text!r}")
                self.need(":")
                pairs.append((key.strip("`\"'"), self.expression()))
                if not self.take(","):
                    self.need("}")
                    break
            return ("map", pairs)
        raise SyntaxProblem(f"unexpected {text!r} in {self.text!r}")

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.text[self.at :][:30]!r} in {self.text!r}")

    def clauses(self) -> list[Clause]:
        out = []
        while True:
            at = self.at
            tree = self.expression()
            source = self.text[at : self.at].strip()
            names = [source]
            if self.peek() == ("name", "as"):
                self.next()
                if self.take("("):
                    names = []
                    while not self.take(")"):
                        names.append(self.next()[1].strip("`\"'"))
                        self.take(",")
                else:
                    m = re.match(r"\s*(`[^`]*`|\"[^\"]*\"|'[^']*'|[\w{}.-]+)", self.text[self.at :])
                    if not m:
                        raise SyntaxProblem(f"a name expected after 'as' in {self.text!r}")
                    self.at, self.peeked = self.at + m.end(), None
                    names = [m[1].strip("`\"'")]
            out.append(Clause(tree, names, source))
            if not self.take(","):
                self.end()
                return out


def parse(text: str) -> tuple:
    p = Parser(text)
    tree = p.expression()
    p.end()
    return tree


def parse_clauses(text: str) -> list[Clause]:
    """`expression as name, expression as (a, b), ..`; a clause without name has its own text."""
    return Parser(text).clauses()


def replace_under(tree: tuple, by: tuple) -> tuple:
    """tree with `by` in place of `_`."""
    if not isinstance(tree, tuple) or not tree:
        return tree
    kind = tree[0]
    if kind == "under":
        return by
    if kind == "list":
        return ("list", [replace_under(x, by) for x in tree[1]])
    if kind == "map":
        return ("map", [(k, replace_under(x, by)) for k, x in tree[1]])
    if kind == "call":
        return ("call", tree[1], [replace_under(x, by) for x in tree[2]], {k: replace_under(x, by) for k, x in tree[3].items()})
    if kind == "lambda":
        return ("lambda", tree[1], replace_under(tree[2], by))
    if kind == "pipe":
        return ("pipe", replace_under(tree[1], by), tree[2])
    return tree


def uses_under(tree: tuple) -> bool:
    return replace_under(tree, ("lit", None)) != tree
