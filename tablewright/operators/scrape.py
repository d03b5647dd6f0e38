"""Scraping of HTML cells: head, urls, images, articles, and a language of selectors and extractors.

A program is a set of fields: `title: "h1".text()`, `links: all("a").attr("href")`, chained from the document's root:
selectors first(css), last(css), all(css), root(), parent(), find_ancestor(css), prev_sibling(css?), next_sibling(css?);
extractors name(), id(), attr(name), attrs(), classes(), data(name), text(), raw_text(), inner_html(), outer_html(), json(),
json_ld(type?). A bare string selects the first match.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without end, and those that text puts on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def descendants(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.descendants()

    def siblings(self) -> list[Node]:
        return [c for c in self.parent.children if isinstance(c, Node)] if self.parent else [self]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def raw_text(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw_text() for c in self.children)

    def text(self) -> str:
        out: list[str] = []

        def walk(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    out.append(re.sub(r"\s+", " ", c))
                elif c.name == "br":
                    out.append("\n")
                elif c.name == "hr":
                    out.append("\n\n")
                elif c.name not in ("script", "style"):
                    edge = "\n\n" if c.name in BLOCKS else ""
                    out.append(edge)
                    walk(c)
                    out.append(edge)

        walk(self)
        lines = re.sub(r" *\n *", "\n", "".join(out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", lines)).strip()

    def inner_html(self) -> str:
        return "".join(c if isinstance(c, str) else c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        attrs = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>" + ("" if self.name in VOID else f"{self.inner_html()}</{self.name}>")


class _Builder(HTMLParser):
    """mark: what stands for & in the text fed, so that it isn't taken for the start of a character reference."""

    def __init__(self, mark: str = "&"):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.mark = mark

    def _attrs(self, attrs):
        return {k.replace(self.mark, "&"): v and v.replace(self.mark, "&") for k, v in attrs}

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "tr", "td", "th", "option") and self.at.name == tag:
            self.at = self.at.parent
        node = Node(tag, self._attrs(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, self._attrs(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data.replace(self.mark, "&"))


def parse(html: str, written: bool = False) -> Node:
    """The document's tree. written: character references stay as they are written (&quot;), else they are what they stand for."""
    html = html or ""
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html) if written else "&"
    b = _Builder(mark)
    b.feed(html.replace("&", mark))
    b.close()
    return b.root


PART = re.compile(r"(?P<tag>[\w*-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^)]*)\))?")


#: Parts of a selector list, and steps of a selector: brackets and parentheses stay whole.
CHOICE = re.compile(r"(?:\[[^\]]*\]|\([^)]*\)|[^,\[(])+")
STEP = re.compile(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+|[>+~]")


def _simple(node: Node, part: str) -> bool:
    for m in PART.finditer(part):
        if m["tag"] and m["tag"] not in ("*", node.name):
            return False
        if m["id"] and node.attrs.get("id") != m["id"]:
            return False
        if m["cls"] and m["cls"] not in node.classes():
            return False
        if m["attr"]:
            v = node.attrs.get(m["attr"])
            if m["attr"] not in node.attrs:
                return False
            w, x = m["val"], v or ""
            if m["op"] and not {"=": x == w, "^=": x.startswith(w), "$=": x.endswith(w), "*=": w in x, "~=": w in x.split(), "|=": x == w or x.startswith(f"{w}-")}[m["op"]]:
                return False
        if m["pseudo"]:
            sibs = node.siblings()
            at = sibs.index(node) + 1
            ok = {"first-child": at == 1, "last-child": at == len(sibs), "nth-child": m["arg"] is not None and m["arg"].isdigit() and at == int(m["arg"]), "not": m["arg"] is not None and not matches(node, m["arg"]), "contains": m["arg"] is not None and m["arg"].strip("\"'") in node.raw_text()}
            if not ok.get(m["pseudo"], False):
                return False
    return True


def matches(node: Node, css: str) -> bool:
    return any(_chain(node, STEP.findall(s)) for s in CHOICE.findall(css))


def _chain(node: Node, parts: list[str]) -> bool:
    if not _simple(node, parts[-1]):
        return False
    if len(parts) == 1:
        return True
    how, rest = (parts[-2], parts[:-2]) if parts[-2] in ">+~" else (" ", parts[:-1])
    sibs = node.siblings()
    at = sibs.index(node)
    if how == ">":
        return node.parent is not None and node.parent.name != "#document" and _chain(node.parent, rest)
    if how in "+~":
        return any(_chain(s, rest) for s in (sibs[at - 1 : at] if how == "+" and at else sibs[:at] if how == "~" else []))
    up = node.parent
    while up is not None and up.name != "#document":
        if _chain(up, rest):
            return True
        up = up.parent
    return False


def find(node: Node, css: str) -> Iterator[Node]:
    return (n for n in node.descendants() if matches(n, css))


CALL = re.compile(r"""\s*\.?\s*(?:(?P<name>\w+)\(\s*(?:(?P<arg>"[^"]*"|'[^']*'|\w+)\s*)?\)|(?P<css>"[^"]*"|'[^']*'))""")


def program(source: str) -> list[tuple[str, list[tuple[str, str | None]]]]:
    """[(field, [(call, argument)])] of `field: chain` lines, separated by line breaks or semicolons."""
    out = []
    for line in re.split(r"[\n;]+", source.strip().strip("{}")):
        if line.strip():
            name, _, chain = line.partition(":")
            steps, at = [], 0
            while at < len(chain) and chain[at:].strip():
                m = CALL.match(chain, at)
                if not m:
                    raise ValueError(f"{chain[at:]!r} can't be read in {line!r}")
                steps.append(("first", m["css"].strip("\"'")) if m["css"] else (m["name"], m["arg"].strip("\"'") if m["arg"] else None))
                at = m.end()
            out.append((name.strip(), steps))
    return out


def _step(nodes: list[Node], name: str, arg: str | None):
    one = nodes[0] if nodes else None
    if name == "first":
        return [x for x in [next(find(one, arg), None)] if x] if one else []
    if name == "last":
        return list(find(one, arg))[-1:] if one else []
    if name == "all":
        return [x for n in nodes for x in find(n, arg)]
    if name == "root":
        while one and one.parent:
            one = one.parent
        return [one] if one else []
    if name == "parent":
        return [one.parent] if one and one.parent else []
    if name == "find_ancestor":
        while one and one.parent:
            one = one.parent
            if one.parent and matches(one, arg):
                return [one]
        return []
    if name in ("prev_sibling", "next_sibling"):
        if not one:
            return []
        sibs = one.siblings()
        at = sibs.index(one)
        side = sibs[:at][::-1] if name == "prev_sibling" else sibs[at + 1 :]
        return [s for s in side if arg is None or matches(s, arg)][:1]
    raise ValueError(f"no selector {name!r}")


EXTRACTORS = {
    "name": lambda n, a: n.name, "id": lambda n, a: n.attrs.get("id"), "attr": lambda n, a: n.attrs.get(a), "attrs": lambda n, a: json.dumps(n.attrs), "classes": lambda n, a: " ".join(n.classes()),
    "data": lambda n, a: n.attrs.get(f"data-{a}"), "text": lambda n, a: n.text(), "raw_text": lambda n, a: n.raw_text(), "inner_html": lambda n, a: n.inner_html(), "outer_html": lambda n, a: n.outer_html(),
    "json": lambda n, a: _json(n.raw_text()), "json_ld": lambda n, a: json.dumps(next(json_ld(n, a), None)),
}


def _json(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        return None


def json_ld(node: Node, kind: str | None = None) -> Iterator[dict]:
    """JSON-LD objects of a type, in scripts that hold one object or an array of them."""
    for script in find(node, 'script[type="application/ld+json"]'):
        try:
            data = json.loads(script.raw_text())
        except ValueError:
            continue
        for x in data if isinstance(data, list) else [data]:
            types = x.get("@type") if isinstance(x, dict) else None
            types = [str(t).lower().rsplit("/", 1)[-1] for t in (types if isinstance(types, list) else [types])]
            if isinstance(x, dict) and (kind is None or kind.lower() in types):
                yield x


def run_program(fields, start: Node, sep: str = "|") -> list[str | None]:
    out = []
    for _, steps in fields:
        nodes, value, many = [start], None, False
        for name, arg in steps:
            if name in EXTRACTORS:
                got = [EXTRACTORS[name](n, arg) for n in nodes]
                value = sep.join(x for x in got if x is not None) if many else (got[0] if got else None)
            else:
                many = many or name == "all"
                nodes = _step(nodes, name, arg)
        out.append(value if any(s[0] in EXTRACTORS for s in steps) else (nodes[0].text() if nodes else None))
    return out


def _mapped(df: DataFrame, column: str, names: list[str], rows_of, keep: list[str]) -> DataFrame:
    """keep's columns beside rows_of(html, base): rows of texts; in Arrow batches, any number of rows a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, made = [], []
            for i, cell in enumerate(batch["_html"]):
                for row in rows_of(cell or ""):
                    at.append(i)
                    made.append(row)
            kept = batch[keep].iloc[at].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame(made, columns=names, dtype=object)], axis=1)[[*keep, *names]]

    fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keep)
    shape = ", ".join([*([fields] if keep else []), *[f"`{n}` string" for n in names]])
    return df.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{column}`").alias("_html")).mapInPandas(run, shape)


def _kept(df: DataFrame, column: str, keep: list[str] | None) -> list[str]:
    return [c for c in df.columns if c != column] if keep is None else keep


def head(df: DataFrame, column: str, keep: list[str] | None = None, written: bool = False) -> DataFrame:
    """title and canonical_url of the first head; written: as for `parse`."""

    def one(html: str):
        m = re.search(r"<head[^>]*>(.*?)(?:</head>|<body)", html, re.S | re.I)
        top = parse(m[1] if m else "", written)
        title, link = next(find(top, "title"), None), next(find(top, 'link[rel="canonical"]'), None)
        return [(title.raw_text().strip() if title else "", (link.attrs.get("href") or "") if link else "")]

    return _mapped(df, column, ["title", "canonical_url"], one, _kept(df, column, keep))


LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)


def urls(df: DataFrame, column: str, base: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row for each link of the text without scripts, joined with a base url."""

    def many(html: str):
        text = re.sub(r"<script\b.*?</script>", "", html, flags=re.S | re.I)
        links = (next(g for g in m.groups() if g is not None).strip() for m in LINK.finditer(text))
        return [(urljoin(base, x) if base else x,) for x in links]

    return _mapped(df, column, ["url"], many, _kept(df, column, keep))


def images(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    return _mapped(df, column, ["src"], lambda html: [(n.attrs["src"],) for n in find(parse(html), "img[src]")], _kept(df, column, keep))


ARTICLE = ("canonical_url", "headline", "description", "date_created", "date_published", "date_modified", "section", "keywords", "authors", "image", "image_caption", "free")


def article_fields(html: str) -> list[tuple]:
    doc = parse(html)
    x = next(json_ld(doc, "newsarticle"), {})
    meta = lambda *names: next((n.attrs.get("content") or "" for name in names for n in find(doc, f'meta[property="{name}"], meta[name="{name}"]')), "")
    text = lambda v: "" if v is None else v if isinstance(v, str) else v.get("name") or v.get("url") or "" if isinstance(v, dict) else "|".join(text(i) for i in v) if isinstance(v, list) else json.dumps(v)
    link = next(find(doc, 'link[rel="canonical"]'), None)
    image = x.get("image") if not isinstance(x.get("image"), list) else (x["image"] or [None])[0]
    return [(
        (link.attrs.get("href") or "") if link else text(x.get("url")), text(x.get("headline")) or meta("og:title"), text(x.get("description")) or meta("og:description", "description"), text(x.get("dateCreated")),
        text(x.get("datePublished")) or meta("article:published_time"), text(x.get("dateModified")) or meta("article:modified_time"), text(x.get("articleSection")) or meta("article:section"), text(x.get("keywords")) or meta("keywords"),
        text(x.get("author")) or meta("author"), text(image) or meta("og:image"), text(image.get("caption")) if isinstance(image, dict) else "", text(x.get("isAccessibleForFree")),
    )]


def article(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    return _mapped(df, column, list(ARTICLE), article_fields, _kept(df, column, keep))


def scrape(df: DataFrame, column: str, source: str, foreach: str | None = None, sep: str = "|", keep: list[str] | None = None, written: bool = False) -> DataFrame:
    """The fields of a program; foreach: a row for each element that a selector finds, programs starting from it; written: as for
    `parse`."""
    fields = program(source)

    def rows(html: str):
        doc = parse(html, written)
        starts = list(find(doc, foreach)) if foreach else [doc]
        return [tuple(run_program(fields, s, sep)) for s in starts]

    return _mapped(df, column, [n for n, _ in fields], rows, _kept(df, column, keep))
