"""Chains of operators: as methods of a Table, or as text, `groupby l_returnflag 'count() as n' | sort n -N`."""

from __future__ import annotations

import inspect
import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import aggregate, graph, joins, reshape, rows, scrape, search, text

#: Operators by command name; the first argument is the table, the rest as in the function.
COMMANDS: dict[str, Callable] = {
    "select": rows.select, "drop": rows.drop, "map": rows.map_columns, "transform": rows.transform, "filter": rows.filter_rows, "head": rows.head, "tail": rows.tail, "slice": rows.slice_rows,
    "bisect": rows.bisect, "sample": rows.sample, "shuffle": rows.shuffle, "enum": rows.enum, "reverse": rows.reverse, "rename": rows.rename, "sort": rows.sort, "top": rows.top, "dedup": rows.dedup,
    "fill": rows.fill, "blank": rows.blank, "agg": aggregate.agg, "groupby": aggregate.groupby, "window": aggregate.window, "frequency": aggregate.frequency, "freq": aggregate.frequency, "stats": aggregate.stats,
    "bins": aggregate.bins, "corr": aggregate.correlations, "matrix": aggregate.matrix_count, "adjacency": aggregate.adjacency, "join": joins.join, "fuzzy-join": joins.fuzzy, "cross": joins.cross,
    "search": search.search, "matches": search.count_matches, "breakdown": search.breakdown, "replace": search.replace, "explode": reshape.explode, "implode": reshape.implode, "separate": reshape.separate,
    "pivot": reshape.pivot, "unpivot": reshape.unpivot, "transpose": reshape.transpose, "complete": reshape.complete, "flatten": reshape.flatten, "tokenize": text.tokenize, "sentences": text.sentences,
    "paragraphs": text.paragraphs, "cluster": text.cluster, "vocab-token": text.vocab_token, "vocab-doc": text.vocab_doc, "vocab-doc-token": text.vocab_doc_token, "vocab-corpus": text.vocab_corpus,
    "cooc": text.cooccurrences, "network": graph.edge_list, "scrape": scrape.scrape, "scrape-head": scrape.head, "scrape-urls": scrape.urls, "scrape-article": scrape.article,
}


class Table:
    """A DataFrame with the operators as methods; `order_by` is given once and used wherever an operator takes it."""

    def __init__(self, df: DataFrame, order_by: str | list[str] | None = None):
        self.df, self.order_by = df, order_by

    def run(self, command: str, *args, **options) -> Table:
        f = COMMANDS[command]
        names = list(inspect.signature(f).parameters)
        order = [self.order_by] if isinstance(self.order_by, str) else self.order_by or []
        there = bool(order) and all(c in self.df.columns for c in order)
        if there and "order_by" in names and "order_by" not in options and len(args) + 1 <= names.index("order_by"):
            options["order_by"] = self.order_by
        return Table(f(self.df, *args, **options), self.order_by)

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in COMMANDS:
            raise AttributeError(name)
        return lambda *args, **options: self.run(name, *args, **options)


def _value(text: str):
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text)
    except ValueError:
        return text


def run(df: DataFrame, script: str, order_by: str | list[str] | None = None) -> DataFrame:
    """The table after a chain of `command argument .. --option value` stages, all of them one plan."""
    lexer = shlex.shlex(script, posix=True, punctuation_chars="|")
    lexer.whitespace_split = True
    table, stage = Table(df, order_by), []
    for word in [*lexer, "|"]:
        if word != "|":
            stage.append(word)
            continue
        args, options, rest = [], {}, iter(stage[1:])
        for w in rest:
            if w.startswith("--"):
                name, _, given = w[2:].partition("=")
                parameter = inspect.signature(COMMANDS[stage[0]]).parameters[name.replace("-", "_")]
                options[parameter.name] = True if parameter.default is False and not given else _value(given or next(rest))
            else:
                args.append(_value(w))
        if stage:
            table = table.run(stage[0], *args, **options)
        stage = []
    return table.df
