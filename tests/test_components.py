"""Rounds and results of connected components on the shapes that are hard for label propagation."""

import math
import random

import pytest

from tablewright.operators import graph


def smallest(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for n in sorted(near):
        todo = [] if n in root else [n]
        while todo:
            u = todo.pop()
            if root.setdefault(u, n) == n:
                todo += [v for v in near[u] if v not in root]
    return root


def shapes():
    rnd, n = random.Random(4), 256
    mixed = list(range(n))
    rnd.shuffle(mixed)
    last = [*range(2, n + 1), 1]
    zigzag = [x for i in range(n // 2) for x in (i, n - 1 - i)]
    yield "ascending", list(zip(range(n), range(1, n), strict=False))
    yield "smallest last", list(zip(last, last[1:], strict=False))
    yield "mixed", list(zip(mixed, mixed[1:], strict=False))
    yield "zigzag", list(zip(zigzag, zigzag[1:], strict=False))
    yield "star", [(n, i) for i in range(n)] + [(3, 3)]
    yield "random", [(rnd.randrange(10**4), rnd.randrange(10**4)) for _ in range(10**4)]


@pytest.mark.parametrize("name,edges", list(shapes()), ids=[name for name, _ in shapes()])
def test_rounds_and_roots(spark, monkeypatch, name, edges):
    rounds, really = [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda e: rounds.append(1) or really(e))
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in smallest(edges).items() if n != r or any(n in e and e[0] != e[1] for e in edges)}
    assert len(rounds) - 1 <= 2 * math.log2(len(got)), rounds


def test_no_edges(spark):
    assert graph.connected(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
