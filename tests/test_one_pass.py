import random

from pyspark.sql import functions as F

from tablewright.operators import graph, text


def test_statistics_without_components_take_no_rounds(spark, monkeypatch):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "d"), ("e", "f")], "s string, t string")
    edges = graph.edge_list(df, "s", "t")
    whole = graph.statistics(edges).first().asDict()
    monkeypatch.setattr(graph, "connected", None)
    got = graph.statistics(edges, components=False).first().asDict()
    assert got == {k: v for k, v in whole.items() if k not in ("connected_components", "largest_component")} and got["nodes"] == 6


def test_fast_patterns_find_the_same_tokens(spark):
    rnd = random.Random(3)
    parts = ["a", "é", "Zz", "7", "1,2", "-", "'", "’", ".", "@", "#", "_", "http://", "www.", "/", ":", " ", "\n", "é", "😀", "☀", "+", "x.y", "mail@a.bc", '"', "<", "ß", "א", "٣", "_", "﻿"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = "(?:" + "|".join(f"(?:{p})" for _, p in text.KINDS) + ")"
    both = df.select(text.token_array(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b"))
    assert both.filter("a <> b").collect() == []
    kind = None
    for k, p in text.KINDS:
        test = F.col("w").rlike(f"^(?:{p})$")
        kind = F.when(test, k) if kind is None else kind.when(test, k)
    words = both.select(F.explode("a").alias("w"))
    assert words.filter(text.token_kind(F.col("w")) != kind.otherwise("punct")).collect() == [] and words.count() > 4000
    assert len({r[0] for r in words.select(text.token_kind(F.col("w"))).collect()}) == len(text.KINDS)


def test_tokens_are_dealt_once(spark):
    rows = [(d, w) for d, ws in ((1, "a b a"), (2, "b c"), (None, "a z")) for w in ws.split()]
    out = text.vocab_doc_token(spark.createDataFrame(rows, "doc long, token string").repartition(3), "doc", "token")
    got = {(r.doc, r.token): (r.tf, round(r.expected_tf, 9)) for r in out.collect()}
    gf, dl = {"a": 3, "b": 2, "c": 1}, {1: 3, 2: 2}
    assert got == {(d, w): (float(c), round(gf[w] * dl[d] / 7, 9)) for (d, w), c in {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (2, "c"): 1}.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(token" not in plan
