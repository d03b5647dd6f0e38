import random
import re

from pyspark.sql import functions as F

from tablewright.llm import lines
from tablewright.llm.queries import op10_line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rnd.randrange(len(s) + 1), rnd.randrange(3)
        if kind == 0:
            s.insert(at, rnd.choice("abcé"))
        elif at < len(s):
            s[at : at + 1] = [] if kind == 1 else [rnd.choice("abcé")]
    return "".join(s)


def test_edit_distance(spark):
    rnd = random.Random(0)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("abc", "abc"), ("é漢x", "é漢"), ("aab", "baa")]
    for _ in range(250):
        s = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 30)))
        pairs.append((s, edited(rnd, s, rnd.randrange(5))))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", lines.edit_distance_within(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [distance(r.a, r.b) <= 2 for r in got]


def test_links_match_brute_force(spark):
    rnd = random.Random(1)
    texts = set()
    for _ in range(25):
        s = "".join(rnd.choice("ab é漢") for _ in range(rnd.randrange(16, 60)))
        texts |= {edited(rnd, s, rnd.randrange(4)) for _ in range(8)}
    texts = sorted(t for t in texts if len(t) >= 16)
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "h long, line string, n int")
    got = {(r.a, r.b) for r in lines.links(frame).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if abs(len(texts[i]) - len(texts[j])) < 3 and distance(texts[i], texts[j]) <= 2}
    assert len(want) > 100 and got == want


def brute_force(docs):
    """doc_id, line, n_links, first_doc_id, first_line, kept, by comparing all lines with all."""
    places = [((d is None, d or 0, d, i), re.sub(r"[ \t\r\x0b\x0c]+", " ", raw).strip(" ")) for d, t in docs for i, raw in enumerate(t.split("\n") if t is not None else [])]
    texts = sorted({t for _, t in places if t})
    near = {t: {u for u in texts if u != t and abs(len(t) - len(u)) <= 2 and distance(t, u) <= (max(len(t), len(u)) >= 8) + (max(len(t), len(u)) >= 16)} for t in texts}
    group = {}
    for t in texts:
        todo = [] if t in group else [t]
        while todo:
            u = todo.pop()
            if group.setdefault(u, t) == t:
                todo += [v for v in near[u] if v not in group]
    first = {}
    for at, t in places:
        if t:
            first[group[t]] = min(first.get(group[t], at), at)
    out = []
    for at, t in places:
        best = first[group[t]] if t else at
        out.append((at[2], at[3], len(near[t]) if t else 0, best[2], best[3], at == best))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, tmp_path):
    rnd, long = random.Random(2), "a line that stands in many of the documents"
    docs = [(5, f"{long}\nshort\n own line of five, all alone"), (3, f"short\n {long}  \nshort"), (4, f"a line that  stands in manyy of the document\n\n{long}"), (6, None), (7, ""), (None, long), (9, "x" * 5000 + "\n" + "x" * 4999)]
    docs += [(8, "\n".join([long] * 3 + ["tie"]))] * 2  # a repeated row: both are first where none comes before
    for d in range(20, 60):
        seeds = ["", "a", "ab", "seven77", "eight888", "fifteen chars 5", "sixteen chars 66", "a common line of some length", "\u6f22\u5b57 \u00e9\u00e9\u00e9 of any script", "\t x \r"]
        docs.append((d, "\n".join(edited(rnd, rnd.choice(seeds), rnd.choice([0, 0, 0, 1, 1, 2, 3])) for _ in range(rnd.randrange(12)))))
    docs.append((70, "\n".join(["the very common line"] * 300)))
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, line int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_line_dedup(spark, str(tmp_path)).collect()), key=str)
    want = brute_force(docs)
    assert sum(w[2] > 0 for w in want) > 100 and got == want


def test_many_frequent_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(d, "\n".join(f"line number {k} of {d % 3}" for k in range(d, 40))) for d in range(40)], "doc_id long, text string")
    usual = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    monkeypatch.setattr(lines, "FEW", 3)  # all joins by shuffles
    monkeypatch.setattr(lines, "COPIES", 2)
    monkeypatch.setattr(lines, "HOT", 60)
    assert sorted(map(tuple, lines.dedup_lines(docs).collect())) == usual


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
