import random
import re

import pyarrow as pa

from tablewright.llm import decontamination as dc
from tablewright.llm.queries import op6_decontamination


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items):
    out = []
    docs, items = ([(i, shingles(t)) for i, t in side] for side in (docs, items))
    for d, have in docs:
        for i, s in items:
            if s and len(s & have) >= 0.8 * len(s):
                out.append((d, i, len(s & have), len(s), len(s & have) / len(s)))
    return sorted(out, key=str)


def cases(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, text(rnd.choice([1, 4, 5, 6, 9, 12, 30, 60, 150, 900]))) for i in range(40)]
    docs = []
    for n in range(200):
        body = text(rnd.choice([0, 3, 50, 300, 3000]))
        if n % 2:
            part = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(3)):
                part[rnd.randrange(len(part))] = "changed"
            if n % 4 == 1 and len(part) > 20:  # held in two places
                body = part[: len(part) // 2 + 4] + body + part[len(part) // 2 :]
            else:
                at = rnd.randrange(len(body) + 1)
                body = body[:at] + part + body[at:]
        docs.append((n, " \n".join(body)))
    docs += [(300, None), (301, ""), (302, " ".join(items[5][1]).upper()), (302, " ".join(items[5][1]).upper()), (None, " ".join(items[6][1]))]
    return docs, [*((i, " ".join(t)) for i, t in items), (90, None), (91, ""), (92, "w1 w2"), (6, " ".join(items[6][1]))]


def test_matches_brute_force(spark, tmp_path):
    docs, items = cases(1)
    docs.append((303, "w1  w2"))
    spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items)
    assert len(want) > 40
    assert sorted(map(tuple, op6_decontamination(spark, str(tmp_path)).collect()), key=str) == want
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    assert sorted(map(tuple, dc.search(read("documents"), read("benchmark"), limit=3000).collect()), key=str) == want
    kept = dc.drop_contaminated(read("documents"), read("benchmark"), limit=9000)
    assert kept.columns == ["doc_id", "text", "item_id"]
    bad = {d for d, *_ in want}
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, t in docs if d not in bad)


def test_recall_of_candidates():
    found = wanted = 0
    for seed in range(2, 8):
        docs, items = cases(seed)
        want = {(d, i) for d, i, *_ in brute(docs, items)}
        block = dc.Items([i for i, _ in items], [t for _, t in items])
        got = {(docs[d][0], block.ids[n]) for d, n, _ in dc.found(block, pa.array([t for _, t in docs]))}
        assert got <= want
        found, wanted = found + len(got), wanted + len(want)
    assert found >= 0.999 * wanted


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dc.search(docs, items).collect() == [] == dc.search(docs.union(spark.createDataFrame([(1, "x")])), items.limit(0)).collect()
    assert dc.drop_contaminated(docs, items).collect() == []
