import math

import numpy as np

from tablewright.llm import embeddings
from tablewright.llm.queries import op5_embedding_caps


def brute(rows):
    def sound(e, label):
        return label is not None and e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)

    n, out = len(rows), []
    root, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if sound(a, la) and sound(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    old, new = root[i], root[j]
                    root = [new if r == old else r for r in root]
    least = {}
    for r, (v, _, _) in zip(root, rows, strict=True):
        if v is not None:
            least[r] = min(v, least.get(r, v))
    for r, k, (v, _, _) in zip(root, links, rows, strict=True):
        out.append((v, k, least.get(r), v == least.get(r)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rnd.standard_normal(16)
        for _ in range(int(rnd.integers(1, 40))):
            v = centre + rnd.standard_normal(16) * rnd.choice([0.0, 0.05, 0.1, 0.2])
            rows.append((len(rows) * 7 % 1009, [float(np.float32(x)) for x in v], c % 3))
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, [float("inf"), 1.0], 1), (2005, [], 1), (2006, [1.0, 2.0], None), (2007, [1.0, 2.0], None)]
    rows += [(2010, [1.0], 1), (2011, [2.0], 1), (2012, [-1.0], 1), (2013, [1.0, 2.0, 3.0], 5), (2013, [1.0, 2.0, 3.0], 5), (2014, [2.0, 4.0, 6.0], 5), (None, [2.0, 4.0, 6.1], 5), (2015, [1e30, 2e30, 3e30], 5)]
    spark.createDataFrame([(*r, False) for r in rows], "vec_id long, embedding array<float>, label int, kept boolean").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op5_embedding_caps(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute([(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], k) for v, e, k in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want
    tiles = embeddings.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), tile=8)
    assert sorted(map(tuple, tiles.collect()), key=str) == want


def test_recall_at_the_threshold():
    rnd = np.random.default_rng(1)
    for dim, size in ((64, 96), (64, 700), (8, 96), (16, 96)):
        x = rnd.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rnd.standard_normal((400, dim))
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        a, b = embeddings.decode(x, size), embeddings.decode(y, size)
        for u, got in zip(x[:9], a, strict=False):
            want = []
            for number in range(embeddings.CODES):
                first, second, threshold = embeddings.code(dim, size, number)
                score = ((u @ first)[:, None] + u @ second).ravel()
                over = np.flatnonzero(score >= min(threshold, np.sort(score)[-embeddings.LEAST_CAPS]))
                want += (over + number * size**2).tolist()
            assert got.tolist() == want
        assert sum(bool(set(p) & set(q)) for p, q in zip(a, b, strict=True)) >= 399


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
