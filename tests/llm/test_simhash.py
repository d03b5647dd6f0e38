import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablewright.llm import simhash
from tablewright.llm.queries import op4_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = {}
    for r, (d, _) in zip(root, rows, strict=True):
        if d is not None:
            ids[r] = min(d, ids.get(r, d))
    return [ids.get(r) for r in root]


TEXTS = ["", None, " \n\t", "one", "One  two", "one two three", "a b c d e f g h", "A b\tc d e f g\nh", "ÀÉ ß λ", "x " * 5000, "same words here", "same words here", "\x1ca b", "a b c " * 300]


def test_fingerprints_match_brute_force():
    got = simhash.fingerprints(pa.array(TEXTS))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]
    sliced = pa.array(TEXTS).slice(3, 6)
    assert [int(x) for x in simhash.fingerprints(sliced)] == [brute_fingerprint(t) for t in TEXTS[3:9]]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_close_pairs(radius):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(20)]
    left = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (2**64 - 1) for b in base for _ in range(4)]
    right = [b ^ (1 << rnd.randrange(64)) for b in base for _ in range(7)]
    i, j = simhash.close_pairs(np.array(left, np.uint64), np.array(right, np.uint64), radius)
    want = {(a, b) for a, x in enumerate(left) for b, y in enumerate(right) if (x ^ y).bit_count() <= radius}
    assert want and set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_near_duplicates_with_tiles(spark):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ (1 << rnd.randrange(20)) ^ (1 << rnd.randrange(64)) for c in centres for _ in range(60)}
    rows = [(i, p) for i, p in enumerate(sorted(prints, key=lambda p: p * 7919 % 1000))]
    frame = spark.createDataFrame([(d, p - 2**64 if p >= 2**63 else p) for d, p in rows], "doc_id long, fp long")
    got = {r.fp % 2**64: r.component_id for r in simhash.classes(frame, 2, tile=16).collect()}
    assert [got[p] for _, p in rows] == brute_components(rows)


def test_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS)
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(20, 300))]
        for _ in range(4):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    docs = [(i * 3 % 101 + 1000 * (i // 101), t) for i, t in enumerate(texts)] + [(None, "one two three"), (9005, TEXTS[6]), (9005, TEXTS[6])]
    spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(d, brute_fingerprint(t)) for d, t in docs]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows), strict=True)), key=str)
    got = op4_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "fp"]
    classes = {}
    for (d, _), c in zip(rows, brute_components(rows), strict=True):
        classes.setdefault(c, []).append(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == [] == simhash.keep_one(empty).collect()
