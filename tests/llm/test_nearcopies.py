import random

import pytest
from tests.llm.test_simhash import WORD, brute_fingerprint

import corpus_pipeline


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The smallest doc_id of each class of (doc_id, text), by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    classes = {}
    for r, (d, _) in zip(root, rows, strict=True):
        classes.setdefault(r, []).append(d)
    return sorted(min(c) for c in classes.values())


@pytest.mark.parametrize("tile", [5, 256])
def test_near_copies_go(spark, monkeypatch, tile):
    from tablewright.llm import nearcopies

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "one two", "One  two", "one two three four five"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 300))]
        for edits in (0, 0, 1, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keep = nearcopies.keep_one
    monkeypatch.setattr(nearcopies, "keep_one", lambda d: keep(d, tile))
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in kept) == want and len(want) < len(set(texts))
    assert all(texts[r.doc_id] == r.text for r in kept)


def test_empty(spark):
    from tablewright.llm import nearcopies

    assert nearcopies.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_of_both_kinds_make_classes(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    tail = [rnd.choice(words) for _ in range(100)]
    often = "a b c " * 300  # fingerprints follow what is repeated, sets of shingles don't
    texts = [often, often + " ".join(tail), "a b c " + " ".join([*tail[:-1], "other"]), " ".join(rnd.choice(words) for _ in range(60))]
    prints = [brute_fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < min((prints[2] ^ p).bit_count() for p in prints[:2])
    assert brute_kept(list(enumerate(texts))) == [0, 1, 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()) == [0, 3]
