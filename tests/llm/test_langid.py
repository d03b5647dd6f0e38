import math
import random

import pyarrow as pa

from tablewright.llm import langid
from tablewright.llm.queries import op8_language_id

EN = "the quick brown fox jumps over the lazy dog and then the other animals went home with this thing "
FR = "le renard brun saute par dessus le chien paresseux et puis les autres animaux sont rentrés à la maison "


def brute_grams(text):
    code = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    while "  " in code:
        code = code.replace("  ", " ")
    code = code[1:] if code.startswith(" ") else code
    return [code[i : i + n] for n in (1, 2, 3) for i in range(len(code) - n + 1) if code[i : i + n].strip()]


def test_grams_match_brute_force():
    texts = ["Ab, c", None, "", "123 !", "É漢Ω x", "a", " lead", "end  ", "ß İ"]
    bucket, doc = langid.grams(pa.array(texts))
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(brute_grams(t)), t
    by = {}
    for n, b in zip(brute_grams("Ab, c"), bucket[doc == 0].tolist(), strict=True):
        assert by.setdefault(n, b) == b
    alone = langid.grams(pa.array(["Ab, c"]))[0]
    assert alone.tolist() == bucket[doc == 0].tolist()


def test_query(spark, tmp_path):
    rows = [(i, EN[i % 20 :] if i % 2 else FR[i % 20 :], ("en" if i % 2 else "fr") if i % 5 else None) for i in range(80)]
    rows += [(100, None, "en"), (101, "12 34", "fr"), (None, "the dog and the fox", "en"), (102, EN * 300, "en"), (3, EN, "en"), (3, EN, "en")]
    spark.createDataFrame([(*r, True, 9.0) for r in rows], "doc_id long, text string, lang string, held_out boolean, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows)
    import zlib

    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        want = "und" if r.doc_id in (100, 101) else "en" if r.doc_id is None or r.doc_id % 2 or r.doc_id == 102 else "fr"
        assert r.lang_pred == want, r


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in op8_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got) > 100


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(docs, langid.fit(docs)).collect()] == [(1, False, "und", 0.0)]
    assert op8_empty(spark) == []


def op8_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    return langid.predict(docs, langid.fit(docs)).collect()


def test_posteriors_of_many_languages_match_brute_force(spark):
    """More languages than a block, with ties; probabilities by Bayes' rule from counts of hashed n-grams."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdeé xyz") for _ in range(rnd.randrange(1, 90))) for _ in range(150)]
    rows = [(i, t, f"l{i % 70:02}") for i, t in enumerate(texts)] + [(200, "abc abc", "z1"), (201, "abc abc", "z2"), (202, "xyz " * 50000, None), (203, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    counts, n_docs = {}, {}
    buckets = {i: langid.grams(pa.array([t]))[0].tolist() for i, t, _ in rows}
    for i, _, lang in rows:
        if lang is not None:
            n_docs[lang] = n_docs.get(lang, 0) + 1
            for b in buckets[i]:
                counts.setdefault(lang, {})[b] = counts.get(lang, {}).get(b, 0) + 1
    total = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    for i, _, _ in rows[::11] + rows[-4:]:
        if not buckets[i]:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {x: math.log(n / sum(n_docs.values())) + sum(math.log((counts.get(x, {}).get(b, 0) + langid.SMOOTHING) / total.get(x, langid.SMOOTHING * langid.BUCKETS)) for b in buckets[i]) for x, n in n_docs.items()}
        top = max(logs.values())
        assert got[i].lang_pred == min(x for x, v in logs.items() if v > top - 1e-9), i
        assert math.isclose(got[i].score, 1 / sum(math.exp(v - top) for v in logs.values()), rel_tol=1e-6)
