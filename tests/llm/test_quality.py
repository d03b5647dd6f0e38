import random

import numpy as np
import pyarrow as pa

from tablewright.llm import quality
from tablewright.llm.queries import op1_quality_cotraining


def test_views_match_brute_force():
    texts = ["Ab1, ab1 x", None, "", "one\ntwo three\n", "é", "a b a b a b"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "source": ["s", None, "", "s", "t", "s"], "lang": ["en"] * 5 + [None], "n_chars": pa.array([10, None, 0, 14, 1, 11], pa.int64())})
    view = quality.content_view(batch.column("text"))
    for row, text in zip(view, texts, strict=True):
        data = (text or "").encode()
        words = (text or "").lower().split()
        size = max(1, len(data))
        upper, digit = sum(65 <= b <= 90 for b in data), sum(48 <= b <= 57 for b in data)
        assert np.isclose(row[quality.GRAMS], upper / size) and np.isclose(row[quality.GRAMS + 1], digit / size)
        assert np.isclose(row[quality.GRAMS + 4], len(set(words)) / max(1, len(words)))
        assert np.isclose(row[quality.GRAMS + 3], sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, len(words)))
        assert np.isclose(np.linalg.norm(row[: quality.GRAMS]), float(len(data) > 2), atol=1e-5)
    for i, text in enumerate(texts):
        alone = quality.content_view(pa.array([text], pa.string()))
        assert np.allclose(alone[0], view[i])
    meta = quality.metadata_view(batch)
    assert (meta.sum(axis=1) == 3).all()
    assert (view[:, quality.GRAMS + quality.MEASURES :].sum(axis=1) == 3).all()
    lines_at = quality.GRAMS + quality.MEASURES
    assert view[3, lines_at + 2] == 1 and view[0, lines_at + 1] == 1  # 3 lines: bin log2(4); 1 line: bin log2(2)
    changed = pa.RecordBatch.from_pydict({"text": ["other"] * 6, **{c: batch.column(c) for c in ("source", "lang", "n_chars")}})
    assert (quality.metadata_view(changed) == meta).all()  # the text is no metadata
    assert (meta[0, : quality.SOURCES] == meta[3, : quality.SOURCES]).all() and meta[1, quality.SOURCES - 1] == 1


def test_query(spark, tmp_path):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) + ("" if good else "###") for _ in range(40)]
        rows.append((i, " ".join(words), "news" if good else rnd.choice(["news", "spam"]), "en", 100))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(1, 1, 0), (3, None, None), (None, 1, 1), (9999, 0, 0)]
    rows += [(500, None, None, None, None), (501, "", "x", "y", 0), (None, "words here", "news", "en", 3), (3, rows[3][1], "news", "en", 100)]
    spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_quality_cotraining(spark, str(tmp_path))
    assert got.columns == ["doc_id", "content_score", "metadata_score", "score", "keep"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.keep == (r.score >= quality.KEEP) for r in got)
    right = [r.keep == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) >= 0.98 * len(right)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 5)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for d, given in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        model = quality.fit(d, given)
        assert model.views is None
        assert [r.score for r in quality.score(d, model).collect()] == [0.5] * d.count()
        assert quality.keep_good(d, model).columns == d.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 1"))
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id % 4 = 1").collect()}
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    good = [got[d] for d, q in truth.items() if q]
    bad = [got[d] for d, q in truth.items() if not q]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_views_teach_each_other(spark):
    """Metadata alone tells the classes apart, labels are few: the content view learns from what metadata is sure of."""
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        good = i % 2
        # most labelled documents have words that tell nothing; the others' words do
        words = ["alpha", "beta"] if i < 240 else ["gamma", "delta"] if good else ["omega", "sigma"]
        rows.append((i, " ".join(rnd.choice(words) for _ in range(30)), "good.org" if good else "bad.org", "en", 100))
        if i < 300:
            labels.append((i, good))
    rows.append((2000, "gamma delta " * 50000, "good.org", "en", 600000))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    test = spark.createDataFrame([(1, "gamma delta gamma delta gamma", None, None, None), (0, "omega sigma sigma omega", None, None, None)], docs.schema)
    alone = {r.doc_id: r.content_score for r in quality.score(test, quality.fit(docs, given, rounds=0)).collect()}
    taught = {r.doc_id: r.content_score for r in quality.score(test, quality.fit(docs, given)).collect()}
    again = {r.doc_id: r.content_score for r in quality.score(test, quality.fit(docs.repartition(7), given)).collect()}
    assert taught[1] - taught[0] > max(0.0, alone[1] - alone[0]) and taught == again


def test_smallest_draws_match_brute_force(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.random(), b"", b"") for k in (0, 1, 3) for _ in range(rnd.choice([5, 300]))]
    rows += rows[:3]
    got = quality._smallest(spark.createDataFrame(rows, "kind int, draw double, content binary, metadata binary").repartition(3), 20)
    want = [(k, d) for k in range(4) for d in sorted({d for kind, d, *_ in rows if kind == k})[:20]]
    assert list(zip(got.column("kind").to_pylist(), got.column("draw").to_pylist(), strict=True)) == want
