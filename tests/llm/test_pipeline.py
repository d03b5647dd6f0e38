import random

from tests.llm.test_decontamination import brute
from tests.llm.test_mixing_sharding import water_fill
from tests.llm.test_simhash import WORD, brute_components, brute_fingerprint

import __spark_entry__
import corpus_pipeline
from tablewright.llm import quality


def test_stages_match_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(150):
        body = text(rnd.randrange(30, 120))
        if i % 10 == 3:
            body += " " + items[i % 5][1]
        if i % 10 == 7:
            body = rows[-1][1]
        good = i % 4 > 0
        rows.append((i, body if good else " ".join(w + "###" for w in body.split()), f"s{i % 3}", "en", len(body)))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", "s1", "en", 0), (5, rows[5][1], "s2", "en", rows[5][4]), (None, text(20), "s2", "en", 9)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, str(tmp_path))
        if name != "rendezvous_sharding":
            assert out.schema.simpleString() == before.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect(), docs.collect()

    rows_of = lambda part: sorted((r[:5] for r in part), key=str)
    before, after = seen["quality_cotraining"]
    frame = spark.createDataFrame(before, schema)
    model = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {(r.doc_id, r.score) for r in quality.score(frame, model).collect() if r.keep}
    assert len(after) == sum(1 for r in quality.score(frame, model).collect() if r.keep) and {r.doc_id for r in after} == {d for d, _ in kept}
    assert sum(r.doc_id is not None and r.doc_id < 150 and r.doc_id % 4 == 0 for r in after) <= 2

    before, after = seen["simhash_near_dedup"]
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in before]
    first = {}
    for r, c in zip(before, brute_components(prints), strict=True):
        if c == r.doc_id:
            first[c] = r
    assert rows_of(after) == rows_of(first.values()) and len(after) < len(before)

    before, after = seen["decontamination"]
    bad = {d for d, *_ in brute([(r.doc_id, r.text) for r in before], items)}
    assert bad and rows_of(after) == rows_of(r for r in before if r.doc_id not in bad)

    before, after = seen["source_mixing"]
    size = lambda t: len(WORD.findall(t or ""))
    totals = {}
    for r in before:
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
    for source, target in water_fill(totals).items():
        assert abs(sum(size(r.text) for r in after if r.source == source) - target) <= 80
    assert {r[:5] for r in after} <= {r[:5] for r in before}

    before, after = seen["rendezvous_sharding"]
    assert rows_of(before) == rows_of(after) and {r.shard for r in after} <= set(range(8))
    assert rows_of(__spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()) == rows_of(after)


def test_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard"] and out.collect() == []
