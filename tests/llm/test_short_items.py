import corpus_pipeline


def test_short_items_inside_long_documents(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(200))
    docs = [(1, f"{filler} Two  words {filler}"), (2, f"{filler} two {filler} words"), (3, "one"), (4, "x four short plain words"), (5, f"{filler} four short plain word"), (6, None), (7, f"alone {filler}"), (8, filler)]
    items = [(1, "two words"), (2, "four short plain words"), (3, "ALONE"), (4, None), (5, ""), (6, "one two three words missing here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8]
