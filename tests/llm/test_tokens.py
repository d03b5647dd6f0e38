import random

import numpy as np

from tablewright.llm import tokens
from tablewright.llm.durable import scratch
from tablewright.llm.queries import op9_token_counts


def test_query_matches_direct_counts(spark, tmp_path):
    rnd = random.Random(0)
    docs = [(i, " ".join(rnd.choice(["the", "maison", "Straße", "x9", "%%%", "\n"]) for _ in range(rnd.randrange(400)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "long text " * 20000), (None, "no id"), (7, "again"), (7, "again"), (103, "<|endoftext|>")]
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_tokens int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with open(tokens.TOKENIZER, "rb") as f:
        encode = tokens.encoding(f.read()).encode_ordinary
    want = sorted(((d, len(encode(t or ""))) for d, t in docs), key=str)
    got = op9_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    ids, eod = tokens.write_flat(spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/flat")
    ids.write.parquet(f"{tmp_path}/ids")
    small = tokens.scan(tokens.flat_blocks(spark, f"{tmp_path}/flat", 64), eod)
    assert sorted(map(tuple, tokens.counts(small, spark.read.parquet(f"{tmp_path}/ids")).collect()), key=str) == want


def test_flat_files(spark):
    rnd = np.random.default_rng(0)
    for eod, kind in ((50256, np.uint16), (100000, np.uint32)):
        path, want = scratch(spark, "flat"), {}
        streams = []
        for n in range(4):
            lengths = [int(x) for x in rnd.choice([0, 0, 1, 5, 300], 20 * n)]
            stream = np.concatenate([np.append(rnd.integers(0, eod, k), eod) for k in lengths] + [rnd.integers(0, eod, 3 * (n % 2))]).astype(kind)
            streams.append(stream)
            starts = np.cumsum([0] + [k + 1 for k in lengths])[:-1].tolist() if lengths else []
            want[n] = [(i, s, k, True) for i, (s, k) in enumerate(zip(starts, lengths, strict=True))]
            if n % 2:
                want[n].append((len(lengths), len(stream) - 3, 3, False))
        import os

        os.makedirs(path.removeprefix("file:"), exist_ok=True)
        for n, stream in enumerate(streams):
            stream.tofile(f"{path.removeprefix('file:')}/s{n}.bin")
        for size in (8, 1000, 1 << 20):
            got = {}
            for r in tokens.scan(tokens.flat_blocks(spark, path, size), eod).collect():
                got.setdefault(int(r.file[-5]), []).append((r.ordinal, r.start, r.n_tokens, r.ended))
            assert {n: sorted(x) for n, x in got.items()} == {n: x for n, x in want.items() if x}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_token_counts(spark, str(tmp_path)).collect() == []
    assert tokens.scan(spark.createDataFrame([], "file string, block long, data binary"), 9).collect() == []
