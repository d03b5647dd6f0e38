import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, sharding
from tablewright.llm.queries import op2_source_mixing, op3_rendezvous_sharding


def water_fill(sizes):
    """Targets by repeated capping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), "a" if i % 3 else f"s{i % 5}") for i in range(600)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \t\n", None), (903, "two words", None), (7, "same", "s1"), (7, "same", "s1"), (None, "no id", "a"), (904, "x\x1cy z" * 400, "a")]
    rows += [(1000, "hot row here", "hot")] * 40
    path = str(tmp_path_factory.mktemp("mix"))
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, size double")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_mix(spark, docs_dir):
    path, rows = docs_dir
    got = op2_source_mixing(spark, path).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = water_fill(totals)
    by_id = {(d, size(t)): s for d, t, s in rows}
    taken = dict.fromkeys(totals, 0)
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == totals[s] and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= (400 if s == "a" else 120), s
    assert sorted(map(str, op2_source_mixing(spark, path).collect())) == sorted(map(str, got))
    mixed = mixing.mix_rows(spark.read.parquet(f"{path}/documents.parquet"))
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())


def test_shards(spark, docs_dir):
    path, rows = docs_dir
    got = op3_rendezvous_sharding(spark, path).collect()
    assert len(got) == len(rows)
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)


def test_shards_match_brute_force(spark, docs_dir):
    """The highest of -1 / ln(u) over the shards; u from the 64-bit hash of (doc_id, shard, seed) that Spark's SQL gives."""
    path, rows = docs_dir
    ids = sorted({d for d, _, _ in rows if d is not None})
    frame = spark.createDataFrame([(d, i) for d in ids for i in range(9)], "d long, i int")
    u = {(r.d, r.i): ((r.h % 2**64 >> 11) + 0.5) / 2**53 for r in frame.selectExpr("d", "i", "xxhash64(d, i, 0) h").collect()}
    best = lambda d, n: max(range(n), key=lambda i: (-1 / math.log(u[d, i]), -i))
    got = op3_rendezvous_sharding(spark, path)
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (best(r.doc_id, 8), best(r.doc_id, 9))
    again = sharding.shard_slots(spark.read.parquet(f"{path}/documents.parquet").repartition(7), [1.0] * 8)
    assert sorted(map(str, again.select("doc_id", "text_crc32", "slot").collect())) == sorted(map(str, got.select("doc_id", "text_crc32", "slot").collect()))


def test_pareto_inclusion_frequencies(spark):
    """In many like sources a document is drawn about as often as its probability says, which differs within a source."""
    sizes, sources = [1 + i % 7 * 3 for i in range(70)], 60
    docs = spark.createDataFrame([(k * 70 + i, " ".join(["w"] * n), f"s{k:02}") for k in range(sources) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mix_plan(docs, cycle=(1.0,), total=1.3).collect()
    rest = 0.3 * sum(sizes)
    rate, drawn = rest / sum(s * s for s in sizes), {}
    for r in got:
        drawn.setdefault(r.size, []).append(r.copies - 1)
    for s, x in drawn.items():
        assert set(x) <= {0, 1} and abs(sum(x) / len(x) - rate * s) < 0.06, (s, sum(x) / len(x), rate * s)
    assert sum(r.taken for r in got) / sources == pytest.approx(1.3 * sum(sizes), abs=6)
    other = mixing.mix_plan(docs, cycle=(1.0,), total=1.3, seed="x").collect()
    assert sorted((r.doc_id, r.copies) for r in other) != sorted((r.doc_id, r.copies) for r in got)


def test_certain_copies(spark):
    """A document too large for its probability is taken for certain, and the rest of the words goes to the others."""
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(100)] + [(200, "w " * 900, "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_plan(docs, total=0.7).collect()}
    assert got[200].copies == 1 and sum(r.taken for r in got.values()) == pytest.approx(0.7 * 1900, abs=5)


def test_weighted_shards_follow_weights_and_move_little(spark):
    keys = spark.range(20000).withColumn("shard", F.lit("clash"))
    two = {r.id: r.shard for r in sharding.shard_rows(keys, [1.0, 3.0], "id").collect()}
    assert 0.73 < sum(two.values()) / len(two) < 0.77
    three = {r.id: r.shard for r in sharding.shard_rows(keys, [1.0, 3.0, 4.0], "id").collect()}
    assert all(three[k] in (two[k], 2) for k in two) and 0.48 < sum(v == 2 for v in three.values()) / len(two) < 0.52


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op2_source_mixing(spark, str(tmp_path)).collect() == [] == op3_rendezvous_sharding(spark, str(tmp_path)).collect()
    assert mixing.mix_rows(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() == []
