"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds `shard`.

Defined cases: as in the operators. A null or empty text is scored like any, is one class of near duplicates of which one stays,
holds no benchmark item of words, takes no part in the mix as it has no words; a null source is a source, a null doc_id is kept
and is the last of its class; rows repeated are one class; a very long text is handled whole; an empty table passes all stages
empty; further columns are carried by all stages, but for one named `shard`, which the last replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontamination, mixing, nearcopies, quality, sharding
from tablewright.llm.durable import remove, scratch

SHARDS = 8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by SimHash fingerprints within 2 bits, or by a Jaccard similarity of 0.8 of their 5-word
    shingles, that of the smallest doc_id."""
    return nearcopies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inside=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.shard_rows(docs, [1.0] * SHARDS)


STAGES = [
    ("quality_cotraining", good_quality),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("rendezvous_sharding", sharded),
]

#: SQL can express neither the classifier nor XXH64; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's result written to shared storage and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # all that was read from it is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
