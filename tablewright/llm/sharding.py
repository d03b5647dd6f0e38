"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard of the highest score -weight / ln(u), u being a hash of key and shard number. Scores of
other shards never change, so one more shard takes records only into itself, and each shard's part of the records
follows its weight.

Defined cases: of shards with equal scores the first is taken; a null key is a key of its own; repeated rows go to one shard, with a slot each; a null text has size
1 and checksum 0; an empty table gives an empty result; other columns are ignored by `shard_slots` and carried by
`shard_rows`, which replaces a column of the name it adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Blocks a shard in which slots are numbered; the table of their offsets has at most shards x BLOCKS rows.
BLOCKS = 1024
#: Copies of a row that are listed at a time.
COPIES = 4096


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard, 0 to len(weights) - 1, of a key."""

    def score(w: Column, i: Column) -> Column:
        h = F.xxhash64(key, i, F.lit(seed))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-w / F.log(u)).alias("score"), (-i).alias("at"))

    best = F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), score))
    return (-best["at"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard", seed: int = 0) -> DataFrame:
    """docs with their shard. One pass, no shuffle."""
    return docs.withColumn(name, rendezvous(F.col(key), weights, seed))


def shard_slots(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots are numbered within blocks of a shard, to which offsets from the blocks' counts are added. Equal rows are counted
    first, so that a row of very many copies doesn't meet in one task: it is numbered once and takes that many slots.
    A row's block depends on doc_id and text alone, and rows of a block are ordered by these, so slots are the same
    however the input is split.
    """
    key = F.col("doc_id")
    more = rendezvous(key, grown, seed) if grown else F.lit(None).cast("int")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("th"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "th").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("doc_id", "th"), F.lit(BLOCKS)).cast("int").alias("block")
    rows = durable(rows.select("*", rendezvous(key, weights, seed).alias("shard"), more.alias("grown_shard"), block))
    counts = rows.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("block"))
    offsets = counts.select("shard", "block", (upto - F.col("n")).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "th")) - F.col("n")
    placed = rows.withColumn("place", inside).join(F.broadcast(offsets), ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("place"))
    # copies in two steps, so that no list is longer than COPIES or one COPIES-th of them
    zero = F.lit(0).cast("long")
    several = placed.filter("n > 1").withColumn("low", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(COPIES).cast("long"))))
    several = several.withColumn("copy", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + COPIES, F.col("n")) - 1)))
    out = placed.filter("n = 1").withColumn("copy", zero).unionByName(several.drop("low"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")
