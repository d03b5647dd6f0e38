"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source has a target number of words. With ratio = target / words of the source, every document gets floor(ratio)
certain copies. What is left of the target goes to one more copy of some documents, whose inclusion probabilities are
proportional to their sizes: rate x size, with a rate of the source such that the words expected are the words left.
Documents whose probability would reach 1 get a certain copy, and the rate is that of the words left to the others. Those are
ranked by Q = odds(u) / odds(probability), u being a fixed random number of the document, and the lowest ranks are
taken until the words, which are the fixed size of the sample, are nearest to what is left.

The cut through the ranks is found by three levels of 128 rank buckets a source, so no task ever orders a source.

Defined cases: a null text has no words and takes none; a null source is a source of its own, the last in order; rows
equal in doc_id and text share one random number, so they are taken or left together; an empty table gives an empty
result; columns of the input other than doc_id, text and source are ignored by `mix_plan` and carried by `mix_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, few

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (3.0, 1.0, 2.0)
#: Words of the whole mix, in words of the input.
TOTAL = 1.5
#: Copies of a document at most.
MOST = 2.0
#: Rank buckets a level, and levels.
FAN, LEVELS = 128, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A number in (0, 1) that depends on doc_id, text and seed alone: 48 bits of an MD5."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, cycle: Sequence[float] = CYCLE, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> also target, whole (certain copies) and rest (words left to one more).

    Weights repeat the cycle over the sources by code point, null last. Targets above `most` times the source are
    cut to that and the excess is shared by weight among the others: with sources by cap/weight ascending, a source
    is capped while its cap is within its share of what the ones before it left. One row a source: a small table.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    t = sizes.withColumn("weight", F.element_at(weights, (place + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole_table = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(total) * F.sum(F.col("source_size").cast("double")).over(whole_table) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(whole_table) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("share", share).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("share"))
    level = F.max(F.when(~F.col("capped"), F.col("share"))).over(whole_table)
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("whole", F.floor(ratio).cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size").cast("double")
    return t.select("source", "source_size", "target", "whole", rest.alias("rest"))


def source_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows(source, size, ..), targets(source, rest) -> (source, sure, rate, rest) of the sources that have words left.

    Documents of more than `sure` words get one more copy for certain, others with a probability of rate x size; `rest` is what
    the certain ones leave. Sizes are taken from the largest: all above are certain if the rate without them keeps
    this one below 1. A source has no more distinct sizes than its longest text has words, so these are few rows.
    """
    size = F.col("size")
    sizes = rows.filter("size > 0").groupBy("source", "size").agg(F.sum("size").alias("words"), F.sum((size * size).cast("decimal(20,0)")).alias("squares"))
    t = targets.filter("rest > 0").select(F.col("source").alias("t_source"), F.col("rest").alias("t_rest"))
    sizes = sizes.join(few(t), F.col("source").eqNullSafe(F.col("t_source")))
    by = Window.partitionBy("source")
    larger = F.coalesce(F.sum("words").over(by.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum("squares").over(by.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("left", F.col("t_rest") - larger).withColumn("rate", F.col("left") / squares.cast("double"))
    fits = F.max(F.when(F.col("rate") * size < 1, F.struct("size", "rate", "left")))
    out = sizes.groupBy("source").agg(fits.alias("f"))
    return out.select("source", F.coalesce("f.size", F.lit(0)).cast("long").alias("sure"), F.coalesce("f.rate", F.lit(0.0)).alias("rate"), F.coalesce("f.left", F.lit(0.0)).alias("rest"))


def pareto_rank(u: Column, chance: Column) -> Column:
    """Q / (1 + Q) with Q = odds(u) / odds(chance): Pareto's order, mapped into (0, 1)."""
    q = (u / (1.0 - u)) / (chance / (1.0 - chance))
    return q / (1.0 + q)


def _cuts(ranked: DataFrame) -> DataFrame:
    """ranked(source, size, rank, rest) -> (source, cut): ranks up to the cut take words nearest to rest."""
    cell = F.least(F.floor(F.col("rank") * float(FAN**LEVELS)), F.lit(FAN**LEVELS - 1)).cast("long")
    rows = ranked.select("source", "size", "rank", "rest", cell.alias("cell"))
    by_source = Window.partitionBy("source")
    inside = None
    for level in range(LEVELS):
        here = rows.withColumn("bucket", F.floor(F.col("cell") / float(FAN ** (LEVELS - 1 - level))).cast("long"))
        if inside is None:
            here = here.withColumn("base", F.lit(0).cast("long"))
        else:
            up = inside.select(F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"), "base")
            here = here.join(up, F.col("source").eqNullSafe(F.col("in_source")) & (F.floor(F.col("bucket") / float(FAN)) == F.col("in_bucket")))
        sums = here.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        upto = F.col("base") + F.sum("words").over(by_source.orderBy("bucket"))
        sums = sums.withColumn("upto", upto)
        # the bucket in which the words first reach the rest; the last one if none does
        found = F.min(F.struct((F.col("upto") < F.col("rest")).alias("short"), F.when(F.col("upto") < F.col("rest"), -F.col("bucket")).otherwise(F.col("bucket")).alias("at"), "bucket", (F.col("upto") - F.col("words")).alias("base")))
        inside = sums.groupBy("source").agg(found.alias("f")).select("source", F.col("f.bucket").alias("bucket"), F.col("f.base").alias("base"))
    up = inside.select(F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"), "base")
    last = rows.join(up, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("cell") == F.col("in_bucket")))
    ties = last.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    ties = ties.withColumn("upto", F.col("base") + F.sum("words").over(by_source.orderBy("rank")))
    before = F.col("upto") - F.col("words")
    taken = (F.col("upto") <= F.col("rest")) | ((before < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - before))
    at = ties.groupBy("source").agg(F.max(F.when(taken, F.col("rank"))).alias("cut"), F.min("rank").alias("least"))
    # none taken in the last cell: all ranks of the cells before it, none of this one
    return at.select("source", F.coalesce(F.col("cut"), F.col("least") * (1.0 - 2.0**-50)).alias("cut"))


def plan(rows: DataFrame, cycle: Sequence[float] = CYCLE, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """rows(source, size, u), narrow and cheap to read again -> one row a source: source_size, target, whole, sure, rate, cut."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, cycle, total, most))
    rates = durable(source_rates(rows, targets))
    t = rates.select(F.col("source").alias("t_source"), "sure", "rate", "rest")
    ranked = rows.join(few(t), F.col("source").eqNullSafe(F.col("t_source"))).filter("size > 0 and size <= sure")
    cuts = _cuts(ranked.select("source", "size", pareto_rank(F.col("u"), F.col("rate") * F.col("size")).alias("rank"), "rest"))
    rates = rates.select(F.col("source").alias("r_source"), "sure", "rate")
    cuts = cuts.select(F.col("source").alias("c_source"), "cut")
    out = targets.join(rates, F.col("source").eqNullSafe(F.col("r_source")), "left").join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return durable(out.drop("rest", "r_source", "c_source"))


def copies(u: Column, size: Column) -> Column:
    """Copies of a row joined with its source's plan; without a rate a source has no words left."""
    drawn = (size <= F.col("sure")) & (F.col("rate") > 0) & (pareto_rank(u, F.col("rate") * size) <= F.col("cut"))
    extra = F.coalesce((size > F.col("sure")) | drawn, F.lit(False))
    return F.when(size > 0, F.col("whole") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long")


def mix_plan(docs: DataFrame, cycle: Sequence[float] = CYCLE, total: float = TOTAL, most: float = MOST, seed: str = "") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    text = F.col("text")
    rows = durable(docs.select("doc_id", "source", word_count(text).alias("size"), uniform(F.col("doc_id"), text, seed).alias("u")))
    p = few(plan(rows, cycle, total, most)).withColumnRenamed("source", "p_source")
    out = rows.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", copies(F.col("u"), F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, cycle: Sequence[float] = CYCLE, total: float = TOTAL, most: float = MOST, seed: str = "") -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, with the columns of docs."""
    text = F.col("text")
    rows = durable(docs.select("source", word_count(text).alias("size"), uniform(F.col("doc_id"), text, seed).alias("u")))
    p = F.struct("source_size", "target", "whole", "sure", "rate", "cut")
    p = plan(rows, cycle, total, most).select(F.col("source").alias("_mix_source"), p.alias("_mix_plan"))
    named = docs.select(F.struct(*docs.columns).alias("_mix_row"))
    row = F.col("_mix_row")
    joined = named.join(few(p), row["source"].eqNullSafe(F.col("_mix_source"))).select("_mix_row", "_mix_plan.*")
    n = copies(uniform(row["doc_id"], row["text"], seed), word_count(row["text"]))
    out = joined.select("_mix_row", n.alias("_mix_n")).filter("_mix_n > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
    return out.select("_mix_row.*")
