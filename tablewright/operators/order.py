"""The order of rows. Tables have none of their own: operators that depend on it take `order_by`, columns whose values tell rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

def order_struct(order_by: str | list[str]) -> Column:
    names = [order_by] if isinstance(order_by, str) else order_by
    return F.struct(*[F.col(f"`{n}`") for n in names])


def ranged(df: DataFrame, order_by: str | list[str], name: str = "_range", place: str = "_within") -> DataFrame:
    """df with `name`, the number of the range of the order that a row falls into, and `place`, its place within from 0.

    There are as many ranges as partitions of a shuffle. Rows are kept as they fell, so that numbers agree however often
    they are read.
    """
    order = order_struct(order_by)
    at = F.monotonically_increasing_id()
    kept = durable(df.repartitionByRange(order).sortWithinPartitions(order).withColumn(name, at))
    return kept.withColumn(place, F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).withColumn(name, F.shiftright(name, 33))


def numbered(df: DataFrame, order_by: str | list[str], name: str = "_row") -> DataFrame:
    """df with `name`, each row's place from 0. No task holds all rows: to their places within ranges of the order the counts of
    the ranges before are added, a small table of one row a range."""
    placed = ranged(df, order_by)
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_range"))
    offsets = counts.select("_range", (upto - F.col("_n")).alias("_offset"))
    out = placed.join(F.broadcast(offsets), "_range")
    return out.withColumn(name, F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def runs(df: DataFrame, keys: list[str], order_by: str | list[str], name: str = "_run") -> DataFrame:
    """df with `name`, the number of the run of rows with equal keys, in order, that a row is in. Runs are told apart within ranges
    of the order; whether one goes on from a range to the next, the ranges' first and last keys say."""
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    rows_in_order = Window.partitionBy("_range").orderBy("_within")
    fresh = F.when(F.col("_within") > 0, ~key.eqNullSafe(F.lag(key).over(rows_in_order))).otherwise(F.lit(False)).cast("long")
    placed = ranged(df, order_by).withColumn("_fresh", fresh)
    ends = placed.groupBy("_range").agg(F.sum("_fresh").alias("_n"), F.min_by(key, "_within").alias("_first"), F.max_by(key, "_within").alias("_last"))
    ranges = Window.orderBy("_range")
    goes_on = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(ranges)), F.lit(False)) & F.lag("_range").over(ranges).isNotNull()
    ends = ends.withColumn("_begins", F.when(goes_on, 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_begins")).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_range", (before + F.col("_begins")).alias("_base"))
    counted = placed.withColumn("_upto", F.sum("_fresh").over(rows_in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = counted.join(F.broadcast(ends), "_range").withColumn(name, F.col("_base") + F.col("_upto"))
    return out.drop("_range", "_within", "_fresh", "_upto", "_base")


def window(group: list[str] | None, order_by: str | list[str]) -> Window:
    """Rows of a group in order; without groups all rows are one, which only small tables should be."""
    return Window.partitionBy(*(group or [])).orderBy(order_struct(order_by))
