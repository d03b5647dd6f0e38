"""Groups of unbounded size, cut into tiles so that all pairs of a group can be compared in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, few


def tiled(met: DataFrame, keys: list[str], item: str, salt: Column, tile: int) -> DataFrame:
    """met(keys, item) -> (keys, tiles): for each group of at least two items either its one tile, or each pair of its tiles.

    A tile is an array of about `tile` items at most, a row holds one or two: comparing within a single tile and across
    the two of a pair meets every pair of the group once. A pair's own tiles are paired with themselves, as one tile.
    Items are dealt to tiles by the hash `salt`; the groups' counts come from an aggregate with map-side sums.
    """
    counts = durable(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    met = met.join(few(counts), keys)
    cut = F.ceil(F.col("_n") / float(tile)).cast("int").alias("_cut")
    met = met.select(*keys, item, cut, F.pmod(salt, cut).cast("int").alias("_tile"))
    tiles = met.groupBy(*keys, "_cut", "_tile").agg(F.collect_list(item).alias("_items"))
    alone = tiles.filter("_cut = 1").select(*keys, F.array("_items").alias("tiles"))
    partner = F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)).alias("_partner")
    cuttings = tiles.filter("_cut > 1").select(*keys, "_tile", "_items", partner)
    pair = (F.least("_tile", "_partner").alias("_low"), F.greatest("_tile", "_partner").alias("_high"))
    return alone.union(cuttings.groupBy(*keys, *pair).agg(F.collect_list("_items").alias("tiles")).select(*keys, "tiles"))
