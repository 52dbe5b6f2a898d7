"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobledger.session import materialise


def _min_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node that has a link.

    Each round is two joins on the node against its smallest neighbour: minima
    are combined before the shuffle and no list of neighbours is built, so a
    hub costs its rows only and adaptive execution may split it.  Rounds are
    cut by a table in the shared folder; only a count and a checksum of
    each reach the driver.  Null and equal ends are no links.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    pair = materialise(pair.distinct(), "links")
    seen = None
    while True:
        now = pair.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1_000_003)).first()
        if now == seen:
            return pair.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = pair.union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        itself = F.least(F.col("u"), F.col("m")).alias("m")
        low = _min_of(both).select("u", itself)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _min_of(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        pair = materialise(small, "links")
