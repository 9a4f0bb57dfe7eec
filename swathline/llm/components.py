"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge; the root is the smallest node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node near it; the number of
    rounds grows with the logarithm of the diameter. A hub is never gathered: minima are partial aggregates and the join
    back is one that the engine can split. Self loops and repeated edges are harmless; no edges give no rows.
    """
    pairs = stored(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null").distinct()
    )
    state = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u > v").distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        pairs = after
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
