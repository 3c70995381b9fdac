"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hint_cleaning


def dealt_anew(df: DataFrame) -> DataFrame:
    """The same rows behind a shuffle of their own, so that a join on them can split a hot key of the other side.

    Spark splits skewed partitions only of joins that read two plain shuffles, not of those that reuse an aggregate's.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: (a, b) of longs, in any direction, repeats and loops allowed. Returns (node, component), the least node reachable.

    Nodes without an edge to another node don't appear. Each star sends a row per edge, and the hub's minimum
    comes from a pre-aggregated table, so no task holds a hub's neighbours.
    """
    now = cut(_pairs(edges, "a", "b"))
    stamp = None
    for _ in range(most_rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = dealt_anew(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = _pairs(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u"), "v", "m")
        down = dealt_anew(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(down, "hi")
        now = cut(_pairs(small.select("hi", "m").union(small.select(F.col("lo"), "m")), "hi", "m"))
        del both, least, large, down, small
        hint_cleaning(edges.sparkSession)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if seen == stamp:
            break
        stamp = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
