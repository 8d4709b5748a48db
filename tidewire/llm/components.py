"""Connected components of a graph given as links, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import materialise

MOST_ROUNDS = 60


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node that its component reaches.

    Alternates the large-star and small-star steps until nothing changes. Each step groups links by a
    node to find its smallest neighbour and joins it back, so a node with very many links is a skewed
    join that Spark splits, never one row. Steps are written to shared storage to cut lineage. Links
    that are null at one end, or from a node to itself, are left out.
    """
    links = materialise(links.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for k in range(MOST_ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialise(moved.distinct(), f"{name}-{k + 1}")
        was, now = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, after))
        links = after
        if tuple(was) == tuple(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
