"""Connected components of a link table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (u, v: long) with the least node reachable from it.

    Each round hangs all neighbours of a node under its least neighbour; rounds grow with the logarithm of the longest
    chain. Rounds end in reliable checkpoints, so neither lineage nor a lost executor makes them start again. A hub's links
    are pre-aggregated by task before they meet, and its join is one that Spark can split.
    """
    now = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("l")).select("l.*")
        now = cut_lineage(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
