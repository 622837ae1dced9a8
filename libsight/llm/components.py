"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on node ids; a node with very many neighbours is
one row of the minima, and its edges stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from libsight.llm.scratch import Scratch


def components(edges: DataFrame, keep: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` for every node of an edge; ``comp`` is the least node of its component.

    Ids are bigints without nulls; loops and repeated edges do no harm.
    """
    def facts(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .where("u <> v").distinct())
    state = facts(pairs)
    while state[0]:
        # large star: neighbours above a node move to the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # edges towards the least neighbour itself stay as they are
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small star: a node and its lower neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))).distinct()
        pairs = keep(small)
        now = facts(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
