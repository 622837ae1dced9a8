"""Substring matching between two tables as an equi-join.

Every pattern is filed under the piece of ``size`` characters that fewest texts hold, every
text offers the pieces that any pattern has, and matches are verified as text.  Only a text's
hash travels with its pieces; the text itself is fetched for candidates.  No pair is formed
without a shared piece, so there is no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pieces(c: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; empty for shorter texts."""
    last = F.length(c) - (size - 1)
    every = F.transform(F.sequence(F.lit(1), last), lambda i: c.substr(i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
                  size: int = 3, shortest: int = 1) -> DataFrame:
    """Pairs of rows where ``text`` contains ``pattern``.

    Patterns shorter than ``size`` are matched under pieces of their own length;
    none may be shorter than ``shortest``.
    """
    keyed, out = texts.withColumn("_key", F.xxhash64(text)), None
    for n in range(shortest, size + 1):
        fits = F.length(pattern) == n if n < size else F.length(pattern) >= n
        some = patterns.where(fits)
        grams = some.select(F.col(pattern).alias("_p")).distinct().select(
            "_p", F.explode(pieces(F.col("_p"), n)).alias("_gram"))
        wanted = grams.select("_gram").distinct()
        offered = (keyed.select("_key", F.explode(pieces(F.col(text), n)).alias("_gram"))
                   .join(wanted, "_gram", "left_semi"))
        held = offered.groupBy("_gram").agg(F.count("*").alias("_n"))
        # a pattern with a piece that no text holds is nowhere
        anchors = (grams.join(held, "_gram", "left").groupBy("_p")
                   .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_least"))
                   .where("_least.n > 0").select("_p", F.col("_least._gram").alias("_gram")))
        pairs = offered.join(anchors, "_gram").select("_key", "_p").distinct()
        found = (keyed.join(pairs, "_key").where(F.contains(F.col(text), F.col("_p")))
                 .join(some, F.col(pattern) == F.col("_p")).drop("_p", "_key"))
        out = found if out is None else out.unionByName(found)
    return out
