"""Ordered operators that stay parallel when one key holds much of the data.

A plain window sorts all rows of a key in one task.  Here the order column is
cut into buckets, the window runs per (key, bucket), and only one summary row
per bucket goes through the per-key window, so a hot key spreads over as many
tasks as it has buckets.  The rows are shuffled and sorted once, by (key,
bucket); joining the summaries back reuses that partitioning.  Keys must not be
NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lag_struct(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
               columns: Sequence[str], name: str = "prev") -> DataFrame:
    """Add struct ``name`` with ``columns`` of the preceding row of the same keys.

    ``bucket`` must not decrease along ``order``.
    """
    keys_b = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    within = Window.partitionBy(*keys_b).orderBy(*order)
    last = rows.groupBy(*keys_b).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(*keys_b, F.lag("_last").over(across).alias("_carry"))
    inner = rows.withColumn("_lag", F.lag(F.struct(*columns)).over(within))
    return (inner.join(carried, keys_b, "left")
            .withColumn(name, F.coalesce("_lag", "_carry"))
            .drop("_lag", "_carry", "_bucket"))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                  value: Column, name: str, descending: bool = False,
                  how: str = "sum") -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` per keys along ``order``.

    ``bucket`` follows the order, downwards when ``descending``.
    """
    keys_b = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    merge = F.sum if how == "sum" else F.max
    to_here = (Window.partitionBy(*keys_b).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, 0))
    along = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = (Window.partitionBy(*keys).orderBy(along)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (rows.groupBy(*keys_b).agg(merge("_value").alias("_part"))
               .select(*keys_b, merge("_part").over(before).alias("_offset")))
    inner = rows.withColumn("_running", merge("_value").over(to_here))
    joined = inner.join(offsets, keys_b, "left")
    total = (F.col("_running") + F.coalesce("_offset", F.lit(0)) if how == "sum"
             else F.greatest("_running", "_offset"))
    return joined.withColumn(name, total).drop("_bucket", "_value", "_running", "_offset")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  position: str | None = None) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark limit each group before the shuffle, so a
    hot group sends at most ``k`` rows per input task.
    """
    name = position or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if position else kept.drop(name)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a table counted to have at most ``rows`` rows, else no hint.

    Over a plain scan the count stops at the limit.  Over an aggregate or a ``distinct()`` it
    is computed in full, once more in the query; give it a checkpointed table there.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
              hot_rows: int = 5_000_000, splits: int = 64, broadcast: bool = True) -> DataFrame:
    """Equi-join whose hot keys in ``big`` are spread over ``splits`` tasks each.

    A key is hot when it has more than ``hot_rows`` rows, so there are at most
    ``rows / hot_rows`` of them and their table is safe to broadcast.  Rows of
    ``small`` are copied only for the hot keys.  Unlike run-time skew handling
    this also holds when an aggregate on the same key follows.  Rows are spread by
    a hash of their columns (maps have none), which a recomputed task repeats.
    ``broadcast=False`` keeps both sides off the driver, for sides whose size Spark can only guess.
    """
    hot = (big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
           .select(*on, F.lit(True).alias("_hot")))
    hashed = [F.col(f"`{f.name}`") for f in big.schema if "map<" not in f.dataType.simpleString()]
    scatter = F.pmod(F.xxhash64(*hashed), F.lit(splits)).cast("int")
    left = (big.join(F.broadcast(hot), list(on), "left")
            .withColumn("_salt", F.when(F.col("_hot"), scatter).otherwise(F.lit(0)))
            .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(
        F.array(F.lit(0)))
    right = (small.join(F.broadcast(hot), list(on), "left")
             .withColumn("_salt", F.explode(copies)).drop("_hot"))
    if not broadcast:
        left, right = left.hint("merge"), right.hint("merge")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
