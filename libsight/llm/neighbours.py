"""Global order without one global task: rows dealt to ordered ranges, ends shared.

Ranges are cut at quantiles of the order key.  The quantiles only place rows; neighbours are
exact because every range also gets the first row of the next non-empty range, and the last
row of the one before.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The most ranges there are; bounds what the driver and the broadcast ends hold.
MOST_RANGES = 20_000


def _cuts(keys: DataFrame, ranges: int) -> list:
    """About ``ranges - 1`` distinct keys that cut the rows evenly; at most MOST_RANGES."""
    ranges = min(ranges, MOST_RANGES)
    kind = keys.schema[0].dataType.simpleString()
    if kind == "bigint":
        got = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5],
                                           20 * ranges)).first()[0]
        return sorted(set(got or []))
    # other types: the keys with the least hashes, a bounded and fixed sample
    sample = (keys.distinct().orderBy(F.xxhash64("key"), "key").limit(20 * ranges)
              .select("key").collect())
    listed = sorted(row[0] for row in sample)
    return sorted({listed[len(listed) * i // ranges] for i in range(1, ranges)}) if listed else []


def deal(df: DataFrame, key: Column, order: list[Column], payload: list[str], ranges: int,
         before: bool = False, wrap: bool = False) -> DataFrame:
    """Rows of ``df`` in partitions sorted by (``_range``, ``order``), with shared ends.

    ``key`` leads the order, is not null, and is a bigint or a string of which rows with equal
    values stay in one range.  Output: ``payload`` columns, ``_range`` and ``_own`` (false: the
    row belongs to a neighbouring range and is here for its neighbours only).  ``before`` shares
    last rows as well.  ``wrap``: the last range also gets the first row of all.
    """
    keyed = df.withColumn("key", key)
    cuts = _cuts(keyed.select("key"), ranges)

    @F.pandas_udf("bigint")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int64")

    ranged = keyed.withColumn("_range", place("key") if cuts else F.lit(0).cast("bigint"))
    # ends of each range by the whole order; one row per range comes to the driver
    span = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ends = sorted((row["_range"], row["first"], row["last"]) for row in ranged.groupBy("_range").agg(
        F.min(span).alias("first"), F.max(span).alias("last")).collect())
    n = len(ends)
    spread = F.array(F.struct(F.col("_range").alias("r"), F.lit(True).alias("own"), F.lit(0).alias("late")))
    extra = []
    if n:
        numbers = [e[0] for e in ends]
        back = {numbers[i]: numbers[i - 1] for i in range(n) if i or wrap}
        ahead = {numbers[i]: numbers[i + 1] for i in range(n - 1)}
        extra.append((ends, 1, back))
        if before:
            extra.append((ends, 2, ahead))
    for rows, at, to in extra:
        table = df.sparkSession.createDataFrame(
            [(e[0], e[at], to[e[0]]) for e in rows if e[0] in to] or [],
            ranged.select(F.col("_range").alias("_r"), span.alias(f"_e{at}"),
                          F.lit(0).cast("bigint").alias(f"_t{at}")).schema)
        ranged = ranged.join(F.broadcast(table), F.col("_range") == F.col("_r"), "left").drop("_r")
        spread = F.concat(spread, F.when(span == F.col(f"_e{at}"), F.array(
            F.struct(F.col(f"_t{at}").alias("r"), F.lit(False).alias("own"),
                     (F.lit(at == 1) & (F.col(f"_t{at}") >= F.col("_range"))).cast("int").alias("late"))))
            .otherwise(F.array()))
    dealt = ranged.withColumn("_to", F.explode(spread))
    names = [f"_o{i}" for i in range(len(order))]
    return (dealt.select(F.col("_to.r").alias("_range"), F.col("_to.own").alias("_own"), *payload,
                         F.col("_to.late").alias("_late"),
                         *[c.alias(name) for name, c in zip(names, order)])
            .repartition(max(1, ranges), "_range").sortWithinPartitions("_range", "_late", *names)
            .drop("_late", *names))
