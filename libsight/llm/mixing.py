"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size.
Its whole part is certain; its fractional part is a probability.  Pairs of documents pass
word mass to each other at random until one probability is 0 or 1, so a source's words are
kept exactly up to a single open document.  Pairing runs in leaves of bounded size; the
leaves' open documents meet in the next level of a tree, until one is left per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from libsight.llm.texts import n_words
from libsight.session import cut_lineage, ship

#: Rows a leaf of the tree pairs, and leaves that meet in one node of the next level.
LEAF_ROWS, FAN = 4096, 64
#: The table of sources is broadcast up to this number of rows, counted first.
BROADCAST_SOURCES = 20_000


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Words each source shall give: column ``target`` for ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all
    sizes; none gets more than ``cap`` times its size, and what is above is shared again by
    weight.  That fixed point is min(cap * size, level * weight) for the one level at which
    the targets add up; sorted by cap * size / weight, the capped sources come first.
    One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    limit = F.lit(float(cap)) * F.col("source_size")
    by_limit = Window.orderBy((limit / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if exactly the sources before this one are capped; the first of them that leaves
    # this one uncapped is right, and later ones are lower
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    return (sources.withColumn("_weight", weight).withColumn("_level", level)
            .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") <= limit,
                                               F.col("_level"))).over(everything))
            .withColumn("target", F.least(limit, F.col("_level") * F.col("_weight")))
            .drop("_weight", "_level"))


def _unit(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the row."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11),
                  F.lit(1 << 53)) / F.lit(float(1 << 53))


_MASK = (1 << 64) - 1


def _coin(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) fixed by two items and the seed."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93 + seed) & _MASK
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * factor) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


_ROUNDED = "item bigint, node bigint, chance double, mass double, draw double, copy int"


def _pair_level(rows: DataFrame, seed: int) -> DataFrame:
    """Pair the open rows of each (source, node); at most one stays open (``copy`` null).

    Rows stream through from the longest down, so that the one left open tends to be short;
    only the open one is held.
    """
    ordered = (rows.repartition("source", "node")
               .sortWithinPartitions("source", "node", F.desc("mass"), "draw", "item")
               .select("source", "item", "node", "chance", "mass", "draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None  # held: source, item, node, chance, mass, draw

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0], row[2]) != place or place is None:
                    if held is not None:
                        out.append((*held, None))
                    place, held = (row[0], row[2]), row
                    continue
                source, item, node, p, m, draw = row
                _, h_item, h_node, q, w, h_draw = held
                give = min((1 - q) * w, p * m)   # to the held row
                take = min(q * w, (1 - p) * m)   # from the held row
                if _coin(h_item, item, seed) * (give + take) < take:
                    held_done, this_done = (1 - q) * w <= p * m, p * m <= (1 - q) * w
                    q, p = q + give / w, p - give / m
                    q, p = (1.0 if held_done else q), (0.0 if this_done else p)
                else:
                    held_done, this_done = q * w <= (1 - p) * m, (1 - p) * m <= q * w
                    q, p = q - take / w, p + take / m
                    q, p = (0.0 if held_done else q), (1.0 if this_done else p)
                held = None
                for one, done in (((source, h_item, h_node, q, w, h_draw), held_done),
                                  ((source, item, node, p, m, draw), this_done)):
                    if done:
                        out.append((*one, int(one[3])))
                    else:
                        held = one
                if held is None:
                    place = None
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([(*held, None)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(),
                 pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)],
            names=["source", "item", "node", "chance", "mass", "draw", "copy"])

    return ordered.mapInArrow(run, "source string, " + _ROUNDED)


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0,
        seed: int = 17, size: Column | None = None, leaf_rows: int = LEAF_ROWS,
        wording: Column | None = None) -> DataFrame:
    """Copies of every document: ``doc_id, source, size, n_rows, source_size, target, copies, extra``.

    One row per distinct (doc_id, source, size) with its number of rows ``n_rows``: each of
    those rows is taken ``copies`` times, and ``extra`` of them (below ``n_rows``) once more, so
    ``copies * n_rows + extra`` documents together.  Rows are rounded, not groups: the whole part
    of a group's sum is certain, and one row of it takes part in the pairing.  A source's words
    differ from its target by less than its largest document.  ``size`` defaults to the words of
    ``text``, 0 for a null; very long texts count whole.  ``wording``, a hash of the text for instance,
    tells documents of equal id, source and size apart and is returned as a column.  Rows of size 0
    carry no words and are rounded on their own, at their source's rate (0 where the source has no
    words).  Null sources are a source, null doc_ids are equal to each other.  Results depend
    only on rows and ``seed``, not on their order or partitioning.  The table of sources passes
    through one task (``targets``).  Empty input: no rows.
    """
    ship(documents.sparkSession)
    told = [] if wording is None else ["wording"]
    items = cut_lineage(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("source").cast("string").alias("source"),
                         (n_words() if size is None else size.cast("bigint")).alias("size"),
                         *([] if wording is None else [wording.cast("bigint").alias("wording")]))
        .groupBy("doc_id", "source", "size", *told).agg(F.count("*").alias("n_rows"))
        .withColumn("item", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.isnull("doc_id"), "size",
                                       F.coalesce("source", F.lit("")), F.isnull("source"), *told)))
    totals = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("_items"))
    plan = targets(totals, weights, cap)
    most, n_sources = totals.agg(F.max("_items"), F.count("*")).first()
    plan = plan.withColumnRenamed("source", "_source")
    keyed = (items.join(F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan,
                        F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
             .withColumn("_rate", F.coalesce(F.col("target") / F.when(
                 F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
             .withColumn("_sure", F.floor("_rate").cast("int"))
             .withColumn("_more", (F.col("_rate") - F.col("_sure")) * F.col("n_rows"))
             .withColumn("_extra", F.floor("_more"))
             .withColumn("chance", F.col("_more") - F.col("_extra"))
             .withColumn("mass", F.col("size").cast("double"))
             .withColumn("draw", _unit(F.col("item"), seed=seed))
             .withColumn("node", F.floor(F.col("draw") * F.ceil(F.col("_items") / F.lit(leaf_rows)))))
    paired = (F.col("chance") > 0) & (F.col("mass") > 0)
    levels = 1 + (math.ceil(math.log(max(1, math.ceil(most / leaf_rows)), FAN)) if most else 0)

    open_rows = keyed.where(paired).select(
        F.coalesce("source", F.lit("")).alias("source"), F.isnull("source").alias("_null"),
        "item", "node", "chance", "mass", "draw")
    # a null source must not meet a source named like its stand-in
    open_rows = open_rows.withColumn(
        "source", F.concat(F.when(F.col("_null"), F.lit("n")).otherwise(F.lit("s")), "source")).drop("_null")
    decided = None
    for level in range(levels):
        rounded = cut_lineage(_pair_level(open_rows, seed))
        done = rounded.where("copy is not null").select("item", "copy")
        decided = done if decided is None else decided.unionByName(done)
        open_rows = (rounded.where("copy is null").drop("copy")
                     .withColumn("node", F.floor(F.col("node") / FAN)))
    last = open_rows.select("item", (F.col("draw") * F.lit(7919.0) % 1 < F.col("chance"))
                            .cast("int").alias("copy"))
    alone = _unit(F.col("item"), seed=seed + 1) < F.col("chance")
    rounded = keyed.join(decided.unionByName(last).groupBy("item").agg(F.max("copy").alias("copy")), "item", "left")
    extra = F.col("_extra") + F.when(paired, F.col("copy")).otherwise(alone.cast("int"))
    # a group whose every row is taken once more has no extra rows left
    return (rounded.withColumn("_all", extra >= F.col("n_rows")).select(
        "doc_id", "source", "size", *told, "n_rows", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("_sure") + F.col("_all").cast("int")).cast("bigint").alias("copies"),
        F.when(F.col("_all"), F.lit(0)).otherwise(extra).cast("bigint").alias("extra")))
