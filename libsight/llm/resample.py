"""Resampling towards a target: hashed n-gram weights, random keys, exact ranks by regular sampling.

Every feature falls into one of a fixed number of buckets; a bucket's gain says how much likelier
it is in the target than in the corpus.  A document's weight is the sum of its gains, and a random
Gumbel number on top makes the highest scores a draw without replacement.

The highest scores are found by parallel sorting by regular sampling.  Scored rows are written as
locally sorted runs; every so many rows of a run one is a sample, and regular samples of all
samples cut the order into ranges.  Each row finds its range, the ranges' sizes add up to offsets,
and only ranges that reach into the drawn rows are exchanged, sorted and numbered from their
offset.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from libsight.llm.scratch import Scratch
from libsight.llm.terms import AlnumBlock, run_checksums
from libsight.llm.texts import text_of
from libsight.llm.words import blocks
from libsight.session import ship

#: Samples that the driver sorts (one more for every run at most), and ranges they are cut into.
SAMPLES, FEWEST_RANGES, MOST_RANGES = 200_000, 200, 4000
#: Rows of a range, as long as there are fewer than MOST_RANGES of them.
RANGE_ROWS = 250_000

Batches = Iterator[pa.RecordBatch]
_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
_KEYS = ("doc_id", "n_features", "weight", "row")


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> dict[int, int]:
    """Features of all texts by bucket; at most ``buckets`` entries."""
    def count(batches: Batches) -> Batches:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), kind=AlnumBlock):
                sums, _ = run_checksums(block, width)
                total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        if len(there):
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    counted = (texts.select(text_of().alias("text")).mapInArrow(count, "bucket bigint, n bigint")
               .groupBy("bucket").agg(F.sum("n")))
    return dict(map(tuple, counted.collect()))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Whole thousandths of the log ratio of every bucket, one added to each count."""
    all_s, all_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(
        float(target.get(b, 0) + 1) * all_s / (float(corpus.get(b, 0) + 1) * all_t)))
        for b in range(buckets)], dtype=np.int64)


def weigh(documents: DataFrame, table: np.ndarray, width: int, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")

    def score(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts, h = batch.columns
            noise = np.array([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))
                              for x in h.to_pylist()], dtype=np.int64)
            for block in blocks(texts, kind=AlnumBlock):
                sums, owner = run_checksums(block, width)
                # sums of integers below 2**53, exact as doubles
                weight = np.bincount(owner, table[sums % np.uint32(len(table))], len(block)).astype(np.int64)
                rows = slice(block.row, block.row + len(block))
                yield pa.RecordBatch.from_arrays(
                    [ids[rows], pa.array(block.counts.astype(np.int64)),
                     pa.array(np.bincount(owner, minlength=len(block)).astype(np.int64)),
                     pa.array(weight), pa.array(weight + noise[rows])],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"),
                            draw.alias("h")).mapInArrow(score, _SCORED)


def _key(row: tuple) -> tuple:
    """Order of ``score, doc_id, n_features, weight, row``: highest score, null ids last."""
    return (-row[0], row[1] is None, *(x or 0 for x in row[1:]))


def rank_highest(scored: DataFrame, drawn: int, keep: Scratch, samples: int = SAMPLES) -> DataFrame:
    """``scored`` (of ``weigh``) with ``rank`` 1 to ``drawn`` by score; null for the others.

    Ties go to the smaller doc_id, null ids last, then to fewer features and the smaller weight;
    rows equal in all of these are interchangeable.  No key is too common: rows that tie are told
    apart by a number that they were written with.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    runs = keep(scored.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(*order))
    n = runs.count()
    step = max(1, n // samples)

    def sample(batches: Batches) -> Batches:
        seen = 0
        for batch in batches:
            at = np.arange((-seen - 1) % step, batch.num_rows, step)
            seen += batch.num_rows
            if len(at):
                yield batch.take(pa.array(at))

    columns = ["score", *_KEYS]
    picked = runs.select(*columns).mapInArrow(sample, ", ".join(f"{c} bigint" for c in columns))
    keys = sorted(_key(tuple(row)) for row in picked.collect())
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, -(-n // RANGE_ROWS)))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    heads = np.array([c[0] for c in cuts], dtype=np.int64)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            falling = -batch.column("score").to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(heads, falling, side) for side in ("left", "right"))
            tied = np.flatnonzero(low < high)
            if len(tied):  # scores at which ranges are cut: by the whole key
                rows = zip(*(batch.column(c).take(pa.array(tied)).to_pylist() for c in columns))
                low[tied] = [bisect_left(cuts, _key(row)) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int64))],
                                             names=[*batch.schema.names, "_range"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    placed = runs.mapInArrow(place, f"{kinds}, _range bigint")
    sizes = sorted(map(tuple, placed.groupBy("_range").count().collect()))
    offsets, total = {}, 0
    for number, size in sizes:
        offsets[number], total = total, total + size
    reached = sum(1 for at in offsets.values() if at < drawn)
    number_of = {r: i for i, r in enumerate(sorted(offsets))}
    last = sizes[reached - 1][0] if reached else -1

    def number(batches: Batches) -> Batches:
        current, done = None, 0
        for batch in batches:
            found = batch.column("_range").to_numpy(zero_copy_only=False)
            rank = np.empty(len(found), dtype=np.int64)
            for r in dict.fromkeys(found.tolist()):
                current, done = (r, done) if r == current else (r, 0)
                here = np.flatnonzero(found == r)
                rank[here] = offsets[r] + done + 1 + np.arange(len(here))
                done += len(here)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rank, mask=rank > drawn)], names=[*batch.schema.names[:-1], "rank"])

    dense = F.element_at(F.lit([number_of.get(i, 0) for i in range(last + 1)] or [0]), (F.col("_range") + 1).cast("int"))
    exchanged = (placed.where(F.col("_range") <= last).repartitionById(max(1, reached), dense.cast("int"))
                 .sortWithinPartitions("_range", *order).mapInArrow(number, f"{kinds}, rank bigint"))
    others = placed.where(F.col("_range") > last).withColumn("_range", F.lit(None).cast("bigint"))
    return exchanged.unionByName(others.withColumnRenamed("_range", "rank")).drop("row")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20,
             width: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every row of ``documents``.

    ``text`` of both tables is read whole; a null is empty.  Words are runs of digits, letters
    (A-Z lower-cased) and characters from U+0080; features are runs of 1 to ``width`` words.
    Of the N rows with ``least_words`` words, floor(percent * N / 100) are drawn, ranks 1, 2, ...
    by score; other rows have a null rank.  A text without words weighs 0.  Ties go to the smaller
    doc_id, then to fewer features and the smaller weight.  Rows are never merged: of repeated
    rows each has its own rank.  A null doc_id draws as an empty string and sorts last.  Empty
    tables: no features, no rows.  Other columns are not read, whatever their names.  Needs
    memory for one block of texts or the longest text, and ``buckets`` counters.  Results depend
    on rows and ``seed`` only, not on partitioning.
    """
    ship(documents.sparkSession)
    table = gains(bucket_counts(documents, width, buckets), bucket_counts(target, width, buckets), buckets)
    with Scratch(documents.sparkSession) as keep:
        scored = keep(weigh(documents, table, width, seed))
        fits = F.col("n_words") >= least_words
        n = scored.where(fits).count()
        ranked = rank_highest(scored.where(fits), percent * n // 100, keep)
        out = ranked.unionByName(scored.where(~fits).withColumn("rank", F.lit(None).cast("bigint")))
        return (out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
                .checkpoint(eager=True))
