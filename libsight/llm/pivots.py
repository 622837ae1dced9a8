"""Near-equal vectors through a pivot-permutation index.

Reference points (pivots) are chosen among the vectors.  A vector is described by its nearest
pivots in order, and filed under them in inverted lists.  Vectors that lie close share several of
their nearest pivots, so a pair is a candidate if it shares at least two; candidates are verified
by their cosine.

A pair that shares two of PREFIX pivots shares one among the PREFIX - 1 rarest of either, so only
those are filed, and the pair is met in the list of the rarest pivot it shares and nowhere else.
Long lists are cut into chunks, and two chunks at a time meet in a task.  A task sends out sums of
links per vector and a spanning forest of the links, never the pairs of a group.  Equal vectors
are one entry with a number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from libsight.llm.components import components
from libsight.llm.scratch import Scratch
from libsight.session import ship

#: Nearest pivots that describe a vector, and how many of them a candidate pair shares.
PREFIX, SHARED = 8, 2
#: Pivots: about the root of the number of vectors, within these bounds.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 16_384
#: Vectors that the pivots are chosen among, per pivot, and the numbers they may hold together.
SAMPLED, SAMPLE_NUMBERS = 4, 16_000_000
#: Members of a chunk of a list.
CHUNK = 1024
#: A cosine as near to the threshold as this is computed again with exact sums.
NEAR = 1e-9

Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column without nulls as doubles; with ``width`` cut or filled up with 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = int(lengths.max(initial=0))
    if width is None and (lengths == n).all():
        return flat.reshape(len(lengths), n)
    out = np.zeros((len(lengths), n if width is None else width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = at < out.shape[1]
    out[row[fits], at[fits]] = flat[fits]
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors of a sample, each far from those before (copies never meet)."""
    sample = unit(sample)
    chosen, nearest = [0], np.full(len(sample), -2.0)
    while len(chosen) < min(n, len(sample)):
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
    return sample[chosen]


def describe(entries: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """``entries`` with ``near``: numbers of the nearest pivots, nearest first."""
    prefix = min(prefix, len(pivots))
    turned = pivots.T.copy()

    def nearest(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column("vector")
            parts = []
            for at in range(0, batch.num_rows, 1024):
                likeness = unit(_matrix(column.slice(at, 1024), len(turned)) + 0.0) @ turned
                likeness[np.isnan(likeness)] = 0  # nothing within the pivots' width
                first = np.argpartition(-likeness, prefix - 1, axis=1)[:, :prefix]
                order = np.argsort(-np.take_along_axis(likeness, first, 1), axis=1, kind="stable")
                parts.append(np.take_along_axis(first, order, 1))
            near = np.concatenate(parts) if parts else np.zeros((0, prefix), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel().astype(np.int32)), prefix)
                 .cast(pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    with np.errstate(invalid="ignore"):
        return entries.mapInArrow(nearest, f"{kinds}, near array<int>")


def by_rarity(described: DataFrame, number: np.ndarray) -> DataFrame:
    """``near`` as ``number`` renumbers the pivots, from the least on."""
    def renumber(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column("near")
            near = np.sort(number[_matrix(column).astype(np.int64)], axis=1).astype(np.int32)
            yield batch.set_column(batch.schema.get_field_index("near"), "near", pa.FixedSizeListArray.from_arrays(
                pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int32())))

    return described.mapInArrow(renumber, described.schema)


def shared_pivots(a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """Pivots that rows of ``a`` and ``b`` share; negative where one is rarer than ``pivot``.

    Entries are pivots numbered from the rarest; both sides are inverted into lists by pivot.
    """
    count = np.zeros((len(a), len(b)), dtype=np.int16)

    def lists(x: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(x.ravel(), kind="stable")
        numbers, start = np.unique(x.ravel()[order], return_index=True)
        return dict(zip(numbers.tolist(), np.split(order // x.shape[1], start[1:])))

    left, right = lists(a), lists(b)
    for number in left.keys() & right.keys():
        count[np.ix_(left[number], right[number])] += np.int16(1 if number >= pivot else -1000)
    return count


def linked(a: np.ndarray, b: np.ndarray, candidates: np.ndarray, threshold: float) -> np.ndarray:
    """Candidate pairs of rows whose cosine reaches the threshold, as a matrix of booleans."""
    x, y = unit(a), unit(b)
    out = np.zeros(candidates.shape, dtype=bool)
    if 8 * np.count_nonzero(candidates) > candidates.size:
        cosine = x @ y.T
        out[:] = candidates & (cosine >= threshold)
        i, j = np.nonzero(candidates & (np.abs(cosine - threshold) < NEAR))
    else:
        i, j = np.nonzero(candidates)
        cosine = np.concatenate([np.einsum("ij,ij->i", x[i[at:at + 65536]], y[j[at:at + 65536]])
                                 for at in range(0, len(i), 65536)] or [np.zeros(0)])
        out[i, j] = cosine >= threshold
        close = np.abs(cosine - threshold) < NEAR
        i, j = i[close], j[close]
    for r, s in zip(i, j):
        dot, xx, yy = (math.fsum(u * v) for u, v in ((a[r], b[s]), (a[r], a[r]), (b[s], b[s])))
        out[r, s] = dot / (math.sqrt(xx) * math.sqrt(yy)) >= threshold
    return out


def _forest(left: np.ndarray, right: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links: members and the least member."""
    one, other = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        pulled = np.minimum(one, np.where(links, other[None, :], big).min(axis=1, initial=big))
        pushed = np.minimum(other, np.where(links, pulled[:, None], big).min(axis=0, initial=big))
        if (pulled == one).all() and (pushed == other).all():
            break
        one, other = pulled, pushed
    member, root = np.concatenate([left, right]), np.concatenate([one, other])
    return member[member != root], root[member != root]


def _meet(posted: DataFrame, threshold: float, shared: int) -> DataFrame:
    """``node, n, root`` of the chunks that meet: rows linked to a node, and edges of the forest."""
    def meet(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, rows = table["node"].to_numpy(), table["n_rows"].to_numpy()
        near = _matrix(table["near"].combine_chunks()).astype(np.int64)
        vectors = _matrix(table["vector"].combine_chunks())
        same = table["a"][0].as_py() == table["b"][0].as_py()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        candidates = shared_pivots(near[a], near[b], table["pivot"][0].as_py()) >= shared
        if same:
            np.fill_diagonal(candidates, False)
        links = linked(vectors[a], vectors[b], candidates, threshold)
        member, root = _forest(node[a], node[b], links)
        to_a = np.where(links, rows[b][None, :], 0).sum(axis=1)
        to_b = np.where(links, rows[a][:, None], 0).sum(axis=0)
        nodes, sums = (node[a], to_a) if same else (np.concatenate([node[a], node[b]]), np.concatenate([to_a, to_b]))
        there = sums > 0
        nothing = np.zeros(len(member), np.int64)
        return pa.table({
            "node": np.concatenate([nodes[there], member]),
            "n": np.concatenate([sums[there], nothing]).astype(np.int64),
            "root": pa.array(np.concatenate([nodes[there], root]))})

    return (posted.groupBy("label", "size", "pivot", "a", "b")
            .applyInArrow(meet, "node bigint, n bigint, root bigint"))


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, most_pivots: int = MOST_PIVOTS,
                 prefix: int = PREFIX, shared: int = SHARED, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings``.

    Rows of the same label (not null) and vector length are linked if they share ``shared`` of
    their ``prefix`` nearest pivots and the cosine of their vectors, in doubles, reaches
    ``threshold``; no link is below it, a few may be missed (see the README for recall).  Equal
    vectors are always linked.  Vectors that are null, empty or zero, or hold nulls or numbers
    that aren't finite, link with nothing.  ``n_links`` counts the rows linked directly,
    ``component_id`` is the least vec_id within reach, itself included, and ``kept`` marks rows that have
    it.  Rows with equal vec_id are judged each by its vector.  Null vec_ids count as rows and are
    no least id; a component of them only has a null id and keeps all.  Empty table: no rows.
    Other columns are not read, whatever their names.  Pivots are chosen among
    the vectors with the least hashes, SAMPLED for each pivot; every vector is filed.
    """
    spark = ship(embeddings.sparkSession)
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64(F.lit(i), "label", "vector").alias(f"k{i}") for i in (1, 2)]
    with Scratch(spark) as keep:
        entries = keep(rows.where(fine).groupBy(*key).agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n_rows"),
            F.min("vec_id").alias("least"))
            .withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")))
        n, widest = entries.agg(F.count("*"), F.max("size")).first()
        wanted = min(most_pivots, max(FEWEST_PIVOTS, math.isqrt(n)))
        sample = entries.orderBy("k1", "k2").limit(min(SAMPLED * wanted, SAMPLE_NUMBERS // (widest or 1) + 1))
        found = [row[0] for row in sample.select("vector").collect()]
        width = max(map(len, found), default=0)
        base = np.array([[*map(float, v), *[0.0] * (width - len(v))] for v in found])
        pivots = choose_pivots(base, wanted) if found else np.ones((1, 1))
        described = keep(describe(entries.select("node", "label", "size", "n_rows", "vector"), pivots, prefix))

        # pivots from the rarest on; at most as many rows as there are pivots
        held = described.select("label", "size", F.explode("near").alias("pivot"))
        used = {p: n for p, n in held.groupBy("pivot").count().collect()}
        by_use = sorted(range(len(pivots)), key=lambda p: (used.get(p, 0), p))
        number = np.argsort(np.array(by_use))
        least = max(1, min(prefix, len(pivots)) - min(shared, len(pivots)) + 1)
        filed = by_rarity(described, number).withColumn("pivot", F.explode(F.slice("near", 1, least)))
        length = (filed.groupBy("label", "size", "pivot").agg(F.count("*").alias("_n"))
                  .select("label", "size", "pivot", F.ceil(F.col("_n") / F.lit(chunk)).alias("chunks")))
        chunked = filed.join(length, ["label", "size", "pivot"]).withColumn(
            "own", F.pmod(F.xxhash64("node"), "chunks"))
        posted = (chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
                  .select("label", "size", "pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                          (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n_rows", "near", "vector"))
        met = keep(_meet(posted, threshold, min(shared, len(pivots))))
        sums = met.groupBy("node").agg(F.sum("n").alias("n"))
        comps = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), keep)
        placed = keep(entries.select("node", "k1", "k2", "n_rows", "least").join(sums, "node", "left")
                      .join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        names = keep(placed.groupBy("comp").agg(F.min("least").alias("component_id")))
        result = keep(placed.join(names, "comp").select(
            "k1", "k2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_links")))
        own = rows.select("vec_id", *[F.when(fine, k).alias(f"k{i}") for i, k in enumerate(key, 1)])
        out = own.join(result, ["k1", "k2"], "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        return (out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
                .checkpoint(eager=True))
