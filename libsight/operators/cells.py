"""Exact vector search over stored codes, cut into cells.

Vectors are grouped around centroids and stored in blocks: one row holds the int8 codes of up to
BLOCK neighbours, how far each code may be off, and the exact vectors in a column of their own.
A block's radius is the widest angle between its vectors and its centroid; by the triangle
inequality nothing in the block lies nearer to a query than their angle less the radius.

A search reads codes first, of blocks whose bound reaches the query's k-th hit so far.  A code's
cosine is off by the stored error at most, so a row survives if the upper end of its band reaches
the k-th best lower end.  Exact vectors are read for survivors' blocks alone.  Rows, scores and ties
equal those of ``search.vector_search``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from libsight.operators import search
from libsight.session import cut_lineage, ship

#: Vectors of a block.
BLOCK = 256
#: Centroids: about the root of the number of vectors, at most these; vectors they are fitted on, each.
MOST_CELLS, SAMPLED = 4096, 32
ROUNDS = 6
#: Room for rounding in angles and cosines.
SLACK = 1e-9
#: Vectors of another length than the centroids, and zero vectors: never skipped, always exact.
ODD = -1

Batches = Iterator[pa.RecordBatch]


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def fit_cells(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``n`` unit centroids of unit vectors, by rounds of assignment and mean from every
    so-manyth vector; cells left empty go."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = _unit(sums[np.linalg.norm(sums, axis=1) > 1e-6])
    return centroids


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in column.to_pylist()]


def build(chunks: DataFrame, path: str, most_cells: int = MOST_CELLS) -> None:
    """Write ``chunk_id, item_key, vector`` as blocks; rows without a vector have no place in them.

    Centroids are fitted on the vectors with the least hashes, SAMPLED for each; every vector is
    stored.
    """
    spark = ship(chunks.sparkSession)
    rows = chunks.where("size(vector) > 0").select("chunk_id", "item_key", F.col("vector").cast("array<double>").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width, total = (common[0], common[1]) if common else (1, 0)
    n = max(1, min(most_cells, math.isqrt(total)))
    # hashes of vectors, so that copies have one; rows of a bounded sample come to the driver
    sample = [r[0] for r in rows.where(F.size("vector") == width).orderBy(F.xxhash64("vector"))
              .limit(SAMPLED * n).select("vector").collect()]
    unit = _unit(np.array(sample, dtype=np.float64).reshape(-1, width))
    unit = unit[np.linalg.norm(unit, axis=1) > 0]
    centroids = fit_cells(unit, n) if len(unit) else np.eye(1, width)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, vector array<double>").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/centroids")

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for v in _rows(batch.column("vector")):
                norm = np.linalg.norm(v)
                found.append(int((centroids @ v).argmax()) if len(v) == width and 0 < norm < np.inf else ODD)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(assign, f"{kinds}, cell int")
    out = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()),
        T.StructField("chunk_ids", T.ArrayType(rows.schema["chunk_id"].dataType)),
        T.StructField("item_keys", T.ArrayType(rows.schema["item_key"].dataType)),
        T.StructField("codes", T.BinaryType()), T.StructField("scales", T.ArrayType(T.DoubleType())),
        T.StructField("errors", T.ArrayType(T.DoubleType())), T.StructField("exact", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def pack(batches: Batches) -> Batches:
        cell, held = None, []
        for batch in batches:
            for i, row in zip(batch.column("cell").to_pylist(), zip(*(batch.column(c).to_pylist() for c in (
                    "chunk_id", "item_key", "vector")))):
                if held and (i != cell or len(held) == BLOCK):
                    yield block(cell, held, batch.schema)
                    held = []
                cell = i
                held.append(row)
        if held:
            yield block(cell, held, batch.schema)

    def block(cell: int, held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        names, items, vectors = zip(*held)
        if cell == ODD:
            radius, codes, scales, errors = math.pi, b"", [0.0] * len(held), [2.0] * len(held)
        else:
            x = _unit(np.array(vectors, dtype=np.float64))
            # coded around the centroid, so that near neighbours have small errors
            rest = x - centroids[cell]
            step = np.maximum(1e-12, np.abs(rest).max(axis=1)) / 127
            coded = np.clip(np.floor(rest / step[:, None] + 0.5), -127, 127).astype(np.int8)
            errors = np.linalg.norm(rest - coded * step[:, None], axis=1) + SLACK
            radius = float(np.arccos(np.clip(x @ centroids[cell], -1, 1)).max()) + SLACK
            codes, scales, errors = coded.tobytes(), step.tolist(), errors.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([radius]), pa.array([list(names)], pa.list_(schema.field("chunk_id").type)),
             pa.array([list(items)], pa.list_(schema.field("item_key").type)), pa.array([codes], pa.binary()),
             pa.array([scales], pa.list_(pa.float64())), pa.array([errors], pa.list_(pa.float64())),
             pa.array([list(vectors)], pa.list_(pa.list_(pa.float64())))], names=out.names)

    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(16))
    (placed.repartition("cell", salt).sortWithinPartitions("cell", "chunk_id").mapInArrow(pack, out)
     .withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/blocks"))


class _Asked:
    """A block of queries, with their angles to the centroids."""

    def __init__(self, rows: list[tuple], centroids: np.ndarray):
        self.ids = [r[0] for r in rows]
        self.vectors = [np.asarray(r[1], dtype=np.float64) for r in rows]
        width = centroids.shape[1]
        self.plain = np.array([len(v) == width and 0 < np.linalg.norm(v) < np.inf for v in self.vectors], dtype=bool)
        self.unit = _unit(np.array([v if ok else np.zeros(width) for v, ok in zip(self.vectors, self.plain)]).reshape(-1, width))
        self.angles = np.arccos(np.clip(self.unit @ centroids.T, -1, 1))

    def bounds(self, cell: int, radius: float) -> np.ndarray:
        """The highest cosine that any vector of the block may have, by query."""
        if cell == ODD:
            return np.ones(len(self.ids))
        return np.where(self.plain, np.cos(np.maximum(0, self.angles[:, cell] - radius)) + SLACK, 1.0)


def _score(cosine: np.ndarray) -> np.ndarray:
    return search.SEMANTIC_WEIGHT * (cosine + 1) / 2


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = search.TOP_K,
                 per_item: int = search.PER_ITEM) -> DataFrame:
    """As ``search.vector_search`` without lexical scores, over the stored blocks of ``path``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    centroids = np.array([r["vector"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    parts = [_search_block(blocks, centroids, some, k, per_item)
             for some in search.query_blocks(queries.select("query_id", "qv"))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return search.diverse_top(found, k, per_item)


def survivors(blocks: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, per_item: int) -> DataFrame:
    """``query_id, block, at, chunk_id, item_key, low, high`` of rows whose band may reach the best ``k``.

    Column ``scanned`` says for how many (query, block) pairs the task read codes.
    """
    asked = _Asked([tuple(r) for r in queries.collect()], centroids)  # a block of queries
    out = T.StructType([queries.schema["query_id"], T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()),
                        T.StructField("chunk_id", blocks.schema["chunk_ids"].dataType.elementType),
                        T.StructField("item_key", blocks.schema["item_keys"].dataType.elementType),
                        *[T.StructField(c, T.DoubleType()) for c in ("score", "high")], T.StructField("scanned", T.LongType())])

    def first(batches: Batches) -> Batches:
        best = search.scoring.Winners(len(asked.ids), k, per_item, search.MIN_SCORE)
        seen: list[list[tuple]] = [[] for _ in asked.ids]
        scanned = 0
        for batch in batches:
            cells, radii = batch.column("cell").to_pylist(), batch.column("radius").to_pylist()
            bound = np.array([_score(asked.bounds(c, r)) for c, r in zip(cells, radii)]).reshape(len(cells), len(asked.ids))
            # blocks that promise most come first and raise the thresholds
            for i in np.argsort(-bound.max(axis=1, initial=0), kind="stable").tolist():
                reached = np.flatnonzero(bound[i] >= best.threshold)
                if not len(reached):
                    continue
                scanned += len(reached)
                names, items = batch.column("chunk_ids")[i].as_py(), batch.column("item_keys")[i].as_py()
                cosine, band = np.zeros((len(reached), len(names))), np.full((len(reached), len(names)), 2.0)
                near = asked.plain[reached]
                if cells[i] != ODD:
                    coded = np.frombuffer(batch.column("codes")[i].as_py(), np.int8).reshape(len(names), -1)
                    vectors = coded * np.array(batch.column("scales")[i].as_py())[:, None] + centroids[cells[i]]
                    cosine[near] = asked.unit[reached[near]] @ vectors.T
                    band[near] = np.array(batch.column("errors")[i].as_py())
                low, high = _score(np.maximum(-1, cosine - band)), _score(np.minimum(1 + SLACK, cosine + band))
                best.offer(low, items, names, reached)
                number = batch.column("block")[i].as_py()
                for line, at in zip(*np.nonzero(high >= best.threshold[reached][:, None])):
                    seen[reached[line]].append((number, int(at), names[at], items[at], low[line, at], high[line, at]))
        rows = [(asked.ids[q], *r, scanned) for q, held in enumerate(seen) for r in held if r[5] >= best.threshold[q]]
        if rows:
            kinds = (None, pa.int64(), pa.int32(), batch.schema.field("chunk_ids").type.value_type,
                     batch.schema.field("item_keys").type.value_type, pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=out.names)

    return blocks.select("block", "cell", "radius", "chunk_ids", "item_keys", "codes", "scales", "errors").mapInArrow(first, out)


def _search_block(blocks: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, per_item: int) -> DataFrame:
    found = cut_lineage(survivors(blocks, centroids, queries, k, per_item))
    reached = (search.diverse_top(found.drop("high", "scanned"), k, per_item).where(F.col("position") == k)
               .select("query_id", F.col("score").alias("least")))
    left = (found.join(reached, "query_id", "left").where("least IS NULL OR high >= least")
            .groupBy("block").agg(F.collect_list(F.struct("query_id", "at")).alias("pairs")))
    asked = {r["query_id"]: np.asarray(r["qv"], dtype=np.float64) for r in queries.collect()}  # a block of queries
    out = T.StructType([queries.schema["query_id"],
                        T.StructField("chunk_id", blocks.schema["chunk_ids"].dataType.elementType),
                        T.StructField("item_key", blocks.schema["item_keys"].dataType.elementType),
                        *[T.StructField(c, T.DoubleType()) for c in ("score", "semantic")]])

    def exact(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for names, items, vectors, pairs in zip(*(batch.column(c).to_pylist() for c in (
                    "chunk_ids", "item_keys", "exact", "pairs"))):
                for pair in pairs:
                    at, query = pair["at"], asked[pair["query_id"]]
                    cosine = search._cosines(np.asarray([vectors[at]], dtype=np.float64), query[None, :])[0, 0]
                    rows.append((pair["query_id"], names[at], items[at], float(_score(cosine)), float((cosine + 1) / 2)))
            kinds = (None, batch.schema.field("chunk_ids").type.value_type, batch.schema.field("item_keys").type.value_type,
                     pa.float64(), pa.float64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=out.names)

    scored = blocks.select("block", "chunk_ids", "item_keys", "exact").join(left, "block").mapInArrow(exact, out)
    return scored.where(F.col("score") > search.MIN_SCORE)
