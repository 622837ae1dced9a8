"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products.

Tokens are runs of letters or of ASCII symbols inside words.  A text's features are its
token unigrams and bigrams, the same n-grams of token shapes (class, capitals, whether the
token repeats its forerunner) and a mark on bigrams that occurred before in the text; all
are hashed into one table and carry their share of the text's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from libsight.llm.words import Block, SPACE, blocks, mix
from libsight.session import ship

BITS = 18
#: Default bounds of the training sample: labelled rows, and feature entries (8 bytes each) that the
#: fitting task holds.
SAMPLE_ROWS, SAMPLE_ENTRIES = 8192, 40_000_000
#: Factor on shares, so that one whole family of features has this length.
SCALE = 8.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_KIND = np.where(SPACE, 0, np.where(_SYMBOL, 1, 2)).astype(np.uint8)


class TokenBlock(Block):
    """Like a block of words, but words are cut where letters and symbols meet."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray):
        super().__init__(row, data, offsets)
        kind = _KIND[data]
        if len(data):
            change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            inside = change[(kind[change] > 0) & (kind[change - 1] > 0)]
            # a place where two texts meet is cut already
            inside = inside[~np.isin(inside, offsets)]
            self.starts = np.sort(np.concatenate([self.starts, inside]))
            self.ends = np.sort(np.concatenate([self.ends, inside]))
            self.first = np.searchsorted(self.starts, offsets)


def features(block: TokenBlock, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and text numbers of a block, ungrouped.

    A text without tokens has the single feature 0.
    """
    h, first, n = block.hashes, block.first, block.counts
    text = np.repeat(np.arange(len(n)), n)
    shift = np.uint64(64 - bits)
    one = np.uint64(1)
    if not len(h):
        return (np.zeros(len(n), np.int64), np.ones(len(n)), np.arange(len(n)))
    caps = np.concatenate([[0], np.cumsum(_CAPITAL[block.data])])
    n_caps = caps[block.ends] - caps[block.starts]
    size = block.ends - block.starts
    kind = _KIND[block.data[block.starts]]
    opening = np.zeros(len(h), bool)
    opening[first[:-1][n > 0]] = True
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & ~opening[1:]
    shape = (kind.astype(np.uint64) * np.uint64(32)
             + np.where(n_caps == 0, 0, np.where(n_caps < size, 1, 2)).astype(np.uint64) * np.uint64(8)
             + same.astype(np.uint64) * np.uint64(4) + (size > 1).astype(np.uint64))
    shape = mix(np.where(kind == 1, shape + (h << np.uint64(9)), shape) + np.uint64(77))
    pair = np.flatnonzero(~opening)          # second tokens of bigrams
    grams = mix(h[pair - 1] * np.uint64(3) + h[pair] + one)
    shapes = mix(shape[pair - 1] * np.uint64(3) + shape[pair] + np.uint64(5))
    # bigrams that occurred before in the same text
    again = np.zeros(len(pair), bool)
    if len(pair):
        key = grams ^ mix(text[pair].astype(np.uint64) + np.uint64(1 << 40))
        order = np.argsort(key, kind="stable")
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
    repeats = mix(np.where(again, 11, 12).astype(np.uint64))
    index = np.concatenate([h, shape, grams, shapes, repeats]) >> shift
    owner = np.concatenate([text, text, text[pair], text[pair], text[pair]])
    share = SCALE / np.maximum(n, 1)
    empty = np.flatnonzero(n == 0)
    return (np.concatenate([index.astype(np.int64), np.zeros(len(empty), np.int64)]),
            np.concatenate([share[owner], np.ones(len(empty))]),
            np.concatenate([owner, empty]))


def grouped(index: np.ndarray, value: np.ndarray, owner: np.ndarray, bits: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per (text, feature)."""
    key = (owner.astype(np.int64) << bits) | index
    keys, at = np.unique(key, return_inverse=True)
    return keys & ((1 << bits) - 1), np.bincount(at, value, len(keys)), keys >> bits


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one coordinate rate each."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02,
                 l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0,
                        shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS,
        sample_rows: int = SAMPLE_ROWS, epochs: int = 4, sample_entries: int = SAMPLE_ENTRIES) -> np.ndarray:
    """Weights of the classifier, learned from a bounded sample of labelled documents.

    Rows that ``held_out`` names are left out.  The sample are the training ids with the least
    hashes, at most ``sample_rows`` of them, and in that order only as many documents as have
    ``sample_entries`` features together; the first that goes beyond ends the sample.  It is
    the same in every run.  Its ids are broadcast, and one task passes over the features ``epochs``
    times.  Null ids or labels are left out; of several labels of one id the greatest counts, of
    several texts that with the least hash.  Without labelled rows all weights are 0.
    """
    ship(documents.sparkSession)
    rows = (labels.select(F.col("doc_id").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
            .where("_id is not null and _label is not null").where(~held_out(F.col("_id")))
            .groupBy("_id").agg(F.max("_label").alias("_label"))
            .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    train = (documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
             .join(F.broadcast(rows), "_id").groupBy("_id", "_label")
             .agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.coalesce("_text", F.lit("")))).alias("_text")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), kind=TokenBlock):
                index, value, owner = grouped(*features(block, bits), bits)
                cuts = np.searchsorted(owner, np.arange(len(block) + 1)).astype(np.int32)
                part = slice(block.row, block.row + len(block))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part],
                     pa.ListArray.from_arrays(cuts, pa.array(index.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))],
                    names=["_id", "_label", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, entries = [], 0
        for batch in batches:
            # views of the batch: features are held once, as they came; past the bound batches only pass
            for label_, index, value in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if entries > sample_entries:
                    break
                index = index.values.to_numpy()
                entries += len(index)
                if entries <= sample_entries:
                    docs.append((label_, index, value.values.to_numpy()))
        model = Ftrl(1 << bits)
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(docs)):
                model.update(docs[i][1], docs[i][2].astype(np.float64), docs[i][0])
        weights = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], names=["weights"])

    got = (train.mapInArrow(extract, "_id bigint, _label int, index array<int>, value array<float>")
           .repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id")
           .mapInArrow(learn, "weights binary").collect())
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros(1 << bits, np.float32)


def score(documents: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",),
          threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null texts score as empty ones.  Rows are scored one by one from their whole text, with no
    shuffle; repeated rows score alike; an empty table gives no rows.  A kept column named like
    an added one is dropped.
    """
    ship(documents.sparkSession)
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    bits = int(np.log2(len(weights)))
    # a kept text is sent once; else it comes last and stays behind
    slim = documents.select(*[F.col(f"`{c}`") for c in keep],
                            *([] if "text" in keep else [F.col("text").cast("string")]))
    at = slim.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:len(keep)]]
                       + ["score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in blocks(batch.column(at), kind=TokenBlock):
                index, value, owner = features(block, bits)
                parts.append(np.bincount(owner, weights[index].astype(np.float64) * value, len(block)))
            total = np.concatenate(parts) if parts else np.zeros(0)
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*batch.schema.names[:len(keep)], "score", "predicted"])

    return slim.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",),
             threshold: float = 0.3) -> DataFrame:
    """Fit on the training labels, score every document; adds ``held_out``."""
    return (score(documents, fit(documents, labels), keep, threshold)
            .withColumn("held_out", held_out(F.col("doc_id"))))
