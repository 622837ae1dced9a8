"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words the least of its shorter
word runs (the leftmost on ties), so equal windows have equal seeds at equal places.  The
windows that share one seed occurrence form a stretch, the furthest a seed can be extended
both ways.  Stretches that meet at a seed and agree as a whole are repeats; those that agree
in part are compared window by window, one stretch for each different wording.  Repeated
windows of one document merge into maximal repeats.  Groups are only counted, never gathered
or paired, so a passage that a third of all documents share costs one row per occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from libsight.llm.scratch import Scratch
from libsight.llm.words import Block, blocks, signed
from libsight.session import cut_lineage, ship

LENGTH, SEED_WORDS = 35, 8


def stretches(block: Block, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Seed hash, stretch hash, text number, first window (word of the block), windows."""
    start, text = block.windows(length)
    width = length - seed + 1
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    begin = np.arange(len(block.hashes) - seed + 1)
    value = block.run_hashes(begin, begin + seed)
    least = np.empty(len(value) - width + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(value, width)
    for at in range(0, len(least), 1 << 15):  # bounds what argmin touches at a time
        least[at:at + (1 << 15)] = view[at:at + (1 << 15)].argmin(axis=1)
    place = start + least[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    begin = start[first]
    return (value[place[first]], block.run_hashes(begin, begin + count + length - 1),
            text[first], begin, count)


def _keyed(documents: DataFrame, others: list[str]) -> DataFrame:
    """Rows with ``key``: equal for rows of equal id and text only."""
    return documents.select(
        *[F.col(f"`{c}`") for c in others],
        F.xxhash64(F.isnull("doc_id"), "doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))


def _places(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """One row per text and wording of a stretch: ``seed, stretch, key, place, more``.

    place = first word * 64 + windows; ``more`` has the later places of the same wording in the
    same text, so that a text that repeats itself over and over is not many rows of one seed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                value, whole, text, begin, count = stretches(block, length, seed)
                order = np.lexsort((begin, whole, text))
                value, whole, text, begin, count = (x[order] for x in (value, whole, text, begin, count))
                first = np.ones(len(text), bool)
                first[1:] = (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])
                place = (begin - block.first[text]) * 64 + count
                later = np.concatenate([[0], np.cumsum(~first)]).astype(np.int32)
                at = np.flatnonzero(first)
                more = pa.ListArray.from_arrays(pa.array(np.r_[later[at], later[-1]], pa.int32()),
                                                pa.array(place[~first]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(value[at])), pa.array(signed(whole[at])),
                     pa.array(keys[block.row + text[at]]), pa.array(place[at]), more],
                    names=["seed", "stretch", "key", "place", "more"])

    return keyed.select("key", "text").mapInArrow(
        run, "seed bigint, stretch bigint, key bigint, place bigint, more array<bigint>")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows in the listed stretches: ``window, key, place, bit, sure``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0).to_numpy(), batch.column(2)
            for block in blocks(batch.column(1)):
                part = lists.slice(block.row, len(block))
                values = part.flatten().to_numpy()
                row = np.repeat(np.arange(len(block)), pa.compute.list_value_length(part).to_numpy())
                place, sure = values >> 1, values & 1
                count, begin = place & 63, (place >> 6) + block.first[row]
                at = np.repeat(np.arange(len(place)), count)
                bit = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                start = begin[at] + bit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(block.run_hashes(start, start + length))),
                     pa.array(keys[block.row + row[at]]), pa.array(place[at]),
                     pa.array(bit.astype(np.int32)), pa.array(sure[at] == 1)],
                    names=["window", "key", "place", "bit", "sure"])

    return (texts.select("key", "text", "places")
            .mapInArrow(run, "window bigint, key bigint, place bigint, bit int, sure boolean"))


def covered_words(n: int, places: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for bit in range(64):
        on = ((masks >> np.int64(bit)) & 1) == 1
        if on.any():
            start = (places[on] >> 6) + bit
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(texts: DataFrame, others: list[str], length: int, with_text: bool) -> DataFrame:
    """Remove the repeated words from every text."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    added = ["n_words bigint", "n_removed bigint", "n_repeats bigint",
             "kept_text string" if with_text else "kept_sha256 string"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], *added])
    names = [*others, *[part.split()[0] for part in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(others) + 1)
            for block in blocks(batch.column(len(others))):
                n = block.counts
                gone = np.zeros(len(block.starts), bool)
                for i in np.flatnonzero(pa.compute.is_valid(found.slice(block.row, len(block)))
                                        .to_numpy(zero_copy_only=False)):
                    entry = found[block.row + int(i)].values
                    places = entry.field("places")
                    masks = np.repeat(entry.field("mask").to_numpy(),
                                      pa.compute.list_value_length(places).to_numpy())
                    gone[block.first[i]:block.first[i + 1]] = covered_words(
                        n[i], places.flatten().to_numpy(), masks, length)
                text = np.repeat(np.arange(len(n)), n)
                edges = gone.copy()
                edges[1:] &= ~(gone[:-1] & (text[1:] == text[:-1]))
                repeats = np.bincount(text[edges], minlength=len(n))
                removed = np.bincount(text[gone], minlength=len(n))
                last = _texts(block, gone, removed) if with_text else _digests(block, gone)
                part = slice(block.row, block.row + len(block))
                yield pa.RecordBatch.from_arrays(
                    [*[c[part] for c in batch.columns[:len(others)]], pa.array(n.astype(np.int64)),
                     pa.array(removed.astype(np.int64)), pa.array(repeats.astype(np.int64)),
                     pa.array(last, pa.string())], names=names)

    return texts.select(*[F.col(f"`{c}`") for c in others], "text", "found").mapInArrow(run, schema)


def _digests(block: Block, gone: np.ndarray) -> list[str]:
    """SHA-256 of the kept words joined by one space."""
    kept = np.flatnonzero(~gone)
    text = np.searchsorted(block.first, kept, side="right") - 1
    data = block.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    edge[block.starts[kept]] = 1
    edge[block.ends[kept]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    # the gap before each kept word but a text's first becomes its one space
    later = kept[1:][text[1:] == text[:-1]] if len(kept) else kept
    data[block.starts[later] - 1] = 0x20
    inside[block.starts[later] - 1] = True
    joined = data[inside].tobytes()
    sums = np.concatenate([[0], np.cumsum(inside)])[block.offsets]
    return [hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(sums[:-1], sums[1:])]


def _texts(block: Block, gone: np.ndarray, removed: np.ndarray) -> list[str]:
    """The texts without the removed words; white space before kept words stays."""
    out = []
    for i in range(len(block)):
        a, b = block.offsets[i], block.offsets[i + 1]
        if not removed[i]:
            out.append(block.data[a:b].tobytes().decode("utf-8", "replace"))
            continue
        words = np.arange(block.first[i], block.first[i + 1])
        edge = np.zeros(b - a + 1, np.int8)
        lost = words[gone[words]]
        # a removed word takes the white space after it along
        after = np.r_[block.starts[words[1:]], b][lost - words[0]]
        edge[block.starts[lost] - a] += 1
        np.subtract.at(edge, after - a, 1)
        out.append(block.data[a:b][np.cumsum(edge[:-1]) == 0].tobytes().decode("utf-8", "replace"))
    return out


def _found(keyed: DataFrame, keep: Scratch, length: int, seed: int) -> DataFrame:
    """Repeated windows of every document: ``key, places, mask`` (bit i: window i of each)."""
    at_seed, at_stretch = Window.partitionBy("seed"), Window.partitionBy("seed", "stretch")
    met = keep(
        _places(keyed, length, seed).repartition("seed").withColumn("_n", 1 + F.size("more"))
        .withColumn("_met", F.sum("_n").over(at_seed)).where("_met > 1")
        .withColumn("_same", F.sum("_n").over(at_stretch))
        .withColumn("_first", F.row_number().over(at_stretch.orderBy("key", "place")) == 1)
        .select("key", "place", "more", (F.col("_same") > 1).alias("sure"),
                (F.col("_first") & (F.col("_met") > F.col("_same"))).alias("compare")))
    # one stretch of each wording, where a seed has several
    lists = met.where("compare").groupBy("key").agg(F.collect_list(
        F.col("place") * 2 + F.col("sure").cast("int")).alias("places"))
    windows = (_windows(keyed.select("key", "text").join(lists, "key"), length)
               .repartition("window")
               .withColumn("_met", F.count("*").over(Window.partitionBy("window")))
               .where("_met > 1 and not sure"))
    part = windows.groupBy("key", "place").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    # the later places of a wording have as many windows as the first
    # rows of equal id and text have equal places: one list for all of them
    whole = (met.where("sure").groupBy("key", "place").agg(F.first("more").alias("more"))
             .select("key", F.concat(F.array("place"), "more").alias("places"),
                     F.expr("shiftleft(1L, cast(place & 63 as int)) - 1").alias("mask")))
    return cut_lineage(whole.unionByName(part.select("key", F.array("place").alias("places"), "mask")))


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS,
                   with_text: bool = False, others: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Remove every word that a repeated window of ``length`` words covers.

    A window repeats if its word sequence starts anywhere else in the corpus, same document
    included; windows are judged on the input.  Output: the columns ``others``, ``n_words``,
    ``n_removed``, ``n_repeats`` (maximal removed runs) and ``kept_sha256`` (of the kept words
    joined by one space) or, with ``with_text``, ``kept_text``, in which white space before kept
    words stays and untouched texts are unchanged.  Null texts have no words.  Repeated rows
    repeat each other's windows, and share one list of places.  A very long text is hashed in one piece,
    so a task holds some 30 bytes for each byte of the longest text.  ``documents`` needs ``doc_id`` and ``text``; ids may be null or
    repeated.  A column of ``others`` named like an added one is dropped.  Empty input: no rows.
    """
    if length - seed + 1 > 63 or seed < 1:
        raise ValueError("a seed must leave at most 63 places in a window")
    spark = ship(documents.sparkSession)
    taken = {"text", "key", "found", "n_words", "n_removed", "n_repeats", "kept_text", "kept_sha256"}
    others = [c for c in others if c not in taken]
    keyed = _keyed(documents, others)
    with Scratch(spark) as keep:
        spots = _found(keyed, keep, length, seed)
    found = spots.groupBy("key").agg(F.collect_list(F.struct("places", "mask")).alias("found"))
    return _cut(keyed.join(found, "key", "left"), others, length, with_text)
