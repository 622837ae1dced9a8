"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each is the longest known phrase and one more
character).  The phrases' hashes fall into slots by their leading bits, and each slot keeps
its least hash; two texts are as alike as their filled slots agree, which estimates how many
phrases they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from libsight.llm.neighbours import deal
from libsight.llm.texts import text_of
from libsight.session import ship

SLOTS = 128
EMPTY = 0xFFFF
_STARTS = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS.bit_length() + 1))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def phrases(text: str, seen: set[str], open_: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` after what ``seen`` holds (it is extended), and the open rest."""
    new, add = [], seen.add
    for char in text:
        open_ += char
        if open_ not in seen:
            add(open_)
            new.append(open_)
            open_ = ""
    return new, open_


def least(new: list[str]) -> np.ndarray:
    """Least phrase hash of every slot."""
    out = np.full(SLOTS, _NONE)
    if new:
        hashes = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)))
        at = np.searchsorted(hashes, _STARTS)
        ends = np.r_[at[1:], len(hashes)]
        filled = ends > at
        out[filled] = hashes[at[filled]]
    return out


def slots(lowest: np.ndarray) -> np.ndarray:
    """16 bits a slot; EMPTY where no phrase fell."""
    short = (lowest % np.uint64(EMPTY)).astype(np.uint16)
    return np.where(lowest == _NONE, np.uint16(EMPTY), short)


def show(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots filled in either that agree; 1 for two texts without phrases."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def fingerprint(text: str) -> np.ndarray:
    return slots(least(phrases(text, set())[0]))


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (hex) of every whole text; a null is empty.  No shuffle.

    Equal texts have equal fingerprints; an empty text's slots are all empty.  A kept column
    named like the result is dropped.
    """
    ship(documents.sparkSession)
    keep = tuple(c for c in keep if c != "fingerprint")
    slim = documents.select(*[F.col(f"`{c}`") for c in keep], text_of().alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
                       + ["fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [show(fingerprint(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shown, pa.string())],
                                             names=[*batch.schema.names[:-1], "fingerprint"])

    return slim.mapInArrow(run, schema)


def probe_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends, in its last floor(n_chars / 4) code points, with the first as many (or
    all) of the next document by doc_id (after the last: the first).  Output ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  A null text is
    empty.  Null doc_ids come last; equal ids are ordered by a hash of their texts.  Both
    parses share the common beginning.  A document alone is its own next.  Empty input: no rows.
    """
    spark = ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.isnull("doc_id"), F.xxhash64("text")]
    dealt = deal(rows, key, order, ["doc_id", "text"], ranges, wrap=True)
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: range, own, id, text, parse
        for batch in batches:
            out = []
            for place, own, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                cut = len(text) - len(text) // 4
                seen: set[str] = set()
                head, open_ = phrases(text[:cut], seen)
                tail, _ = phrases(text[cut:], seen, open_)
                begun = least(head)
                mark = slots(np.minimum(begun, least(tail)))
                if held is not None and held[0] == place and held[1]:
                    out.append(_row(held, text, mark))
                seen.difference_update(tail)
                held = (place, own, doc, text, cut, seen, open_, begun, mark)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def _row(held: tuple, following: str, next_mark: np.ndarray) -> tuple:
        _, _, doc, text, cut, seen, open_, begun, mark = held
        tail = following[:len(text) // 4]
        edited = slots(np.minimum(begun, least(phrases(tail, seen, open_)[0])))
        digest = hashlib.sha256((text[:cut] + tail).encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), digest, show(mark), show(edited), likeness(mark, edited),
                likeness(mark, next_mark))

    return dealt.mapInArrow(run, schema)
