"""Best-fit packing into bins of several permitted lengths.

Pieces are packed longest first.  A piece goes to the open bin it fills best; if none has
room, the bin length whose greedy fill from the pieces still to come costs least per word is
opened.  At the end each bin shrinks to the shortest permitted length that holds its words.
Packing runs inside each input partition over windows of bounded size, so it needs no
shuffle and no group of pieces meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from libsight.llm.texts import n_words
from libsight.session import ship

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together; what a task holds at most.
WINDOW = 65_536
#: Relative cost of a bin of length c is c * (1 + c / COST_SCALE): long rows cost more per word.
COST_SCALE = 65_536.0


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / COST_SCALE)


def _greedy_fill(gap: int, lengths: list[int], left: dict[int, int]) -> int:
    """Words that the pieces still to come would put into ``gap``, longest first."""
    filled, at = 0, bisect_right(lengths, gap)
    while at and gap > 0:
        length = lengths[at - 1]
        n = min(left[length], gap // length)
        filled, gap = filled + n * length, gap - n * length
        at = min(at - 1, bisect_right(lengths, gap))
    return filled


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int]]:
    """(bin, place) of every piece; pieces are 1 to max(capacities) long."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left: dict[int, int] = {}
    for length in lengths:
        left[length] = left.get(length, 0) + 1
    distinct = sorted(left)
    rooms: list[int] = []              # distinct free lengths of open bins, ascending
    bins: dict[int, list[int]] = {}    # free length -> bins
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    opened: dict[int, int] = {}        # remembered choice while the same length repeats
    for i in order:
        length = lengths[i]
        left[length] -= 1
        if not left[length]:
            distinct.pop(bisect_left(distinct, length))
            opened = {}
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            number = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
        else:
            choice = opened.get(length)
            if choice is None:
                choice = opened[length] = min(
                    (c for c in capacities if c >= length),
                    key=lambda c: (cost(c) / (length + _greedy_fill(c - length, distinct, left)), c))
            room, number = choice, len(used)
            used.append(0)
        out[i] = (number, used[number])
        used[number] += length
        room -= length
        if room:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append(number)
    return out


def pack_documents(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES,
                   length: Column | None = None, window: int = WINDOW) -> DataFrame:
    """Place every document's words into bins.

    Output ``doc_id, piece, start, n_words, bin_id, bin_capacity, bin_words, position``: words
    ``start .. start + n_words`` of the document lie at ``position`` in the bin.  A document
    longer than the longest bin is cut into pieces of that length and a rest.  ``length``
    defaults to the words of ``text``; a null or empty text has one piece of 0 words, in no bin
    (null bin).  Repeated rows are packed each; null doc_ids are kept; other columns are
    ignored.  Bin numbers are unique over all partitions.  Empty input: no rows.
    """
    ship(documents.sparkSession)
    capacities = tuple(sorted(set(int(c) for c in capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    longest = capacities[-1]
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                            (n_words() if length is None else length.cast("bigint")).alias("n"))
    schema = ("doc_id bigint, piece bigint, start bigint, n_words bigint, bin_id bigint, "
              "bin_capacity bigint, bin_words bigint, position bigint")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        opened = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, opened
            full = [row for row in held if row[3]]
            placed = pack([row[3] for row in full], capacities)
            sums: dict[int, int] = {}
            for row, (number, _) in zip(full, placed):
                sums[number] = sums.get(number, 0) + row[3]
            places = iter(placed)
            rows = []
            for row in held:
                if row[3]:
                    number, position = next(places)
                    words = sums[number]
                    fits = capacities[bisect_left(capacities, words)]
                    rows.append((*row, base + opened + number, fits, words, position))
                else:
                    rows.append((*row, None, None, None, None))
            opened += len(sums)
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = n or 0
                for piece, start in enumerate(range(0, max(n, 1), longest)):
                    held.append((doc, piece, start, min(longest, n - start)))
                    if len(held) >= window:
                        yield flush()
        if held:
            yield flush()

    return slim.mapInArrow(run, schema)
