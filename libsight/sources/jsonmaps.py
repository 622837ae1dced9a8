"""Large JSON files read by many tasks: the entries of one map as rows.

A JSON file cannot be cut anywhere, since a byte does not say whether it lies in a string or how deep.  Here
the text reader cuts files at a separator that never follows a backslash, tasks gather its pieces into blocks, and each
block states what it does to quotes and depth under both assumptions, begun inside a string or outside.
Running totals over these small figures give every block its true start; the blocks are then cut at the commas
between entries, and only entries that cross a block's end are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from libsight.functions.ordered import broadcast_if_small
from libsight.session import cut_lineage

BLOCK = 1 << 20
QUOTE, BACKSLASH, COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARKS = _STEP != 0
_MARKS[COMMA] = True
_BODY = "file string, start bigint, seq bigint, body binary"
_FIGURES = ("file string, start bigint, seq bigint, turns bigint, outside_step bigint, inside_step bigint, "
            "outside_commas map<bigint,bigint>, inside_commas map<bigint,bigint>")
_PARTS = "file string, n bigint, start bigint, seq bigint, closed boolean, body binary"


def _quotes(block: np.ndarray) -> np.ndarray:
    """Positions of quotes that open or close a string."""
    at = np.flatnonzero(block == QUOTE)
    slashes = block == BACKSLASH
    if not len(at) or not slashes.any():
        return at
    place = np.arange(len(block))
    last_other = np.maximum.accumulate(np.where(slashes, -1, place))
    before = np.where(at > 0, last_other[np.maximum(at, 1) - 1], -1)
    return at[(at - 1 - before) % 2 == 0]


def _marks(block: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brackets and commas outside strings: position, step, and depth before each, from 0."""
    at = np.flatnonzero(_MARKS[block])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    step = _STEP[block[at]].astype(np.int64)
    return at, step, np.cumsum(step) - step


def _batch(schema: str, columns: Sequence) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(),
             "map<bigint,bigint>": pa.map_(pa.int64(), pa.int64())}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _figures(body: bytes) -> list:
    """Parity of quotes, then step and commas by depth if begun outside and inside a string."""
    block = np.frombuffer(body, np.uint8)
    quotes = _quotes(block)
    steps, commas = [], []
    for inside in (0, 1):
        _, step, depth = _marks(block, quotes, inside)
        steps.append(int(step.sum()))
        commas.append(list(zip(*(a.tolist() for a in np.unique(depth[step == 0], return_counts=True)))))
    return [len(quotes) % 2, *steps, *commas]


def _blocks(spark: SparkSession, path: str, separator: str, size: int, figures: bool) -> DataFrame:
    """Blocks of whole pieces, each with its body or with its figures."""
    pieces = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("piece"))
    mark, schema = separator.encode(), _FIGURES if figures else _BODY

    def row(file: str, start: int, seq: int, held: list[bytes]) -> pa.RecordBatch:
        body = mark.join(held) + mark
        return _batch(schema, [[v] for v in (file, start, seq, *(_figures(body) if figures else [body]))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, weight = None, 0, [], 0
        for batch in batches:
            files, starts = batch.column(0), batch.column(1)
            if not len(starts):
                continue
            changed = np.diff(starts.to_numpy()) != 0
            changed |= pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(starts)]
            for lo, hi in zip(edges, edges[1:]):
                here = (files[lo].as_py(), starts[lo].as_py())
                if here != key:
                    if held:
                        yield row(*key, seq, held)
                    key, seq, held, weight = here, 0, [], 0
                for piece in batch.column(2).slice(lo, hi - lo).to_pylist():
                    held.append(piece)
                    weight += len(piece) + 1
                    if weight >= size:
                        yield row(*key, seq, held)
                        seq, held, weight = seq + 1, [], 0
        if held:
            yield row(*key, seq, held)

    return pieces.mapInArrow(gather, schema)


def entries(spark: SparkSession, path: str, levels: Sequence[int] = (1,), separator: str = "}",
            size: int = BLOCK) -> DataFrame:
    """Entries ``file, n, entry`` of the JSON files at ``path``, in order from 0.

    An entry is the text between two commas at one of the depths ``levels`` (1: the outermost map or list); the
    brackets that enclose entries are left out.  Cut at a ``separator`` that is frequent, one
    of ``}``, ``]`` and ``,``.  An entry that the file's end cuts off is left out, empty files and maps have none.
    """
    if separator not in ("}", "]", ","):
        raise ValueError(f"separator {separator!r} may follow a backslash or split an escape")
    wanted = sorted(levels)
    before = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(column):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    states = _blocks(spark, path, separator, size, True).withColumn("inside", earlier("turns") % 2)
    states = states.withColumn("depth", earlier(F.when(F.col("inside") == 1, F.col("inside_step")).otherwise(F.col("outside_step"))))
    commas = F.when(F.col("inside") == 1, F.col("inside_commas")).otherwise(F.col("outside_commas"))
    met = sum((F.coalesce(F.try_element_at(commas, F.lit(level).cast("bigint") - F.col("depth")), F.lit(0)) for level in wanted), F.lit(0))
    states = cut_lineage(states.withColumn("n", earlier(met)).select("file", "start", "seq", "inside", "depth", "n"))
    placed = _blocks(spark, path, separator, size, False).join(
        broadcast_if_small(states), ["file", "start", "seq"]).select("file", "start", "seq", "body", "inside", "depth", "n")

    def cut(crossing: bool):
        def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    file, start, seq, body, inside, depth, n = (batch.column(c)[r].as_py() for c in range(7))
                    head = (start, seq) == (0, 0)
                    if depth <= 0 and not head:
                        continue  # the file has more after its map
                    block = np.frombuffer(body, np.uint8).copy()
                    at, step, level = _marks(block, _quotes(block), inside)
                    level = level + depth
                    shut = at[(step == -1) & (level == 1)]
                    limit = int(shut[0]) if len(shut) else len(block)
                    ends = at[(step == 0) & np.isin(level, wanted) & (at < limit)]
                    block[at[(step != 0) & (np.minimum(level, level + step) < wanted[-1])]] = 0x20
                    clean, edges = block.tobytes(), [-1, *ends.tolist(), limit]
                    parts = [(n + i, clean[lo + 1:hi]) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
                    closed = [True] * len(ends) + [len(shut) > 0]
                    whole = [c and (i > 0 or head) for i, c in enumerate(closed)]
                    kept = [(file, k, start, seq, c, part) for (k, part), c, w in zip(parts, closed, whole) if w != crossing]
                    if kept:
                        yield _batch(_PARTS, list(zip(*kept)))
        return parts_of

    whole = placed.mapInArrow(cut(False), _PARTS).select("file", "n", "body")
    crossing = placed.mapInArrow(cut(True), _PARTS).groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("start", "seq", "closed", "body"))).alias("p")).where(
        F.exists("p", lambda s: s["closed"])).select(
        "file", "n", F.aggregate("p", F.lit(b""), lambda done, s: F.concat(done, s["body"])).alias("body"))
    text = F.regexp_replace(F.col("body").cast("string"), r"^[\s\ufeff]+|\s+$", "")
    return whole.unionByName(crossing).select("file", "n", text.alias("entry")).where("entry <> ''")


def save(rows: DataFrame, path: str) -> None:
    """Write ``library_id, k, v`` (``v`` as JSON text) as one JSON map per library, a folder ``library_id=…`` each.

    A library's entries run through one task in key order, one at a time, since they make up one file.  Null keys
    or values are left out; of repeated keys all are written, as JSON allows.
    """
    named = rows.where("k is not null and v is not null").select(
        F.coalesce(F.col("library_id").cast("string"), F.lit("")).alias("library_id"), F.col("k").cast("string").alias("k"), "v")
    ends = named.select("library_id").distinct().select("library_id", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"))
    order = Window.partitionBy("library_id").orderBy(F.col("k").asc_nulls_last())
    name = F.to_json(F.array("k"))
    line = F.when(F.col("k").isNull(), F.lit("}")).otherwise(F.concat(
        F.when(F.col("rank") == 1, F.lit("{")).otherwise(F.lit(",")), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("v")))
    (named.unionByName(ends).withColumn("rank", F.row_number().over(order)).select("library_id", line.alias("value"))
     .write.partitionBy("library_id").text(path))
