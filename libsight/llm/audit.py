"""How far the sources of a language lie apart, term by term and in pairs.

Every (language, source) group has an add-one-smoothed rate for each kept term of its language,
in billionths.  Two rates p and q differ by floor((p - q)^2 / (p + q)); a pair's divergence is the
sum over all kept terms, a term's its difference from the language's own rate.

Pairs are summed by Gustavson's row accumulation.  The cells (term, group, rate) are dealt by term;
inside a block a term-major index lists each term's groups.  Each group walks its terms, gathers
their lists and scatters into one dense accumulator with a slot per peer, so no posting pair leaves
the task.  A cell that is missing stands for the group's rate at count 0; what the scattered cells
owe to it is corrected there, and the rest comes from every group's few distinct rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from libsight.llm.scratch import Scratch
from libsight.llm.terms import AlphaBlock
from libsight.llm.texts import text_of
from libsight.llm.words import blocks
from libsight.session import ship

#: Cells a counting task gathers before it sends them on, and cells of a block of the index.
GATHERED, BLOCK_CELLS = 400_000, 100_000
#: Rate of a term that makes up a whole group.
WHOLE = 1_000_000_000
#: Entries of one matrix of rates by peers.
MATRIX = 2_000_000

Batches = Iterator[pa.RecordBatch]


def count_terms(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: partial counts, several rows for a term of a group."""
    names = ["lang", "source", "term"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).combine_chunks()
        return (table.group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
                .rename_columns([*names, "n", "docs"]))

    def count(batches: Batches) -> Batches:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            langs, sources, texts = batch.columns
            for block in blocks(texts, kind=AlphaBlock):
                own = slice(block.row, block.row + len(block))
                coded = block.terms().dictionary_encode()
                size = max(1, len(coded.dictionary))
                text = np.repeat(np.arange(len(block)), block.counts)
                cells, n = np.unique(text * size + coded.indices.to_numpy(), return_counts=True)
                at = pa.array(cells // size)
                held.append(pa.table({
                    "lang": langs[own].take(at), "source": sources[own].take(at),
                    "term": coded.dictionary.take(pa.array(cells % size)).cast(pa.string()),
                    "n": pa.array(n.astype(np.int64)), "docs": pa.array(np.ones(len(n), np.int64))}))
                rows += len(n)
                if rows >= 2 * GATHERED:
                    held = [merged(held)]
                    rows = held[0].num_rows
                    if rows >= GATHERED:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    return (documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                             text_of().alias("text"))
            .mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint"))


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * terms)), exactly."""
    return (F.lit(1) + F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)"),
                                       (total + 2 * terms).cast("decimal(20,0)"))).cast("bigint")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _diff(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def scatter(term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums for pairs of groups over the terms that both have.

    One entry of each array is a cell: term, group, rate, and the group's rate at count 0.
    Returns groups a < b and what f(p, q) exceeds f(p, zero of b) + f(zero of a, q) - f(zeros) by.
    """
    order = np.lexsort((group, term))
    term, group, p, zero = term[order], group[order], p[order], zero[order]
    numbers, slot = np.unique(group, return_inverse=True)
    new = np.flatnonzero(np.diff(term)) + 1
    ends = np.repeat(np.append(new, len(term)), np.diff(np.concatenate([[0], new, [len(term)]])))
    by_group = np.argsort(slot, kind="stable")
    bounds = np.searchsorted(slot[by_group], np.arange(len(numbers) + 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    accumulator = np.zeros(len(numbers), dtype=np.int64)
    for i in range(len(numbers)):
        row = by_group[bounds[i]:bounds[i + 1]]
        n = ends[row] - row - 1  # peers of a higher number in each term's list
        peer = np.repeat(row + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(peer):
            continue
        mine, base = np.repeat(p[row], n), zero[row[0]]
        value = (_diff(mine, p[peer]) - _diff(mine, zero[peer]) - _diff(base, p[peer])
                 + _diff(base, zero[peer]))
        accumulator[:] = 0
        np.add.at(accumulator, slot[peer], value)
        there = np.flatnonzero(accumulator)
        found.append((np.full(len(there), numbers[i]), numbers[there], accumulator[there]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _shared(cells: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of ``scatter`` for every block; cells carry ``lang, block``."""
    def block(table: pa.Table) -> pa.Table:
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        a, b, value = scatter(term, *[table[c].to_numpy() for c in ("number", "p", "zero")])
        return pa.table({"lang": pa.repeat(table["lang"][0], len(a)), "a": a, "b": b, "value": value})

    # dealt by block as well: a language's cells must not stay together
    return cells.repartition("lang", "block").groupBy("lang", "block").applyInArrow(block, "lang string, a bigint, b bigint, value bigint")


def _baselines(rates: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for each group and peer, the group's side of a pair without shared terms.

    That is f(p, peer's zero) - f(zeros) over the group's own terms; for the group of the lower number
    f(zeros) over all kept terms as well.  A row of ``rates`` is a group: ``lang, terms, number, zero``,
    ``own`` (its distinct rates, with how many terms have each) and ``peers`` (number and zero of
    every group of the language).
    """
    def sums(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, terms, number, zero, own, peers = (c[row] for c in batch.columns)
                terms, number, zero = terms.as_py(), number.as_py(), zero.as_py()
                to, base = (peers.values.field(i).to_numpy() for i in (0, 1))
                other = to != number
                to, base = to[other], base[other]
                total = np.zeros(len(to), dtype=np.int64)
                if terms:
                    p, n = (own.values.field(i).to_numpy() for i in (0, 1))
                    per = max(1, MATRIX // max(1, len(to)))
                    for at in range(0, len(p), per):
                        total += (_diff(p[at:at + per, None], base[None, :]) * n[at:at + per, None]).sum(axis=0)
                    total += _diff(np.int64(zero), base) * (np.where(to > number, terms, 0) - n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(to)), pa.array(np.minimum(number, to)), pa.array(np.maximum(number, to)),
                     pa.array(total)], names=["lang", "a", "b", "value"])

    return (rates.select("lang", "terms", "number", "zero", "own", "peers").repartition("lang", "number")
            .mapInArrow(sums, "lang string, a bigint, b bigint, value bigint"))


def divergence(documents: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``documents``.

    Part ``pair``: every other source of the language, by divergence.  Part ``term``: the
    ``top`` kept terms that the source uses more than its language does, by difference.  Ranks
    run from 1 by falling value, ties by item in UTF-8 order.  Terms are runs of letters (A-Z
    lower-cased) and characters from U+0080 of the whole text; a language keeps those in at least
    ``least_docs`` of its rows.  Null text, lang and source read as empty strings.  Every row is a
    document, so repeated rows count again.  Groups without words take part in pairs at their
    smoothed rates; a language without kept terms has pairs of value 0 and no terms.  Empty table:
    no rows.  Other columns are not read, whatever their names.  All arithmetic is exact for
    groups of up to 10^18 words.  A counting task holds one block of texts, or the longest text,
    and GATHERED cells; a pair task one block of the index and a slot per source of its language.
    """
    ship(documents.sparkSession)
    group = ["lang", "source"]
    with Scratch(documents.sparkSession) as keep:
        counts = keep(count_terms(documents).groupBy(*group, "term")
                      .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = keep(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                    .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        cells = keep(counts.join(kept, ["lang", "term"]).select(*group, "term", "n", "lang_n"))
        totals = cells.groupBy(*group).agg(F.sum("n").alias("total"))
        occurring = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group]).distinct()
        nothing = F.lit(0).cast("bigint")
        groups = keep(
            occurring.join(totals, group, "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
            .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint"))
            .withColumn("zero", F.when(F.col("terms") > 0, rate(nothing, F.col("total"), F.col("terms"))).otherwise(nothing)))
        rated = keep(cells.join(groups, group).select(
            *group, "term", "number", "zero", "n", rate(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            rate(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")))

        # cells of a language are cut into blocks by term
        blocks_of = rated.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BLOCK_CELLS)).alias("blocks"))
        blocked = rated.join(blocks_of, "lang").select(
            "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "number", "p", "zero")
        same_rate = rated.groupBy("lang", "number", "p").agg(F.count("*").alias("n"))
        own = same_rate.groupBy("lang", "number").agg(F.collect_list(F.struct("p", "n")).alias("own"))
        peers = groups.groupBy("lang").agg(F.collect_list(F.struct("number", "zero")).alias("peers"))
        nothing_own = F.array().cast("array<struct<p:bigint,n:bigint>>")
        baselines = _baselines(groups.select("lang", "terms", "number", "zero").join(own, ["lang", "number"], "left")
                               .withColumn("own", F.coalesce("own", nothing_own)).join(peers, "lang"))
        pairs = keep(_shared(blocked).unionByName(baselines)
                     .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))

        both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        name = groups.select("lang", "number", "source")
        by_value = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        pair_rows = (both.join(name.withColumnRenamed("number", "a"), ["lang", "a"])
                     .join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
                     .select(*group, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")))
        term_rows = (rated.where(F.col("p") > F.col("q"))
                     .select(*group, F.lit("term").alias("part"), F.col("term").alias("item"),
                             difference(F.col("p"), F.col("q")).alias("value"))
                     .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
        return pair_rows.unionByName(term_rows).checkpoint(eager=True)
