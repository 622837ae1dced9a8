"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set are its distinct word shingles.  All sets are sorted by one order, rare
shingles first (a count sketch of the whole corpus says what is frequent).  Two sets of sizes
n and m and Jaccard t or more share o = ceil(t (n + m) / (1 + t)) shingles, hence, for every
k, at least k among the first n - o + k of the one and m - o + k of the other.  Each document
picks the k at which scanning its longer prefix and verifying its fewer candidates are
estimated to cost least; a pair is verified if it shares the smaller k of the two, or o if
that is less.

Links are wanted as components, so a list of documents that share a shingle is first tied
to one centre, the document in which the fewest rarer shingles precede it: each document is
verified against the centres it meets most often.  Only lists that still hold several
components are then joined, each document outside a list's largest component with the
others, which keeps every link and never spells out the pairs inside a group of copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from libsight.llm.components import components
from libsight.llm.scratch import Scratch
from libsight.llm.words import Block, blocks, mix, signed
from libsight.session import ship

SIZE, PERCENT = 5, 75
#: Prefix extensions that a document may choose.
STEPS = (1, 2, 4, 8)
#: Cost of verifying one candidate, in list entries scanned.
VERIFY_COST = 50
#: Count sketch: counters, and the pieces it is summed in.
SKETCH_BITS, SKETCH_PARTS = 21, 16
#: Centres each document is tied to, and members that meet one copy of a centre.
CENTRES, MEMBERS = 2, 512
#: Rows of a broadcast list of texts to fetch; larger lists are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Set keys an emitting task remembers, so that copies inside it are emitted once.
REMEMBERED = 500_000


def shingle_sets(block: Block, size: int = SIZE, levels: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted per text; text numbers; set sizes.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; a text
    without words has none.  With ``levels`` the leading 6 bits are the frequency level.
    """
    n, first = block.counts, block.first
    start, owner = block.windows(size)
    short = np.flatnonzero((n > 0) & (n < size))
    h = np.concatenate([block.run_hashes(start, start + size),
                        block.run_hashes(first[short], first[short] + n[short])])
    owner = np.concatenate([owner, short])
    if levels is not None:
        level = levels[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
        h = (level << np.uint64(58)) | (h >> np.uint64(6))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, owner, np.bincount(owner, minlength=len(n))


def set_keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of every set; equal sets have equal keys."""
    out = []
    for salt in (0x51, 0xC3):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)))])
        ends = np.cumsum(sizes)
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def _profile(documents: DataFrame, size: int) -> DataFrame:
    """Per document: set size and keys.  Per task: a count sketch, in pieces (``part``)."""
    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, part int, counts binary"
    names = ["doc_id", "n", "k1", "k2", "part", "counts"]
    width = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(width, np.uint32), False
        for batch in batches:
            any_ = True
            for block in blocks(batch.column(1), lower=True):
                h, _, sizes = shingle_sets(block, size)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                k1, k2 = set_keys(h, sizes)
                none = pa.nulls(len(block), pa.int32()), pa.nulls(len(block), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[block.row:block.row + len(block)], pa.array(sizes.astype(np.int64)),
                     pa.array(signed(k1)), pa.array(signed(k2)), *none], names=names)
        if any_:
            small = np.minimum(counts, 65_535).astype("<u2").reshape(SKETCH_PARTS, -1)
            packed = [zlib.compress(row.tobytes(), 1) for row in small]
            nulls = [pa.nulls(SKETCH_PARTS, pa.int64()) for _ in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*nulls, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())],
                names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _levels(sketches: DataFrame) -> np.ndarray:
    """Frequency level of every counter: two levels per doubling, 0 to 63."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(zlib.decompress(packed), "<u2")
                sums[part] = sums[part] + row if part in sums else row.astype(np.int64)
        if sums:
            level = [np.minimum(np.log2(v + 1.0) * 2, 63).astype(np.uint8).tobytes()
                     for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level)],
                                             names=["part", "level"])

    rows = sketches.repartition(SKETCH_PARTS, "part").mapInArrow(run, "part int, level binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    return np.concatenate([np.frombuffer(r[1], np.uint8) for r in sorted(rows, key=lambda r: r[0])])


def _prefixes(documents: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """Prefix shingles: ``token, doc, meta`` with meta = set size * 2**32 + rank in the set, as
    far as any partner and any k can ask.  Copies inside one task are emitted once."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), lower=True):
                h, owner, n = shingle_sets(block, size, shared.value)
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(zip(*(k.tolist() for k in set_keys(h, n)))):
                    if key not in seen:
                        fresh[i] = True
                        seen.add(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                ends = np.cumsum(n)
                rank = np.arange(len(h)) - (ends - n)[owner]
                most = n - (percent * n + 99) // 100 + STEPS[-1]
                pick = (rank < most[owner]) & fresh[owner]
                owner = owner[pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[pick])), pa.array(ids[block.row + owner]),
                     pa.array((n[owner].astype(np.int64) << 32) + rank[pick])],
                    names=["token", "doc", "meta"])

    return (documents.select("doc_id", "text")
            .mapInArrow(run, "token bigint, doc bigint, meta bigint"))


def _verified(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts' sets have the wanted Jaccard.

    Members ``b`` stream past their centre ``a``; a centre with many members is copied, one
    copy per MEMBERS of them.  Texts are fetched once for all their roles.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).alias("_copies"))
    dealt = pairs.join(counts, "a").withColumn(
        "copy", F.pmod(F.xxhash64("b"), F.col("_copies")))
    roles = dealt.select("a", "copy", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(
        dealt.select("a", "copy", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct())
    few = roles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = documents.select("doc_id", "text").join(F.broadcast(roles) if few else roles, "doc_id")
    rows = (texts.repartition("a", "copy").sortWithinPartitions("a", "copy", "role", "doc_id")
            .select("a", "copy", "role", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            roles_, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hits: list[tuple[int, int]] = []
            for block in blocks(batch.column(4), lower=True):
                h, _, n = shingle_sets(block, size)
                ends = np.cumsum(n)
                for i in range(len(block)):
                    row = block.row + i
                    own = h[ends[i] - n[i]:ends[i]]
                    if places[row] != at:
                        at, centres = places[row], []
                    if roles_[row] == 0:
                        centres.append(own.copy())
                        continue
                    for centre in centres:
                        found = np.searchsorted(centre, own)
                        found[found == len(centre)] = 0
                        both = int((centre[found] == own).sum()) if len(centre) else 0
                        if both and 100 * both >= percent * (len(own) + len(centre) - both):
                            hits.append((at[0], ids[row]))
                            break
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)],
                                                 names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def join_similar(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents`` (``doc_id, text``).

    Texts are lower-cased in A-Z and cut into words; two documents link when
    100 * intersection >= percent * union of their shingle sets.  ``component_id`` is the least
    doc_id reachable by links.  Documents without words link with nothing; a null text has no
    words.  Rows with a null doc_id are not joined (null component).  Rows that share a doc_id
    are one node: what links with one links with all.  Other columns are ignored.  Empty
    input: no rows.  The whole computation runs when called; the result is checkpointed.
    """
    spark = ship(documents.sparkSession)
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                             F.col("text").cast("string").alias("text"))
    known = named.where("doc_id is not null")
    with Scratch(spark) as keep:
        profile = keep(_profile(named, size))
        sizes = profile.where("part is null").select("doc_id", "n", "k1", "k2")
        levels = _levels(profile.where("part is not null").select("part", "counts"))

        # equal sets: a star around the least id
        ids = sizes.where("doc_id is not null and n > 0")
        stars = (ids.join(ids.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("b"), F.count("*").alias("_c"))
                          .where("_c > 1"), ["k1", "k2", "n"])
                 .select(F.col("doc_id").alias("a"), "b").where("a <> b"))

        by_token, by_part = Window.partitionBy("token"), Window.partitionBy("token", "comp")
        lists = keep(
            _prefixes(known, levels, size, percent)
            .select("token", "doc", F.shiftright("meta", 32).alias("n"),
                    F.col("meta").bitwiseAND((1 << 32) - 1).alias("rank")).repartition("token")
            .withColumn("centre", F.min(F.struct("rank", "doc", "n")).over(by_token))
            .withColumn("_met", F.count("*").over(by_token)).where("_met > 1")
            .select("token", "doc", "n", "rank", F.col("centre.doc").alias("centre_doc"),
                    F.col("centre.n").alias("centre_n"), F.col("centre.rank").alias("centre_rank")))

        def overlap(a: str, b: str) -> Column:
            return F.ceil(percent * (F.col(a) + F.col(b)) / F.lit(100.0 + percent) - 1e-9)

        def within(one: str, other: str, k: Column) -> Column:
            """Both entries lie in the k-prefixes that this pair of sizes asks for."""
            o, (n, m) = overlap(f"{one}n", f"{other}n"), (F.col(f"{one}n"), F.col(f"{other}n"))
            return ((o <= F.least(n, m)) & (F.col(f"{one}rank") < n - o + k)
                    & (F.col(f"{other}rank") < m - o + k))

        met = (lists.where("doc <> centre_doc").where(within("", "centre_", F.lit(1)))
               .groupBy("doc", "centre_doc").agg(F.count("*").alias("met")))
        best = Window.partitionBy("doc").orderBy(F.desc("met"), "centre_doc")
        first = keep(met.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= CENTRES)
                     .select(F.col("centre_doc").alias("a"), F.col("doc").alias("b")))
        links = keep(_verified(first, known, size, percent))
        edges = stars.unionByName(links)
        comps = components(edges, keep)

        # lists that still hold several components; ``others``: entries of other components,
        # ``outside``: not of the list's largest component
        joined = (lists.select("token", "doc", "n", "rank")
                  .join(comps.withColumnRenamed("node", "doc"), "doc", "left")
                  .withColumn("comp", F.coalesce("comp", "doc")).repartition("token"))
        open_ = keep(joined.withColumn("_met", F.count("*").over(by_token))
                     .withColumn("_own", F.count("*").over(by_part)).where("_met > _own")
                     .withColumn("_main", F.max(F.struct("_own", "comp")).over(by_token)["comp"])
                     .select("token", "doc", "n", "rank", "comp", (F.col("_met") - F.col("_own")).alias("others"),
                             (F.col("comp") != F.col("_main")).alias("outside")))
        # k by estimated cost for partners of equal size: entries scanned, and candidates to verify
        # if k shared ones are asked
        most = F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100.0 + percent))
        spread = [F.sum(F.when(F.col("rank") < most + k, F.col("others"))).alias(f"s{k}") for k in STEPS]
        costs = F.array(*[F.struct((F.coalesce(F.col(f"s{k}"), F.lit(0)) * (1 + VERIFY_COST / k)).alias("cost"),
                                   F.lit(k).alias("k")) for k in STEPS])
        chosen = (open_.groupBy("doc").agg(*spread)
                  .select("doc", F.array_min(costs)["k"].alias("k")))
        loosest = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100.0))
        entries = keep(open_.join(chosen, "doc").where(F.col("rank") < loosest + F.col("k"))
                       .select("token", "doc", "n", "rank", "comp", "k", "outside"))
        left, right = (entries.select("token", *[F.col(c).alias(f"{s}{c}") for c in
                                                 ("doc", "n", "rank", "comp", "k", "outside")])
                       for s in ("a_", "b_"))
        # a pair of small sets need not share more than its overlap
        k = F.least("a_k", "b_k", overlap("a_n", "b_n"))
        candidates = (left.where("a_outside").join(right, "token")
                      .where("a_comp <> b_comp and (not b_outside or a_doc < b_doc)")
                      .where(within("a_", "b_", k))
                      .groupBy(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"))
                      .agg(F.count("*").alias("met"), F.min(k).alias("k"))
                      .where("met >= k").select("a", "b"))
        tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        second = keep(candidates.join(tried, ["a", "b"], "left_anti"))
        more = keep(_verified(second, known, size, percent))
        final = components(edges.unionByName(more), keep)
        out = (sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
               .select("doc_id", F.col("n").alias("n_shingles"),
                       F.coalesce("comp", "doc_id").alias("component_id")))
        return out.checkpoint(eager=True)
