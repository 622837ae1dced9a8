"""Index build and hybrid retrieval.

Chunks: ``chunk_id, item_key, page, text`` and optionally ``vector``.  Postings:
``token, chunk_id, item_key, tf, length``, one row per token and chunk.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from libsight.functions import text as tx, vectors
from libsight.functions.ordered import broadcast_if_small, top_per_group
from libsight.functions.substring import contains_join
from libsight.operators import scoring
from libsight.session import cut_lineage

K1 = 1.4
B = 0.72
SEMANTIC_WEIGHT = 0.62
LEXICAL_WEIGHT = 0.38
MIN_SCORE = 0.001
PER_ITEM = 3
TOP_K = 8
QUERY_BLOCK = 1024
#: Places of a lexical share that count for its rank; sums of one chunk's gains differ beyond by their order.
DIGITS = 9


# --- index build

def _pack(pieces: Sequence[dict], size: int, overlap: int) -> list[tuple[int, str]]:
    """Fill buffers with pieces; a full buffer is emitted and its tail carried over."""
    done: list[tuple[int, str]] = []
    held, page = "", 0
    for piece in pieces:
        if len(held) + len(piece["body"]) > size:
            if len(held.strip()) >= tx.MIN_CHUNK:
                done.append((page, held.strip()))
            held, page = (held[-overlap:] if overlap > 0 else ""), piece["page"]
        held += piece["body"] + piece["gap"]
    if len(held.strip()) >= tx.MIN_CHUNK:
        done.append((page, held.strip()))
    return done


def chunk_text(documents: DataFrame, size: int = 1200, overlap: int = 160, key: str = "item_key",
               pages: str = "pages", carry: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping chunks ``key, n, page, text`` of documents given as page arrays.

    Splitting into paragraphs and sentences is done by native expressions; only
    the sequential packing runs in Python, over Arrow batches.  Columns ``carry`` stay with
    every chunk of their document.
    """
    def pieces_of(page_text, index):
        def of_paragraph(p):
            def piece(body, gap):
                return F.struct(index.alias("page"), body.alias("body"), F.lit(gap).alias("gap"))
            return F.when(F.length(p) > size, F.transform(
                tx.split_sentences(p), lambda s: piece(s, " "))).otherwise(F.array(piece(p, "\n\n")))
        return F.flatten(F.transform(tx.split_paragraphs(page_text), of_paragraph))

    prepared = documents.select(key, *carry, F.flatten(F.transform(F.col(pages), pieces_of)).alias("pieces"))
    out = T.StructType([documents.schema[key], T.StructField("n", T.IntegerType()),
                        T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()),
                        *[documents.schema[c] for c in carry]])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, page, body, *more)
                    for k, pieces, *more in zip(batch[key], batch["pieces"], *[batch[c] for c in carry])
                    for n, (page, body) in enumerate(_pack(pieces, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "n", "page", "text", *carry])

    return prepared.mapInPandas(pack, out)


def build_chunks(items: DataFrame, indexed: DataFrame | None = None, force: bool = False,
                 size: int = 1200, overlap: int = 160) -> DataFrame:
    """Chunks of items not indexed yet: ``chunk_id, item_key, page, text``.

    ``items`` has ``item_key, meta, pages``.  The metadata block goes first as
    page −1, or is the only body where there is no text.
    """
    rows = items
    if indexed is not None and not force:
        rows = not_indexed(items, indexed)
    body = F.filter("pages", lambda p: F.coalesce(p, F.lit("")) != "")
    rows = rows.withColumn("_body", body)
    has_body = F.size("_body") > 0
    # numbering starts at the metadata block where there is one
    headed = has_body & (F.coalesce("meta", F.lit("")) != "")
    rows = rows.withColumn("_shift", headed.cast("int"))
    chunked = chunk_text(rows.withColumn("_pages", F.when(has_body, F.col("_body"))
                                         .otherwise(F.array("meta"))),
                         size, overlap, pages="_pages", carry=("_shift",))
    heads = rows.where("_shift = 1").select(
        "item_key", F.lit(-1).alias("n"), F.lit(-1).alias("page"), F.col("meta").alias("text"), "_shift")
    together = chunked.unionByName(heads)
    return together.select(
        F.concat(F.col("item_key").cast("string"), F.lit(":"),
                 (F.col("n") + F.col("_shift")).cast("string")).alias("chunk_id"),
        "item_key", "page", "text")


def not_indexed(items: DataFrame, index: DataFrame) -> DataFrame:
    return items.join(index.select("item_key").distinct(), "item_key", "left_anti")


def upsert(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace every chunk of the incoming items."""
    return not_indexed(index, incoming).unionByName(incoming, allowMissingColumns=True)


def remove_items(index: DataFrame, gone: DataFrame) -> DataFrame:
    return not_indexed(index, gone)


def with_vectors(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks with quantised vectors where an embedding exists."""
    stored = embedded.withColumn("_q", vectors.quantise("embedding")).select(
        "chunk_id", F.col("_q.codes").alias("codes"), F.col("_q.scale").alias("scale"))
    return chunks.join(stored, "chunk_id", "left")


def index_stats(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("item_key").alias("items"),
                      F.count(vector).alias("vectors"))


def tokenised(chunks: DataFrame) -> DataFrame:
    tokens = chunks.select("chunk_id", "item_key", tx.lex_tokens("text").alias("tokens"))
    return tokens.withColumn("length", F.size("tokens"))


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Token counts per chunk; a ``vocabulary`` (token) prunes before the shuffle.

    Rows are placed by chunk, so what a search groups by chunk afterwards needs
    no further shuffle; ``tasks`` says over how many tasks.
    """
    words = tokenised(chunks).select("chunk_id", "item_key", "length",
                                     F.explode("tokens").alias("token"))
    if vocabulary is not None:
        words = words.join(vocabulary, "token", "left_semi")
    words = words.repartition(tasks, "chunk_id") if tasks else words.repartition("chunk_id")
    return words.groupBy("token", "chunk_id", "item_key", "length").agg(
        F.count("*").alias("tf"))


def write_postings(posting_rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Store postings by token bucket, so a search reads only its tokens' buckets."""
    (posting_rows.withColumn("bucket", token_bucket("token", buckets))
     .repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
     .sortWithinPartitions("bucket", "token")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def token_bucket(token: str, buckets: int = 256):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean token count."""
    lengths = chunks.select(tx.lex_count("text").alias("length"))
    return lengths.agg(F.count("*").alias("n"),
                       F.coalesce(F.avg("length"), F.lit(1.0)).alias("avg_length"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("token").agg(F.count("*").alias("df"))


# --- scores

def query_tokens(queries: DataFrame) -> DataFrame:
    """Distinct tokens per query."""
    return queries.select("query_id", F.explode(
        F.array_distinct(tx.lex_tokens("query"))).alias("token"))


def raw_bm25(queries: DataFrame, posting_rows: DataFrame, stats: DataFrame,
             pool: DataFrame | None = None, by_chunk: bool = False) -> DataFrame:
    """BM25 ``score`` per (query, chunk).

    Frequencies are corpus-wide even when ``pool`` (item_key) narrows the
    search.  Term weights are computed once per posting, not per query.  With a
    query set counted to be small, its tokens and their weights are broadcast
    and each chunk is scored where its postings lie; a larger one is joined by
    token.  ``by_chunk`` says the postings are already placed by chunk.
    """
    wanted = query_tokens(queries)
    sized = broadcast_if_small(wanted)
    hint = F.broadcast if sized is not wanted else (lambda df: df)
    hits = posting_rows.join(hint(wanted.select("token").distinct()), "token", "left_semi")
    if not by_chunk:
        hits = hits.repartition("chunk_id")
    df = document_frequency(hits).withColumn("_one", F.lit(1))
    # the corpus figures are one row
    weights = (df.join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").select(
        "token", "avg_length",
        F.log(1 + (F.greatest(F.lit(1), F.col("n")) - F.col("df") + 0.5)
              / (F.col("df") + 0.5)).alias("idf")))
    if pool is not None:
        hits = hits.join(pool.select("item_key").distinct(), "item_key", "left_semi")
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    weighted = hits.join(hint(weights), "token").select(
        "token", "chunk_id", "item_key",
        (F.col("idf") * (F.col("tf") * (K1 + 1)) / saturation).alias("w"))
    return (weighted.join(sized, "token").groupBy("query_id", "chunk_id", "item_key")
            .agg(F.sum("w").alias("score")).where("score > 0"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores as ``lexical``, divided by the best score of their query.

    The best score is an aggregate joined back, since a window would gather all
    chunks of a query in one task.
    """
    best = scores.groupBy("query_id").agg(F.max("score").alias("_best"))
    return scores.join(best, "query_id").select(
        "query_id", "chunk_id", "item_key", (F.col("score") / F.col("_best")).alias("lexical"))


def bm25(queries: DataFrame, posting_rows: DataFrame, stats: DataFrame,
         pool: DataFrame | None = None, by_chunk: bool = False) -> DataFrame:
    """BM25 per (query, chunk) as a share of the pool's best score."""
    return normalised(raw_bm25(queries, posting_rows, stats, pool, by_chunk))


#: Pairs of a query and a chunk that one task may have to sum up, and the most tasks dealt out for that.
PAIRS_PER_TASK = 1_000_000
MOST_TASKS = 20_000


def _tasks(queries: DataFrame, chunks: DataFrame) -> int:
    """Tasks to place postings in, so that a task's pairs do not grow with the tables.

    Postings are small and their pairs with the queries many, so neither the usual number of
    partitions nor one found by the postings' bytes bounds what a task holds.
    """
    usual = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = queries.select("query_id").count() * chunks.select("chunk_id").count()
    return max(usual, min(MOST_TASKS, -(-pairs // PAIRS_PER_TASK)))


def _raw_scores(queries: DataFrame, chunks: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    vocabulary = broadcast_if_small(query_tokens(queries).select("token").distinct())
    placed = postings(chunks, vocabulary, _tasks(queries, chunks))
    return raw_bm25(queries, placed, corpus_stats(chunks), pool, by_chunk=True)


def lexical_scores(queries: DataFrame, chunks: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """BM25 shares straight from the chunks; only the queries' own tokens are shuffled."""
    return normalised(_raw_scores(queries, chunks, pool))


def _shares(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``score`` as a share of the best one per key, also as ``lexical``; the negligible dropped.

    The best score is an aggregate joined back, since a window would gather all rows of a key in one task.
    """
    best = scores.groupBy(*keys).agg(F.max("score").alias("_best"))
    share = scores.join(best, list(keys)).withColumn("score", F.col("score") / F.col("_best")).drop("_best")
    return share.where(F.col("score") > MIN_SCORE).withColumn("lexical", F.col("score"))


def diverse_top(scored: DataFrame, k: int = TOP_K, per_item: int = PER_ITEM, digits: int | None = None) -> DataFrame:
    """At most ``per_item`` hits of an item, then the best ``k`` per query, with ``position``.

    Scores that are equal to ``digits`` places are ties, which the chunk's id breaks.
    """
    order = [(F.col("score") if digits is None else F.round("score", digits)).desc(), F.col("chunk_id")]
    capped = top_per_group(scored, ["query_id", "item_key"], order, per_item)
    return top_per_group(capped, ["query_id"], order, k, "position")


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K,
                   pool: DataFrame | None = None) -> DataFrame:
    """Search without vectors: the lexical score alone.

    Hits are ranked by their share of the query's best score, rounded.  Query sets whose weights
    fit a matrix are scored by products over batches of chunks, one pass for the best scores and
    one for the shares; larger ones by a join on the token.
    """
    wanted = cut_lineage(query_tokens(queries))
    if scoring.Weights.fits(wanted):
        shares = _array_shares(wanted, chunks, k, PER_ITEM, pool)
    else:
        shares = _shares(_raw_scores(queries, chunks, pool), ["query_id"])
    return diverse_top(shares, k, digits=DIGITS)


def _weighted(wanted: DataFrame, chunks: DataFrame, carry: tuple[str, ...] = ()
              ) -> tuple[DataFrame, scoring.Weights, np.ndarray]:
    """Encoded chunks, the queries' weights, and the weights' column of every encoded id."""
    rows = [tuple(r) for r in wanted.select("query_id", "token").collect()]  # at most MATRIX, counted before
    tokens = sorted({t for _, t in rows})
    encoded = scoring.encode(chunks, tokens, carry)
    weights = scoring.weights_of(encoded, rows, tokens)
    column = {t: i for i, t in enumerate(weights.tokens)}
    return encoded, weights, np.array([column.get(t, -1) for t in tokens], dtype=np.int64)


def _in_pool(chunks: DataFrame, pool: DataFrame | None) -> DataFrame:
    return chunks if pool is None else chunks.join(pool.select("item_key").distinct(), "item_key", "left_semi")


def _array_shares(wanted: DataFrame, chunks: DataFrame, k: int, per_item: int, pool: DataFrame | None) -> DataFrame:
    """``query_id, chunk_id, item_key, score, lexical`` of rows that can still win, by task."""
    encoded, weights, place = _weighted(wanted, chunks)
    rows = _in_pool(encoded, pool).select("chunk_id", "item_key", "length", "ids", "tfs")
    best = best_scores(_winning_rows(rows, wanted, weights, place, 1, 1))
    shares = _winning_rows(rows, wanted, weights, place, k, per_item, best)
    return shares.withColumn("lexical", F.col("score"))


def best_scores(scored: DataFrame) -> dict:
    """The best score of each query of a bounded set."""
    return {r["query_id"]: r["best"] for r in scored.groupBy("query_id").agg(F.max("score").alias("best")).collect()}


def _winning_rows(rows: DataFrame, wanted: DataFrame, weights: scoring.Weights, place: np.ndarray, k: int,
                 per_item: int, best: dict | None = None) -> DataFrame:
    """The pass over encoded chunks: every row scored, the winners of each task kept; by shares of ``best`` if given."""
    out = T.StructType([wanted.schema["query_id"], rows.schema["chunk_id"], rows.schema["item_key"],
                        T.StructField("score", T.DoubleType())])
    top = np.array([best.get(q, 1.0) if best else 1.0 for q in weights.ids])[:, None]
    least, digits = (MIN_SCORE, DIGITS) if best is not None else (0.0, None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winners = scoring.Winners(len(weights.ids), k, per_item, least, digits)
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for at in range(0, batch.num_rows, scoring.ROWS):
                cells = scoring.cells_of(batch, at, weights, place, K1, B)
                part = batch.slice(at, scoring.ROWS)
                winners.offer(weights.scores(*cells) / top, part.column("item_key").to_pylist(),
                              part.column("chunk_id").to_pylist())
        if kinds is not None:
            yield from winners.batches(weights.ids, kinds)

    return rows.mapInArrow(score, out)


def _cosines(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of rows against rows over the shorter length, 0 for a zero norm."""
    n = min(matrix.shape[1], queries.shape[1])
    a, b = matrix[:, :n], queries[:, :n]
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    dots = a @ b.T
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _local_best(scores: np.ndarray, items: np.ndarray, tie_rank: np.ndarray, k: int,
                per_item: int) -> list[int]:
    """Rows of one batch that can still be among the best: item cap, then k."""
    order = np.lexsort((tie_rank, -scores))
    used: Counter = Counter()
    kept: list[int] = []
    for i in order:
        if scores[i] <= MIN_SCORE or len(kept) == k:
            break
        if used[items[i]] < per_item:
            used[items[i]] += 1
            kept.append(int(i))
    return kept


def vector_search(chunks: DataFrame, query_vectors: DataFrame, lexical: DataFrame | None = None,
                  k: int = TOP_K, per_item: int = PER_ITEM) -> DataFrame:
    """Hybrid search with exact cosines: one pass over the chunk vectors.

    ``chunks`` has ``chunk_id, item_key, vector``; ``lexical`` the BM25 shares.
    Each Arrow batch is scored as one matrix product and keeps only rows that can
    still win, so what is shuffled is at most ``k`` rows per query and batch.
    A batch never drops a winner: rows ahead of it within the batch are also
    ahead of it overall.

    Query vectors travel in blocks of at most ``QUERY_BLOCK`` rows, so driver and tasks
    hold a bounded block whatever the number of queries; more queries mean more passes.
    """
    blocks = query_blocks(query_vectors)
    scored = None
    for some in blocks:
        lex = None if lexical is None else lexical.join(
            some.select("query_id"), "query_id", "left_semi")
        part = _scored_block(chunks, some, lex, k, per_item)
        scored = part if scored is None else scored.unionByName(part)
    return diverse_top(scored, k, per_item, None if lexical is None else DIGITS)


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of at most ``QUERY_BLOCK`` rows each; one block, perhaps empty, at least."""
    numbered = cut_lineage(queries.withColumn("_n", F.monotonically_increasing_id()))
    # rows are numbered within partitions, so no block is larger
    part = F.shiftright("_n", 33).alias("part"), F.floor(F.col("_n").bitwiseAND((1 << 33) - 1) / QUERY_BLOCK).alias("at")
    sizes = numbered.select(*part).groupBy("part", "at").count().orderBy("part", "at").collect()
    joined: list[list[tuple]] = [[]]
    held = 0
    for p, at, n in sizes:
        if held + n > QUERY_BLOCK:
            joined.append([])
            held = 0
        joined[-1].append((p, at))
        held += n
    out = []
    for group in joined:
        inside = F.lit(False)
        for p, at in group:
            start = (p << 33) + at * QUERY_BLOCK
            inside = inside | F.col("_n").between(start, start + QUERY_BLOCK - 1)
        out.append(numbered.where(inside).drop("_n"))
    return out


def _scored_block(chunks: DataFrame, query_vectors: DataFrame, lexical: DataFrame | None,
                  k: int, per_item: int) -> DataFrame:
    rows = query_vectors.select("query_id", "qv").orderBy("query_id").collect()
    ids = [r["query_id"] for r in rows]
    stacked = np.array([r["qv"] for r in rows], dtype=np.float64)
    place = {q: j for j, q in enumerate(ids)}
    prepared = chunks.select("chunk_id", "item_key", "vector")
    if lexical is not None:
        shares = lexical.groupBy("chunk_id").agg(
            F.collect_list("query_id").alias("_q"), F.collect_list("lexical").alias("_l"))
        prepared = prepared.join(shares, "chunk_id", "left")
    else:
        prepared = prepared.withColumns({"_q": F.lit(None).cast("array<bigint>"),
                                         "_l": F.lit(None).cast("array<double>")})
    out = T.StructType([query_vectors.schema["query_id"], chunks.schema["chunk_id"],
                        chunks.schema["item_key"], T.StructField("score", T.DoubleType()),
                        T.StructField("lexical", T.DoubleType()),
                        T.StructField("semantic", T.DoubleType())])
    names = [f.name for f in out]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            semantic = np.zeros((len(batch), len(ids)))
            sizes = batch["vector"].map(lambda v: 0 if v is None else len(v)).to_numpy()
            for size in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == size)
                matrix = np.vstack(batch["vector"].to_numpy()[at]).astype(np.float64)
                semantic[at] = (_cosines(matrix, stacked) + 1) / 2
            lex = np.zeros_like(semantic)
            for i, (qs, ls) in enumerate(zip(batch["_q"], batch["_l"])):
                if qs is not None:
                    lex[i, [place[q] for q in qs]] = ls
            total = (SEMANTIC_WEIGHT * semantic + LEXICAL_WEIGHT * lex)
            items, chunk_ids = batch["item_key"].to_numpy(), batch["chunk_id"].to_numpy()
            tie_rank = np.unique(chunk_ids, return_inverse=True)[1]
            ranks = total if lexical is None else np.round(total, DIGITS)
            kept = [_local_best(ranks[:, j], items, tie_rank, k, per_item)
                    for j in range(len(ids))]
            row = np.array([i for rows in kept for i in rows], dtype=np.int64)
            col = np.repeat(np.arange(len(ids)), [len(rows) for rows in kept])
            yield pd.DataFrame({
                "query_id": [ids[j] for j in col], "chunk_id": chunk_ids[row],
                "item_key": items[row], "score": total[row, col], "lexical": lex[row, col],
                "semantic": semantic[row, col]}, columns=names)

    return prepared.mapInPandas(score, out)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K,
                  pool: DataFrame | None = None, items: DataFrame | None = None,
                  columns: Sequence[str] = ("title",)) -> DataFrame:
    """The best search the inputs allow, chosen from the columns present.

    Queries with ``qv`` and chunks with ``vector`` search both ways, otherwise
    by text alone; without chunks (None) item metadata is searched.
    """
    if chunks is None:
        return fallback_search(queries, items, k, columns)
    if "qv" not in queries.columns or "vector" not in chunks.columns:
        return lexical_search(queries, chunks, k, pool)
    parts = [_hybrid_block(some, chunks, k, pool) for some in query_blocks(queries.select("query_id", "query", "qv"))]
    if all(part is not None for part in parts):
        return diverse_top(functools.reduce(DataFrame.unionByName, parts), k, digits=DIGITS)
    lexical = lexical_scores(queries, chunks, pool)
    return vector_search(_in_pool(chunks, pool), queries.select("query_id", "qv"), lexical, k)


def _hybrid_block(queries: DataFrame, chunks: DataFrame, k: int, pool: DataFrame | None) -> DataFrame | None:
    """Rows that can still win by both scores, for a block of queries; None if its weights fit no matrix.

    Chunks are encoded once; one pass finds each query's best lexical score, one scores everything
    where the chunk lies, so nothing is shuffled by chunk.
    """
    wanted = cut_lineage(query_tokens(queries))
    if not scoring.Weights.fits(wanted):
        return None
    encoded, weights, place = _weighted(wanted, chunks, ("vector",))
    rows = _in_pool(encoded, pool)
    best = best_scores(_winning_rows(
        rows.select("chunk_id", "item_key", "length", "ids", "tfs"), wanted, weights, place, 1, 1))
    asked = {r["query_id"]: r["qv"] for r in queries.select("query_id", "qv").collect()}
    ids = sorted(asked)
    line = {q: i for i, q in enumerate(weights.ids)}
    lexical_line = np.array([line.get(q, -1) for q in ids])
    scale = np.array([1 / best[q] if best.get(q) else 0.0 for q in ids])
    stacked = np.array([asked[q] for q in ids], dtype=np.float64)
    out = T.StructType([queries.schema["query_id"], rows.schema["chunk_id"], rows.schema["item_key"],
                        *[T.StructField(c, T.DoubleType()) for c in ("score", "lexical", "semantic")]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, kinds = scoring.Winners(len(ids), k, PER_ITEM, MIN_SCORE, DIGITS), None
        for batch in batches:
            kinds = batch.schema
            for at in range(0, batch.num_rows, scoring.ROWS):
                cells = scoring.cells_of(batch, at, weights, place, K1, B)
                part = batch.slice(at, scoring.ROWS)
                lexical = np.zeros((len(ids), part.num_rows))
                if weights.ids:
                    lexical[lexical_line >= 0] = weights.scores(*cells)[lexical_line[lexical_line >= 0]]
                lexical *= scale[:, None]
                semantic = np.zeros_like(lexical)
                sizes = pc.fill_null(pc.list_value_length(part.column("vector")), 0).to_numpy()
                for size in set(sizes.tolist()) - {0}:
                    where = np.flatnonzero(sizes == size)
                    matrix = part.column("vector").take(pa.array(where)).flatten().to_numpy(
                        zero_copy_only=False).astype(np.float64).reshape(len(where), size)
                    semantic[:, where] = ((_cosines(matrix, stacked) + 1) / 2).T
                top.offer(SEMANTIC_WEIGHT * semantic + LEXICAL_WEIGHT * lexical,
                          part.column("item_key").to_pylist(), part.column("chunk_id").to_pylist(),
                          more=lambda q, i, lexical=lexical, semantic=semantic: (lexical[q, i], semantic[q, i]))
        if kinds is not None:
            yield from top.batches(ids, kinds)

    return rows.select("chunk_id", "item_key", "vector", "length", "ids", "tfs").mapInArrow(score, out)


def fallback_search(queries: DataFrame, items: DataFrame, k: int = TOP_K,
                    columns: Sequence[str] = ("title",)) -> DataFrame:
    """Substring search over item metadata, constant score, first ``k`` by key."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    docs = items.select("item_key", hay.alias("_hay"))
    asked = queries.select("query_id", F.lower(tx.strip("query")).alias("_text"))
    found = contains_join(docs, "_hay", asked, "_text").select("query_id", "item_key")
    first = top_per_group(found, ["query_id"], [F.col("item_key")], k, "position")
    return first.select("query_id", F.concat(F.col("item_key").cast("string"), F.lit(":meta"))
                        .alias("chunk_id"), "item_key", F.lit(0.5).alias("score"),
                        F.lit(0.5).alias("lexical"), F.lit(0.0).alias("semantic"), "position")


def evidence(queries: DataFrame, chunks: DataFrame, per_item: int = 3) -> DataFrame:
    """Best chunks for every query inside every item that says anything on it.

    Pairs come from shared tokens; an item without any has no evidence and needs
    no row.
    """
    # scored once; ranks gather the rows of a query and an item anyway, so the best score is found there too
    scores = _raw_scores(queries, chunks).repartition(_tasks(queries, chunks), "query_id", "item_key")
    best = F.max("score").over(Window.partitionBy("query_id", "item_key"))
    shares = scores.withColumn("score", F.col("score") / best).where(F.col("score") > MIN_SCORE).withColumn("lexical", F.col("score"))
    order = [F.round("score", DIGITS).desc(), F.col("chunk_id")]
    return top_per_group(shares, ["query_id", "item_key"], order, per_item, "position")
