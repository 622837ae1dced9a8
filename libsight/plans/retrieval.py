"""Review, watch, conversation and retrieval queries."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from libsight.functions import text as tx, vectors
from libsight.operators import cells, context, review, search, store, watch
from libsight.plans.registry import Tables, query
from libsight.plans.texts import ITEM_CHUNKS
from libsight.session import checkpoint_dir, cut_lineage

TODAY = "2024-01-30"

DECK = """WITH marked AS (SELECT *, max(CASE WHEN grade = 'again' THEN (ts, review_id) END) OVER (PARTITION BY card_key) AS again FROM reviews),
folded AS (SELECT card_key,
  least(5, coalesce(sum(CASE WHEN again IS NULL OR (ts, review_id) > again THEN CASE grade WHEN 'easy' THEN 2 WHEN 'good' THEN 1 END END), 0)) AS step,
  count(*) FILTER (grade = 'again') AS lapses, count(*) AS reviews,
  arg_max(grade, (ts, review_id)) AS last_grade, max(ts)::DATE AS last_day FROM marked GROUP BY card_key),
deck AS (SELECT card_key, last_day + CASE WHEN last_grade = 'again' THEN 1 ELSE ([1, 3, 7, 16, 35, 90])[CAST(step + 1 AS INT)] END AS due,
  CAST(step AS INT) AS step, lapses, reviews, last_grade FROM folded)
"""


def _deck(t: Tables) -> DataFrame:
    return review.deck_state(t.reviews)


@query(DECK + "SELECT card_key, CAST(due AS VARCHAR) AS due, step, lapses, reviews, last_grade FROM deck")
def review_deck(t: Tables) -> DataFrame:
    return _deck(t).withColumn("due", F.col("due").cast("string"))


@query(DECK + f"""SELECT count(*) AS total, count(*) FILTER (due <= DATE '{TODAY}') AS due,
count(*) FILTER (step >= 3) AS mature, CAST(sum(lapses) AS BIGINT) AS lapses FROM deck""")
def deck_stats(t: Tables) -> DataFrame:
    return review.deck_stats(_deck(t), TODAY)


@query(DECK + f"""SELECT d.card_key, CAST(d.due AS VARCHAR) AS due, d.reviews, a.text, i.title FROM deck d
JOIN annotations a ON a.annotation_key = d.card_key JOIN items i ON i.item_key = a.item_key
WHERE due <= DATE '{TODAY}' ORDER BY due, reviews, card_key LIMIT 12""")
def due_cards(t: Tables) -> DataFrame:
    due = review.due_cards(_deck(t), t.annotations.select("annotation_key", "item_key", "text"),
                           t.items.select("item_key", "title"), TODAY)
    return due.select("card_key", F.col("due").cast("string").alias("due"), "reviews", "text", "title")


@query(f"""SELECT annotation_key AS card_key, item_key, CAST(DATE '{TODAY}' + 1 AS VARCHAR) AS due
FROM annotations WHERE length(text || ' ' || text) >= 25 AND annotation_key NOT IN (SELECT card_key FROM reviews)""")
def enrol_annotations(t: Tables) -> DataFrame:
    # the text of this table is short, so it is said twice, as a comment
    marks = t.annotations.withColumns({"comment": F.concat_ws(" ", "text", "text"), "text": F.lit("")})
    new = review.enrol(marks, t.reviews.select("card_key").distinct(), TODAY)
    return new.select("card_key", "item_key", F.col("due").cast("string").alias("due"))


@query("""SELECT annotation_key FROM annotations WHERE length(text || ' ' || text) >= 25""")
def review_eligible(t: Tables) -> DataFrame:
    # the text of this table is short, so it is said twice, as a comment
    marks = t.annotations.withColumns({"comment": F.concat_ws(" ", "text", "text"), "text": F.lit("")})
    return marks.where(review.reviewable()).select("annotation_key")


# --- watches

@query("""SELECT watch_id, finding_id, CAST(day AS VARCHAR) AS run_day FROM (
  SELECT watch_id, finding_id, min(run_day) AS day FROM findings GROUP BY ALL) f
JOIN (SELECT watch_id, min(run_day) AS base FROM findings GROUP BY ALL) b USING (watch_id) WHERE day > base""")
def new_findings(t: Tables) -> DataFrame:
    return watch.replay(t.findings).withColumn("run_day", F.col("run_day").cast("string"))


@query("""WITH runs AS (SELECT event_type AS watch_id, user_id || props AS finding_id, CAST(ts AS DATE) AS run_day FROM events),
last AS (SELECT max(run_day) AS d FROM runs)
SELECT DISTINCT watch_id, finding_id FROM runs, last WHERE run_day = d AND (watch_id, finding_id) NOT IN
(SELECT (watch_id, finding_id) FROM runs, last WHERE run_day < d)""")
def unseen_findings(t: Tables) -> DataFrame:
    runs = t.events.select(
        F.col("event_type").alias("watch_id"), F.to_date("ts").alias("run_day"),
        F.concat(F.col("user_id").cast("string"), "props").alias("finding_id"), F.lit(1).alias("_one"))
    last = runs.agg(F.max("run_day").alias("_last")).withColumn("_one", F.lit(1))
    dated = runs.join(last, "_one")
    current, earlier = dated.where("run_day = _last"), dated.where("run_day < _last")
    ran = earlier.select("watch_id").distinct()
    return watch.alerts(current, earlier, ran).select("watch_id", "finding_id")


@query("""SELECT watch_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY watch_id
ORDER BY d DESC, finding_id) AS rn FROM (SELECT watch_id, finding_id, max(run_day) AS d FROM findings GROUP BY ALL) x) y
WHERE rn <= 100""")
def seen_memory(t: Tables) -> DataFrame:
    seen = t.findings.withColumnRenamed("run_day", "seen_at")
    return watch.remember(seen, seen, memory=100).select("watch_id", "finding_id")


# --- conversation and tokens

TOKENS = """CAST(ceil(length(regexp_replace(text, '[^\\x{3000}-\\x{9fff}\\x{ff00}-\\x{ffef}]', '', 'g')) / 1.5::DOUBLE
+ length(regexp_replace(text, '[\\x{3000}-\\x{9fff}\\x{ff00}-\\x{ffef}]', '', 'g')) / 3.8::DOUBLE) AS BIGINT)"""


@query(f"""SELECT conv_id, turn, role FROM (SELECT *, sum({TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used,
row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM turns) x
WHERE (used <= 300 OR rn = 1) AND trim(text) <> ''""")
def history_budget(t: Tables) -> DataFrame:
    return context.history(t.turns, budget=300).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS newest FROM turns) x
WHERE turn = newest AND trim(text) <> ''""")
def history_one_shot(t: Tables) -> DataFrame:
    return context.history(t.turns, one_shot=True).select("conv_id", "turn")


# --- retrieval

TOKENISED = """WITH toks AS (SELECT chunk_id, item_key, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS tk FROM corpus),
lens AS (SELECT chunk_id, len(tk) AS length FROM toks),
posting AS (SELECT token, chunk_id, item_key, count(*) AS tf FROM (SELECT chunk_id, item_key, unnest(tk) AS token FROM toks) u GROUP BY ALL),
freq AS (SELECT token, count(*) AS df FROM posting GROUP BY token),
stats AS (SELECT count(*) AS n, avg(length) AS al FROM lens)
"""
BM25 = TOKENISED + """, qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]{2,}')) AS token FROM search_queries),
raw AS (SELECT q.query_id, p.chunk_id, p.item_key,
  sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE
      / (tf + 1.4::DOUBLE * (0.28::DOUBLE + 0.72::DOUBLE * length / al))) AS s
  FROM qt q JOIN posting p USING (token) JOIN freq USING (token) JOIN lens USING (chunk_id), stats GROUP BY ALL),
lexical AS (SELECT query_id, chunk_id, item_key, s / max(s) OVER (PARTITION BY query_id) AS lexical FROM raw WHERE s > 0)
"""
TOP = """, capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS position FROM capped WHERE rn <= 3)
"""


@query(TOKENISED + "SELECT token, df FROM freq")
def token_frequency(t: Tables) -> DataFrame:
    return search.document_frequency(search.postings(t.corpus))


@query(TOKENISED + "SELECT n, round(al, 6) AS avg_length FROM stats")
def corpus_stats(t: Tables) -> DataFrame:
    return search.corpus_stats(t.corpus).withColumn("avg_length", F.round("avg_length", 6))


@query("""SELECT count(*) AS chunks, count(DISTINCT item_key) AS items, count(embedding) AS vectors
FROM corpus LEFT JOIN embeddings ON vec_id = chunk_id""")
def index_stats(t: Tables) -> DataFrame:
    return search.index_stats(_vector_chunks(t))


@contextlib.contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder that all executors reach, deleted at the end; results must not read it later."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _revised(t: Tables, path: str) -> store.Store:
    """The corpus, with some items replaced and some removed after it was stored."""
    kept = store.Store(t.spark, path)
    kept.upsert(t.corpus)
    kept.upsert(t.corpus.where("item_key % 7 = 3").withColumn("text", F.concat("text", F.lit(" added later"))))
    kept.remove(t.corpus.where("item_key % 7 = 5").select("item_key"))
    return kept


REVISED = """revised AS (SELECT chunk_id, item_key, CASE WHEN item_key % 7 = 3 THEN text || ' added later' ELSE text END AS text
  FROM corpus WHERE item_key % 7 <> 5)"""


@query("WITH " + REVISED + ", " + BM25.replace("FROM corpus", "FROM revised")[5:] + ", scored AS (SELECT *, lexical AS score FROM lexical WHERE lexical > 0.001)" + TOP +
       "SELECT query_id, chunk_id, item_key, CAST(position AS INT) AS position, round(score, 6) AS score FROM best WHERE position <= 8")
def stored_search(t: Tables) -> DataFrame:
    with shared_folder(t.spark) as path:
        hits = _revised(t, path).search(t.search_queries)
        return cut_lineage(hits.select("query_id", "chunk_id", "item_key", "position", F.round("score", 6).alias("score")))


@query("WITH " + REVISED + ", " + TOKENISED.replace("FROM corpus", "FROM revised")[5:] + """
SELECT token, df, n AS chunks, (SELECT count(DISTINCT item_key) FROM revised) AS items, round(al, 6) AS avg_length FROM freq, stats""")
def stored_figures(t: Tables) -> DataFrame:
    with shared_folder(t.spark) as path:
        kept = _revised(t, path)
        figures = kept.figures().select("chunks", "items", F.round(F.col("length") / F.col("chunks"), 6).alias("avg_length"))
        return cut_lineage(kept.document_frequency().join(F.broadcast(figures)))


@query("WITH " + REVISED + " SELECT chunk_id, item_key, text FROM revised")
def stored_chunks(t: Tables) -> DataFrame:
    with shared_folder(t.spark) as path:
        kept = _revised(t, path)
        kept.compact()
        return cut_lineage(kept.chunks())


@query(BM25 + "SELECT query_id, chunk_id, round(lexical, 6) AS lexical FROM lexical")
def bm25_scores(t: Tables) -> DataFrame:
    scores = search.lexical_scores(t.search_queries, t.corpus)
    return scores.select("query_id", "chunk_id", F.round("lexical", 6).alias("lexical"))


@query(BM25 + ", scored AS (SELECT *, lexical AS score FROM lexical WHERE lexical > 0.001)" + TOP +
       "SELECT query_id, chunk_id, item_key, CAST(position AS INT) AS position, round(score, 6) AS score FROM best WHERE position <= 8")
def lexical_search(t: Tables) -> DataFrame:
    hits = search.lexical_search(t.search_queries, t.corpus)
    return hits.select("query_id", "chunk_id", "item_key", "position", F.round("score", 6).alias("score"))


# query vectors: the centroid of each label's embeddings
CENTROIDS = """centroid AS (SELECT query_id, list(x ORDER BY i) AS qv FROM (
  SELECT label AS query_id, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) c GROUP BY ALL)
"""
COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], c.qv)"


def _query_vectors(t: Tables) -> DataFrame:
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qv"))


def _vector_chunks(t: Tables) -> DataFrame:
    stored = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return t.corpus.join(stored, "chunk_id", "left")


@query("WITH " + CENTROIDS + f"""SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(position AS INT) AS position, round(score, 6) AS score FROM (
  SELECT c.query_id, vec_id AS chunk_id, 0.62::DOUBLE * ({COSINE} + 1) / 2 AS score,
    row_number() OVER (PARTITION BY c.query_id ORDER BY {COSINE} DESC, vec_id) AS position
  FROM embeddings e, centroid c) x WHERE position <= 8""")
def semantic_search(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("item_key"),
                                 F.col("embedding").alias("vector"))
    hits = search.vector_search(chunks, _query_vectors(t))
    return hits.select("query_id", "chunk_id", "position", F.round("score", 6).alias("score"))


@query("WITH " + CENTROIDS + f"""SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(position AS INT) AS position, round(score, 6) AS score FROM (
  SELECT c.query_id, vec_id AS chunk_id, 0.62::DOUBLE * ({COSINE} + 1) / 2 AS score,
    row_number() OVER (PARTITION BY c.query_id ORDER BY {COSINE} DESC, vec_id) AS position
  FROM embeddings e, centroid c) x WHERE position <= 8""")
def cell_search(t: Tables) -> DataFrame:
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("item_key"),
                                 F.col("embedding").alias("vector"))
    with shared_folder(t.spark) as path:
        cells.build(chunks, path)
        hits = cells.search_cells(t.spark, path, _query_vectors(t))
        return cut_lineage(hits.select("query_id", "chunk_id", "position", F.round("score", 6).alias("score")))


@query(BM25 + ", " + CENTROIDS + f""", sem AS (
  SELECT c.query_id, vec_id AS chunk_id, ({COSINE} + 1) / 2 AS semantic FROM embeddings e, centroid c),
scored AS (SELECT c.query_id, k.chunk_id, k.item_key,
  0.62::DOUBLE * coalesce(s.semantic, 0) + 0.38::DOUBLE * coalesce(l.lexical, 0) AS score
  FROM (SELECT query_id FROM centroid WHERE query_id IN (SELECT query_id FROM search_queries)) c CROSS JOIN corpus k
  LEFT JOIN sem s ON s.query_id = c.query_id AND s.chunk_id = k.chunk_id
  LEFT JOIN lexical l ON l.query_id = c.query_id AND l.chunk_id = k.chunk_id)""" + TOP +
       "SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(position AS INT) AS position, round(score, 6) AS score FROM best WHERE position <= 8")
def hybrid_search(t: Tables) -> DataFrame:
    queries = t.search_queries.join(_query_vectors(t), "query_id")
    hits = search.hybrid_search(queries, _vector_chunks(t))
    return hits.select("query_id", "chunk_id", "position", F.round("score", 6).alias("score"))


@query("""SELECT query_id, item_key, CAST(position AS INT) AS position FROM (
  SELECT n_nationkey AS query_id, i.item_key, row_number() OVER (PARTITION BY n_nationkey ORDER BY i.item_key) AS position
  FROM nation CROSS JOIN items i WHERE contains(lower(i.title || ' ' || i.venue), lower(lpad(CAST(n_nationkey AS VARCHAR), 4, '0')))) x
WHERE position <= 8""")
def fallback_search(t: Tables) -> DataFrame:
    queries = t.nation.select(F.col("n_nationkey").alias("query_id"),
                              F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("query"))
    hits = search.fallback_search(queries, t.items, columns=("title", "venue"))
    return hits.select("query_id", "item_key", "position")


@query("""SELECT item_key FROM items WHERE item_key NOT IN (SELECT item_key FROM corpus WHERE item_key IS NOT NULL)""")
def not_indexed(t: Tables) -> DataFrame:
    return search.not_indexed(t.items, t.corpus).select("item_key")


@query("""SELECT chunk_id, item_key, text FROM corpus
WHERE item_key NOT IN (SELECT item_key FROM corpus WHERE contains(text, 'Re er'))
UNION ALL SELECT chunk_id, item_key, upper(text) FROM corpus WHERE contains(text, 'Re er')""")
def index_upsert(t: Tables) -> DataFrame:
    incoming = t.corpus.where(F.contains("text", F.lit("Re er"))).withColumn("text", tx.upper("text"))
    return search.upsert(t.corpus, incoming)


@query("""SELECT chunk_id FROM corpus WHERE item_key NOT IN (SELECT item_key FROM corpus WHERE contains(text, 'Re er'))""")
def index_remove(t: Tables) -> DataFrame:
    gone = t.corpus.where(F.contains("text", F.lit("Re er")))
    return search.remove_items(t.corpus, gone).select("chunk_id")


@query("WITH " + CENTROIDS + f"""SELECT CAST(c.query_id AS BIGINT) AS query_id, vec_id, round({COSINE}, 6) AS cosine,
round(({COSINE} + 1) / 2, 6) AS semantic FROM embeddings e JOIN centroid c ON c.query_id = e.label""")
def vector_cosine(t: Tables) -> DataFrame:
    own = t.embeddings.withColumn("query_id", F.col("label").cast("long")).join(_query_vectors(t), "query_id")
    cosine = vectors.cosine("embedding", "qv")
    return own.select("query_id", "vec_id", F.round(cosine, 6).alias("cosine"),
                      F.round(vectors.semantic_score(cosine), 6).alias("semantic"))


@query("""SELECT vec_id, round(top / 127, 9) AS scale, CAST(list_sum(list_transform(embedding, lambda x:
  greatest(-127, least(127, floor(x::DOUBLE / (top / 127) + 0.5))))) AS BIGINT) AS code_sum
FROM (SELECT *, greatest(1e-8, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS top FROM embeddings) e""")
def vector_quantise(t: Tables) -> DataFrame:
    stored = t.embeddings.withColumn("q", vectors.quantise("embedding"))
    return stored.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate(
        "q.codes", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("code_sum"))


def _documents_as_items(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("item_key"),
                              F.concat(F.lit("Title: document "), F.col("doc_id").cast("string"))
                              .alias("meta"), F.array("text").alias("pages"))


@query(ITEM_CHUNKS + "SELECT * FROM built WHERE item_key NOT IN (SELECT doc_id FROM labels)")
def build_chunks(t: Tables) -> DataFrame:
    indexed = t.labels.select(F.col("doc_id").alias("item_key"))
    return search.build_chunks(_documents_as_items(t), indexed)


@query(BM25.replace("max(s) OVER (PARTITION BY query_id)", "max(s) OVER (PARTITION BY query_id, item_key)") + """
SELECT query_id, item_key, chunk_id, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id, item_key ORDER BY round(lexical, 9) DESC, chunk_id) AS position FROM lexical WHERE lexical > 0.001) x
WHERE position <= 3""")
def claim_evidence(t: Tables) -> DataFrame:
    hits = search.evidence(t.search_queries, t.corpus)
    return hits.select("query_id", "item_key", "chunk_id", "position")


def _hits(t: Tables) -> DataFrame:
    found = search.lexical_search(t.search_queries, t.corpus)
    return found.join(t.corpus.select("chunk_id", "text"), "chunk_id").withColumns({
        "title": F.concat(F.lit("Source "), F.col("item_key").cast("string")), "page": F.lit(0)})


@query(BM25 + ", scored AS (SELECT *, lexical AS score FROM lexical WHERE lexical > 0.001)" + TOP + """
SELECT query_id, string_agg('[' || position || '] Source ' || b.item_key || ' (p. 1)' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS excerpts
FROM best b JOIN corpus USING (chunk_id) WHERE position <= 8 GROUP BY query_id""")
def excerpt_context(t: Tables) -> DataFrame:
    return context.excerpts(_hits(t))


@query(BM25 + ", scored AS (SELECT *, lexical AS score FROM lexical WHERE lexical > 0.001)" + TOP + """
SELECT query_id, 'Source ' || b.item_key AS title, 0 AS page, b.item_key, round(score, 6) AS score, substring(text, 1, 400) AS text
FROM best b JOIN corpus USING (chunk_id) WHERE position <= 8""")
def source_list(t: Tables) -> DataFrame:
    return context.source_list(_hits(t)).withColumn("score", F.round("score", 6))


@query("""SELECT item_key, string_agg('(p. ' || (page + 1) || ') "' || text || '"  [' || color || ']', chr(10)
ORDER BY page, annotation_key) AS annotations FROM annotations GROUP BY item_key""")
def annotation_context(t: Tables) -> DataFrame:
    marks = t.annotations.withColumns({"comment": F.lit(None).cast("string"), "tags": F.array("color"),
                                       "page_label": (F.col("page") + 1).cast("string")})
    return context.annotation_context(marks)


@query("SELECT array_to_string(list_sort(list(tag)), ', ') AS tags FROM (SELECT DISTINCT tag FROM item_tags ORDER BY tag LIMIT 100) x")
def library_tags(t: Tables) -> DataFrame:
    return context.library_tags(t.item_tags)


@query(f"SELECT doc_id, {TOKENS} AS tokens, regexp_matches(text, '[\\x{{3000}}-\\x{{9fff}}\\x{{ff00}}-\\x{{ffef}}]') AS cjk FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.estimate_tokens("text").alias("tokens"),
                              tx.has_cjk("text").alias("cjk"))
