"""Payload, model-reply and callable-transform queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from libsight.functions import text as tx
from libsight.operators import annotations as anno
from libsight.operators import claims, context, passages, prompts, search, transform
from libsight.plans.library import HITS, RULES, _annotations
from libsight.plans.texts import ITEM_CHUNKS, KEYED, SENTENCES
from libsight.plans.registry import Tables, query
from libsight.plans.retrieval import BM25, _documents_as_items
from libsight.sources import digests, payloads
from libsight.sources.fixtures import spread


# --- landed payloads, built from the tables and read back

def _landed_refs(t: Tables) -> DataFrame:
    paper = F.struct(F.concat(F.lit("s"), F.col("cited_key").cast("string")).alias("paperId"),
                     F.concat(F.lit("  "), "title").alias("title"), F.lit(2020).alias("year"),
                     F.col("citations").alias("citationCount"),
                     F.transform(F.split("title", " "), lambda w: F.struct(w.alias("name"))).alias("authors"),
                     F.struct(F.col("doi").alias("DOI")).alias("externalIds"))
    return t.refs.groupBy("citing_key").agg(F.to_json(F.struct(F.collect_list(
        F.struct(paper.alias("citedPaper"))).alias("data"))).alias("payload")).withColumnRenamed(
        "citing_key", "item_key")


@query("""SELECT citing_key, title, doi, 2020 AS year, array_to_string(string_split(title, ' ')[1:3], ', ') AS authors,
CAST(citations AS BIGINT) AS citations, 's' || cited_key AS paper_id FROM refs WHERE length(title) > 6""")
def reference_ingest(t: Tables) -> DataFrame:
    return payloads.references(_landed_refs(t))


@query("""SELECT item_key, source, label, CAST(value AS VARCHAR) AS value FROM (
SELECT item_key, source, CASE source WHEN 'semanticscholar' THEN 'Total(S2)' WHEN 'openalex' THEN 'Total(OA)' ELSE 'Total(CR)' END AS label, cited AS value FROM source_counts
UNION ALL SELECT item_key, source, 'Highly Influential', 0 FROM source_counts WHERE source = 'semanticscholar') x""")
def count_ingest(t: Tables) -> DataFrame:
    n = F.col("cited").cast("string")
    payload = (F.when(F.col("source") == "semanticscholar", F.concat(F.lit('{"citationCount":'), n, F.lit("}")))
               .when(F.col("source") == "openalex", F.concat(F.lit('{"results":[{"cited_by_count":'), n, F.lit("}]}")))
               .otherwise(F.concat(F.lit('{"message":{"is-referenced-by-count":'), n, F.lit("}}"))))
    landed = t.source_counts.withColumns({"payload": payload, "fetched_at": F.lit("2024-01-01").cast("timestamp")})
    return payloads.citation_counts(landed).select("item_key", "source", "label", "value")


@query("""SELECT user_id AS item_key, CASE event_type WHEN 'click' THEN 'Background' WHEN 'purchase' THEN 'Methods' ELSE 'Results' END AS label,
count(*) AS value FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY ALL""")
def intent_tally(t: Tables) -> DataFrame:
    intent = (F.when(F.col("event_type") == "click", "background").when(F.col("event_type") == "purchase", "methodology")
              .when(F.col("event_type") == "error", "result").otherwise("other"))
    landed = t.events.select(F.col("user_id").alias("item_key"), F.to_json(F.struct(F.array(F.struct(
        F.array(intent).alias("intents"))).alias("data"))).alias("payload"))
    return payloads.intent_tally(landed)


@query("""SELECT source AS watch_id, 'd' || doc_id AS finding_id, lang AS title, 'A, B, C' AS authors, 2023 AS year,
CASE WHEN lang = 'en' THEN 'https://doi.org/10.1/' || doc_id ELSE 'https://www.semanticscholar.org/paper/d' || doc_id END AS url,
'Semantic Scholar' AS source FROM documents""")
def finding_ingest_json(t: Tables) -> DataFrame:
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    paper = F.struct(
        key.alias("paperId"), F.col("lang").alias("title"), F.lit(2023).alias("year"),
        F.transform(F.array(*map(F.lit, "ABCD")), lambda n: F.struct(n.alias("name"))).alias("authors"),
        F.struct(F.when(F.col("lang") == "en", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("DOI"))
        .alias("externalIds"))
    landed = t.documents.select(F.col("source").alias("watch_id"), F.to_json(F.struct(F.array(
        F.struct(paper.alias("citingPaper"))).alias("data"))).alias("payload"))
    return payloads.findings_json(landed)


@query("""SELECT url AS watch_id, 'http://x/' || page_id AS finding_id, 'A b' AS title, 'N1, N2, N3' AS authors,
2021 AS year, 'http://x/' || page_id AS url, 'arXiv' AS source FROM pages""")
def finding_ingest_atom(t: Tables) -> DataFrame:
    names = "".join(f"<author><name> N{i}</name></author>" for i in range(1, 6))
    entry = F.concat(F.lit("<feed><entry><id>http://x/"), F.col("page_id").cast("string"), F.lit(
        "</id>\n<title type='t'>A\n  b</title><published>2021-03-04T00:00:00Z</published>" + names
        + "</entry><entry><title>no id</title></entry></feed>"))
    return payloads.findings_atom(t.pages.select(F.col("url").alias("watch_id"), entry.alias("payload")))


@query("""SELECT c_custkey AS venue_key, 'sciUp' AS field, 'Q' || c_nationkey % 5 AS label FROM customer
UNION ALL SELECT c_custkey, 'own', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'jcr', 'custom' FROM customer""")
def rank_ingest(t: Tables) -> DataFrame:
    segment, tier = F.col("c_mktsegment"), (F.col("c_nationkey") % 5).cast("string")
    payload = F.concat(F.lit('{"data":{"officialRank":{"all":{"sciUp":"Q'), tier, F.lit(
        '","jcr":"official"}},"customRank":{"rankInfo":[{"abbName":"own","uuid":"u1","rank":"'), segment, F.lit(
        '"},{"abbName":"jcr","uuid":"u2","rank":"custom"},{"abbName":"nameless"}]}}}'))
    customers = spread(t.customer, "c_custkey")  # short rows: a file too small to split holds many
    records = payloads.rank_records(customers.select(F.col("c_custkey").alias("venue_key"), payload.alias("payload")))
    return records.select("venue_key", F.explode("record").alias("field", "label"))


# --- model replies

@query("""SELECT item_id AS item_key, 0 AS claim_no, text AS claim, CASE WHEN item_id = 0 THEN NULL ELSE CAST(item_id AS INT) END AS page FROM benchmark
UNION ALL SELECT item_id, 1, 'second', 7 FROM benchmark""")
def claim_reply(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("Here you are:\n"), F.to_json(F.array(
        F.struct(F.concat(F.lit(" "), "text").alias("claim"), F.col("item_id").cast("string").alias("page")))), F.lit(""))
    listed = F.concat(F.regexp_replace(answer, r"\]$", ""), F.lit(
        ',{"claim":5},{"other":"x"},{"claim":"second","page":7},{"claim":"cut","page":1}]\nDone.'))
    answers = t.benchmark.select(F.col("item_id").alias("item_key"), listed.alias("answer"))
    return payloads.claims(answers, limit=2)


@query("""SELECT event_id AS item_key, 0 AS claim_no, CASE WHEN event_type = 'click' THEN 'supports' WHEN event_type = 'error'
THEN 'contradicts' ELSE 'unclear' END AS verdict, event_type AS evidence, CAST(user_id AS INT) AS page FROM events WHERE user_id > 0
UNION ALL SELECT event_id, 0, CASE WHEN event_type = 'click' THEN 'supports' WHEN event_type = 'error'
THEN 'contradicts' ELSE 'unclear' END, event_type, NULL FROM events WHERE user_id = 0""")
def verdict_reply(t: Tables) -> DataFrame:
    verdict = F.when(F.col("event_type") == "click", "supports").when(F.col("event_type") == "error", "contradicts").otherwise("maybe")
    body = F.to_json(F.array(F.struct(F.lit(1).alias("claim"), verdict.alias("verdict"), F.col("event_type").alias("evidence"),
                                      F.col("user_id").alias("page"))))
    answers = t.events.select(F.col("event_id").alias("item_key"), F.lit(1).alias("n"), F.concat(
        F.lit("Sure. "), F.regexp_replace(body, r"\]$", ',{"claim":9,"verdict":"absent"}]')).alias("answer"))
    return payloads.verdicts(answers, claim_count="n")


@query("""SELECT doc_id, 2 AS page, trim(lang || ' ' || source || ' passage') AS quote, lang AS comment FROM documents""")
def passage_reply(t: Tables) -> DataFrame:
    quote = F.concat_ws(" ", "lang", "source", F.lit("passage"))
    body = F.to_json(F.array(F.struct(F.lit(2).alias("page"), quote.alias("quote"), F.col("lang").alias("comment")),
                             F.struct(F.lit(3).alias("page"), F.lit("short").alias("quote"), F.lit("").alias("comment"))))
    return payloads.passages(t.documents.select("doc_id", body.alias("answer")))


@query("""SELECT p_partkey, p_brand || '|' || p_type AS tags FROM part""")
def tag_reply(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("- "), "p_brand", F.lit("\n2. "), "p_type", F.lit("、x,, "), F.lit("y" * 50))
    return t.part.select("p_partkey", F.array_join(payloads.list_reply(answer), "|").alias("tags"))


@query("""SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS body, '' AS skipped FROM conversations""")
def numbered_reply(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("Translation:\n<<3>> "), "text", F.lit("\n<<1>>\n"), "role", F.lit("\n<<9>> out of range"))
    blocks = payloads.numbered_blocks(answer, 3)
    return t.conversations.select("conv_id", "turn", blocks[2].alias("body"), blocks[1].alias("skipped"))


@query("""SELECT conv_id, turn, text AS answer, role = 'assistant' AS truncated FROM conversations""")
def response_payload(t: Tables) -> DataFrame:
    cut = F.col("role") == "assistant"
    blocks = F.to_json(F.struct(F.array(
        F.struct(F.lit("thinking").alias("type"), F.lit("hidden").alias("text")),
        F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"),
        F.when(cut, "max_tokens").otherwise("end").alias("stop_reason")))
    choices = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.col("text").alias("content")).alias("message"),
        F.when(cut, "length").otherwise("stop").alias("finish_reason"))).alias("choices")))
    shape = F.when(F.col("turn") % 2 == 0, "blocks").otherwise("choices")
    rows = t.conversations.withColumn("shape", shape).withColumn(
        "payload", F.when(F.col("shape") == "blocks", blocks).otherwise(choices))
    return rows.select("conv_id", "turn", payloads.model_answer("payload", "shape").alias("r")).select(
        "conv_id", "turn", "r.answer", "r.truncated")


@query("""SELECT conv_id AS response_id, string_agg(text, '' ORDER BY turn) AS answer, false AS truncated FROM conversations GROUP BY conv_id""")
def streamed_response(t: Tables) -> DataFrame:
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    rows = t.conversations.select(F.col("conv_id").alias("response_id"), F.col("turn").alias("seq"),
                                  F.lit("choices").alias("shape"), delta.alias("payload"))
    return payloads.stream_answers(rows)


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'quota' WHEN event_type = 'click' THEN 'model'
WHEN user_id % 3 = 0 THEN 'rate' WHEN user_id % 3 = 1 THEN 'server' ELSE 'rejected' END AS kind FROM events) x GROUP BY kind""")
def failure_triage(t: Tables) -> DataFrame:
    body = (F.when(F.col("event_type") == "error", '{"error":{"message":"Insufficient quota"}}')
            .when(F.col("event_type") == "click", '{"message":"Model m does not exist"}')
            .otherwise("<html>busy</html>"))
    rest = F.array(F.lit(429), F.lit(503), F.lit(400))[(F.col("user_id") % 3).cast("int")]
    status = F.when(F.col("event_type").isin("error", "click"), 400).otherwise(rest)
    return payloads.failure_triage(t.events.select(status.alias("status"), body.alias("body")))


# --- callable transforms with stand-in callables

def _shout(texts: list[str]) -> list[str]:
    if any("password" in text for text in texts):
        raise ValueError("refused")
    return [text.replace("e", "E") for text in texts]


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'password') THEN NULL ELSE replace(text, 'e', 'E') END AS answer,
CASE WHEN contains(text, 'password') THEN 'refused' END AS error FROM conversations""")
def model_map(t: Tables) -> DataFrame:
    done = transform.model_map(t.conversations, _shout, "text", "stand-in", "shout", batch=16)
    return done.select("conv_id", "turn", "answer", "error")


@query("SELECT doc_id, length(text)::DOUBLE AS x, len(string_split(text, ' '))::DOUBLE AS y FROM documents")
def embedding_map(t: Tables) -> DataFrame:
    rows = transform.embed(t.documents.select("doc_id", "text"),
                           lambda texts: [[float(len(s)), float(len(s.split(" ")))] for s in texts])
    return rows.select("doc_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


def _lower_short(texts: list[str]) -> list[str]:
    return [text.lower() if len(text) < 300 else "" for text in texts]


ENGINES = (transform.Engine("first", _lower_short, batch=12),
           transform.Engine("paid", _shout, fallback=False),
           transform.Engine("second", _shout, batch=1))


def _cache(t: Tables) -> DataFrame:
    known = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("text").distinct()
    return known.select(F.lit("first").alias("engine"), F.lit("en").alias("lang"),
                        tx.text_key("text").alias("text_hash"), F.lit("cached").alias("value"))


@query("""SELECT text, CASE WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id)) THEN 'cached' END AS value
FROM (SELECT DISTINCT text FROM documents WHERE trim(text) <> '') d""")
def cache_lookup(t: Tables) -> DataFrame:
    texts = transform.distinct_texts(t.documents)
    return transform.cache_lookup(texts, _cache(t), "first", "en").select("text", "value")


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id)) THEN 'cached'
WHEN length(text) < 300 THEN lower(text) WHEN contains(text, 'password') THEN NULL ELSE replace(text, 'e', 'E') END AS translated FROM documents""")
def cached_translate(t: Tables) -> DataFrame:
    done = transform.translate(t.documents.select("doc_id", "text"), ENGINES, "first", "en", _cache(t))
    return done.select("doc_id", "translated")


@query("""SELECT item_key, replace(title, 'e', 'E') AS title_translated, replace(body, 'e', 'E') AS abstract_translated,
extra || chr(10) || 'lib-title: ' || replace(title, 'e', 'E') AS extra,
'<p>' || body || '</p>' || CASE WHEN contains(body, 'e') THEN chr(10) || chr(10) || '【translated】' || replace(body, 'e', 'E') ELSE '' END AS abstract
FROM (SELECT *, 'on ' || venue AS body FROM items) i""")
def metadata_translate(t: Tables) -> DataFrame:
    items = t.items.withColumn("abstract", F.concat(F.lit("<p>on "), "venue", F.lit("</p>")))
    engine = [transform.Engine("shout", _shout)]
    done = transform.translate(transform.metadata_texts(items), engine, "shout", "en")
    wide = items.join(transform.metadata_table(done), "item_key")
    return wide.select("item_key", "title_translated", "abstract_translated",
                       transform.append_title("extra", "title_translated").alias("extra"),
                       transform.append_abstract("abstract", "abstract_translated").alias("abstract"))


@query(f"""SELECT doc_id, CAST(page AS INT) AS page, CAST(pair_no AS INT) AS pair_no, original, replace(original, 'e', 'E') AS translated
FROM (SELECT doc_id, page, unnest(range(len(p))) AS pair_no, unnest(p) AS original FROM (
  SELECT doc_id, page, CASE WHEN len(s) >= 2 THEN s ELSE [text] END AS p FROM (
    SELECT doc_id, page, text, {SENTENCES} AS s FROM (
      SELECT doc_id, unnest(range(len(l))) AS page, unnest(l) AS text FROM (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b WHERE trim(text) <> '') c) d) e""")
def bilingual_pairs(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    # the pairs of every line, so this engine refuses none
    marked = transform.Engine("marked", lambda texts: [s.replace("e", "E") for s in texts])
    return transform.bilingual_pairs(transform.translate(lines, [marked], "marked", "en"))


@query("""SELECT annotation_key, '[explained] sEt ' || item_key AS comment FROM annotations WHERE item_key IS NOT NULL""")
def explain_annotations(t: Tables) -> DataFrame:
    marks = _annotations(t).withColumn("set_id", F.col("item_key"))
    sets = marks.select("set_id").distinct().withColumn("prompt", F.concat(F.lit("set "), F.col("set_id").cast("string")))
    answers = transform.model_map(sets, _shout, "prompt")
    return transform.explained(marks, answers).select("annotation_key", "comment")


@query("""SELECT annotation_key, replace(text, 'e', 'E') AS comment FROM annotations""")
def translate_annotations(t: Tables) -> DataFrame:
    marks = _annotations(t).withColumn("passage", transform.passage())
    done = transform.translate(marks, [transform.Engine("shout", _shout)], "shout", "en", text="passage")
    return transform.with_translation(done).select("annotation_key", "comment")


@query("""SELECT item_key, 'Group thEsE highlights into thEmEs.' || chr(10) || chr(10) || replace(string_agg(
'(p. ' || (page + 1) || ') "' || text || '"  [' || color || ', ' || split_part(text, ' ', 1) || ']', chr(10) ORDER BY page, annotation_key), 'e', 'E') AS answer
FROM annotations GROUP BY item_key""")
def prompt_job(t: Tables) -> DataFrame:
    marks = _annotations(t).withColumn("page_label", (F.col("page") + 1).cast("string"))
    contexts = context.annotation_context(marks).withColumnRenamed("annotations", "context")
    done = prompts.run(contexts, prompts.table(t.spark), "annotations-digest", _shout, "stand-in")
    return done.select("item_key", "answer")


def _measured(texts: list[str]) -> list[str]:
    return [f"{len(text)}: {text}" for text in texts]


PROMPTS = ", ".join("('{}', '{}', '{}')".format(i, kind, body.replace("'", "''").replace("\n", "' || chr(10) || '"))
                    for i, kind, body in prompts.BUILTIN)


@query(f"""WITH prompts(prompt_id, kind, body) AS (VALUES {PROMPTS}),
contexts AS (SELECT 'fulltext' AS kind, doc_id AS key, text AS context FROM documents
  UNION ALL SELECT 'page', doc_id * 1000 + unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d
  UNION ALL SELECT 'selection', item_id, text FROM benchmark UNION ALL SELECT 'library', item_id, '[1] ' || text FROM benchmark
  UNION ALL SELECT 'abstract', item_key, title || chr(10) || 'on ' || venue FROM items
  UNION ALL SELECT 'annotations', annotation_key, text FROM annotations),
asked AS (SELECT kind AS context_kind, CAST(key AS BIGINT) AS key, prompt_id, replace(body, '{{context}}', context) AS prompt FROM contexts JOIN prompts USING (kind))
SELECT context_kind, key, prompt_id, length(prompt) || ': ' || prompt AS answer FROM asked WHERE prompt IS NOT NULL""")
def prompt_jobs(t: Tables) -> DataFrame:
    """All built-in prompts, each over the contexts it takes: whole texts, their lines, passages, items and annotations."""
    def of(kind: str, rows: DataFrame, key, text) -> DataFrame:
        return rows.select(F.lit(kind).alias("context_kind"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("context"))

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn(
        "key", F.col("doc_id") * 1000 + F.col("n"))
    numbered = t.benchmark.withColumn("excerpt", F.concat(F.lit("[1] "), "text"))
    items = t.items.withColumn("abstract", F.concat("title", F.lit("\non "), "venue"))
    contexts = functools.reduce(DataFrame.unionByName, [
        of("fulltext", t.documents, "doc_id", "text"), of("page", lines, "key", "line"), of("selection", t.benchmark, "item_id", "text"),
        of("library", numbered, "item_id", "excerpt"), of("abstract", items, "item_key", "abstract"),
        of("annotations", t.annotations, "annotation_key", "text")])
    return prompts.run_each(contexts, prompts.table(t.spark), _measured).select("context_kind", "key", "prompt_id", "answer")


def _claim_model(texts: list[str]) -> list[str]:
    """Stand-in: claims six words of the paper at a time, four claims in all."""
    import json
    out = []
    for text in texts:
        words = text.split("\n\n", 1)[1].split()
        out.append("Claims: " + json.dumps([
            {"claim": " ".join(words[at:at + 6]), "page": at // 6 + 1} for at in range(0, min(24, len(words)), 6)]))
    return out


def _judge_model(texts: list[str]) -> list[str]:
    """Stand-in: evidence of even length supports, of odd length contradicts."""
    import json
    out = []
    for text in texts:
        found = text.rsplit("Evidence:\n", 1)[1]
        verdict = "supports" if len(found) % 2 == 0 else "contradicts"
        out.append(json.dumps([{"claim": 1, "verdict": verdict, "evidence": found[:40], "page": 1}]))
    return out


def _papers(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("item_key"), F.col("text").alias("context"))


def _claims(t: Tables) -> DataFrame:
    """Every claim the model gives, however many papers there are."""
    return claims.extract(_papers(t), _claim_model)


def _cells(t: Tables, extracted: DataFrame | None = None) -> DataFrame:
    """Every benchmark passage's claim judged by the evidence each source holds."""
    found = (extracted or _claims(t)).select(F.col("claim_id").alias("query_id"), F.col("claim").alias("query"))
    hits = search.evidence(found, t.corpus).join(t.corpus.select("chunk_id", "text"), "chunk_id")
    evidence = claims.evidence_text(hits.withColumn("page", F.lit(0)))
    pairs = evidence.join(found, "query_id").select(
        F.col("query_id").alias("claim_id"), "item_key", F.col("query").alias("claim"), "evidence")
    return claims.judge(pairs, _judge_model)


CLAIMS = """SELECT item_id || ':' || k AS claim_id, item_id AS item_key, array_to_string(w[6 * k + 1:6 * k + 6], ' ') AS claim,
CAST(k + 1 AS INT) AS page FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark) b,
(SELECT unnest(range(5)) AS k) n WHERE 6 * k < least(24, len(w))"""

# claims judged by the best three chunks of each source, by the stand-in's rule
CELLS = (BM25.replace("FROM search_queries", f"FROM (SELECT claim_id AS query_id, claim AS query FROM ({CLAIMS}) c0) q0")
         .replace("max(s) OVER (PARTITION BY query_id)", "max(s) OVER (PARTITION BY query_id, item_key)") + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY round(lexical, 9) DESC, chunk_id) AS position
  FROM lexical WHERE lexical > 0.001),
found AS (SELECT query_id AS claim_id, r.item_key, substring(string_agg('(p.1) ' || c.text, chr(10) ORDER BY position), 1, 2400) AS whole
  FROM ranked r JOIN corpus c ON c.chunk_id = r.chunk_id WHERE position <= 3 GROUP BY ALL),
cells AS (SELECT claim_id, item_key, CASE WHEN length(whole) % 2 = 0 THEN 'supports' ELSE 'contradicts' END AS verdict,
  substring(whole, 1, 40) AS evidence, 1 AS page FROM found)
""")


@query(CLAIMS + """
AND k < (SELECT CASE WHEN count(*) > 4 THEN 3 ELSE 5 END FROM benchmark)""")
def claim_extract(t: Tables) -> DataFrame:
    papers = _papers(t)
    return claims.extract(papers, _claim_model, limit=claims.claims_per_paper(papers.count()))


@query(CELLS + "SELECT * FROM cells")
def claim_verdicts(t: Tables) -> DataFrame:
    return _cells(t)


@query(CELLS + """SELECT claim_id, item_key, count(*) OVER (PARTITION BY claim_id) AS papers
FROM cells WHERE verdict = 'contradicts'""")
def claim_conflicts(t: Tables) -> DataFrame:
    return claims.conflicts(_cells(t))


@query(CELLS + """, shown AS (SELECT claim_id, item_key, CASE verdict WHEN 'supports' THEN '✔' ELSE '✘' END || ' ' || replace(evidence, '|', '') AS cell FROM cells),
papers AS (SELECT DISTINCT item_key FROM corpus),
lines AS (SELECT claim_id, string_agg(coalesce(cell, '·'), ' | ' ORDER BY item_key) AS cells
  FROM (SELECT c1.claim_id, papers.item_key FROM ({CLAIMS}) c1, papers) g LEFT JOIN shown USING (claim_id, item_key) GROUP BY claim_id)
SELECT '0' AS sort, '| Claim | ' || string_agg(CAST(item_key AS VARCHAR), ' | ' ORDER BY item_key) || ' |' AS line FROM papers
UNION ALL SELECT '1', '| --- | ' || string_agg('---', ' | ') || ' |' FROM papers
UNION ALL SELECT '2' || claim_id, '| ' || replace(claim, '|', '') || ' | ' || cells || ' |' FROM lines JOIN ({CLAIMS}) c2 USING (claim_id)""".replace("{CLAIMS}", CLAIMS))
def claim_matrix(t: Tables) -> DataFrame:
    found = _claims(t)
    lines = claims.matrix_lines(_cells(t, found), found, t.corpus, columns=7)
    return digests.claim_lines(lines, found.select("claim_id", "claim"))


def _pick_model(texts: list[str]) -> list[str]:
    """Stand-in: quotes the first line of the first page of a prompt."""
    import json
    out = []
    for text in texts:
        lines = text.split("---\n", 1)[1].split("\n")
        number = int(text.split("--- PAGE ", 1)[1].split(" ", 1)[0])
        out.append(json.dumps([{"page": number, "quote": lines[0], "comment": "first"}]))
    return out


@query(f"""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pages AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS page, unnest(l) AS text FROM lines),
picked AS (SELECT doc_id, page, text, CASE WHEN length(text) > 8360 THEN substring(text, 1, 8360) ELSE text END AS said
  FROM pages WHERE page % 6 = 0),
placed AS (SELECT doc_id, page, trim(said) AS quote, {KEYED.format("trim(said)")} AS k, {KEYED.format("text")} AS body
  FROM picked WHERE length(said) > 8)
SELECT doc_id, quote, 'first' AS comment, page, CASE WHEN length(k) >= 8 AND instr(body, k) > 0 THEN 'highlight' ELSE 'note' END AS kind,
CASE WHEN length(k) >= 8 AND instr(body, k) > 0 THEN CAST(instr(body, k) - 1 AS INT) ELSE 0 END AS "offset" FROM placed""")
def picked_passages(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return passages.anchor(passages.pick(pages, _pick_model), pages)


# --- digests

@query(HITS + """, cells AS (SELECT item_key, rule, string_agg(text || ' (p.' || (page + 1) || ')', '<br/>' ORDER BY position) AS cell FROM ranked GROUP BY ALL)
SELECT '0' AS sort, '| Paper | urgent | second | high |' AS line UNION ALL SELECT '1', '| --- | --- | --- | --- |'
UNION ALL SELECT '2' || item_key, '| ' || 'Anon. n.d. — ' || i.title || ' | ' || coalesce(u.cell, '') || ' | ' || coalesce(s.cell, '') || ' | ' || coalesce(h.cell, '') || ' |'
FROM (SELECT DISTINCT item_key FROM hits) k JOIN items i USING (item_key)
LEFT JOIN (SELECT * FROM cells WHERE rule = 'urgent') u USING (item_key) LEFT JOIN (SELECT * FROM cells WHERE rule = 'second') s USING (item_key)
LEFT JOIN (SELECT * FROM cells WHERE rule = 'high') h USING (item_key)""")
def matrix_digest(t: Tables) -> DataFrame:
    marks = _annotations(t).withColumn("page_label", (F.col("page") + 1).cast("string"))
    cells = anno.export_cells(marks, RULES)
    named = cells.join(t.items.select("item_key", "title"), "item_key").withColumn("citation", F.lit("Anon. n.d."))
    return digests.annotation_matrix(named, [r.name for r in RULES])


@query("""SELECT source AS watch_id, '## ' || upper(source) || chr(10) || chr(10) || string_agg('- [' || lang || '](http://x) — A (2024) · feed', chr(10) ORDER BY rn) AS section
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) d WHERE rn <= 25 GROUP BY source""")
def watch_digest(t: Tables) -> DataFrame:
    fresh = t.documents.select(
        F.col("source").alias("watch_id"), F.col("doc_id").alias("finding_id"), F.col("lang").alias("title"),
        F.lit("http://x").alias("url"), F.lit("A").alias("authors"), F.lit(2024).alias("year"), F.lit("feed").alias("source"))
    watches = t.documents.select(F.col("source").alias("watch_id"), F.upper("source").alias("label")).distinct()
    return digests.watch_digest(fresh, watches)


@query("""SELECT item_key, '## ' || title || chr(10) || chr(10) || '*Anon. n.d.*' || chr(10) || chr(10) || 'See ([p. 3](lib/open?page=3)). ' || venue
|| coalesce(chr(10) || chr(10) || '### My highlights' || chr(10) || chr(10) || marks, '') AS section
FROM items LEFT JOIN (SELECT item_key, string_agg('- p. ' || (page + 1) || ' "' || text || '"', chr(10) ORDER BY rn) AS marks FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY page, annotation_key) AS rn FROM annotations) r
  WHERE rn <= 40 GROUP BY item_key) m USING (item_key)""")
def paper_digest(t: Tables) -> DataFrame:
    papers = t.items.select("item_key", "title", F.lit("Anon. n.d.").alias("citation"),
                            F.concat(F.lit("See (p. 3). "), "venue").alias("digest"))
    marks = _annotations(t).withColumn("page_label", (F.col("page") + 1).cast("string"))
    return digests.paper_digest(papers, marks, "lib/open")


@query(ITEM_CHUNKS + "SELECT chunk_id, item_key, page, greatest(length(text), 1) / 127 AS scale, 2 AS dims FROM built")
def embedded_index(t: Tables) -> DataFrame:
    chunks = search.build_chunks(_documents_as_items(t))
    embedded = transform.embed(chunks, lambda texts: [[float(len(s)), 1.0] for s in texts])
    return search.with_vectors(chunks, embedded.select("chunk_id", "embedding")).select(
        "chunk_id", "item_key", "page", "scale", F.size("codes").alias("dims"))
