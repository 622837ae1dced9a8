"""Input views over plain tables, stated once in SQL both engines accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "ticks": """
SELECT event_id AS tick_id, user_id AS reader_id, user_id AS item_key,
       user_id * 2 + CASE WHEN k >= 50 THEN 1 ELSE 0 END AS attachment_key,
       k % 20 AS page, event_type <> 'error' AS focused, 20 AS num_pages, ts
FROM (SELECT event_id, user_id, event_type, ts,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "attachments": "SELECT DISTINCT attachment_key, item_key FROM ticks",
    "annotations": """
SELECT o_orderkey AS annotation_key, o_custkey AS item_key,
       CAST(floor(o_totalprice) AS BIGINT) % 31 - 1 AS page,
       concat('#c', substring(o_orderpriority, 1, 1)) AS color,
       concat(o_orderpriority, ' ', o_orderstatus, ' ', CAST(o_orderkey AS STRING)) AS text,
       CAST(floor(o_totalprice) AS BIGINT) % 200 AS n_chars,
       o_orderdate AS ts
FROM orders""",
    "items": """
SELECT c_custkey AS item_key, c_name AS title, c_mktsegment AS item_type,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'The Lancet' WHEN 'MACHINERY' THEN 'Nature Physics'
            WHEN 'HOUSEHOLD' THEN 'VLDB' ELSE concat('Journal of ', c_mktsegment) END AS venue,
       concat('note', chr(10), 'lib-rating: ', CAST(c_custkey % 8 AS STRING), chr(10), 'lib-read: ',
              CAST(c_custkey % 2 AS STRING)) AS extra
FROM customer""",
    "refs": """
SELECT l.l_orderkey AS citing_key, p.p_partkey AS cited_key,
       CASE WHEN p.p_partkey % 5 = 0 THEN NULL
            ELSE concat('10.5555/P', CAST(p.p_partkey AS STRING)) END AS doi,
       concat(p.p_name, ' no ', CAST(p.p_partkey AS STRING)) AS title, p.p_size AS citations
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "owned": """
SELECT p_partkey AS item_key,
       CASE WHEN p_partkey % 2 = 0 THEN concat('https://doi.org/10.5555/p', CAST(p_partkey AS STRING))
            ELSE NULL END AS doi,
       concat(upper(p_name), ' - No. ', CAST(p_partkey AS STRING)) AS title
FROM part WHERE p_size <= 10""",
    "item_tags": """
SELECT p_partkey AS item_key, concat('#brand/', p_brand, '/', CAST(p_size AS STRING)) AS tag FROM part
UNION ALL SELECT p_partkey, concat('#type/', p_type) FROM part
UNION ALL SELECT p_partkey, 'status' FROM part""",
    "reviews": """
SELECT event_id AS review_id, user_id AS card_key, ts,
       CASE event_type WHEN 'error' THEN 'again' WHEN 'purchase' THEN 'easy' ELSE 'good' END AS grade
FROM events""",
    "notes": """
SELECT doc_id AS note_id,
       concat('<p>see link?annotation=', lpad(CAST(doc_id % 50 AS STRING), 8, '0'),
              ' and ', lpad(CAST((doc_id * 7) % 90 AS STRING), 8, '0'), '</p>') AS html
FROM documents""",
    "corpus": """
SELECT doc_id AS chunk_id, CAST(replace(source, 'src', '') AS INT) AS item_key, text
FROM documents""",
    "search_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "findings": """
SELECT event_type AS watch_id, user_id AS finding_id, CAST(ts AS DATE) AS run_day FROM events""",
    "source_counts": """
SELECT c_custkey AS item_key, 'semanticscholar' AS source, CAST(c_custkey % 97 AS INT) AS cited FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'openalex', CAST(c_custkey % 89 AS INT) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'crossref', CAST(c_custkey % 83 AS INT) FROM customer WHERE c_custkey % 7 <> 0""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}


def _needed(sql: str) -> list[str]:
    """Views a query uses, each after the views it is built on."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """The query with the views it names spelled out in front."""
    sql = sql.strip()
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql)]
    if not ctes:
        return sql
    if re.match(r"WITH\s", sql, re.I):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + sql


#: Tables of long texts, whose rows cost much more to process than to read.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Scan of fewer splits than cores spread over all cores; larger scans stay as they are.

    A small file of one row group would otherwise be tokenised by one task.
    ``df`` must be a plain scan, since its partitions are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table, or a view over the base tables, in ``folder``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in BASE:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name in TEXT_KEYS:
            df = spread(df, TEXT_KEYS[name])
        naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df
    query = with_views(f"SELECT * FROM {name}")
    used = {b: table(spark, folder, b) for b in BASE if re.search(rf"\b{b}\b", query)}
    for b in used:
        query = re.sub(rf"\b(FROM|JOIN)\s+{b}\b", rf"\1 {{{b}}}", query)
    return spark.sql(query, **used)
