"""State files written from the tables, one JSON map a library, and read back by entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from libsight.operators import reading
from libsight.plans.reading import CLOCK, _credits
from libsight.plans.registry import Tables, query
from libsight.session import checkpoint_dir, cut_lineage
from libsight.sources import jsonmaps, snapshots


def _through_files(t: Tables, rows: DataFrame, kind: str, shape) -> DataFrame:
    """``shape`` of a snapshot kind that ``library_id, k, v`` were saved as."""
    spark = t.spark
    base = f"{checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    jsonmaps.save(rows, base)
    out = cut_lineage(shape(snapshots.load(spark, f"{base}/*/*", kind)))
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


@query(CLOCK + """SELECT CAST(h.attachment_key % 3 AS VARCHAR) AS library_id, CAST(h.attachment_key AS VARCHAR) AS attachment_key, page,
h.deciseconds AS page_deciseconds, t.deciseconds, epoch_us(first) // 1000 AS first_ms, epoch_us(last) // 1000 AS last_ms, num_pages
FROM heat h JOIN totals t USING (attachment_key)""")
def reading_snapshot(t: Tables) -> DataFrame:
    credits = _credits(t)
    state = snapshots.reading_state(reading.page_heat(credits), reading.attachment_heat(credits))
    rows = state.select((F.col("k").cast("bigint") % 3).alias("library_id"), "k", "v")

    def shape(loaded: DataFrame) -> DataFrame:
        pages = snapshots.page_heat(loaded).withColumnRenamed("deciseconds", "page_deciseconds")
        return pages.join(loaded.drop("pages"), ["library_id", "attachment_key"]).select(
            "library_id", "attachment_key", "page", "page_deciseconds", "deciseconds",
            F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "num_pages")

    return _through_files(t, rows, "reading", shape)


@query("""SELECT source AS library_id, 'mt' AS engine, lang, CAST(doc_id AS VARCHAR) AS text_hash, text AS value
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL""")
def cache_snapshot(t: Tables) -> DataFrame:
    """Whole texts as the values of translation caches, one per source."""
    quoted = F.to_json(F.array("text"))
    rows = t.documents.where("text is not null and source is not null and lang is not null").select(
        F.col("source").alias("library_id"), F.concat_ws(":", F.lit("mt"), "lang", F.col("doc_id").cast("string")).alias("k"),
        F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("v"))
    return _through_files(t, rows, "translation-cache", lambda loaded: loaded)
