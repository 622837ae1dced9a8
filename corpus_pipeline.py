"""From raw documents to packed training rows: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from libsight.llm import classifier, jaccard, mixing, packing, substrings
from libsight.llm.texts import n_words
from libsight.session import checkpoint_dir, cut_lineage, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of a list of ids that is broadcast to the texts; longer lists are joined by shuffle.
BROADCAST_ROWS = 400_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, checkpointed; with a broadcast hint if it was counted to be small."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))


def _unwrapped(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c)
                       for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, takes for good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classifier.score(_wrapped(docs), classifier.fit(docs, labels), ("doc_id", "text", "rest"))
    return _unwrapped(scored.where("predicted = 1"), docs)


def _node() -> Column:
    """A number for each different (doc_id, text)."""
    return F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that with the least id (null ids last).

    Every different (doc_id, text) is a document of its own, so of rows that share an id only near
    copies go.  Of rows that are equal in both one stays.
    """
    named = docs.withColumn("_node", _node())
    groups = cut_lineage(
        jaccard.join_similar(named.select(F.col("_node").alias("doc_id"), "text"))
        .groupBy(F.col("doc_id").alias("_node")).agg(F.min("component_id").alias("_group"), F.count("*").alias("_rows")))
    shared = groups.groupBy("_group").count().where("count > 1").select("_group")
    members = groups.join(shared, "_group").select("_node", "_group")
    least = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_node")
    stays = (named.select("_node", "doc_id").join(members, "_node").groupBy("_group")
             .agg(F.min(least)["_node"].alias("_node")).select("_node"))
    drop = _small(members.select("_node").join(stays, "_node", "left_anti"))
    kept = _wrapped(docs).withColumn("_node", _node()).join(drop, "_node", "left_anti")
    again = groups.where("_rows > 1").select("_node")
    if again.limit(1).count():
        again = _small(again)
        kept = (kept.join(again, "_node", "left_anti")
                .unionByName(kept.join(again, "_node", "left_semi").dropDuplicates(["_node"])))
    return _unwrapped(kept, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; ``n_chars`` follows the text."""
    cut = substrings.remove_repeats(_wrapped(docs), with_text=True, others=("doc_id", "rest"))
    out = _unwrapped(cut.withColumnRenamed("kept_text", "text"), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; equal rows share out what they take together."""
    wording = F.xxhash64("text")
    key = ["_id", "_source", "_size", "_wording"]
    taken = _small(mixing.mix(docs, wording=wording).where("copies > 0 or extra > 0").select(
        *[F.col(c).alias(f"_{name}") for c, name in (("doc_id", "id"), ("source", "source"), ("size", "size"),
                                                     ("wording", "wording"), ("copies", "copies"), ("extra", "extra"))]))
    sized = _wrapped(docs).withColumns({"_words": n_words(), "_said": wording})
    joined = sized.join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))
                        & F.col("rest.source").cast("string").eqNullSafe(F.col("_source"))
                        & (F.col("_words") == F.col("_size")) & (F.col("_said") == F.col("_wording")))
    if taken.where("_extra > 0").limit(1).count():  # only rows that others equal are numbered
        some = joined.where("_extra > 0").withColumn(
            "_row", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        joined = joined.where("_extra = 0").unionByName(some.withColumn(
            "_copies", F.col("_copies") + (F.col("_row") <= F.col("_extra")).cast("int")).drop("_row"))
    return _unwrapped(joined.where("_copies > 0").withColumn("_copy", F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training rows."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", target_mix),
    ("best_fit_packing", packed),
]

#: A learned model and random rounding have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the Parquet that its predecessor wrote.

    A stage's files are removed once the next stage is written; the last one's stay.
    """
    ship(spark)
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
