"""Named queries of the operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from libsight.llm import (
    audit, chat, classifier, fingerprint, jaccard, mixing, packing, pages, pivots, resample,
    rules, substrings, tokens)
from libsight.llm.oracles import ORACLES  # noqa: F401
from libsight.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ship(spark), folder)
    QUERIES[fn.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


@_query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    rows = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows"))))
    copies = F.col("copies") + (F.col("_row") <= F.col("extra")).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                       "source", copies.alias("copies"))


@_query
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"))
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(rows.unionByName(extra)))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@_query
def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, folder, "documents"), vocabulary())


@_query
def op9_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op6_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op10_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.probe_edits(_table(spark, folder, "documents"))


@_query
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_similar(_table(spark, folder, "documents"))


@_query
def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats")


@_query
def op5_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(_table(spark, folder, "pages"))


@_query
def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


@_query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit.divergence(_table(spark, folder, "documents"))


@_query
def op13_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, folder, "embeddings"))
