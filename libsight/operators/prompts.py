"""Built-in prompts as data, and jobs that run them over context tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from libsight.functions.ordered import broadcast_if_small
from libsight.operators.transform import TextFn, model_map

#: prompt id, what context it takes, instruction; ``{context}`` marks the place of the context.
BUILTIN = (
    ("ask-pdf", "fulltext", "Answer from this paper and give pages as (p. N).\n\n{context}"),
    ("ask-library", "library", "Answer from these excerpts only and cite them as [n].\n\n{context}"),
    ("summarize", "fulltext", "Summarise problem, method, data, findings and limits.\n\n{context}"),
    ("outline", "fulltext", "Outline each section with pages as (p. N).\n\n{context}"),
    ("explain", "selection", "Explain this passage in plain words.\n\n{context}"),
    ("translate", "selection", "Translate this passage and return nothing else.\n\n{context}"),
    ("page-summary", "page", "Summarise this page in a few bullets.\n\n{context}"),
    ("page-figure", "page", "Describe the figures and tables of this page.\n\n{context}"),
    ("critique", "fulltext", "Review this paper as a referee would.\n\n{context}"),
    ("related", "library", "Relate this paper to the excerpts.\n\n{context}"),
    ("tag-suggest", "abstract", "Suggest tags as one comma list.\n\n{context}"),
    ("annotations-digest", "annotations", "Group these highlights into themes.\n\n{context}"),
    ("digest", "fulltext", "Write a compact digest with pages as (p. N).\n\n{context}"),
    ("fill-template", "fulltext", "Fill in this template from the paper.\n\n{context}"),
)


def table(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """Prompts as rows; custom prompts replace built-in ones of the same id."""
    base = spark.createDataFrame(BUILTIN, "prompt_id string, context_kind string, body string")
    if custom is None:
        return base
    return base.join(custom.select("prompt_id"), "prompt_id", "left_anti").unionByName(custom)


def rendered(contexts: DataFrame, prompts: DataFrame, prompt_id: str) -> DataFrame:
    """Contexts (``context`` column) with the ``prompt`` text to send."""
    chosen = prompts.where(F.col("prompt_id") == prompt_id).select("prompt_id", "body").limit(1)
    # one row, attached through its id
    joined = contexts.withColumn("prompt_id", F.lit(prompt_id)).join(F.broadcast(chosen), "prompt_id")
    return joined.withColumn("prompt", F.replace("body", F.lit("{context}"), F.col("context"))).drop("body", "prompt_id")


def run(contexts: DataFrame, prompts: DataFrame, prompt_id: str, fn: TextFn, model: str = "",
        tasks: int | None = None) -> DataFrame:
    """Summary, outline, digest, template or tag job: one answer per context row."""
    return model_map(rendered(contexts, prompts, prompt_id), fn, "prompt", model, prompt_id, tasks=tasks)


def run_each(contexts: DataFrame, prompts: DataFrame, fn: TextFn, model: str = "", tasks: int | None = None) -> DataFrame:
    """Every prompt over every context of the kind it takes (``context_kind, context``): ``prompt_id`` and one answer a row.

    A context of a kind no prompt takes has no row, nor has a null context.
    """
    joined = contexts.where("context is not null").join(broadcast_if_small(prompts), "context_kind")
    asked = joined.withColumn("prompt", F.replace("body", F.lit("{context}"), F.col("context"))).drop("body", "context")
    return model_map(asked, fn, "prompt", model, F.col("prompt_id"), tasks=tasks)
