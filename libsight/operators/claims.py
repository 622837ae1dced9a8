"""Claim extraction, judging and the claim × paper matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from libsight.operators.transform import TextFn, model_map
from libsight.session import cut_lineage
from libsight.sources import payloads

# How verdicts are shown.
MARKS = {"supports": "✔", "contradicts": "✘", "unclear": "~", "absent": "·"}
EVIDENCE_CHARS = 2400


def claims_per_paper(papers: int) -> int:
    """Fewer claims of each of many papers, for a first look; judging takes every claim a model gives."""
    return 3 if papers > 4 else 5


def extract(contexts: DataFrame, fn: TextFn, limit: int = 5, model: str = "") -> DataFrame:
    """Claims of each paper (``item_key, context``): ``claim_id, item_key, claim, page``."""
    asked = contexts.withColumn("prompt", F.concat(
        F.lit(f'List up to {limit} central claims as JSON [{{"claim":"…","page":0}}].\n\n'), "context"))
    answers = model_map(asked.select("item_key", "prompt"), fn, "prompt", model, "claims")
    return payloads.claims(answers, limit).select(
        F.concat_ws(":", "item_key", "claim_no").alias("claim_id"), "item_key", "claim", "page")


def evidence_text(hits: DataFrame) -> DataFrame:
    """Evidence per (claim, paper): its best chunks, page-marked, at most 2400 characters.

    ``hits`` are the top chunks of :func:`libsight.operators.search.evidence`
    with ``page`` and ``text``; their number per pair is bounded there.
    """
    line = F.concat(F.lit("(p."), (F.col("page") + 1).cast("string"), F.lit(") "), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))),
                        lambda s: s["l"])
    return hits.groupBy("query_id", "item_key").agg(
        F.substring(F.array_join(lines, "\n"), 1, EVIDENCE_CHARS).alias("evidence"))


def judge(pairs: DataFrame, fn: TextFn, model: str = "") -> DataFrame:
    """Verdict per (claim, paper) row with ``claim`` and ``evidence`` text.

    One call per pair, so a paper with many claims is not one call or one group.
    """
    asked = pairs.withColumn("prompt", F.concat(
        F.lit('Judge the claim by the evidence only. JSON [{"claim":1,"verdict":"supports|'
              'contradicts|unclear|absent","evidence":"","page":0}].\n\nClaim 1: '), "claim",
        F.lit("\n\nEvidence:\n"), F.coalesce("evidence", F.lit("(nothing retrieved)"))))
    answers = model_map(asked.select("claim_id", "item_key", "prompt"), fn, "prompt", model, "judge")
    return payloads.verdicts(answers, ["claim_id", "item_key"]).where("claim_no = 0").drop("claim_no")


def matrix(cells: DataFrame, papers: Sequence[str]) -> DataFrame:
    """Claims × papers; a pair without verdict shows as absent."""
    note = F.when(F.col("evidence") != "", F.concat(
        F.lit(" "), F.substring(F.replace("evidence", F.lit("|"), F.lit("")), 1, 90))).otherwise("")
    marks = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    shown = cells.withColumn("_cell", F.concat(marks[F.col("verdict")], note))
    wide = shown.groupBy("claim_id").pivot("item_key", list(papers)).agg(F.first("_cell"))
    return wide.na.fill(MARKS["absent"])


def matrix_lines(cells: DataFrame, claims: DataFrame, papers: DataFrame, columns: int = 500) -> DataFrame:
    """The matrix as text, ``claim_id, cells``: a claim's cells in the order of the papers' keys.

    ``papers`` (``item_key``) may be any number.  The matrix stays long, one row for each claim and block of
    ``columns`` papers, until a claim's blocks are put in a line; row claim_id null has the papers
    themselves.  Only the papers' keys are numbered in one task.
    """
    numbered = papers.select("item_key").distinct().withColumn("_n", F.row_number().over(Window.orderBy("item_key")))
    numbered = cut_lineage(numbered.withColumn("_block", F.floor((F.col("_n") - 1) / columns)))
    blocks = numbered.groupBy("_block").agg(F.array_sort(F.collect_list(
        F.struct("_n", F.col("item_key").cast("string").alias("name")))).alias("_papers"))
    n_blocks = -(-numbered.count() // columns)
    note = F.when(F.col("evidence") != "", F.concat(
        F.lit(" "), F.substring(F.replace("evidence", F.lit("|"), F.lit("")), 1, 90))).otherwise("")
    marks = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    shown = (cells.join(numbered, "item_key").groupBy("claim_id", "_block", "_n")
             .agg(F.min(F.concat(marks[F.col("verdict")], note)).alias("_cell"))
             .groupBy("claim_id", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_n", "_cell"))).alias("_cells")))
    every = claims.select("claim_id").distinct().withColumn("_block", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")) if n_blocks else F.array().cast("array<bigint>")))
    filled = every.join(blocks, "_block").join(shown, ["claim_id", "_block"], "left").select(
        "claim_id", "_block", F.array_join(F.transform("_papers", lambda p: F.coalesce(
            F.try_element_at("_cells", p["_n"]), F.lit(MARKS["absent"]))), " | ").alias("_part"))
    head = blocks.select(F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"), "_block",
                         F.array_join(F.transform("_papers", lambda p: p["name"]), " | ").alias("_part"))
    return filled.unionByName(head).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("_block", "_part"))), lambda b: b["_part"]), " | ").alias("cells"))


def conflicts(cells: DataFrame) -> DataFrame:
    """Contradicting papers per claim, one row each, and their number."""
    against = cells.where(F.col("verdict") == "contradicts").select("claim_id", "item_key")
    counts = against.groupBy("claim_id").agg(F.count("*").alias("papers"))
    return against.join(counts, "claim_id")
