"""Markdown digests, one text row per paper, claim or watch; nothing is collected.

Long lists are written as rows in order rather than gathered per key, except
where the digest itself shows only the first few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions import text as tx
from libsight.functions.ordered import top_per_group
from libsight.operators.claims import MARKS

HIGHLIGHTS = 40
FINDINGS = 25


def _bare(c: Column | str) -> Column:
    return F.replace(F.coalesce(tx.col(c), F.lit("")), F.lit("|"), F.lit(""))


def _table_rows(body: DataFrame, header: Sequence[str]) -> DataFrame:
    """Header and divider lines in front of table rows (``sort, line``)."""
    spark = body.sparkSession
    head = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("0").alias("sort"), F.lit("| " + " | ".join(header) + " |").alias("line")),
        F.struct(F.lit("1").alias("sort"), F.lit("| " + " | ".join("---" for _ in header) + " |").alias("line"))
    )).alias("r")).select("r.*")
    return head.unionByName(body)


def annotation_matrix(cells: DataFrame, rules: Sequence[str], citation: str = "citation",
                      title: str = "title") -> DataFrame:
    """Markdown table lines ``sort, line`` of an annotation matrix.

    ``cells`` come from :func:`libsight.operators.annotations.export_cells`.
    """
    columns = [F.replace(F.array_join(F.coalesce(F.col(r), F.array().cast("array<string>")), "<br/>"),
                         F.lit("|"), F.lit("\\|")) for r in rules]
    paper = F.concat(F.col(citation), F.lit(" — "), _bare(title))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", paper, *columns), F.lit(" |"))
    body = cells.select(F.concat(F.lit("2"), F.col("item_key").cast("string")).alias("sort"), line.alias("line"))
    return _table_rows(body, ["Paper", *rules])


def claim_matrix(matrix: DataFrame, claims: DataFrame, papers: Sequence[str]) -> DataFrame:
    """Markdown table lines of a claim matrix; ``claims`` is (claim_id, claim)."""
    cells = [F.coalesce(F.col(f"`{p}`"), F.lit(MARKS["absent"])) for p in papers]
    rows = claims.join(matrix, "claim_id", "left")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", _bare("claim"), *cells), F.lit(" |"))
    body = rows.select(F.concat(F.lit("2"), "claim_id").alias("sort"), line.alias("line"))
    return _table_rows(body, ["Claim", *papers])


def claim_lines(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Markdown table lines from ``claims.matrix_lines``, for any number of papers."""
    head = lines.where("claim_id is null").select("cells")
    rule = F.regexp_replace(F.regexp_replace("cells", r"(?s)[^|]+", "---"), r"\|", " | ")
    body = claims.join(lines, "claim_id").select(
        F.concat(F.lit("2"), "claim_id").alias("sort"),
        F.concat(F.lit("| "), _bare("claim"), F.lit(" | "), "cells", F.lit(" |")).alias("line"))
    return (head.select(F.lit("0").alias("sort"), F.concat(F.lit("| Claim | "), "cells", F.lit(" |")).alias("line"))
            .unionByName(head.select(F.lit("1").alias("sort"), F.concat(F.lit("| --- | "), rule, F.lit(" |")).alias("line")))
            .unionByName(body))


def watch_digest(fresh: DataFrame, watches: DataFrame) -> DataFrame:
    """One Markdown section per watch with its first new papers."""
    first = top_per_group(fresh, ["watch_id"], [F.col("finding_id")], FINDINGS, "position")
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") — "), "authors", year,
                    F.lit(" · "), "source")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))),
                                     lambda s: s["l"]), "\n")
    sections = first.groupBy("watch_id").agg(lines.alias("_lines"))
    return sections.join(watches.select("watch_id", "label"), "watch_id").select(
        "watch_id", F.concat(F.lit("## "), "label", F.lit("\n\n"), "_lines").alias("section"))


def paper_digest(papers: DataFrame, annotations: DataFrame, base_url: str = "") -> DataFrame:
    """One Markdown section per paper (``item_key, title, citation, digest``).

    Up to 40 highlights follow; page citations in the digest become links when a
    base URL is given.
    """
    first = top_per_group(annotations, ["item_key"], [F.col("page"), F.col("annotation_key")],
                          HIGHLIGHTS, "position")
    text = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit('"'), "text", F.lit('"')))
    comment = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("— "), "comment"))
    line = F.concat_ws(" ", F.concat(F.lit("- p. "), "page_label"), text, comment)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))),
                                     lambda s: s["l"]), "\n")
    marks = first.groupBy("item_key").agg(lines.alias("_marks"))
    body = F.regexp_replace("digest", r"(?i)[(（]p\.?\s*(\d{1,4})[)）]",
                            rf"([p. $1]({base_url}?page=$1))") if base_url else F.col("digest")
    highlights = F.when(F.col("_marks").isNotNull(), F.concat(F.lit("\n\n### My highlights\n\n"), "_marks")).otherwise("")
    return papers.join(marks, "item_key", "left").select("item_key", F.concat(
        F.lit("## "), "title", F.lit("\n\n*"), "citation", F.lit("*\n\n"), body, highlights).alias("section"))


def write_sections(sections: DataFrame, path: str, column: str = "section") -> None:
    """Write sections as text files, in parallel."""
    sections.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered Markdown lines; range partitions keep the order across files."""
    lines.orderBy("sort").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
