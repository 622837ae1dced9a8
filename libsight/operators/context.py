"""Conversation history and prompt contexts as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions import text as tx
from libsight.functions.ordered import running_total, top_per_group

HISTORY_BUDGET = 90_000
MIN_LINE = 12


def history(turns: DataFrame, budget: int = HISTORY_BUDGET, one_shot: bool = False,
            content: str = "text", turns_per_bucket: int = 512) -> DataFrame:
    """Newest turns of each conversation within a token budget, the newest always.

    Blank turns are dropped afterwards.  The running total is taken in stretches
    of turns, so one endless conversation does not land in one task.
    """
    cost = tx.estimate_tokens(content)
    newest = turns.groupBy("conv_id").agg(F.max("turn").alias("_newest"))
    if one_shot:
        kept = turns.join(newest, "conv_id").where("turn = _newest")
    else:
        totals = running_total(turns, ["conv_id"], [F.col("turn").desc()],
                               F.floor(F.col("turn") / turns_per_bucket), cost, "_used",
                               descending=True)
        within = totals.where(F.col("_used") <= budget).drop("_used")
        over = (turns.join(newest, "conv_id").where("turn = _newest").drop("_newest")
                .where(cost > budget))
        kept = within.unionByName(over)
    return kept.where(tx.strip(content) != "").drop("_newest")


def _joined(rows: DataFrame, keys: list[str], line: Column, separator: str, name: str) -> DataFrame:
    """Lines of bounded groups joined in ``position`` order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))),
                        lambda s: s["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, separator).alias(name))


def excerpts(hits: DataFrame) -> DataFrame:
    """Numbered excerpts per query: ``[n] title (p. N)`` and the text, best first.

    ``hits`` holds at most top-k rows per query, with ``position``.
    """
    page = F.when(F.col("page") >= 0, F.concat(
        F.lit(" (p. "), (F.col("page") + 1).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("title"),
                    page, F.lit("\n"), F.col("text"))
    return _joined(hits, ["query_id"], line, "\n\n", "excerpts")


def annotation_line() -> Column:
    """``(p. L) "text" - comment  [tags]``."""
    quoted = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit('"'), "text", F.lit('"')))
    comment = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("- "), "comment"))
    tags = F.when(F.size("tags") > 0, F.concat(
        F.lit("  ["), F.array_join("tags", ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("(p. "), "page_label", F.lit(") "), F.concat_ws(" ", quoted, comment), tags)


def annotation_lines(annotations: DataFrame) -> DataFrame:
    """The annotation lines a prompt may use, one row each."""
    return annotations.withColumn("line", annotation_line()).where(F.length("line") > MIN_LINE)


def annotation_context(annotations: DataFrame, budget: int | None = None) -> DataFrame:
    """Annotation block per item in page order; all of it, or within a token budget.

    With a budget: a line has over 12 characters, hence at least 4 tokens, which
    bounds the lines per item that can matter.
    """
    lines, order = annotation_lines(annotations), [F.col("page"), F.col("annotation_key")]
    if budget is None:
        listed = lines.withColumn("position", F.struct("page", "annotation_key"))
        return _joined(listed, ["item_key"], F.col("line"), "\n", "annotations")
    first = top_per_group(lines, ["item_key"], order, budget // 4, "position")
    block = _joined(first, ["item_key"], F.col("line"), "\n", "annotations")
    return block.withColumn("annotations", tx.clamp_tokens("annotations", budget))


def metadata_context(items: DataFrame, max_chars: int = 12_000, group: str = "selection_id") -> DataFrame:
    """Metadata blocks of a selection joined in item order, within a size budget.

    No block is shorter than one character, so ``max_chars`` bounds the rows.
    """
    rows = top_per_group(items.where(F.col("meta") != ""), [group], [F.col("item_key")],
                         max_chars, "position")
    block = _joined(rows, [group], F.col("meta"), "\n\n---\n\n", "meta")
    return block.withColumn("meta", tx.clamp_tokens("meta", max_chars // 4))


def library_tags(tags: DataFrame, limit: int = 100) -> DataFrame:
    """The first tags by name, as one comma list."""
    first = tags.select("tag").distinct().orderBy("tag").limit(limit)
    return first.agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))


def full_text_context(pages: DataFrame, budget: int = 60_000, key: str = "doc_id",
                      first: int = 1, last: int | None = None) -> DataFrame:
    """Marked pages of each document, from page ``first`` to ``last``, within a budget.

    ``pages`` is (key, page, text); a page header costs tokens, so the budget
    bounds the pages per document that can matter.
    """
    start = max(1, first)
    rows = pages.where(F.col("page") >= start - 1)
    if last is not None:
        rows = rows.where(F.col("page") < last)
    rows = top_per_group(rows, [key], [F.col("page")], budget // 3, "position")
    line = F.concat(F.lit("--- p. "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"),
                    tx.strip("text"))
    block = _joined(rows, [key], line, "\n\n", "context")
    return block.withColumn("context", tx.clamp_tokens("context", budget))


def source_list(hits: DataFrame) -> DataFrame:
    """What an answer was based on: title, page, item, score, start of the text."""
    return hits.select("query_id", "title", "page", "item_key", "score",
                       F.substring("text", 1, 400).alias("text"))
