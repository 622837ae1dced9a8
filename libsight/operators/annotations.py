"""Annotation scans, filters, heat, palette and the annotation matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions.ordered import skew_join, top_per_group
from libsight.functions.rules import FieldRule, matches_query
from libsight.functions.text import utf16_length

# The default palette and its names.
DEFAULT_COLORS = {"#ffd400": "Yellow", "#ff6666": "Red", "#5fb236": "Green", "#2ea8e5": "Blue",
                  "#a28ae5": "Purple", "#e56eee": "Magenta", "#f19837": "Orange",
                  "#aaaaaa": "Grey"}


def resolve_items(annotations: DataFrame, attachments: DataFrame, items: DataFrame) -> DataFrame:
    """Annotation → attachment → item; orphans drop.

    The attachment side is reduced to those whose item exists before the large
    side is joined once, spread out where one attachment holds very many rows.
    """
    owned = (attachments.select("attachment_key", "item_key")
             .join(items.select("item_key"), "item_key", "left_semi")
             .dropDuplicates(["attachment_key"]))
    return skew_join(annotations.drop("item_key"), owned, ["attachment_key"])


def scan(annotations: DataFrame, position: str = "position") -> DataFrame:
    """Page from the position JSON (−1 unknown), label from the page; no non-files."""
    page = F.coalesce(F.get_json_object(position, "$.pageIndex").try_cast("int"), F.lit(-1))
    rows = annotations
    if "is_file" in rows.columns:
        rows = rows.where("is_file")
    label = (F.nullif(F.col("page_label"), F.lit("")) if "page_label" in rows.columns
             else F.lit(None).cast("string"))
    return (rows.withColumn("page", page)
            .withColumn("page_label", F.coalesce(label, (F.col("page") + 1).cast("string")))
            .drop(position))


def colors_in_use(annotations: DataFrame) -> DataFrame:
    """Distinct colours, with the default palette always present."""
    used = annotations.where(F.col("color") != "").select(F.lower("color").alias("color"))
    spark = annotations.sparkSession
    defaults = spark.range(1).select(F.explode(
        F.array(*[F.lit(c) for c in DEFAULT_COLORS])).alias("color"))
    return used.distinct().unionByName(defaults).distinct()


def color_name(color: Column | str, names: dict[str, str] | None = None) -> Column:
    """User's name, else the default name, else the hex value; a plan-time map."""
    c = F.col(color) if isinstance(color, str) else color
    merged = {**DEFAULT_COLORS, **(names or {})}
    table = F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])
    return F.coalesce(table[F.lower(c)], c)


def merge_names(*layers: dict[str, str]) -> dict[str, str]:
    """Settings layered on each other; later ones win, blank values remove a name."""
    merged = {k.lower(): v.strip() for layer in layers for k, v in layer.items()}
    return {k: v for k, v in merged.items() if v}


def haystack(title: Column | str = "title") -> Column:
    def text(c: Column | str) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat_ws(" ", text("text"), text("comment"), F.array_join("tags", " "), text(title))


def filter_annotations(annotations: DataFrame, query: str = "", color: str = "") -> DataFrame:
    """Boolean text query over text, comment, tags and title; colour equality."""
    kept = annotations.where(F.col("color") == color) if color else annotations
    return kept.where(matches_query(haystack(), query)) if query.strip() else kept


def characters(annotations: DataFrame) -> Column:
    """UTF-16 units of an annotation's text and comment; a missing one counts 0."""
    parts = [utf16_length(F.coalesce(F.col(c), F.lit(""))).cast("bigint")
             for c in ("text", "comment") if c in annotations.columns]
    return sum(parts[1:], parts[0])


def page_characters(annotations: DataFrame) -> DataFrame:
    """Characters of text and comment per (item, page); unknown pages excluded."""
    return (annotations.where("page >= 0").groupBy("item_key", "page")
            .agg(F.sum(characters(annotations)).alias("chars")))


def item_heat(annotations: DataFrame) -> DataFrame:
    """Total characters and count per item."""
    return annotations.groupBy("item_key").agg(
        F.sum(characters(annotations)).alias("chars"), F.count("*").alias("annotations"))


def item_colors(annotations: DataFrame) -> DataFrame:
    return (annotations.where(F.col("color") != "").groupBy("item_key", "color")
            .agg(F.count("*").alias("n")))


def palette(annotations: DataFrame) -> DataFrame:
    """Colour counts over the unfiltered set, most used first."""
    return (annotations.groupBy("color").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "color"))


def rules_from_palette(counts: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One matrix column per colour in use, as a rules table."""
    return counts.where(F.col("color") != "").select(
        color_name("color", names).alias("name"), F.lit("color").alias("attribute"),
        F.lit("is").alias("operator"), F.col("color").alias("value"), "n")


def matrix_hits(annotations: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """Annotations exploded over the rules they meet: one scan for all rules."""
    met = F.array(*[F.when(r.test("color", "tags"), F.lit(r.name)) for r in rules])
    return annotations.withColumn("rule", F.explode(F.filter(met, lambda m: m.isNotNull())))


def matrix(annotations: DataFrame, rules: Sequence[FieldRule], per_cell: int = 8,
           text_chars: int = 260) -> DataFrame:
    """Papers × rules; each cell lists its first annotations in page order.

    ``per_cell`` is the display limit; :func:`matrix_hits` is the whole result.
    """
    hits = matrix_hits(annotations, rules)
    first = top_per_group(hits, ["item_key", "rule"], [F.col("page"), F.col("annotation_key")],
                          per_cell, "position")
    shown = F.substring(first_text(), 1, text_chars)
    cell = F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("shown")))),
                       lambda s: s["shown"])
    return first.groupBy("item_key").pivot("rule", [r.name for r in rules]).agg(cell)


def export_cells(annotations: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """Papers × rules for the export: every hit, uncut, in page order, with its page label.

    A cell is one line of text by the export's format, so its hits meet in one row.
    """
    hits = matrix_hits(annotations, rules)
    shown = F.concat(first_text(), F.lit(" (p."), F.coalesce("page_label", (F.col("page") + 1).cast("string")),
                     F.lit(")"))
    cell = F.transform(F.array_sort(F.collect_list(F.struct("page", "annotation_key", shown.alias("shown")))),
                       lambda s: s["shown"])
    return hits.groupBy("item_key").pivot("rule", [r.name for r in rules]).agg(cell)


def first_text() -> Column:
    comment = (F.coalesce(F.col("comment"), F.lit("")))
    return F.coalesce(F.nullif(F.col("text"), F.lit("")), comment)


def first_per_item(annotations: DataFrame, most: int = 12) -> DataFrame:
    """Annotations in page order, at most ``most`` per item, with their position."""
    return top_per_group(annotations, ["item_key"], [F.col("page"), F.col("annotation_key")],
                         most, "position")
