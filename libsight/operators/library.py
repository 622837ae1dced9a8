"""Library scans and the wide per-item and per-attachment views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions import bibliography, keys, rules, text
from libsight.functions.ordered import top_per_group
from libsight.operators import annotations as anno

ITEM_TYPES = ("book", "journalArticle", "conferencePaper", "thesis", "preprint", "report",
              "webpage", "bookSection")


def scan(items: DataFrame, keep: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Regular items once each: the whole library, or the keys in ``keep``."""
    rows = items
    if "is_regular" in rows.columns:
        rows = rows.where("is_regular")
    if keep is not None:
        rows = rows.join(keep.select("item_key"), "item_key", "left_semi")
    rows = rows.dropDuplicates(["item_key"])
    return rows.orderBy("item_key").limit(limit) if limit else rows


def of_type(items: DataFrame, item_type: str) -> DataFrame:
    return items.where(F.col("item_type") == item_type)


def page_split(documents: DataFrame, page_total: str | None = None, key: str = "doc_id",
               body: str = "text", plain: bool = False) -> DataFrame:
    """Pages of each text: ``key, page, text, exact``.

    Form feeds give exact pages.  Otherwise paragraphs are spread evenly over
    ``page_total`` pages; with fewer than two the whole text is one page.  In
    ``plain`` texts form feeds are white space like any other, and a text
    without characters is one empty page, where else it has no pages.
    """
    t = F.coalesce(F.col(body), F.lit(""))
    paragraphs = F.split(t, rf"\n[{text.SPACE}]*\n")
    total = F.coalesce(F.col(page_total), F.lit(0)) if page_total else F.lit(0)
    per = F.greatest(F.lit(1), F.ceil(F.size(paragraphs) / total)).cast("int")
    groups = F.ceil(F.size(paragraphs) / per).cast("int")
    spread = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.array_join(
        F.slice(paragraphs, i * per + 1, per), "\n\n"))
    marked = F.lit(False) if plain else F.contains(t, F.lit("\f"))
    missing = F.col(body).isNull() if plain else t == ""
    pages = (F.when(missing, F.array().cast("array<string>"))
             .when(marked, F.transform(F.split(t, "\f"), text.strip))
             .when(total < 2, F.array(t)).otherwise(spread))
    return documents.select(key, marked.alias("exact"), F.posexplode(pages).alias("page", "text"))


def library_view(items: DataFrame, reading: DataFrame, heat: DataFrame, tags: DataFrame,
                 ranked: DataFrame, citations: DataFrame, tag_rule: str = "#",
                 rank_fields: Sequence[str] = bibliography.RANK_FIELDS) -> DataFrame:
    """One wide row per item.

    Every input is reduced to one row per item first, so the joins are between
    unique keys and no hot item can multiply.  Tag lists are those of one item.
    """
    tag_lists = tags.groupBy("item_key").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    none = F.array().cast("array<string>")
    wide = items
    for part in (reading.select("item_key", "seconds"), heat.select("item_key", "annotations"),
                 tag_lists, ranked.select("item_key", "record"),
                 citations.select("item_key", "citation_record")):
        wide = wide.join(part, "item_key", "left")
    tags_col = F.coalesce("_tags", none)
    return wide.select(
        "item_key", F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("annotations", F.lit(0)).alias("annotations"),
        keys.rating("extra").alias("rating"),
        rules.tags_outside(tags_col, tag_rule).alias("plain_tags"),
        F.transform(rules.pick_tags(tags_col, tag_rule), lambda p: p["label"]).alias("picked_tags"),
        bibliography.rank_labels("record", rank_fields).alias("rank_labels"),
        bibliography.citation_summary("citation_record").alias("cited"))


def _listed(rows: DataFrame, value: Column, name: str, order: Sequence[Column], most: int) -> DataFrame:
    """First ``most`` values per item as a list in order."""
    first = top_per_group(rows, ["item_key"], order, most, "_pos")
    return first.groupBy("item_key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", value.alias("v")))),
        lambda s: s["v"]).alias(name))


def item_digest(items: DataFrame, summary: DataFrame, annotations: DataFrame,
                notes: DataFrame) -> DataFrame:
    """Reading figures, counts, colour spread, first annotations and notes, abstract."""
    shown = _listed(annotations, F.substring(anno.first_text(), 1, 220), "first_annotations",
                    [F.col("page"), F.col("annotation_key")], 12)
    heat = anno.item_heat(annotations)
    # every colour in use: a row per colour, so few by nature
    tally = F.struct((-F.col("n")).alias("less"), "color", F.concat_ws(
        " ", anno.color_name("color"), F.col("n").cast("string")).alias("v"))
    spread = anno.item_colors(annotations).groupBy("item_key").agg(F.transform(
        F.array_sort(F.collect_list(tally)), lambda s: s["v"]).alias("colors"))
    noted = _listed(notes, F.substring(text.strip_html("html"), 1, 160), "first_notes",
                    [F.col("note_id")], 8)
    read = summary.where("seconds > 30").select("item_key", "minutes", "coverage")
    wide = items
    for part in (read, heat, spread, shown, noted):
        wide = wide.join(part, "item_key", "left")
    abstract = text.strip_html("abstract") if "abstract" in items.columns else F.lit("")
    return wide.withColumn("abstract", abstract)


def attachment_listing(attachments: DataFrame, annotations: DataFrame,
                       pages: DataFrame | None = None) -> DataFrame:
    """Annotation count per attachment (0 for non-files) and the start of its first page."""
    counts = annotations.groupBy("attachment_key").agg(F.count("*").alias("n"))
    rows = attachments.join(counts, "attachment_key", "left")
    files = F.col("is_file") if "is_file" in attachments.columns else F.lit(True)
    rows = rows.withColumn("annotations", F.when(files, F.coalesce("n", F.lit(0)))
                           .otherwise(F.lit(0))).drop("n")
    if pages is not None:
        first = pages.where("page = 0").select(
            "attachment_key", F.substring("text", 1, 600).alias("first_page"))
        rows = rows.join(first, "attachment_key", "left")
    return rows
