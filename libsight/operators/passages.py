"""Passage picking, quote anchoring and quote rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions import keys, text as tx
from libsight.functions.ordered import skew_join
from libsight.operators.transform import TextFn, model_map
from libsight.session import cut_lineage
from libsight.sources import payloads

PAGES_PER_CALL = 6
TOKENS_PER_PAGE = 2200
MIN_QUOTE = 8
NOTE_TOP = 720.0  # fixed value: upper edge of a note that has no rectangle


def page_groups(pages: DataFrame, per_page: int = 2) -> DataFrame:
    """Prompts over runs of six pages: ``doc_id, group_no, prompt``."""
    body = F.concat(F.lit("--- PAGE "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"),
                    tx.clamp_tokens("text", TOKENS_PER_PAGE))
    rows = pages.select("doc_id", F.floor(F.col("page") / PAGES_PER_CALL).alias("group_no"),
                        "page", body.alias("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))),
                                      lambda s: s["body"]), "\n\n")
    head = (f"Pick at most {per_page} key sentences per page, copied exactly. JSON "
            '[{"page":1,"quote":"…","comment":"…"}].\n\n')
    return rows.groupBy("doc_id", "group_no").agg(F.concat(F.lit(head), joined).alias("prompt"))


def pick(pages: DataFrame, fn: TextFn, per_page: int = 2, model: str = "") -> DataFrame:
    """Quotes a model picks from each document: ``doc_id, page, quote, comment``."""
    answers = model_map(page_groups(pages, per_page), fn, "prompt", model, "passages")
    return payloads.passages(answers)


def anchor(quotes: DataFrame, pages: DataFrame, normalised: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """Place quotes (1-based ``page``) on pages (0-based ``page``).

    A quote found in the page's text becomes a highlight with its offset in the
    normalised text; otherwise it is kept as a note on the page.  Quotes on
    pages the document lacks drop.  Both sides are normalised before the join;
    ``normalised`` says the page texts already are; ``also`` names columns of the pages to keep.
    """
    asked = quotes.withColumns({"page": F.col("page") - 1, "_q": keys.quote_key("quote")})
    texts = pages.select("doc_id", "page", (F.col("text") if normalised else keys.quote_key("text")).alias("_t"), *also)
    # quotes cut out of answers are larger than Spark expects, so they must not be broadcast
    if normalised:  # pages gathered by their key stay where they are
        joined = asked.hint("merge").join(texts, ["doc_id", "page"])
    else:
        joined = skew_join(asked, texts, ["doc_id", "page"], broadcast=False)
    at = F.when(F.length("_q") >= MIN_QUOTE, F.instr(F.col("_t"), F.col("_q"))).otherwise(0)
    return joined.withColumn("_at", at).select(
        *[c for c in quotes.columns if c != "page"], "page",
        F.when(F.col("_at") > 0, "highlight").otherwise("note").alias("kind"),
        F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(F.lit(0)).alias("offset"), *also)


def sort_keys(anchored: DataFrame, rectangles: DataFrame | None = None) -> DataFrame:
    """Document order key of each anchored quote."""
    top = F.lit(NOTE_TOP)
    rows = anchored
    if rectangles is not None:
        edges = rectangles.groupBy("quote_id").agg(F.max("y1").alias("_y1"))
        rows = rows.join(edges, "quote_id", "left")
        top = F.coalesce("_y1", top)
    key = keys.position_key("page", "offset", F.floor(2000 - top + 0.5).cast("int"))
    return rows.withColumn("sort_key", key).drop("_y1")


def page_text(runs: DataFrame) -> DataFrame:
    """Normalised text of a page from its runs in ``run_no`` order."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(
        "run_no", keys.quote_key("str").alias("piece")))), lambda s: s["piece"])
    return runs.groupBy("doc_id", "page").agg(F.concat(F.array_join(pieces, " "), F.lit(" ")).alias("text"))


def _run_keys(texts: Column) -> Column:
    """``quote_key`` of each text, worked out over all of them at once."""
    # keys drop the mark and the null character alike, so that a text's own null may become a mark
    joined = F.array_join(F.transform(texts, lambda s: F.replace(F.coalesce(s, F.lit("")), F.lit("\0"), F.lit("!"))), "\0")
    return F.split(F.regexp_replace(tx.squeeze(F.lower(joined)), r"[^A-Za-z0-9_ \x00]+", ""), r"\x00", -1)


def _covered(keyed: Column, start: Column, end: Column) -> Column:
    """Places ``lo`` to ``hi`` of the pieces of a page's text that reach into a span; ``lo`` is -1 if none does."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(a: Column, piece: Column) -> Column:
        reaches = (a["at"] + F.length(piece) >= start) & (a["at"] <= end)
        return F.struct((a["at"] + F.length(piece) + 1).alias("at"), (a["n"] + 1).alias("n"),
                        F.when(reaches & (a["lo"] < 0), a["n"]).otherwise(a["lo"]).alias("lo"),
                        F.when(reaches, a["n"]).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(keyed, zero, step)


def quote_rectangles(quotes: DataFrame, runs: DataFrame) -> DataFrame:
    """Line boxes of the runs a quote covers: ``quote_id, line_y, x0, y0, x1, y1``.

    ``runs`` has ``doc_id, page, run_no, str, x, y, width, height``; a page is
    the largest group.  Only runs of pages that quotes name are gathered, once a page.
    """
    quotes = cut_lineage(quotes)  # read several times below
    named = quotes.select("doc_id", (F.col("page") - 1).alias("page")).distinct().hint("shuffle_hash")
    run = F.struct("run_no", "str", "x", "y", "width", "height")
    pages = (runs.join(named, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page")
             .agg(F.array_sort(F.collect_list(run)).alias("_r")))
    keyed = pages.select("doc_id", "page", "_r", F.explode(F.array(_run_keys(F.col("_r.str")))).alias("_k"))
    texts = keyed.withColumn("text", F.concat(F.array_join("_k", " "), F.lit(" ")))
    anchored = anchor(quotes, texts, normalised=True, also=("_r", "_k")).where("kind = 'highlight'")
    # exploded, so that the end is worked out once and not for each run
    ends = anchored.withColumn("_to", F.explode(F.array(F.col("offset") + F.length(keys.quote_key("quote")))))
    span = _covered(F.col("_k"), F.col("offset"), F.col("_to"))
    found = ends.select("quote_id", "doc_id", "page", "_r", F.explode(F.array(span)).alias("_s")).where("_s.lo >= 0")
    covered = found.select("quote_id", "doc_id", "page", F.explode(F.slice(
        "_r", F.col("_s.lo") + 1, F.col("_s.hi") - F.col("_s.lo") + 1)).alias("_run")).select(
        "quote_id", "doc_id", "page", "_run.*")

    def two(c):
        return F.floor(c * 100 + 0.5) / 100

    line = F.floor(F.col("y") / 4 + 0.5) * 4
    return covered.groupBy("quote_id", "doc_id", "page", line.alias("line_y")).agg(
        two(F.min("x")).alias("x0"), two(F.min("y")).alias("y0"),
        two(F.max(F.col("x") + F.coalesce("width", F.lit(0.0)))).alias("x1"),
        two(F.max(F.col("y") + F.coalesce("height", F.lit(10.0)))).alias("y1"))
