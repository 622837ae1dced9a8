"""Reference lists against the owned library: gaps and citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from libsight.functions.keys import canonical_doi, title_key
from libsight.functions.ordered import top_per_group


def _keyed(refs: DataFrame, unicode_titles: bool) -> DataFrame:
    return refs.withColumns({
        "_doi": F.lower(canonical_doi("doi")),
        "_title": F.nullif(title_key("title", unicode_titles), F.lit(""))})


def _owned_keys(owned: DataFrame, unicode_titles: bool) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(owned, unicode_titles)
    return (keyed.where("_doi is not null").select("_doi").distinct(),
            keyed.where("_title is not null").select("_title").distinct())


def _minus_owned(keyed: DataFrame, owned: DataFrame, unicode_titles: bool) -> DataFrame:
    dois, titles = _owned_keys(owned, unicode_titles)
    return keyed.join(dois, "_doi", "left_anti").join(titles, "_title", "left_anti")


def unowned_refs(refs: DataFrame, owned: DataFrame, unicode_titles: bool = False) -> DataFrame:
    """References to works the library lacks, by DOI and by normalised title."""
    return _minus_owned(_keyed(refs, unicode_titles), owned, unicode_titles).drop("_doi", "_title")


def _with_gap_key(refs: DataFrame, unicode_titles: bool) -> DataFrame:
    keyed = _keyed(refs, unicode_titles).withColumn("gap_key", F.coalesce("_doi", "_title"))
    return keyed.where("gap_key is not null")


def gaps(refs: DataFrame, owned: DataFrame, min_hits: int = 3, distinct_citing: bool = False,
         unicode_titles: bool = False) -> DataFrame:
    """Works cited but not owned: ``gap_key, title, doi, citations, hits``.

    References are tallied by their raw DOI and title before keys are derived or
    anything is joined, so a work cited by a third of the corpus becomes one row
    per input task at once, and the expressions run once per work.  First-seen
    attributes are those of the lowest citing key.
    """
    rows = refs
    if distinct_citing:
        named = _with_gap_key(refs, unicode_titles)
        least = F.struct("doi", "title", "citations")
        rows = (named.groupBy("gap_key", "citing_key").agg(F.min(least).alias("_least"))
                .select("citing_key", "_least.*"))
    works = rows.groupBy("doi", "title").agg(
        F.count("*").alias("hits"), F.min(F.struct("citing_key", "citations")).alias("_least"))
    works = works.select("doi", "title", "hits", F.col("_least.citing_key").alias("_citing"),
                         F.col("_least.citations").alias("citations"))
    keyed = _with_gap_key(works, unicode_titles)
    tally = keyed.groupBy("gap_key", "_doi", "_title").agg(
        F.sum("hits").alias("hits"),
        F.min(F.struct("_citing", "title", "doi", "citations")).alias("_first"))
    missing = _minus_owned(tally, owned, unicode_titles)
    merged = missing.groupBy("gap_key").agg(
        F.sum("hits").alias("hits"), F.min("_first").alias("_first"))
    return merged.where(F.col("hits") >= max(1, min_hits)).select(
        "gap_key", "hits", F.col("_first.title").alias("title"), F.col("_first.doi").alias("doi"),
        F.col("_first.citations").alias("citations"))


def cited_by(refs: DataFrame, gap_table: DataFrame, owned: DataFrame | None = None,
             most: int = 8, unicode_titles: bool = False) -> DataFrame:
    """First ``most`` citing works per gap, as rows ``gap_key, position, citing_key``.

    The first of every raw work are taken before keys are derived, so nothing
    larger than ``most`` rows per work is joined.
    """
    first = top_per_group(refs.select("doi", "title", "citing_key"), ["doi", "title"],
                          [F.col("citing_key")], most)
    keyed = _with_gap_key(first, unicode_titles)
    if owned is not None:
        keyed = _minus_owned(keyed, owned, unicode_titles)
    wanted = keyed.join(gap_table.select("gap_key"), "gap_key", "left_semi")
    return top_per_group(wanted.select("gap_key", "citing_key"), ["gap_key"],
                         [F.col("citing_key")], most, "position")


def cited_by_titles(citations: DataFrame, items: DataFrame, chars: int = 60) -> DataFrame:
    """The citing works of each gap by title: ``gap_key, cited_by`` in order.

    ``citations`` come from :func:`cited_by`, at most a few rows per gap; titles are cut to
    ``chars`` characters, and a citing work without an item has an empty one.
    """
    named = citations.join(items.select(F.col("item_key").alias("citing_key"), "title"), "citing_key", "left")
    entry = F.struct("position", F.substring(F.coalesce("title", F.lit("")), 1, chars).alias("t"))
    return named.groupBy("gap_key").agg(F.transform(
        F.array_sort(F.collect_list(entry)), lambda s: s["t"]).alias("cited_by"))


def rank_gaps(gap_table: DataFrame, most: int = 40) -> DataFrame:
    return gap_table.orderBy(F.col("hits").desc(), F.coalesce("citations", F.lit(0)).desc(),
                             "gap_key").limit(most)


def citation_edges(refs: DataFrame, owned: DataFrame) -> DataFrame:
    """Edges between owned works: ``source, target`` through the DOI, weight 2.

    Of several owners of a DOI the last one wins.
    """
    owners = (owned.select(F.lower(canonical_doi("doi")).alias("_doi"), "item_key")
              .where("_doi is not null").groupBy("_doi").agg(F.max("item_key").alias("target")))
    # each spelling of a DOI is brought into canonical form once
    known = (refs.where("doi is not null").select("doi").distinct()
             .withColumn("_doi", F.lower(canonical_doi("doi"))).join(owners, "_doi")
             .select("doi", "target"))
    cited = refs.select(F.col("citing_key").alias("source"), "doi").join(known, "doi")
    return (cited.where("source <> target").select("source", "target").distinct()
            .select("source", "target", F.lit("cite").alias("kind"), F.lit(2.0).alias("weight")))


def stale(items: DataFrame, fetched: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Items whose reference list is missing or at least ``days`` old."""
    fresh = fetched.where(
        F.unix_millis("fetched_at") > F.unix_millis(F.lit(now).cast("timestamp"))
        - days * 86_400_000).select("item_key")
    return items.join(fresh, "item_key", "left_anti")
