"""Venue ranks: lookup by exact and contained name, fields, refresh list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions.bibliography import first_nonblank
from libsight.functions.keys import venue_key
from libsight.functions.substring import contains_join
from libsight.functions.text import strip

# The fallback rank table, in the order that decides between contained names.
BUILTIN: dict[str, dict[str, str]] = {
    "nature": {"sciUp": "1区", "jcr": "Q1"},
    "science": {"sciUp": "1区", "jcr": "Q1"},
    "cell": {"sciUp": "1区", "jcr": "Q1"},
    "nature communications": {"sciUp": "1区", "jcr": "Q1"},
    "science advances": {"sciUp": "1区", "jcr": "Q1"},
    "pnas": {"sciUp": "1区", "jcr": "Q1"},
    "proceedings of the national academy of sciences": {"sciUp": "1区", "jcr": "Q1"},
    "ieee transactions on pattern analysis and machine intelligence": {"ccf": "CCF-A", "sciUp": "1区"},
    "international journal of computer vision": {"ccf": "CCF-A", "sciUp": "2区"},
    "journal of machine learning research": {"ccf": "CCF-A"},
    "ieee transactions on knowledge and data engineering": {"ccf": "CCF-A"},
    "ieee transactions on image processing": {"ccf": "CCF-A", "sciUp": "1区"},
    "acm transactions on graphics": {"ccf": "CCF-A"},
    "artificial intelligence": {"ccf": "CCF-A"},
    "ieee transactions on information theory": {"ccf": "CCF-A"},
    "acm computing surveys": {"ccf": "CCF-A", "sciUp": "1区"},
    "advances in neural information processing systems": {"ccf": "CCF-A"},
    "neurips": {"ccf": "CCF-A"},
    "icml": {"ccf": "CCF-A"},
    "iclr": {"ccf": "CCF-A"},
    "cvpr": {"ccf": "CCF-A"},
    "iccv": {"ccf": "CCF-A"},
    "eccv": {"ccf": "CCF-B"},
    "aaai": {"ccf": "CCF-A"},
    "ijcai": {"ccf": "CCF-A"},
    "acl": {"ccf": "CCF-A"},
    "emnlp": {"ccf": "CCF-B"},
    "naacl": {"ccf": "CCF-B"},
    "sigmod": {"ccf": "CCF-A"},
    "vldb": {"ccf": "CCF-A"},
    "kdd": {"ccf": "CCF-A"},
    "sigir": {"ccf": "CCF-A"},
    "www": {"ccf": "CCF-A"},
    "osdi": {"ccf": "CCF-A"},
    "sosp": {"ccf": "CCF-A"},
    "the lancet": {"sciUp": "1区", "jcr": "Q1"},
    "new england journal of medicine": {"sciUp": "1区", "jcr": "Q1"},
    "jama": {"sciUp": "1区", "jcr": "Q1"},
    "bmj": {"sciUp": "1区", "jcr": "Q1"},
}
GRAM = 6


def venue_of(*fields: Column | str) -> Column:
    """First non-blank of the venue fields, trimmed."""
    return strip(first_nonblank(*fields))


def _record_map(record: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in record.items() for x in kv])


def builtin_ranks(spark) -> DataFrame:
    """The fallback table as rows ``venue_key, record, ordinal``."""
    rows = [(name, record, i) for i, (name, record) in enumerate(BUILTIN.items())]
    df = spark.createDataFrame(rows, "name string, record map<string,string>, ordinal int")
    return df.select(venue_key("name").alias("venue_key"), "record", "ordinal")


def overlay(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Rank maps per venue, the custom map laid over the official one; empty ones skipped."""
    both = base.select("venue_key", F.col("record").alias("_b")).join(
        custom.select("venue_key", F.col("record").alias("_c")), "venue_key", "full")
    empty = F.create_map().cast("map<string,string>")
    return (both.select("venue_key", overlay_map(F.coalesce("_b", empty), F.coalesce("_c", empty))
                        .alias("record")).where(F.size("record") > 0))


def overlay_map(base: Column, over: Column) -> Column:
    """``over`` wins on shared keys, whatever the session's duplicate-key policy."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def contained_names(venues: DataFrame, ranks: DataFrame) -> DataFrame:
    """(venue key, rank row) where a rank's name of 6+ characters occurs in the venue key."""
    names = ranks.where(F.length("venue_key") >= GRAM).select(
        F.col("venue_key").alias("name"), "record", "ordinal")
    return contains_join(venues.select("venue_key"), "venue_key", names, "name", GRAM, GRAM)


def lookup(items: DataFrame, builtin: DataFrame, fetched: DataFrame | None = None,
           contains: bool = False, venue: str = "venue") -> DataFrame:
    """Items with ``venue_key`` and rank ``record``.

    Fetched ranks by exact key first, then the fallback table by exact key,
    then (opt-in) the first fallback name contained in the key.  Works on
    distinct venues, so items join once, against one row per venue.
    """
    keyed = items.withColumn("venue_key", venue_key(venue))
    venues = keyed.where(F.col("venue_key") != "").select("venue_key").distinct()
    exact = builtin.groupBy("venue_key").agg(F.min_by("record", "ordinal").alias("_builtin"))
    found = venues.join(exact, "venue_key", "left")
    choice = [F.col("_builtin")]
    if fetched is not None:
        found = found.join(fetched.select("venue_key", F.col("record").alias("_fetched")),
                           "venue_key", "left")
        choice.insert(0, F.col("_fetched"))
    if contains:
        inside = (contained_names(venues, builtin).groupBy("venue_key")
                  .agg(F.min_by("record", "ordinal").alias("_inside")))
        found = found.join(inside, "venue_key", "left")
        choice.append(F.col("_inside"))
    ranked = found.select("venue_key", F.coalesce(*choice).alias("record"))
    return keyed.join(ranked, "venue_key", "left")


def known_fields(*rank_tables: DataFrame) -> DataFrame:
    """Every field name in use, sorted."""
    out = None
    for ranks in rank_tables:
        fields = ranks.select(F.explode(F.map_keys("record")).alias("field"))
        out = fields if out is None else out.unionByName(fields)
    return out.distinct().orderBy("field")


def venues_to_refresh(items: DataFrame, venue: str = "venue") -> DataFrame:
    return (items.select(strip(F.coalesce(venue, F.lit(""))).alias("venue")).distinct()
            .where(F.col("venue") != ""))


def source_priority(counts: DataFrame, preferred: str = "semanticscholar") -> DataFrame:
    """First available citation record per item: the preferred source, then the others."""
    order = [preferred] + [s for s in ("openalex", "crossref", "semanticscholar")
                           if s != preferred]
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    columns = [c for c in counts.columns if c != "item_key"]
    best = counts.where(rank > 0).groupBy("item_key").agg(
        F.min_by(F.struct(*columns), rank).alias("_r"))
    return best.select("item_key", "_r.*")
