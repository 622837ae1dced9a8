"""Bibliographic strings, labels and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from libsight.functions.rules import parse_rewrites, rewrite
from libsight.functions.text import col, squeeze, strip, strip_html

# Language codes each engine expects.
LANGUAGE_CODES = {
    "deepl": {"zh-cn": "ZH", "zh-tw": "ZH", "en": "EN", "ja": "JA", "ko": "KO", "de": "DE",
              "fr": "FR", "es": "ES", "ru": "RU", "auto": ""},
    "baidu": {"zh-cn": "zh", "zh-tw": "cht", "en": "en", "ja": "jp", "ko": "kor", "de": "de",
              "fr": "fra", "es": "spa", "ru": "ru", "auto": "auto"},
    "youdao": {"zh-cn": "zh-CHS", "zh-tw": "zh-CHT", "en": "en", "ja": "ja", "ko": "ko",
               "auto": "auto"},
    "niutrans": {"zh-cn": "zh", "zh-tw": "cht", "en": "en", "ja": "ja", "ko": "ko",
                 "auto": "auto"},
}
DEEPL_TARGETS = {"zh-tw": "ZH-HANT", "zh-cn": "ZH-HANS"}
# Rank tiers, first match wins; tier 5 is a warning, 0 is none of these.
RANK_TIERS = ((r"(?i)1区|Q1|A\+|CCF-?A|T1", 1), (r"(?i)2区|Q2|CCF-?B|T2|^A$", 2),
              (r"(?i)3区|Q3|CCF-?C|T3", 3), (r"(?i)4区|Q4", 4), (r"(?i)警示|预警|WARN", 5))
RANK_FIELDS = ("sciUp", "sciif", "ccf", "pku", "cssci")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def creator_string(creators: Column | str, most: int = 6) -> Column:
    """Names of ``array<struct<lastName,name>>``, at most ``most`` of them."""
    names = F.filter(F.transform(col(creators), lambda c: F.coalesce(
        F.nullif(c["lastName"], F.lit("")), c["name"], F.lit(""))), lambda n: n != "")
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.coalesce(F.when(F.size(names) > most, F.concat(shown, F.lit(" et al.")))
                      .otherwise(shown), F.lit(""))


def citation(creators: Column | str, date: Column | str) -> Column:
    """``Author Year``, with stand-ins for either when missing."""
    author = F.split(creator_string(creators, 1), ",")[0]
    year = F.substring(text_or_empty(date), 1, 4)
    return F.concat(F.when(author == "", "Anon.").otherwise(author), F.lit(" "),
                    F.when(year == "", "n.d.").otherwise(year))


def node_year(date: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(date), r"(\d{4})", 1)


def meta_block(title: Column | str, creators: Column | str, date: Column | str,
               venue: Column | str, doi: Column | str, abstract: Column | str,
               tags: Column | str) -> Column:
    """Labelled metadata lines; blank fields are left out."""
    fields = (("Title", col(title)), ("Authors", creator_string(creators)),
              ("Year", F.substring(text_or_empty(date), 1, 4)), ("Venue", col(venue)),
              ("DOI", col(doi)), ("Abstract", strip_html(abstract)),
              ("Tags", F.array_join(col(tags), ", ")))
    return F.concat_ws("\n", *[
        F.when(strip(value) != "", F.concat(F.lit(f"{label}: "), strip(value)))
        for label, value in fields])


def first_nonblank(*columns: Column | str) -> Column:
    """First of the columns that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def node_label(mode: str, citation: Column | str, title: Column | str, short_title: Column | str,
               venue: Column | str, year: Column | str) -> Column:
    """Label of a graph node; every mode falls back to the citation."""
    def clean(c: Column | str) -> Column:
        return strip(squeeze(text_or_empty(c)))

    if mode == "none":
        return F.lit("")
    if mode == "title":
        return first_nonblank(clean(title), citation)
    if mode == "shortTitle":
        return first_nonblank(clean(short_title), clean(title), citation)
    if mode == "venue":
        dated = strip(F.concat(clean(venue), F.lit(" "), clean(year)))
        return F.when(clean(venue) != "", dated).otherwise(col(citation))
    return col(citation)


def language_code(engine: Column | str, code: Column | str, target: bool = False) -> Column:
    """The code an engine expects; ``target`` names the script for DeepL targets."""
    lower = F.lower(col(code))
    out = F.lit(None).cast("string")
    for name, table in LANGUAGE_CODES.items():
        known = {**table, **(DEEPL_TARGETS if target and name == "deepl" else {})}
        pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        out = F.when(col(engine) == name, pairs[lower]).otherwise(out)
    return F.coalesce(out, col(code))


def rank_tier(label: Column | str) -> Column:
    tier = F.lit(0)
    for pattern, value in reversed(RANK_TIERS):
        tier = F.when(col(label).rlike(pattern), value).otherwise(tier)
    return tier


def rank_labels(record: Column | str, fields: Sequence[str] = RANK_FIELDS,
                rewrites: str = "", most: int = 5) -> Column:
    """Labels of a rank record in the order of ``fields``; all, by name, if none is given."""
    rules = parse_rewrites(rewrites)
    keys = F.array(*[F.lit(f) for f in fields]) if fields else F.array_sort(F.map_keys(col(record)))
    labels = F.transform(keys, lambda k: rewrite(text_or_empty(F.try_element_at(col(record), k)), rules))
    return F.coalesce(F.slice(F.array_distinct(F.filter(labels, lambda v: v != "")), 1, most),
                      F.array().cast("array<string>"))


def citation_summary(record: Column | str, rewrites: str = "") -> Column:
    """``label value`` pairs of a citation record in label order, fetch date left out."""
    rules = parse_rewrites(rewrites)
    entries = F.filter(F.array_sort(F.map_entries(col(record))), lambda e: e["key"] != "fetchedAt")
    return F.coalesce(F.array_join(F.transform(entries, lambda e: rewrite(
        F.concat(e["key"], F.lit(" "), e["value"]), rules)), " "), F.lit(""))
