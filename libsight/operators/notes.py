"""Links between notes and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from libsight.functions.ordered import skew_join

# How a note's HTML names annotation keys.
KEY = r"([A-Z0-9]{8})"
KEY_IN_JSON = r"annotationKey&quot;:&quot;(\w+)&quot;"
KEY_IN_LINK = r"annotation=([A-Z0-9]{8})"


def backlinks(notes: DataFrame, annotations: DataFrame,
              mentioning: list[str] | None = None) -> DataFrame:
    """(note, annotation) for every annotation key found in a note, once per note.

    ``mentioning`` keeps only notes that contain one of the given attachment
    keys, as a cheap filter before the key extraction.
    """
    rows = notes
    if mentioning:
        test = F.lit(False)
        for key in mentioning:
            test = test | F.contains("html", F.lit(key))
        rows = rows.where(test)
    found = rows.select("note_id", F.explode(F.array_distinct(
        F.regexp_extract_all("html", F.lit(KEY), F.lit(1)))).alias("annotation_key"))
    wanted = annotations.select("annotation_key").distinct()
    return skew_join(found, wanted, ["annotation_key"]).select("note_id", "annotation_key")


def forward_links(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations a note cites, in either notation, with the annotation's columns."""
    keys = F.array_union(F.regexp_extract_all("html", F.lit(KEY_IN_JSON), F.lit(1)),
                         F.regexp_extract_all("html", F.lit(KEY_IN_LINK), F.lit(1)))
    cited = notes.select("note_id", F.explode(keys).alias("annotation_key"))
    return skew_join(cited, annotations, ["annotation_key"])


def notes_containing(notes: DataFrame, text: str) -> DataFrame:
    return notes.where(F.contains("html", F.lit(text)))
