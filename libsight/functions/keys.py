"""Normalised keys, identifiers and key-value lines in free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from libsight.functions.text import HAN, SPACE, col, squeeze, strip

DOI_URL = r"(?i)^https?://(?:dx\.)?doi\.org/"


def title_key(c: Column | str, unicode: bool = False) -> Column:
    """Lower-case alphanumerics of a title, 90 characters.

    ``unicode=True`` keeps letters and digits of every script, so non-Latin
    titles keep a key of their own.
    """
    kept = r"\p{L}\p{N}" if unicode else "a-z0-9"
    # only the text that holds the key is cleaned, not what follows it
    head = F.regexp_extract(F.lower(F.coalesce(col(c), F.lit(""))), rf"^(?:[^{kept}]*+[{kept}]){{0,90}}", 0)
    return F.regexp_replace(head, rf"[^{kept}]+", "")


def venue_key(c: Column | str) -> Column:
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    bare = F.regexp_replace(
        lowered, rf"^(?:the|proceedings of the|proc\.? of)[{SPACE}]+", "")
    return strip(squeeze(F.regexp_replace(bare, rf"[^a-z0-9{HAN} ]", "")))


def quote_key(c: Column | str) -> Column:
    """Lower case, single spaces, ASCII word characters only."""
    # after squeezing, the only white space is the space
    return F.regexp_replace(squeeze(F.lower(F.coalesce(col(c), F.lit("")))), r"[^A-Za-z0-9_ ]+", "")


def canonical_doi(doi: Column | str, extra: Column | str | None = None) -> Column:
    """DOI without resolver prefix; optionally the ``DOI: x`` line of a free-text field."""
    bare = F.regexp_replace(strip(F.coalesce(col(doi), F.lit(""))), DOI_URL, "")
    if extra is not None:
        line = F.regexp_extract(F.coalesce(col(extra), F.lit("")), r"(?i)\bDOI:\s*(\S+)", 1)
        bare = F.when(bare != "", bare).otherwise(line)
    return F.nullif(bare, F.lit(""))


def _line(prefix: str, key: str) -> str:
    return rf"{re.escape(prefix)}-{re.escape(key)}\s*:"


def extra_value(c: Column | str, key: str, prefix: str = "lib") -> Column:
    """Value of a ``prefix-key: value`` line, NULL when there is none."""
    text = F.coalesce(col(c), F.lit(""))
    pattern = rf"(?mi)^{_line(prefix, key)}\s*(.*)$"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def rating(c: Column | str, prefix: str = "lib") -> Column:
    number = F.coalesce(extra_value(c, "rating", prefix).try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), number))


def read_mark(c: Column | str, prefix: str = "lib") -> Column:
    """True / False as marked, NULL when unmarked."""
    return extra_value(c, "read", prefix).isin("1", "true")


def write_extra(c: Column | str, key: str, value: Column | str | None,
                prefix: str = "lib") -> Column:
    """Set, replace or (NULL or empty value) remove a key-value line."""
    text = F.coalesce(col(c), F.lit(""))
    val = F.lit(None).cast("string") if value is None else col(value)
    pattern = rf"(?mi)^{_line(prefix, key)}.*$"
    # only the first such line is touched
    first = rf"(?i)\A([\s\S]*?)(?m:^){_line(prefix, key)}[^\n]*"
    line = F.concat(F.lit(f"{prefix}-{key}: "), val)
    safe = F.regexp_replace(line, r"([\\$])", r"\\$1")
    removed = strip(F.regexp_replace(F.regexp_replace(text, first, "$1"), r"\n{2,}", "\n"))
    replaced = F.regexp_replace(text, F.lit(first), F.concat(F.lit("$1"), safe))
    appended = F.when(text == "", line).otherwise(F.concat(text, F.lit("\n"), line))
    return (F.when(F.coalesce(val, F.lit("")) == "", removed)
            .when(text.rlike(pattern), replaced).otherwise(appended))


def position_key(page: Column | str, offset: Column | str, top: Column | str) -> Column:
    """Sortable ``page|offset|top`` key, zero-padded 5/6/5."""
    def pad(c: Column | str, n: int) -> Column:
        text = col(c).cast("string")
        return F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0"))
    return F.concat_ws("|", pad(page, 5), pad(F.coalesce(col(offset), F.lit(0)), 6),
                       pad(F.greatest(F.lit(0), col(top)), 5))


def stable_bucket(label: Column | str, buckets: int = 10) -> Column:
    """Bucket of a label's top path level: polynomial hash in 32 bits."""
    top = F.lower(strip(F.split(col(label), "/")[0]))
    chars = F.filter(F.split(top, ""), lambda ch: ch != "")
    # the first two bytes of UTF-16 are the code unit of a BMP character
    hashed = F.aggregate(chars, F.lit(0).cast("long"), lambda h, ch: (
        h * 31 + F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("long")) % 4294967296)
    return (hashed % buckets).cast("int")


def local_day(ts: Column | str, timezone: str = "UTC") -> Column:
    """Calendar day of an instant in the reader's own time zone."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(
        F.col(ts) if isinstance(ts, str) else ts, F.current_timezone()), timezone))
