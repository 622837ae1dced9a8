"""Text functions as native Column expressions.

White space follows the Unicode definition web text uses, which is wider than
the ASCII ``\\s`` of Java regular expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Character classes that decide results.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"\u3000-\u9fff\uff00-\uffef"
HAN = r"\u4e00-\u9fff"
ABBREVIATIONS = ("et al", "Fig", "Figs", "Eq", "Eqs", "Ref", "Refs", "vs", "cf", "approx",
                 "Dr", "Prof", "No", "Sec", "Tab", r"i\.e", r"e\.g")
REFERENCE_HEADINGS = r"references|bibliography|参考文献|引用文献|acknowledge?ments?"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
             "\u00ad": "", "\u2010": "-"}
LATIN_WEIGHT = 3.8
CJK_WEIGHT = 1.5
MIN_CHUNK = 24


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of ``SPACE``, one by one.
SPACES = " \t\n\x0b\f\r" + "".join(
    map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# the long list is only asked about characters that are no printable ASCII
_BLANK, _ODD_BLANK = rf"[[^!-~]&&[{SPACE}]]", rf"[[^ -~]&&[{SPACE}]]"


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one space; runs that are one already stay untouched."""
    return F.regexp_replace(col(c), rf" {_BLANK}+|{_ODD_BLANK}{_BLANK}*", " ")


#: Characters whose upper case is longer, and the single one that stands for it, else themselves.
_LONGER = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_SINGLE = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONGER)


def upper(c: Column | str) -> Column:
    """Upper case character by character, so that no text changes its length (``ß`` becomes ``ẞ``)."""
    text = col(c)
    pieces = F.regexp_extract_all(text, F.lit(f"([{_LONGER}]+|[^{_LONGER}]+)"), F.lit(1))
    each = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{_LONGER}]"), F.translate(p, _LONGER, _SINGLE)).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{_LONGER}]"), F.array_join(each, "")).otherwise(F.upper(text))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units; differs from ``length`` on astral characters only."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def has_cjk(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[{CJK}]"), F.lit(False))


def estimate_tokens(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    other = utf16_length(text) - cjk
    return F.ceil(cjk / F.lit(CJK_WEIGHT) + other / F.lit(LATIN_WEIGHT)).cast("long")


_CJK_RANGES = ((0x3000, 0x9FFF), (0xFF00, 0xFFEF))


def _cut_point(text: str, budget: int) -> int:
    units = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    wide = np.zeros(len(units), dtype=bool)
    for low, high in _CJK_RANGES:
        wide |= (units >= low) & (units <= high)
    cjk = np.cumsum(wide)
    other = np.cumsum(np.where(units > 0xFFFF, 2, 1)) - cjk
    cost = np.ceil(cjk / CJK_WEIGHT + other / LATIN_WEIGHT)
    return int(np.searchsorted(cost, budget, side="right"))


def clamp_tokens(c: Column | str, budget: int) -> Column:
    """Longest prefix within the token budget, marked when something was cut.

    Texts within the budget, and texts without CJK (where the cut is a plain
    division), never leave the JVM; only mixed texts over the budget are sent
    through Arrow.
    """
    text = F.coalesce(col(c), F.lit(""))

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else t[:_cut_point(t, budget)])

    over = estimate_tokens(text) > budget
    astral = text.rlike(r"[\x{10000}-\x{10ffff}]")
    plain = F.substring(text, 1, int(np.floor(budget * LATIN_WEIGHT + 1e-9)))
    slow = has_cjk(text) | astral
    prefix = F.when(slow, cut(F.when(over & slow, text))).otherwise(plain)
    return F.when(over, F.concat(prefix, F.lit("\n…[truncated]"))).otherwise(text)


def split_sentences(c: Column | str) -> Column:
    """Array of sentences.

    A boundary is white space after terminal punctuation, or the point after a
    CJK stop.  A boundary right after a known abbreviation is no boundary, which
    a bounded look-behind states directly, so no fold over the pieces is needed.
    """
    abbreviated = rf"(?<!\b(?i:{'|'.join(ABBREVIATIONS)})\.)"
    boundary = rf"(?<=[.!?。！？；;]){abbreviated} +|(?<=[。！？；])"
    pieces = F.split(squeeze(c), boundary)
    # a lambda of one name: F.trim itself would be given the position as characters to trim
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def split_paragraphs(c: Column | str) -> Column:
    blocks = F.split(col(c), rf"\n[{SPACE}]*\n+")
    flat = F.transform(
        blocks, lambda p: strip(F.regexp_replace(p, rf"[{SPACE}]*\n[{SPACE}]*", " ")))
    return F.filter(flat, lambda p: p != "")


def drop_references(c: Column | str) -> Column:
    """Cut at the first reference-list heading, if it lies beyond 40 % of the text."""
    text = col(c)
    at = F.regexp_instr(
        text, F.lit(rf"(?i)\n[{SPACE}]*(?:{REFERENCE_HEADINGS})[{SPACE}]*\n")) - 1
    return F.when(at > F.length(text) * 0.4, text.substr(F.lit(1), at)).otherwise(text)


def page_markers(pages: Column | str, first: int = 1) -> Column:
    """Pages joined under ``--- p. N ---`` headers."""
    marked = F.transform(col(pages), lambda p, i: F.concat(
        F.lit("--- p. "), (i + first).cast("string"), F.lit(" ---\n"), strip(p)))
    return F.array_join(marked, "\n\n")


def escape_html(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _unescape(c: Column, quotes: bool) -> Column:
    pairs = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
    if quotes:
        pairs.append(("&quot;", '"'))
    for entity, char in pairs:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_html(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for pattern, by in ((r"(?is)<style.*?</style>", ""), (r"(?is)<script.*?</script>", ""),
                        (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"),
                        (rf"(?i)<br[{SPACE}]*/?>", "\n"), (r"<[^>]+>", "")):
        out = F.regexp_replace(out, pattern, by)
    return _unescape(out, quotes=True)


def note_markdown(c: Column | str) -> Column:
    """Markdown of a note's HTML.

    Inner tags of headings, list items and quotes are dropped first, so the
    later emphasis rules only see running text.
    """
    out = F.coalesce(col(c), F.lit(""))
    out = _plain_blocks(out, "h([1-6])", lambda level: F.concat(
        F.lit("\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" ")), "\n")
    out = _plain_blocks(out, "li()", lambda _: F.lit("- "), "\n")
    out = _plain_blocks(out, "blockquote()", lambda _: F.lit("> "), "\n")
    for pattern, by in (
            (r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**"),
            (r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", "*$1*"),
            (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
            (r"(?is)<pre[^>]*>(.*?)</pre>", "\n```\n$1\n```\n"),
            (rf"(?i)<br[{SPACE}]*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"<[^>]+>", "")):
        out = F.regexp_replace(out, pattern, by)
    return _unescape(out, quotes=False)


def _plain_blocks(c: Column, tag: str, before, after: str) -> Column:
    """Replace each block by its tag-free trimmed body between two marks.

    The text is split right after every closing tag, so a piece holds at most
    one block, at its end.  ``tag`` captures what ``before`` needs.
    """
    bare = tag.replace("(", "").replace(")", "")
    pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag.replace('([1-6])', chr(92) + '1').replace('()', '')}>\z"

    def render(piece: Column) -> Column:
        body = strip(F.regexp_replace(F.regexp_extract(piece, pattern, 2), r"<[^>]+>", ""))
        done = F.concat(F.regexp_replace(piece, pattern, ""),
                        before(F.regexp_extract(piece, pattern, 1)), body, F.lit(after))
        return F.when(piece.rlike(pattern), done).otherwise(piece)

    pieces = F.split(c, rf"(?i)(?<=</{bare}>)")
    return F.array_join(F.transform(pieces, render), "")


def text_key(c: Column | str) -> Column:
    """Stable cache key of a text; 256 bits, so no collisions at corpus scale."""
    return F.sha2(col(c), 256)


def lex_tokens(c: Column | str) -> Column:
    """Index tokens: lower-case alphanumeric words of 2+ characters and Han bigrams."""
    text = F.coalesce(col(c), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(f"([{HAN}]{{2,}})"), F.lit(1))
    bigrams = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.concat(words, bigrams)


def lex_count(c: Column | str) -> Column:
    """Number of index tokens, without building them."""
    text = F.coalesce(col(c), F.lit(""))
    # a Han run of n characters has n - 1 bigrams: one per character with a Han successor
    return (F.regexp_count(F.lower(text), F.lit("[a-z0-9]{2,}"))
            + F.regexp_count(text, F.lit(f"[{HAN}](?=[{HAN}])")))


def normalise_text(c: Column | str) -> Column:
    """Ligatures spelled out, soft hyphens dropped, the Unicode hyphen made plain."""
    out = col(c)
    for char, plain in LIGATURES.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    return out


def math_delimiters(c: Column | str) -> Column:
    r"""``\( \)`` and ``\[ \]`` become ``$`` and ``$$``, code left alone.

    Code spans are matched by the same pattern as the formulas and put back
    unchanged, since of several alternatives only the matching one captures.
    """
    code = r"```[\s\S]*?(?:```|$)|`[^`\n]*`"
    text = col(c)
    pieces = F.regexp_extract_all(
        text, F.lit(rf"({code}|(?:(?!```[\s\S]*?(?:```|$)|`[^`\n]*`)[\s\S])+)"), F.lit(1))

    def convert(piece: Column) -> Column:
        block = F.regexp_replace(piece, r"\\\[([\s\S]+?)\\\]", r"\$\$$1\$\$")
        inline = F.regexp_replace(
            block, rf"\\\([{SPACE}]*([\s\S]+?)[{SPACE}]*\\\)", r"\$$1\$")
        return F.when(piece.rlike(rf"^(?:{code})$"), piece).otherwise(inline)

    return F.array_join(F.transform(pieces, convert), "")


#: Fixed value: dash forms accepted in page ranges.
DASHES = r"\u2010-\u2015\u2212~\-"
PAGE_CITATION = rf"(?i)[(（]pp?\.?[{SPACE}]*(\d{{1,4}})(?:[{SPACE}]*[{DASHES}][{SPACE}]*(\d{{1,4}}))?[)）]"


def page_citations(c: Column | str) -> Column:
    """Array of (first, last) page numbers cited as ``(p. N)`` or ``(pp. N-M)``."""
    firsts = F.regexp_extract_all(col(c), F.lit(PAGE_CITATION), F.lit(1))
    lasts = F.regexp_extract_all(col(c), F.lit(PAGE_CITATION), F.lit(2))
    return F.transform(F.arrays_zip(firsts.alias("a"), lasts.alias("b")), lambda z: F.struct(
        z["a"].cast("int").alias("first"),
        F.when(z["b"] != "", z["b"].cast("int")).alias("last")))


def link_pages(c: Column | str, base_url: Column | str) -> Column:
    """Page citations turned into links ``base_url?page=N``."""
    with_range = PAGE_CITATION.replace("))?[)）]", "))[)）]")
    single = rf"(?i)[(（]pp?\.?[{SPACE}]*(\d{{1,4}})[)）]"
    url = F.regexp_replace(col(base_url), r"([\\$])", r"\\$1")
    out = F.regexp_replace(col(c), F.lit(with_range), F.concat(
        F.lit('(<a href="'), url, F.lit('?page=$1">p. $1–$2</a>)')))
    return F.regexp_replace(out, F.lit(single), F.concat(
        F.lit('(<a href="'), url, F.lit('?page=$1">p. $1</a>)')))
