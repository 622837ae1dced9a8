"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is paired with the neighbour whose path shares
the longer beginning.  The text lines of both pages are aligned by longest common subsequence,
and lines they share are deleted as boilerplate.  What markup declares is heeded first: menus,
footers, adverts, forms, comments and the like never become lines, and prose inside a declared
article stays even if a neighbour repeats it, since pages may be copies of one another.  Without
a declared article, shared lines that stand on many different pages of the host are boilerplate;
of the others, those of a page that mostly repeats its neighbour are prose.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from libsight.functions.ordered import broadcast_if_small, skew_join
from libsight.llm.neighbours import deal
from libsight.llm.scratch import Scratch
from libsight.session import cut_lineage, ship

# Elements by role, and words in class, id or role that mark boilerplate.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "svg", "math",
           "object", "canvas", "select", "template"}
IN_HEAD = {"base", "link", "meta", "noscript", "object", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
BREAKING = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd",
            "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
            "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
            "li", "main", "menu", "nav", "ol", "optgroup", "p", "pre", "section", "summary", "table",
            "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
MARKED = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner",
          "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
          "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login",
          "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
          "notices", "pager", "pagination", "popup", "promo", "promotion", "related", "replies",
          "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
          "sponsored", "subscribe", "toolbar", "widget", "widgets"}

#: Parts of a class name that turn its other parts round or name a layout.
NEUTRAL = {"no", "non", "not", "without", "free", "has", "with", "less"}
# Which open elements a start tag ends, and where the search for them stops.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
          "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
CELLS = {"table", "caption", "td", "th"}
TABLE_PARTS = {"table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}

#: A line on more different pages of a host than this is boilerplate.
FEW_PAGES = 2

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""",
                        re.I)
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z")


@dataclass
class Line:
    text: str
    article: bool
    links: float  # share of its characters inside links


def _marked(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif any(_condemned(token) for token in value.split()):
            return True
    return False


def _condemned(token: str) -> bool:
    """Whether a class name or id marks boilerplate: one of its parts does, and none says the opposite."""
    parts = set(re.split(r"[^a-z]+", token))
    return bool(MARKED & parts) and not NEUTRAL & parts


class _Open:
    """The open elements of a page, innermost last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, skipped, article
        self.counts: Counter = Counter()
        self.skips = self.articles = self.links = 0

    def push(self, name: str, skipped: bool = False, article: bool = False) -> None:
        self.stack.append((name, skipped, article))
        self._count((name, skipped, article), 1)

    def _count(self, entry: tuple[str, bool, bool], by: int) -> None:
        self.counts[entry[0]] += by
        self.skips += by * entry[1]
        self.articles += by * entry[2]
        self.links += by * (entry[0] == "a")

    def cut(self, to: int) -> None:
        """Close the elements from place ``to`` on."""
        while len(self.stack) > to:
            self._count(self.stack.pop(), -1)

    def find(self, names: set[str], stops: set[str]) -> int | None:
        """Place of the innermost open element of ``names``, unless one of ``stops`` lies further in."""
        if not any(self.counts[n] for n in names):
            return None
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in names:
                return at
            if self.stack[at][0] in stops:
                return None
        return None

    def imply(self, name: str) -> None:
        """Close what a start tag of ``name`` ends without an end tag."""
        if self.counts["head"] and name not in IN_HEAD:
            self.cut(self.find({"head"}, set()))
        if name in ENDS_P and (at := self.find({"p"}, CELLS)) is not None:
            self.cut(at)
        if name in ENDS and (at := self.find(*ENDS[name])) is not None:
            self.cut(at)
        if name == "a" and (at := self.find({"a"}, CELLS)) is not None:
            self._count(self.stack.pop(at), -1)

    def end(self, name: str) -> None:
        """Close the innermost ``name`` and all in it; an end tag without its start does nothing."""
        if name in TABLE_PARTS:
            stops = {"table"} - {name}
        elif name in BREAKING:
            stops = CELLS
        else:
            stops = BREAKING - {"br", "hr"}  # an inline end tag closes no block
        if name not in ("body", "html") and (at := self.find({name}, stops)) is not None:
            self.cut(at)


def _own_end(source: str, at: int, name: str, depth: int) -> bool:
    """Whether an element of ``name`` that is ``depth`` deep in its like gets its end tag after ``at``."""
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>])", source[at:], re.I):
        depth += -1 if tag[1] else 1
        if not depth:
            return True
    return False


def lines_of(source: str) -> list[Line]:
    """Visible blocks of a page in order: white space is one space, references are decoded.

    Open elements form a stack, and end tags that may be left out are implied.  A skipped element
    ends where it is closed; one that never gets its end tag also where an article or the main
    part opens in it.  Script and the like run to their own end tag.  Without any article or main
    element no line is marked as article.
    """
    out: list[Line] = []
    words: list[str] = []
    linked = total = 0
    held = _Open()
    ends: dict[int, bool] = {}  # of skipped elements, by their place: whether an end tag follows
    at = 0

    def flush() -> None:
        nonlocal linked, total
        text = " ".join("".join(words).split())
        if text:
            out.append(Line(text, held.articles > 0, linked / max(total, 1)))
        words.clear()
        linked = total = 0

    def add(text: str) -> None:
        nonlocal linked, total
        if text and not held.skips:
            text = html.unescape(text)
            words.append(text)
            total += len(text)
            linked += len(text) if held.links else 0

    while match := _TAG.search(source, at):
        add(source[at:match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(match[1] or match[4]), match[3] or match[6] or ""
        if name in BREAKING and not held.skips:
            flush()
        if closing:
            held.end(name)
            continue
        held.imply(name)
        if name in RAW:
            if end := re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at):
                at = end.end()
            else:
                at = len(source)
            continue
        if name in VOID or (name in ("svg", "math") and attributes.rstrip().endswith("/")):
            continue
        marked = bool(attributes) and name not in ("html", "body") and _marked(attributes)
        article = name in ("article", "main") and not marked
        if article and held.skips:
            place = next(i for i, entry in enumerate(held.stack) if entry[1])
            kind = held.stack[place][0]
            if place not in ends:
                ends[place] = _own_end(source, at, kind, sum(entry[0] == kind for entry in held.stack[place:]))
            if not ends[place]:
                held.cut(place)
        if not held.skips:
            ends.clear()
            if marked or name in SKIPPED or (name == "header" and not held.articles):
                flush()
                held.push(name, skipped=True)
                continue
        held.push(name, article=article and not held.skips)
    add(_OPEN_END.sub("", source[at:]))
    flush()
    return out


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which entries of ``a`` lie in a longest common subsequence of ``a`` and ``b``.

    Rows of the table are bit strings; beyond 2**28 bits the problem is halved first, so
    memory stays bounded for pages of any number of lines.
    """
    out = [False] * len(a)
    jobs = [(0, len(a), 0, len(b))]
    while jobs:
        a0, a1, b0, b1 = jobs.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out[a1 - 1] = True
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > 1 << 28 and b1 - b0 > 1:
            middle = (b0 + b1) // 2
            head = _lengths(a[a0:a1], b[b0:middle])
            tail = _lengths(a[a0:a1][::-1], b[middle:b1][::-1])[::-1]
            cut = a0 + max(range(len(head)), key=lambda i: head[i] + tail[i])
            jobs += [(a0, cut, b0, middle), (cut, a1, middle, b1)]
            continue
        rows = _rows(a[a0:a1], b[b0:b1])
        i, j = a1 - a0, b1 - b0
        # a zero bit at i - 1 in row j: the length grows from i - 1 to i
        while i and j:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                out[a0 + i - 1] = True
                i, j = i - 1, j - 1
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        v = rows[-1]
        u = v & where.get(y, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Common length of every beginning of ``a`` with ``b``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for bit in reversed(bin(v | 1 << len(a))[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def main_text(page: list[Line], neighbour: list[Line] | None, common: frozenset[int] = frozenset()) -> str:
    """The page's lines that stay, joined by one space.

    ``common``: numbers of the lines that stand on many different pages of the host.
    """
    repeated = (shared([hash(x.text) for x in page], [hash(x.text) for x in neighbour])
                if neighbour else [False] * len(page))
    article = any(x.article for x in page)
    boilerplate = [r and not article and i in common for i, r in enumerate(repeated)]
    # a page that mostly repeats its neighbour in what few pages have is a copy: that is prose
    rest = [(len(x.text), r) for x, r, b in zip(page, repeated, boilerplate) if not b]
    copy = 2 * sum(n for n, r in rest if r) > sum(n for n, _ in rest)
    kept = []
    for x, again, gone in zip(page, repeated, boilerplate):
        if gone or (article and not x.article):
            continue
        if again and (x.links > 0.5 or not (article or copy)):
            continue
        kept.append(x.text)
    return " ".join(kept)


def _host_lines(rows: DataFrame, plain: bool) -> DataFrame:
    """``page, at, line, version`` of every line of every page, or of those without an article.

    ``line`` names a wording on a host, ``version`` all the page's lines.
    """
    def key(*parts: str) -> int:
        return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=8).digest(),
                              "big", signed=True)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, host, source in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(source)
                if plain and any(x.article for x in lines):
                    continue
                version = key(*[x.text for x in lines])
                out += [(page, at, key(host, x.text), version) for at, x in enumerate(lines)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["page", "at", "line", "version"])

    return rows.select("page", "host", "html").mapInArrow(run, "page bigint, at int, line bigint, version bigint")


def _joined(big: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    few = broadcast_if_small(small)
    return big.join(few, on, how) if few is not small else skew_join(big, small, [on], how)


def _with_common(rows: DataFrame) -> DataFrame:
    """``rows`` with ``common``: which lines of a page without an article many pages of its host have."""
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    none = F.array().cast("array<int>")
    with Scratch(rows.sparkSession) as keep:
        plain = keep(_host_lines(rows, True).select("page", "at", "line"))
        if not plain.limit(1).count():
            return rows.withColumn("common", none)
        many = keep(_host_lines(rows, False).select("line", "version").distinct()
                    .groupBy("line").count().where(F.col("count") > FEW_PAGES).select("line"))
        marks = cut_lineage(_joined(plain, many, "line", "inner")
                            .groupBy("page").agg(F.collect_set("at").alias("common")))
    return _joined(rows, marks, "page", "left").withColumn("common", F.coalesce("common", none))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main text and the code points of it.

    Input ``page_id, url, html``; other columns are ignored.  A null html is empty and gives an
    empty text.  A null url has an empty host and path.  Pages of equal host and path are ordered
    by page_id, then by a hash of the html; a page alone on its host has no neighbour.  Repeated
    rows are pages of their own.  A host with very many pages is spread over ordered ranges.
    On pages without an article, lines that more than FEW_PAGES different pages of the host have
    (pages of equal lines count once) go wherever the neighbour shares them; of the other shared
    lines, all go, or none but link lists if they are most of what is left.
    Empty input: no rows.
    """
    spark = ship(pages.sparkSession)
    address = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    rows = (pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
            .withColumn("host", F.lower(F.regexp_extract(address, r"^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)))
    key = F.concat_ws(" ", "host", "path")
    order = [F.col("key"), F.coalesce("page_id", F.lit((1 << 63) - 1)), F.xxhash64("html", "url")]
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal(_with_common(rows), key, order, ["page_id", "url", "html", "host", "path", "common"], ranges, before=True)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = now = None  # the page before and the page that waits for its next

        def finish(before: tuple | None, page: tuple, after: tuple | None) -> tuple:
            near = [p for p in (before, after) if p and p[0] == page[0] and p[4] == page[4]]
            near.sort(key=lambda p: -_common(p[5], page[5]))  # stable: the one before on ties
            text = main_text(page[6], near[0][6] if near else None, page[7])
            return page[2], page[3], text, len(text)

        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            out = []
            for place, own, page_id, url, source, host, path, common in zip(*(c.to_pylist() for c in batch.columns)):
                page = (place, own, page_id, url, host, path, lines_of(source), frozenset(common))
                if now and now[1]:
                    out.append(finish(last, now, page))
                last, now = now, page
            if out:
                yield pack(out)
        if now and now[1]:
            yield pack([finish(last, now, None)])

    return dealt.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
