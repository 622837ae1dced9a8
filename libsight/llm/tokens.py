"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary file's own steps (special strings, NFC, white space, lower case, pattern
split, bytes, pair merges) are applied to whole texts.  The distinct pre-tokens of a
batch lie in one flat array; each round finds every sequence's lowest-rank pair and
merges all its places at once, until no sequence has a pair left.  The surviving symbols
are the tokens.  Merge order equals one-by-one merging because every symbol is made by a
single merge, so a merge never uncovers a lower rank.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from libsight.session import ship

#: Pre-tokens whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

#: Unicode White_Space, and the order of the 256 byte letters of byte-level vocabularies.
_SPACES = r"[\t-\r \x85\xa0  -     　]"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _letters() -> list[str]:
    """The letter of each byte: printable ones stand for themselves, the rest follow U+0100."""
    others = [b for b in range(256) if b not in _PRINTABLE]
    return [chr(b) if b in _PRINTABLE else chr(256 + others.index(b)) for b in range(256)]


class MergeTable:
    """A byte-level pair vocabulary with word ends, as arrays.  Plain data, small, picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError(f"{path}: only lower-casing vocabularies with word ends are read")
        self.pattern = split["pattern"]["Regex"]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty byte string."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        out = lengths.copy()
        seq = np.repeat(np.arange(len(pieces)), lengths)
        none = len(self.keys)
        while len(ids):
            keys = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), none - 1)
            hit = (self.keys[at] == keys) & (seq[:-1] == seq[1:])
            rank = np.full(len(ids), none, dtype=np.int64)
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == none
            out[seq[starts[over]]] = sizes[over]
            wanted = np.repeat(lowest, sizes)
            merge = (rank == wanted) & (wanted < none)
            # of overlapping places (aaa), every second one counts, from the left
            place = np.flatnonzero(merge)
            if len(place):
                run = np.r_[True, np.diff(place) > 1]
                begin = place[run][np.cumsum(run) - 1]
                place = place[(place - begin) % 2 == 0]
                ids[place] = self.made[rank[place]]
            keep = np.repeat(~over, sizes)
            keep[place + 1] = False
            ids, seq = ids[keep], seq[keep]
        return out


class Counter:
    """Counts tokens of texts; remembers pre-tokens it has met."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.split = regex.compile(table.pattern)
        self.space = regex.compile(f"{_SPACES}+")
        self.special = (regex.compile("|".join(map(regex.escape, table.special)))
                        if table.special else None)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = self.space.sub(" ", text)
        # letter by letter: no special form of sigma at word ends
        return self.split.findall(text.replace("Σ", "σ").lower())

    def counts(self, texts: list[str | None]) -> list[int]:
        words, extra = [], []
        for text in texts:
            text = text or ""
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                extra.append(len(parts) - 1)
                words.append([w for part in parts for w in self._words(part)])
            else:
                extra.append(0)
                words.append(self._words(text))
        new = set().union(*words).difference(self.known) if words else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*words)
        if new:
            listed = list(new)
            self.known.update(zip(listed, self.table.counts(
                [w.encode("utf-8", "surrogatepass") for w in listed]).tolist()))
        get = self.known.__getitem__
        return [e + sum(map(get, w)) for e, w in zip(extra, words)]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 2048) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``path`` names a vocabulary file the driver can read; its arrays travel with the tasks
    (about 1 MB).  A null text counts as empty: 0 bytes, 0 tokens.  Rows are handled one by
    one, so ties, repeated rows and empty tables need no rule; other columns are dropped and
    a kept column may not be named like an added one.  No shuffle.
    """
    ship(df.sparkSession)
    table = MergeTable(path)
    keep = tuple(c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit"))
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    schema = ", ".join(filter(None, [schema, "n_bytes bigint, n_tokens bigint, over_limit boolean"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_tokens: list[int] = []
            for at in range(0, len(texts), 256):  # bounds the lists of words
                n_tokens += counter.counts(texts.slice(at, 256).to_pylist())
            tokens = pa.array(n_tokens, pa.int64())
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], n_bytes, tokens, pa.compute.greater(tokens, limit)],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, schema)
