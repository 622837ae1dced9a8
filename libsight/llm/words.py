"""Words of whole texts and their hashes, as numpy arrays inside tasks.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never occur inside a
UTF-8 sequence, so cutting bytes equals cutting characters.  A text is hashed as a
polynomial over 64-bit numbers, with prefix sums, so that the hash of any run of words
costs two lookups.  All functions work on blocks of bounded size: one block holds many
short texts or a single long one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64),
                                np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
                for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_bytes_powers, _words_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def prefix(values: np.ndarray, powers: _Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers.upto(len(values))[0], out=out[1:])
    return out


class Block:
    """Words of some consecutive texts.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``starts`` and ``ends`` are
    byte positions in ``data``; ``hashes`` are 64-bit word hashes.
    """

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray):
        self.row, self.data, self.offsets = row, data, offsets
        inside = ~SPACE[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            starts[1:] &= ~inside[:-1]
            starts[cuts] = inside[cuts]
            ends[:-1] &= ~inside[1:]
            ends[cuts - 1] = inside[cuts - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hashes = self._sums = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            sums = prefix(_BYTE_VALUES[self.data], _bytes_powers)
            down = _bytes_powers.upto(len(self.data) + 1)[1]
            raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
            self._hashes = mix(raw + (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    def run_hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word runs ``begin:end`` (positions in this block)."""
        if self._sums is None:
            self._sums = prefix(self.hashes, _words_powers)
        down = _words_powers.upto(len(self.hashes) + 1)[1]
        raw = (self._sums[end] - self._sums[begin]) * down[begin]
        return mix(raw + (end - begin).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of ``size`` words inside one text, and text numbers."""
        n = np.maximum(self.counts - size + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[text]
        return start, text


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, lower: bool = False, kind: type = Block,
           limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks, in order, that together hold every text."""
    data, offsets = buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        part = data[offsets[at]:offsets[to]]
        yield kind(at, LOWER[part] if lower else part, offsets[at:to + 1] - offsets[at])
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
