"""Words of letters (and digits) in blocks of whole texts, their bytes and their checksums."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from libsight.llm.words import LOWER, Block

#: Runs longer than this are checked one by one, shorter ones a byte position at a time.
LONG_RUN = 64


def _fold(kept: bytes) -> np.ndarray:
    """Bytes as a word shows them: A-Z lower-cased, all but ``kept`` and 0x80-0xFF a space."""
    table = np.full(256, 0x20, dtype=np.uint8)
    inside = np.array([*kept, *range(0x80, 0x100)])
    table[inside] = LOWER[inside]
    return table


_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])


class AlphaBlock(Block):
    """Words of letters A-Z and characters from U+0080, lower-cased in A-Z."""

    fold = _fold(_LETTERS)

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray):
        super().__init__(row, self.fold[data], offsets)

    def terms(self) -> pa.LargeStringArray:
        """All words of the block, in order."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.starts] += 1
        np.add.at(inside, self.ends, -1)
        kept = self.data[np.cumsum(inside[:-1]) > 0] if len(self.data) else self.data
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(
            np.ascontiguousarray(kept)))


class AlnumBlock(AlphaBlock):
    """Words of digits, letters A-Z and characters from U+0080, lower-cased in A-Z."""

    fold = _fold(_LETTERS + bytes(range(0x30, 0x3A)))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ values) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _extend(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes ``starts:ends`` of each run."""
    lengths = ends - starts
    short = np.minimum(lengths, LONG_RUN + 1).astype(np.int16)
    order = np.argsort(short, kind="stable")[::-1]
    out, at, sizes = state[order], starts[order], short[order]
    n_long = int(np.searchsorted(-sizes, -LONG_RUN, side="left"))  # sizes fall
    for i in range(n_long):
        run = data[at[i]:at[i] + lengths[order[i]]].tobytes()
        out[i] = np.uint32(zlib.crc32(run, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
    lo, rest = out[n_long:], at[n_long:]
    active = len(lo) - np.searchsorted(sizes[n_long:][::-1], np.arange(LONG_RUN + 1), side="right")
    for j, n in enumerate(active.tolist()):
        if not n:
            break
        lo[:n] = _step(lo[:n], data[rest[:n] + j])
    result = np.empty_like(out)
    result[order] = out
    return result


def run_checksums(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``width`` words joined by a space; text numbers of the runs."""
    sums, owners = [], []
    text = np.repeat(np.arange(len(block)), block.counts)
    last = block.first[text + 1] if len(text) else np.zeros(0, np.int64)
    word = np.arange(len(text))
    state = np.full(len(text), 0xFFFFFFFF, dtype=np.uint32)
    for w in range(width):
        if w:
            fits = word + w < last
            word, last, text, state = word[fits], last[fits], text[fits], _step(
                state[fits], np.uint32(0x20))
        state = _extend(state, block.data, block.starts[word + w], block.ends[word + w])
        sums.append(state ^ np.uint32(0xFFFFFFFF))
        owners.append(text)
    return np.concatenate(sums), np.concatenate(owners)
