"""Word splitting and hashing of Arrow text batches with numpy; shared by the operators of this package.

A word is a maximal run of bytes other than space and 0x09-0x0D. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are hashed at a time; a single longer text is a block of its own
BLOCK_BYTES = 4 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return raw, np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `size` bytes of text."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a run of rows: byte bounds, and for each row the slice first[i]:first[i + 1] of them."""

    row: int
    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        raw = LOWER[self.raw] if lower else self.raw
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[raw] * _power(_P, n), out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * _power(_P_INVERSE, n + 1)[self.starts]
        return mix64(own + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(raw: np.ndarray, offsets: np.ndarray, row: int = 0, space: np.ndarray = SPACE) -> Words:
    n = len(raw)
    dark = ~space[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = dark[:-1]
        after[:-1] = dark[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(dark & ~before)
    ends = np.flatnonzero(dark & ~after) + 1
    return Words(row, raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_runs(column: pa.Array) -> Iterator[Words]:
    for lo, _, raw, offsets in text_blocks(column):
        yield words_of(raw, offsets, lo)


def window_hashes(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of hashes[i:i + k] for each i; len(hashes) - k + 1 of them, none if that is negative."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = mix64(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(1000003 * (salt + 1))) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * weights[j]
    return mix64(total)


def starts_in_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, among all words of a run, where a window of k words of one row begins, and their rows."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][rows] + inner, rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] : starts[i] + lengths[i]."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def distinct_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, their index for each word in turn, and the n+1 offsets of the rows.

    Empty strings may be among the words, where a text begins or ends with white space.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]
