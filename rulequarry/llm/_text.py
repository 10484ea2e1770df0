"""Whole-batch text handling on Arrow buffers: words, hashes and windows as numpy arrays.

Words are maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, that is
`[^\\x20\\x09-\\x0D]+`; no byte of a multi-byte UTF-8 character falls in that set, so bytes and
characters give the same words. Hashes are 64-bit; arithmetic wraps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACE)] = False
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = BYTE.copy()
FOLD[65:91] = BYTE[97:123]
STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second table, so that two hashes of a word have nothing in common.
OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end (null: none), and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21):
    """Runs of rows of up to `limit` bytes; a longer row makes a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Words of rows first..last of a batch: byte starts and ends, and the first word of each row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int, last: int):
        base = offsets[first]
        self.raw = raw[base : offsets[last]]
        self.row_at = offsets[first : last + 1] - base
        is_word = IS_WORD[self.raw]
        starts, n = is_word.copy(), len(is_word)
        if n:
            starts[1:] &= ~is_word[:-1]
            at = self.row_at[:-1][self.row_at[:-1] < n]
            starts[at] = is_word[at]
            ends = is_word.copy()
            ends[:-1] &= ~is_word[1:]
            before = at[at > 0] - 1
            ends[before] = is_word[before]
            self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.row_at)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, table: np.ndarray = BYTE) -> np.ndarray:
        """A hash of each word's bytes, through `table`."""
        starts, ends = self.starts, self.ends
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
            at, length = starts[i], int(ends[j - 1] - starts[i])
            up, down = powers(length + 1)
            sums = np.zeros(length + 1, np.uint64)
            np.cumsum(table[self.raw[at : at + length]] * up[:length], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * STEP[63]
            i = j
        return mix(out)

    def windows(self, k: int) -> np.ndarray:
        """Of each word: whether a window of k words of its row starts there."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))
        return left >= k


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words (of len(words) - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * STEP[0]
    for j in range(1, k):
        out += words[j : j + n] * STEP[j]
    return mix(out)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours (of len(x) - k + 1), by doubling."""
    width, out = 1, x
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (k - width)], out[k - width :]) if width < k else out
