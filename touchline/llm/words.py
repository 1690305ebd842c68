"""Words and their hashes, vectorised over a batch of texts.

Every text operator sees a batch of Arrow strings as one byte buffer.  Words,
lines and n-grams are spans of that buffer, found and hashed with numpy for the
whole buffer at once; Python loops run per text at most, never per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: \x20 and \x09-\x0D (fixed values).
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 19
_LOW = 12
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Public 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    start = (seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(start))


class Powers:
    """base**i and base**-i modulo 2**64 from two short tables (base is odd)."""

    def __init__(self, base: int, n: int):
        base |= 1
        size = 1 << _LOW
        self.lo, self.hi = self._table(base, size, n)
        self.ilo, self.ihi = self._table(pow(base, -1, 1 << 64), size, n)

    @staticmethod
    def _table(base: int, size: int, n: int):
        low = np.full(size, base, dtype=_U)
        low[0] = 1
        step = np.full((n >> _LOW) + 1, pow(base, size, 1 << 64), dtype=_U)
        step[0] = 1
        return np.multiply.accumulate(low), np.multiply.accumulate(step)

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.hi[i >> _LOW] * self.lo[i & ((1 << _LOW) - 1)]

    def inverse(self, i: np.ndarray) -> np.ndarray:
        return self.ihi[i >> _LOW] * self.ilo[i & ((1 << _LOW) - 1)]

    def scale(self, values: np.ndarray) -> None:
        """values[i] *= base**i in place, a table's length at a time."""
        size = 1 << _LOW
        for block in range(0, len(values), size):
            part = values[block:block + size]
            part *= self.lo[:len(part)] * self.hi[block >> _LOW]


def span_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each span ``values[start : next start]`` (bytes or words as
    uint64; values outside the spans are 0), mixed with its length."""
    if len(starts) == 0:
        return np.zeros(0, dtype=_U)
    powers = Powers(base, len(values))
    values = values.copy()
    powers.scale(values)
    sums = np.add.reduceat(values, starts) * powers.inverse(starts)
    return mix64(sums + mix64(lengths.astype(_U) + _U(0x9E3779B97F4A7C15)))


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, ignoring document borders."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    if width <= 8:
        out = words[:n].copy()
        for j in range(1, width):
            out *= _U(base | 1)
            out += words[j:j + n]
        return mix64(out)
    powers = Powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=_U)
    scaled = words.copy()
    powers.scale(scaled)
    np.cumsum(scaled, out=total[1:])
    return mix64((total[width:] - total[:-width]) * powers.inverse(np.arange(n)))


class Texts:
    """A run of texts: bytes, words and the borders of each text.

    ``row0``: index of the first text in its batch; ``text_at``: byte offsets of
    the texts; ``starts``/``ends``: byte spans of the words; ``word_at``: offsets
    of the texts in the word arrays.
    """

    def __init__(self, row0: int, data: np.ndarray, text_at: np.ndarray, lower: bool = False):
        self.row0, self.text_at, self.n = row0, text_at, len(text_at) - 1
        self.data = LOWER[data] if lower else data
        space = IS_SPACE[self.data]
        before = np.empty(len(data), dtype=bool)
        before[1:] = space[:-1]
        first = text_at[:-1][text_at[:-1] < text_at[1:]]
        before[first] = True
        self.starts = np.flatnonzero(~space & before)
        after = np.empty(len(data), dtype=bool)
        after[:-1] = space[1:]
        after[text_at[1:][text_at[:-1] < text_at[1:]] - 1] = True
        self.ends = np.flatnonzero(~space & after) + 1
        self.space = space
        self.word_at = np.searchsorted(self.starts, text_at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        values = BYTE_VALUES[self.data]
        values[self.space] = 0
        return span_hashes(values, self.starts, self.ends - self.starts, BASE)

    def windows(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every window of ``width`` words inside one text."""
        hashes = window_hashes(words, width, WORD_BASE)
        end = np.repeat(self.word_at[1:], self.n_words)
        at = np.flatnonzero(np.arange(len(hashes)) + width <= end[:len(hashes)])
        return at, hashes[at]


def _tables():
    space = np.zeros(256, dtype=bool)
    space[list(SPACE)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower, seeded(11, 256)


IS_SPACE, LOWER, BYTE_VALUES = _tables()
BASE, WORD_BASE = 0x2545F4914F6CDD1D, 0xD1342543DE82EF95


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of an Arrow string column (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def runs(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a column into runs of whole texts of about ``limit`` bytes; a longer
    text is a run of its own, so memory follows the longest text."""
    raw, offsets = byte_view(column)
    row = 0
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = max(row + 1, min(stop, len(offsets) - 1))
        part = offsets[row:stop + 1]
        yield Texts(row, raw[part[0]:part[-1]], part - part[0], lower)
        row = stop
