"""64-bit hashes of words, lines and shingles of Arrow text columns, without a Python loop over words.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a line ends at ``\\n``.
Texts are taken in slices of about a million bytes, so memory does not follow
the batch; one longer text makes a slice of its own. Null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_BYTE_CODE = np.random.default_rng(20240101).integers(1, 2**64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_WORD_CODE = _BYTE_CODE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_BASE), row(_BASE_INVERSE)


def _power_size(size: int) -> int:
    return 1 << max(20, int(size).bit_length())


@dataclass
class Units:
    """Words or lines of a slice of texts; unit i covers bytes start[i]:end[i] of the slice."""

    first: int  # row of the slice's first text in its batch
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # units of text k are bounds[k]:bounds[k + 1]
    text_start: np.ndarray  # byte where text k starts in the slice, one more entry at the end
    data: np.ndarray
    total: np.ndarray  # running polynomial of the slice's bytes

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes of each unit."""
        end = np.minimum(self.end, self.start + size)
        return mix((self.total[end] - self.total[self.start]) * _powers(_power_size(len(self.data)))[1][self.start])

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def _units(column: pa.Array, inside: np.ndarray, code: np.ndarray) -> Iterator[Units]:
    data, offsets = _buffers(column)
    for lo, hi in _slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        held = inside[part]
        before, after = np.empty_like(held), np.empty_like(held)
        if len(part):
            before[0], before[1:] = False, held[:-1]
            after[-1], after[:-1] = False, held[1:]
            edges = at[1:-1]
            before[edges[edges < len(part)]] = False
            after[edges[edges > 0] - 1] = False
        start = np.flatnonzero(held & ~before)
        end = np.flatnonzero(held & ~after) + 1
        power, inverse = _powers(_power_size(len(part)))
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(code[part] * power[: len(part)], out=total[1:])
        hashes = mix((total[end] - total[start]) * inverse[start])
        yield Units(lo, hashes, start, end, np.searchsorted(start, at), at, part, total)


def words(column: pa.Array) -> Iterator[Units]:
    return _units(column, _WORD, _WORD_CODE)


def tokens(column: pa.Array) -> Iterator[Units]:
    """Runs of letters, digits and characters beyond ASCII, in lower case: words without their punctuation."""
    return _units(column, _TOKEN, _WORD_CODE)


def lines(column: pa.Array) -> Iterator[Units]:
    """Lines that hold at least one byte; empty lines are no unit."""
    return _units(column, _LINE, _BYTE_CODE)


def grams(units: Units, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n units from each unit on, and whether they all lie in its text."""
    h = units.hashes
    out, whole = np.zeros(len(h), dtype=_U), np.zeros(len(h), dtype=bool)
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, dtype=_U)
        for k in range(n):
            rolled = rolled * _U(_BASE) + h[k : len(h) - n + 1 + k]
        out[: len(rolled)] = mix(rolled + _U(n))
        last = np.repeat(units.bounds[1:], np.diff(units.bounds))
        whole = np.arange(len(h)) + n <= last
    return out, whole


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text with fewer than n words has one shingle, its whole sequence; one without words has none.
    """
    for units in words(column):
        rolled, whole = grams(units, n)
        for k in range(len(units)):
            lo, hi = units.bounds[k], units.bounds[k + 1]
            if hi - lo >= n:
                yield np.unique(rolled[lo : hi - n + 1])
            elif hi > lo:
                short = _U(hi - lo)
                for h in units.hashes[lo:hi]:
                    short = _U((int(short) * _BASE + int(h)) % 2**64)
                yield mix(np.array([short], dtype=_U))
            else:
                yield np.zeros(0, dtype=_U)
