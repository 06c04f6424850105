"""Words and word hashes of whole Arrow text columns, vectorised over bytes.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. UTF-8 keeps those bytes
for those characters alone, so the split needs no decoding. A word's 64-bit
hash is a polynomial over random byte values modulo 2**64, finished by a
mixer; two different words share one with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            out.append(np.cumprod(t))
        _powers[:] = out
    return _powers


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a batch: their bytes, and their words."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # of each row's bytes, relative to data
    starts: np.ndarray  # of each word
    ends: np.ndarray
    word_ptr: np.ndarray  # row r has words word_ptr[r] to word_ptr[r + 1]

    def hashes(self, fold: bool) -> np.ndarray:
        """Each word's hash; ``fold`` counts A-Z as a-z."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, dtype=np.uint64)
        power, inverse = _tables(n + 1)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _VALUE)[self.data] * power[:n], out=run[1:])
        return mix((run[self.ends] - run[self.starts]) * inverse[self.starts])

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.word_ptr))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of whole rows of about ``most`` bytes; a longer row is a chunk of its own."""
    raw, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        data = raw[offsets[first] : offsets[last]]
        ptr = offsets[first : last + 1] - offsets[first]
        word = ~_SEPARATOR[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:], after[:-1] = word[:-1], word[1:]
            edge = ptr[:-1][ptr[:-1] < len(data)]
            before[edge] = False
            after[edge[edge > 0] - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        yield Chunk(first, last, data, ptr, starts, ends, np.searchsorted(starts, ptr))
        first = last


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run ``ptr[r]:ptr[r + 1]``, in the values' own type."""
    run = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=run[1:])
    return run[ptr[1:]] - run[ptr[:-1]]
