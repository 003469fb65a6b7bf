"""Words of Arrow text columns as numpy arrays: places, counts and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; one longer text is looked at alone.  A piece's arrays take some hundred times as much memory.
PIECE_BYTES = 1 << 19

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes between ASCII white space.
BETWEEN_SPACES = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: ASCII letters and digits, and every byte of other characters.
ALPHANUMERIC = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
)

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, PIECE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        powers, inverse = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > PIECE_BYTES + 1:
            return powers, inverse  # a very long text: not kept
        _powers, _inverse_powers = powers, inverse
    return _powers[:n], _inverse_powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some consecutive rows: `data[start[k]:end[k]]` (lower case A-Z) are the bytes of word k; row r has words first[r] to first[r+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task; never 0."""
        powers, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * inverse[self.start]
        out = mixed(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[out == 0] = 1
        return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    place = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[place[0] : place[-1]] if data is not None else np.zeros(0, np.uint8)
    return place - place[0], body


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `size` bytes each, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(stop, n)
        row = min(stop, n)


def words(offsets: np.ndarray, body: np.ndarray, kind: np.ndarray) -> Words:
    """Words of the rows that `offsets` cut from `body`; `kind` says which bytes are word bytes."""
    offsets = offsets - offsets[0]
    inside = kind[body]
    n = len(body)
    begins = np.zeros(n + 1, bool)
    begins[:n] = inside
    begins[1:n] &= ~inside[: n - 1] if n > 1 else True
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside
    stops[1:n] &= ~inside[1:] if n > 1 else True
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    edges = offsets[1:][np.diff(offsets) > 0]
    stops[edges] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(LOWER[body], start, end, np.searchsorted(start, offsets))


def give_back_memory() -> None:
    """Freed memory goes back to the system: Spark keeps a worker with all it holds for the next task, also while only the JVM works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def word_pieces(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for one Arrow column, piece by piece."""
    offsets, body = text_buffers(column)
    for low, high in pieces(offsets):
        cut = offsets[low : high + 1]
        yield low, high, words(cut, body[cut[0] : cut[-1]], kind)
    give_back_memory()
