"""Vectorised helpers over Arrow string columns: byte buffers, words and hashes.

They are used inside ``mapInArrow`` tasks.  A task's batches are cut into
slices of bounded byte size, so memory does not grow with the batch; a single
text longer than the bound makes a slice of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
# The white space that separates words, as bytes.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: words longer than this are hashed one by one with blake2b, since a
#: polynomial modulo 2**64 has known collisions on very long inputs
LONG_WORD = 256


def slices(batches, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice's texts stay under ``max_bytes``
    (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back and the n+1 offsets of the texts
    (a null text is empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses a text's border."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, _U)
    terms = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_CODES[data] * _powers(_BASE, len(data)), out=terms[1:])
    inverse = _powers(_BASE_INV, len(data) + 1)
    length = (ends - starts).astype(_U)
    out = mix((terms[ends] - terms[starts]) * inverse[starts] + length * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row and the rows they
    belong to; a row with fewer words has one shingle made of all of them."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    acc = np.zeros(max(len(words) - size + 1, 0), _U)
    for j in range(size):
        acc = mix(acc + words[j:j + len(acc)] + _U(j + 1))
    ok = rows[:len(acc)] == rows[size - 1:size - 1 + len(acc)] if len(acc) else np.empty(0, bool)
    found, owners = acc[ok], rows[:len(acc)][ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    few = np.empty(len(short), _U)
    for i, r in enumerate(short):
        h = np.full(1, _U(0x5851F42D4C957F2D) + _U(counts[r]))
        for w in words[first[r]:first[r] + counts[r]]:
            h = mix(h + w)
        few[i] = h[0]
    return np.concatenate([found, few]), np.concatenate([owners, short])
