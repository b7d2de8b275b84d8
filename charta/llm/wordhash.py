"""Vectorised 64-bit fingerprints of words and word shingles.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. A word's fingerprint is a
polynomial over random 64-bit byte codes, taken for all words of a chunk at once from one running
sum, then mixed. Equal words have equal fingerprints on every executor; the chance that two given
different words collide is about 2**-56.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK, _PIECE = 2 << 20, 1 << 18


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[65:91] = codes[97:123]
    return codes


_CODES = _byte_codes()
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


class _Powers:
    """base**0, base**1, ... modulo 2**64, grown when a longer chunk comes."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        table = self.table
        while len(table) < n:
            table = np.concatenate([table, table * np.uint64(pow(self.base, len(table), 1 << 64))])
        if n <= 2 * _PIECE:  # what a single long word needs is not kept
            self.table = table
        return table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the place where each text begins, with the end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of whole texts of about 2 MB; a longer text comes alone, whole."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def settle() -> None:
    """Give memory that is free back to the system; workers are reused by other stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def portions(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of whole rows of about ``most`` bytes in its column ``at``, so that what is made of it stays small; what was free after each run is given back."""
    column = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    sums = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        done = int(sums[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(sums, done + most, "right")))
        yield batch.slice(row, end - row)
        row = end
        settle()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (with the end)."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint for each word; made in pieces of about _PIECE bytes that end with a word, so that what is made of a byte stays small."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, a + _PIECE, "right")))
        n = int(ends[end - 1]) - a
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data[a : a + n]] * _UP.upto(n), out=sums[1:])
        out[at:end] = mix((sums[ends[at:end] - a] - sums[starts[at:end] - a]) * _DOWN.upto(n)[starts[at:end] - a])
        at = end
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One fingerprint for each window of ``k`` words; windows that span two texts are the caller's to skip."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = words[:n]
    for i in range(1, k):
        h = h * _STEP + words[i : n + i]
    return mix(h)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle fingerprints) of every text.

    A text of fewer than ``k`` words has its whole word sequence as its one shingle; a text without
    words has none.
    """
    for row, data, offsets in chunks(column):
        starts, ends, before = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = shingle_hashes(words, k)
        for i in range(len(offsets) - 1):
            a, z = int(before[i]), int(before[i + 1])
            if z - a >= k:
                yield row + i, np.unique(grams[a : z - k + 1])
            elif z > a:
                yield row + i, shingle_hashes(np.append(words[a:z], np.uint64(z - a)), z - a + 1)
            else:
                yield row + i, np.zeros(0, np.uint64)
