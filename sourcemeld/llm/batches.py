"""Arrow batches as flat byte buffers: the numpy side of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text handled at once inside a task, so that memory does not follow the size of a batch.
SLICE_BYTES = 8 << 20
#: The same for work that keeps several 8-byte numbers for each byte of text.
HASH_SLICE = 1 << 20

#: Base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        sizes = byte_lengths(batch.column(column))
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start:])
            rows = max(1, int(np.searchsorted(total, limit, side="right")))
            yield batch.slice(start, rows)
            start += rows


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets with one more entry than texts); null is empty."""
    lengths = byte_lengths(column)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = b"".join(v.as_buffer() for v in column if v.is_valid and len(v.as_buffer()))
    return np.frombuffer(data, np.uint8), offsets


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (the one of the SplitMix64 generator)."""
    z = values >> np.uint64(30)
    z ^= values
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


class SpanHash:
    """64-bit hashes of any spans of a buffer, from one running sum.

    The sum adds byte * BASE**position; a span's share, divided by BASE**start, depends on its
    bytes alone.
    """

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = data
        self.sums[1:] += np.uint64(1)
        self.sums[1:] *= _powers(BASE, n)
        np.cumsum(self.sums, out=self.sums)
        self.down = _powers(BASE_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes, by its start."""
        if len(self.sums) <= width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the usual slices."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            np.multiply(known[:step], np.uint64(pow(base, done, 1 << 64)), out=known[done : done + step])
            done += step
        if n <= HASH_SLICE + 1:
            _POWERS[base] = known
    return known[:n]


#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every run of bytes other than white space, within each text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]
