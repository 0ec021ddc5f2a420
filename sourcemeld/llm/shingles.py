"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sourcemeld.llm.batches import SpanHash, flat_bytes, lowered, mix, word_spans


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, its text's index) over all texts of a column."""
    data, offsets = flat_bytes(column)
    data = lowered(data)
    starts, ends, rows = word_spans(data, offsets)
    return SpanHash(data).of(starts, ends), rows


def shingle_sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text in ascending order.

    A text of fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    hashes, rows = word_hashes(column)
    count = len(column)
    sizes = np.bincount(rows, minlength=count)
    firsts = np.cumsum(sizes) - sizes
    n = len(hashes)
    full = np.zeros(0, np.uint64)
    full_rows = np.zeros(0, np.int64)
    if n >= words:
        whole = rows[words - 1 :] == rows[: n - words + 1]
        full = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            full = mix(full + hashes[k : n - words + 1 + k] * np.uint64(2 * k + 3))
        full, full_rows = full[whole], rows[: n - words + 1][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    own = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        more = sizes[short] > k
        own[more] = mix(own[more] + hashes[firsts[short[more]] + k] * np.uint64(2 * k + 3))
    own = mix(own + sizes[short].astype(np.uint64))  # a short sequence is no prefix of a shingle
    rows = np.concatenate((full_rows, short))
    hashes = np.concatenate((full, own))
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.searchsorted(rows, np.arange(count + 1))


def multipliers(count: int, seed: int = 1) -> np.ndarray:
    """Odd 64-bit factors: factor * hash modulo 2**64 orders the shingles anew for each coordinate."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest product of each non-empty set under each factor: one row of coordinates per set; empty sets are 0."""
    out = np.zeros((len(offsets) - 1, len(factors)), np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    starts = offsets[:-1][filled]
    step = 1 << 20
    at = 0
    while at < len(filled):  # blocks of sets, so that products stay small
        to = max(at + 1, int(np.searchsorted(offsets[1:][filled], starts[at] + step, side="right")))
        block = hashes[starts[at] : offsets[1:][filled[to - 1]]]
        local = starts[at:to] - starts[at]
        for k, factor in enumerate(factors):
            out[filled[at:to], k] = np.minimum.reduceat(block * factor, local)
        at = to
    return out
