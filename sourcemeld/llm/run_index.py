"""A run-length index over many short strings.

The Burrows-Wheeler transform of repetitive strings has few runs of equal letters. The index keeps
the runs, the text places at the first and last row of each run, and the rows where a block of
suffixes with the same first ``length`` bytes begins, with the smallest label in each block. Any
patterns can then be streamed from right to left for their matching statistics: at each position
the longest match with an indexed string, and a row where it is.
"""

from __future__ import annotations

import numpy as np

#: Longest string the suffix order compares, its end mark included.
MAX_STRING = 127


def _dense_ranks(keys: np.ndarray) -> np.ndarray:
    """1, 2, ... in the order of the keys; equal keys share a rank."""
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.empty(len(keys), np.uint64)
    steps[0] = 1
    steps[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(steps)
    return ranks


class RunIndex:
    """Index of strings given as one buffer and their lengths; no string may hold byte 255."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, length: int = 50) -> None:
        if len(lengths) and lengths.max() > MAX_STRING:
            raise ValueError(f"a string is longer than {MAX_STRING} bytes")
        if not 32 <= length <= 64:
            raise ValueError("length must be between 32 and 64 bytes")
        n, count = len(data) + len(lengths), len(lengths)
        owner = np.repeat(np.arange(count), lengths + 1)
        marks = np.cumsum(lengths + 1) - 1
        text = np.zeros(n + MAX_STRING + 1, np.uint8)  # 0 ends a string, other bytes are one higher
        inside = np.ones(n, bool)
        inside[marks] = False
        text[:n][inside] = data + 1
        left = marks[owner] - np.arange(n)  # bytes up to the end mark
        order, first32 = self._suffix_order(text, left)

        self.text, self.length = text, length
        letters = text[order - 1]  # the letter before each suffix; place -1 is padding
        starts = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1]))) if n else np.zeros(0, np.int64)
        self.run_start, self.run_letter = starts, letters[starts].astype(np.int64)
        sizes = np.diff(np.append(starts, n))
        self.run_last = starts + sizes - 1
        self.first_place, self.last_place = order[self.run_start], order[self.run_last]
        by_letter = np.argsort(self.run_letter, kind="stable")
        begins = np.searchsorted(np.sort(text[:n]), np.arange(256))  # row of the first suffix with each letter
        before = np.cumsum(sizes[by_letter]) - sizes[by_letter]
        first_of_letter = np.searchsorted(self.run_letter[by_letter], np.arange(256))
        base = np.append(before, 0)[np.minimum(first_of_letter, len(before))]
        self.run_target = np.empty(len(starts), np.int64)
        group = self.run_letter[by_letter]
        self.run_target[by_letter] = begins[group] + before - base[group]
        self.letter_runs = group * len(starts) + by_letter  # runs of each letter, in row order

        same = np.zeros(n, bool)
        if n:
            a, b = order[1:], order[:-1]
            shift = length - 32
            padded = np.concatenate((first32, np.zeros(MAX_STRING, first32.dtype)))
            same[1:] = (left[a] >= length) & (left[b] >= length) & (first32[a] == first32[b]) & (padded[a + shift] == padded[b + shift])
        self.block_start = np.flatnonzero(~same)
        self.block_label = np.minimum.reduceat(labels[owner[order]], self.block_start) if n else labels[:0]

    @staticmethod
    def _suffix_order(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, each up to its end mark, and dense ranks by the first 32 bytes."""
        n = len(left)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | np.where(left > j, text[j : j + n], 0).astype(np.uint64)
        ranks = _dense_ranks(key)
        first32 = ranks
        for width in (8, 16, 32, 64):
            later = np.zeros(n, np.uint64)
            reach = np.flatnonzero(left >= width)
            later[reach] = ranks[reach + width]
            ranks = _dense_ranks(ranks << np.uint64(32) | later)
            if width == 16:
                first32 = ranks
        placed = np.sort(ranks << np.uint64(32) | np.arange(n, dtype=np.uint64))  # equal suffixes by place
        return (placed & np.uint64(0xFFFFFFFF)).astype(np.int64), first32

    def _agree(self, places: np.ndarray, pattern: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes, ``most`` at the most, on which the text at ``places`` and the pattern at ``at`` agree."""
        agreed = np.zeros(len(places), np.int64)
        going = np.flatnonzero(most > 0)
        while len(going):
            k = agreed[going]
            equal = self.text[places[going] + k] == pattern[at[going] + k]
            going = going[equal]
            agreed[going] += 1
            going = going[agreed[going] < most[going]]
        return agreed

    def matching_statistics(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, row) of the longest match that begins at each byte of the patterns.

        All patterns move left together. Where the letter of the row's run is not the pattern's, the
        match goes on from the nearest run of that letter above or below, whichever agrees further.
        """
        pattern = data + 1
        found, rows = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        if not len(self.run_start):
            return found, rows
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)[order]
        row, size = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        runs = len(self.run_start)
        alive = np.searchsorted(-lengths[order], -np.arange(lengths.max() if len(lengths) else 0))
        for step, n in enumerate(alive):
            at = ends[:n] - 1 - step
            letter = pattern[at].astype(np.int64)
            run = np.searchsorted(self.run_start, row[:n], side="right") - 1
            off = np.flatnonzero(self.run_letter[run] != letter)
            if len(off):
                here = np.searchsorted(self.letter_runs, letter[off] * runs + run[off])
                above, below = np.maximum(here - 1, 0), np.minimum(here, runs - 1)
                up, down = self.letter_runs[above], self.letter_runs[below]
                up_ok = (here > 0) & (up // runs == letter[off])
                down_ok = (here < runs) & (down // runs == letter[off])
                up, down = up % runs, down % runs
                begin = np.minimum(at[off] + 1, len(pattern) - 1)
                most = size[off]
                up_size = np.where(up_ok, self._agree(self.last_place[up], pattern, begin, np.where(up_ok, most, 0)), -1)
                down_size = np.where(down_ok, self._agree(self.first_place[down], pattern, begin, np.where(down_ok, most, 0)), -1)
                take_up = up_size >= down_size
                run[off] = np.where(take_up, up, down)
                row[off] = np.where(take_up, self.run_last[up], self.run_start[down])
                size[off] = np.maximum(up_size, down_size)  # -1: no string has the letter
            lost = size[:n] < 0
            row[:n] = np.where(lost, 0, self.run_target[run] + row[:n] - self.run_start[run])
            size[:n] += 1
            found[at], rows[at] = size[:n], row[:n]
        return found, rows

    def smallest_label(self, rows: np.ndarray) -> np.ndarray:
        """Smallest label of the strings that share the first ``length`` bytes of the suffix in each row."""
        return self.block_label[np.searchsorted(self.block_start, rows, side="right") - 1]
