"""Vectorised string kernels that run inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

CELLS = 4_000_000


def _codes(texts: list[str], width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(texts), 0), dtype=np.uint32)
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def lcs_lengths(left, right) -> np.ndarray:
    """Longest-common-subsequence length of each pair of texts.

    One row of the dynamic programme per character of the shorter side, for all pairs of a
    chunk at once; the running maximum replaces the inner loop.
    """
    left, right = list(left), list(right)
    out = np.zeros(len(left), dtype=np.int32)
    size_l = np.fromiter((len(s) for s in left), dtype=np.int64, count=len(left))
    size_r = np.fromiter((len(s) for s in right), dtype=np.int64, count=len(right))
    order = np.argsort(size_l * 4096 + size_r, kind="stable")
    start = 0
    while start < len(order):
        # A chunk holds pairs of like length, so little of the work is padding.
        stop = start + 1
        widest = max(1, size_r[order[start]])
        while stop < len(order):
            widest = max(widest, size_r[order[stop]])
            if (stop + 1 - start) * widest > CELLS or stop - start >= 8192:
                break
            stop += 1
        rows = order[start:stop]
        a = _codes([left[i] for i in rows], int(size_l[rows].max(initial=0)))
        b = _codes([right[i] for i in rows], int(size_r[rows].max(initial=0)))
        best = np.zeros((len(rows), b.shape[1] + 1), dtype=np.int32)
        in_b = np.arange(b.shape[1])[None, :] < size_r[rows][:, None]
        for i in range(a.shape[1]):
            hit = (b == a[:, i : i + 1]) & in_b & (i < size_l[rows])[:, None]
            best[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + hit)
            np.maximum.accumulate(best, axis=1, out=best)
        out[rows] = best[:, -1] if b.shape[1] else 0
        start = stop
    return out


def ratios(left, right) -> np.ndarray:
    """2 * LCS / (len + len) of each pair; two empty texts count as equal."""
    left, right = list(left), list(right)
    total = np.fromiter((len(a) + len(b) for a, b in zip(left, right)), dtype=np.float64, count=len(left))
    same = np.fromiter((a == b for a, b in zip(left, right)), dtype=bool, count=len(left))
    out = np.ones(len(left))
    todo = np.flatnonzero(~same)
    if len(todo):
        out[todo] = 2.0 * lcs_lengths([left[i] for i in todo], [right[i] for i in todo]) / total[todo]
    return out


def ratio_series(left: pd.Series, right: pd.Series) -> pd.Series:
    known = left.notna() & right.notna()
    out = pd.Series(np.full(len(left), np.nan))
    mask = known.to_numpy()
    if mask.any():
        out[mask] = ratios(left[known], right[known])
    return out


def _pair_chunks(starts: np.ndarray, sizes: np.ndarray, most: int = 1_000_000):
    """Index pairs (i < j) inside contiguous groups, in chunks of bounded size."""
    first = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
    follow = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes])
    done = 0
    ends = np.cumsum(follow)
    while done < len(first):
        base = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, base + most, side="right")))
        count = follow[done:stop]
        left = np.repeat(first[done:stop], count)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        yield left, left + 1 + offset
        done = stop


def _popcount(values: np.ndarray) -> np.ndarray:
    return sum((values >> bit) & 1 for bit in range(16))


def _two_best(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["grp", "pid", "score", "other"], ascending=[True, True, False, True], kind="stable")
    return frame[frame.groupby(["grp", "pid"], sort=False).cumcount() < 2]


def best_partners(names: int, exacts: int, floor: float):
    """Arrow-batch operator over rows sorted by (block, tile_a, tile_b).

    Every group is bounded by the tile size. Its pairs are compared here and at most two partners per record and
    group leave, so pairs never become rows. ``both`` is the set of names that the two have in common, -1 for any. At
    least one of them is a ``seeker``, and only pairs that can reach the score ``known`` to be passed by
    one of their seekers are scored.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.groupby(["block", "tile_a", "tile_b"], sort=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(groups)])
        tile = pdf["tile"].to_numpy()
        across = (pdf["tile_a"] != pdf["tile_b"]).to_numpy()
        common = pdf["common"].to_numpy()
        agree = pdf["agree"].to_numpy()
        emask = pdf["emask"].to_numpy()
        nmask = pdf["nmask"].to_numpy()
        pid = pdf["pid"].to_numpy()
        copies = pdf["copies"].to_numpy()
        apart = pdf["apart"].to_numpy()
        some_apart = pdf["apart"].notna().to_numpy()
        wanted = pdf["both"].to_numpy()
        seeker = pdf["seeker"].to_numpy(dtype=bool)
        known = np.where(seeker, pdf["known"].to_numpy(dtype=float), np.inf)
        exact = [pd.factorize(pdf[f"e{k}"])[0] for k in range(exacts)]
        name = [pd.factorize(pdf[f"n{k}"], use_na_sentinel=True) for k in range(names)]
        width = [np.array([len(t) for t in texts], dtype=np.int64) for _, texts in name]
        kept = []
        for left, right in _pair_chunks(starts, sizes):
            ok = (emask[left] & emask[right]) == common[left]
            ok &= ~(across[left] & (tile[left] == tile[right]))
            ok &= (seeker[left] | seeker[right]) & ((wanted[left] < 0) | ((nmask[left] & nmask[right]) == wanted[left]))
            left, right = left[ok], right[ok]
            same = np.zeros(len(left), dtype=np.int64)
            for k in range(exacts):
                same |= ((exact[k][left] == exact[k][right]) & (exact[k][left] >= 0)).astype(np.int64) << k
            ok = same == agree[left]
            left, right = left[ok], right[ok]
            both = nmask[left] & nmask[right]
            parts = _popcount(both) + _popcount(common[left])
            need = np.maximum(floor, np.minimum(known[left], known[right])) * parts - _popcount(agree[left])
            bound = np.zeros(len(left))
            for k in range(names):
                on = ((both >> k) & 1).astype(bool)
                a, b = width[k][name[k][0][left[on]]], width[k][name[k][0][right[on]]]
                bound[on] += 2.0 * np.minimum(a, b) / (a + b)
            ok = (parts > 0) & (bound >= need - 1e-9)
            for at in np.flatnonzero(ok & some_apart[left]):
                ok[at] = pid[right[at]] not in apart[left[at]]
            left, right, both, parts = left[ok], right[ok], both[ok], parts[ok]
            if not len(left):
                continue
            total = _popcount(agree[left]).astype(np.float64)
            for k in range(names):
                on = np.flatnonzero((both >> k) & 1)
                if not len(on):
                    continue
                codes, texts = name[k]
                pairs = codes[left[on]].astype(np.int64) * len(texts) + codes[right[on]]
                distinct, back = np.unique(pairs, return_inverse=True)
                score = ratios([texts[p // len(texts)] for p in distinct], [texts[p % len(texts)] for p in distinct])
                total[on] += score[back]
            score = total / parts
            ok = score >= floor - 1e-12
            left, right, score = left[ok], right[ok], score[ok]
            if len(left):
                kept.append(
                    _two_best(
                        pd.DataFrame(
                            {
                                "grp": np.r_[groups[left], groups[left]],
                                "pid": np.r_[pid[left], pid[right]],
                                "other": np.r_[pid[right], pid[left]],
                                "other_copies": np.r_[copies[right], copies[left]],
                                "score": np.r_[score, score],
                            }
                        )
                    )
                )
        if not kept:
            return None
        return _two_best(pd.concat(kept))

    def batch(found: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found["pid"].tolist(), pa.string()),
                pa.array(found["other"].tolist(), pa.string()),
                pa.array(found["other_copies"].to_numpy(dtype=np.int64), pa.int64()),
                pa.array(found["score"].to_numpy(dtype=np.float64), pa.float64()),
            ],
            names=["pid", "other", "other_copies", "score"],
        )

    def run(batches):
        waiting = None
        for part in batches:
            pdf = part.to_pandas()
            if not len(pdf):
                continue
            if waiting is not None:
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            last = pdf.iloc[-1]
            open_group = (
                (pdf["block"] == last["block"]) & (pdf["tile_a"] == last["tile_a"]) & (pdf["tile_b"] == last["tile_b"])
            ).to_numpy()
            found = None if open_group.all() else compare(pdf[~open_group].reset_index(drop=True))
            if found is not None:
                yield batch(found)
            waiting = pdf[open_group].reset_index(drop=True)
        found = None if waiting is None else compare(waiting)
        if found is not None:
            yield batch(found)

    return run


def first_filled(names: list[str], most: int):
    """Arrow-batch operator over (source_file, source_row_number, a column for each name).

    Of every batch only the first ``most`` values of each column and file leave, as (source_file, source_row_number, column, value);
    nothing is held from one batch to the next.
    """

    def run(batches):
        for batch in batches:
            file, number = batch.column(0), batch.column(1)
            codes = file.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            rows = number.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                value = batch.column(2 + i)
                filled = np.flatnonzero(value.is_valid().to_numpy(zero_copy_only=False))
                if not len(filled):
                    continue
                order = filled[np.lexsort((rows[filled], codes[filled]))]
                own = codes[order]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
                kept = pa.array(order[place < most])
                yield pa.RecordBatch.from_arrays(
                    [file.take(kept), number.take(kept), pa.array([name] * len(kept), pa.string()), value.take(kept)],
                    names=["source_file", "source_row_number", "column", "value"],
                )

    return run
