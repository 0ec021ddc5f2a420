"""Removal of long passages that an earlier document holds already.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. All windows of ``length`` bytes are split over buckets by content: the smallest hash of the short
strings inside a window names its bucket, so equal windows meet, wherever they are. Neighbouring
windows with the same smallest hash travel as one fragment (about ``length`` + 20 bytes). Equal
fragments are merged before the shuffle, so a passage that a third of all documents share costs one
fragment per slice of input. A short string that stands in very many different windows, as a sample tells, names
a bucket only where a window has nothing else, so that it does not draw them all into one; the sample decides where windows go,
never what is found.

What is shuffled are groups of buckets: a group takes enough fragments from a slice, or from several slices at a time if there are
very many groups, to be packed well. A task splits its group into the buckets; each builds a run-length index over
its distinct fragments that may repeat and streams the later ones through it (``run_index``). The removed spans, a small
table, then meet the documents again. No bucket sees whole documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.llm.batches import HASH_SLICE, SpanHash, flat_bytes, mix, text_slices
from sourcemeld.llm.run_index import RunIndex
from sourcemeld.session import Scratch

#: Bytes of text whose fragments share a bucket, and a group of buckets, on average.
BUCKET_BYTES, GROUP_BYTES = 2 << 20, 8 << 20
#: Bytes of text whose anchors are counted, and the share of them at least; anchors that are set back at the most, and the
#: bytes of text that an anchor may draw into one bucket before it is.
SAMPLE_BYTES, SAMPLE_SHARE, HOT_MOST, HOT_BYTES = 64 << 20, 1 / 30_000, 100_000, 16 << 20
_SLICE = HASH_SLICE
_PER_FRAME = 500  # groups that find some hundred fragments each in a megabyte of text
_GATHER_MOST = 64 << 20  # text whose fragments a task holds back for packing
_NEVER = np.uint64(2**64 - 1)
_ANCHOR = 12  # bytes of the short strings; they fit ``length`` - 11 times into a window
_MOST_WINDOWS = 64  # per fragment, so that periodic text makes no long ones
_SPANS = "array<struct<start:int,end:int>>"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, best = 1, values
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    rest = width - have
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def _pack(buckets: np.ndarray, count: int, columns: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    """Rows of the columns by bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    columns = [c[order] for c in columns]
    return [(b, [c[edges[b] : edges[b + 1]] for c in columns]) for b in np.flatnonzero(np.diff(edges))]


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _merged(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each owner as maximal runs; touching spans join."""
    if not len(owner):
        return owner, starts, ends
    order = np.lexsort((starts, owner))
    owner, starts, ends = owner[order], starts[order], ends[order]
    high = int(ends.max()) + 1
    reach = np.maximum.accumulate(owner * high + ends)  # never beyond the owner's own range
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (owner[1:] * high + starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], starts[first], reach[last] - owner[first] * high


class HotAnchors:
    """Hashes of short strings that name a bucket only where nothing else can."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(np.asarray(hashes, np.uint64))
        self.marked = np.zeros(1 << 16, bool)
        self.marked[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def set_back(self, short: np.ndarray) -> np.ndarray:
        if len(self.hashes):
            maybe = np.flatnonzero(self.marked[(short & np.uint64(0xFFFF)).astype(np.int64)])
            short[maybe[np.isin(short[maybe], self.hashes)]] = _NEVER
        return short


def _fragments(batch: pa.RecordBatch, length: int, hot: HotAnchors):
    """Fragments of a slice that have to be shipped, as (data, starts, lengths, rows, places, smallest hashes), and
    the spans (row, start, end) that an earlier document of the slice settles."""
    data, offsets = flat_bytes(batch.column("text"))
    docs = batch.column("doc_id")
    known = np.asarray(docs.is_valid())
    ids = docs.fill_null(0).to_numpy(zero_copy_only=False)
    if len(data) < length:
        return None
    hashes = SpanHash(data)
    low = _sliding_min(hot.set_back(hashes.windows(_ANCHOR)), length - _ANCHOR + 1)
    edge = np.zeros(len(low) + 1, np.int32)
    long = (np.diff(offsets) >= length) & known
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int32) > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    fresh[offsets[:-1][long]] = True
    starts = np.flatnonzero(fresh)
    stops = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
    limit = np.append(starts[1:], len(low))
    windows = np.minimum(limit, stops[np.searchsorted(stops, starts, side="right")]) - starts
    pieces = -(-windows // _MOST_WINDOWS)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * _MOST_WINDOWS
    windows = np.minimum(np.repeat(windows, pieces) - nth * _MOST_WINDOWS, _MOST_WINDOWS)
    lengths = windows + length - 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    places = starts - offsets[rows]
    content = hashes.of(starts, starts + lengths)
    order = np.lexsort((ids[rows], content))
    first = np.ones(len(order), bool)
    first[1:] = content[order][1:] != content[order][:-1]
    earliest = np.empty(len(order), ids.dtype)
    earliest[order] = ids[rows][order][np.flatnonzero(first)][np.cumsum(first) - 1]
    later = ids[rows] > earliest
    done = _merged(rows[later], places[later], places[later] + lengths[later])
    own = ~later
    return (data, starts[own], lengths[own], rows[own], places[own], low[starts[own]]), done


def _bucket_of(low: np.ndarray, buckets: int) -> np.ndarray:
    return ((low >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _gathered(batches, length: int, hot: HotAnchors, limit: int):
    """(ids, prints, fragments, settled spans) of some ``limit`` bytes of text at a time; rows count through all of it."""
    held, size = [], 0
    for batch in text_slices(batches, "text", _SLICE):
        found = _fragments(batch, length, hot)
        if found is not None:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            prints = batch.column("print").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            held.append((ids, prints, *found))
            size += len(found[0][0])
        if size >= limit:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list):
    if len(held) == 1:
        return held[0]
    ids, prints, fragments, done = zip(*held)
    rows = np.cumsum([0, *map(len, ids)])
    bytes_before = np.cumsum([0, *(len(f[0]) for f in fragments)])
    data, starts, lengths, of, places, low = zip(*fragments)
    shifted = (np.concatenate([s + b for s, b in zip(starts, bytes_before)]), np.concatenate(lengths), np.concatenate([r + b for r, b in zip(of, rows)]))
    spans = (np.concatenate([d[0] + b for d, b in zip(done, rows)]), np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done]))
    return np.concatenate(ids), np.concatenate(prints), (np.concatenate(data), *shifted, np.concatenate(places), np.concatenate(low)), spans


def _split(groups: int, length: int, hot: HotAnchors):
    """Slices of documents -> per group of buckets, packed fragments, and packed spans that the slices settle themselves."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
    limit = min(_GATHER_MOST, -(-groups // _PER_FRAME) * _SLICE)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for ids, prints, (data, starts, lengths, rows, places, low), done in _gathered(batches, length, hot, limit):

            def owners(r: np.ndarray) -> list[np.ndarray]:
                """Ids and prints of the rows and how many entries each has; rows ascend."""
                own, counts = np.unique(r, return_counts=True)
                return [np.diff(ids[own], prepend=0), prints[own], counts.astype(np.uint32)]

            def frames():
                for b, (s, n, r, p) in _pack(_bucket_of(low, groups), groups, [starts, lengths, rows, places]):
                    yield b, [_gather(data, s, n), n.astype(np.uint8), p.astype(np.uint32), np.zeros(0, np.uint32), *owners(r)]
                if len(done[0]):
                    for b, (r, s, e) in _pack(done[0] % groups, groups, list(done)):
                        yield b, [np.zeros(0, np.uint8), np.zeros(0, np.uint8), s.astype(np.uint32), e.astype(np.uint32), *owners(r)]

            out, size = [], 0
            for b, columns in frames():
                out.append((b, press.compress(_dump(columns))))
                size += len(out[-1][1])
                if size >= _SLICE:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

    return run


def _batch(rows: list[tuple[int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)


def _counted(length: int):
    """Slices of a sample -> (anchor, number of its fragments) and, as anchor null, the number of all."""

    def run(batches):
        nobody = HotAnchors(np.zeros(0, np.uint64))
        for batch in text_slices(batches, "text", _SLICE):
            found = _fragments(batch, length, nobody)
            if found is None or not len(found[0][5]):
                continue
            anchors, counts = np.unique(found[0][5], return_counts=True)
            some = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([*anchors[some].astype(np.int64).tolist(), None], pa.int64()), pa.array([*counts[some].tolist(), int(counts.sum())], pa.int64())],
                names=["anchor", "n"],
            )

    return run


def _hot_anchors(docs: DataFrame, size: int, length: int) -> HotAnchors:
    """Anchors that would draw more than ``HOT_BYTES`` of text into a bucket, by a sample of the documents; at most ``HOT_MOST``."""
    whole = max(SAMPLE_BYTES, size * SAMPLE_SHARE)
    if size <= HOT_BYTES:
        return HotAnchors(np.zeros(0, np.uint64))
    every = max(1, int(size // whole))
    counts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(_counted(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = counts.where("n >= 8").orderBy(F.desc("n"), "anchor").limit(HOT_MOST + 1).collect()
    total = next((r["n"] for r in most if r["anchor"] is None), 0)
    return HotAnchors(np.array([r["anchor"] for r in most if r["anchor"] is not None and r["n"] >= total * HOT_BYTES / size], np.int64).astype(np.uint64))


def _split(groups: int, length: int, hot: HotAnchors):
    """Slices of documents -> per group of buckets, packed fragments, and packed spans that the slices settle themselves."""
    schema = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
    limit = min(_GATHER_MOST, -(-groups // _PER_FRAME) * _SLICE)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for ids, prints, (data, starts, lengths, rows, places, low), done in _gathered(batches, length, hot, limit):

            def owners(r: np.ndarray) -> list[np.ndarray]:
                """Ids and prints of the rows and how many entries each has; rows ascend."""
                own, counts = np.unique(r, return_counts=True)
                return [np.diff(ids[own], prepend=0), prints[own], counts.astype(np.uint32)]

            def frames():
                for b, (s, n, r, p) in _pack(_bucket_of(low, groups), groups, [starts, lengths, rows, places]):
                    yield b, [_gather(data, s, n), n.astype(np.uint8), p.astype(np.uint32), np.zeros(0, np.uint32), *owners(r)]
                if len(done[0]):
                    for b, (r, s, e) in _pack(done[0] % groups, groups, list(done)):
                        yield b, [np.zeros(0, np.uint8), np.zeros(0, np.uint8), s.astype(np.uint32), e.astype(np.uint32), *owners(r)]

            out, size = [], 0
            for b, columns in frames():
                out.append((b, press.compress(_dump(columns))))
                size += len(out[-1][1])
                if size >= _SLICE:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

    return run


def _batch(rows: list[tuple[int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)


def _counted(length: int):
    """Slices of a sample -> (anchor, number of its fragments) and, as anchor null, the number of all."""

    def run(batches):
        nobody = HotAnchors(np.zeros(0, np.uint64))
        for batch in text_slices(batches, "text", _SLICE):
            found = _fragments(batch, length, nobody)
            if found is None or not len(found[0][5]):
                continue
            anchors, counts = np.unique(found[0][5], return_counts=True)
            some = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([*anchors[some].astype(np.int64).tolist(), None], pa.int64()), pa.array([*counts[some].tolist(), int(counts.sum())], pa.int64())],
                names=["anchor", "n"],
            )

    return run


def _hot_anchors(docs: DataFrame, size: int, length: int) -> HotAnchors:
    """Anchors that would draw more than ``HOT_BYTES`` of text into a bucket, by a sample of the documents; at most ``HOT_MOST``."""
    whole = max(SAMPLE_BYTES, size * SAMPLE_SHARE)
    if size <= HOT_BYTES:
        return HotAnchors(np.zeros(0, np.uint64))
    every = max(1, int(size // whole))
    counts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(_counted(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = (counts.where("anchor is null").first() or {"n": 0})["n"]
    hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") >= max(8, total * HOT_BYTES / size))).orderBy(F.desc("n"), "anchor").limit(HOT_MOST)
    return HotAnchors(np.array([r["anchor"] for r in hot.select("anchor").collect()], np.int64).astype(np.uint64))


_KINDS = (np.uint8, np.uint8, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)


def _dump(columns: list[np.ndarray]) -> bytes:
    """Columns as bytes; the bytes of equal weight of all numbers stand together, which packs better."""
    parts = [c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _load(packed: bytes, kinds: tuple = _KINDS) -> list[np.ndarray]:
    sizes = np.frombuffer(packed, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(packed, np.uint8, int(size), at).reshape(width, -1)
        out.append(np.ascontiguousarray(part.T).view(kind).ravel())
        at += int(size)
    return out


#: What is packed of spans: ids, prints and numbers of spans of documents, then starts and ends.
_SPAN_KINDS = (np.int64, np.uint32, np.uint32, np.int32, np.int32)


def _owned(ids: np.ndarray, prints: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, prints, numbers of spans, starts, ends) of documents: the union of their spans as maximal runs."""
    order = np.lexsort((prints, ids))
    ids, prints = ids[order], prints[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    owner, starts, ends = _merged(np.cumsum(new) - 1, starts[order], ends[order])
    first = np.flatnonzero(new)
    return ids[first], prints[first], np.bincount(owner, minlength=len(first)), starts, ends


def _resolve(length: int, buckets: int, hot: HotAnchors, shares: int):
    """All fragments of a group of ``buckets`` -> spans of its documents, packed for ``shares`` parts of the documents."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        spans, parts = [], []
        for value in table.column("packed").to_pylist():
            data, lengths, places, ends, ids, prints, counts = _load(unpack.decompress(value))
            ids, prints = np.repeat(np.cumsum(ids), counts), np.repeat(prints.astype(np.int64), counts)
            if len(lengths):
                parts.append((data, lengths.astype(np.int64), ids, prints, places.astype(np.int64)))
            else:
                spans.append((ids, prints, places.astype(np.int64), ends.astype(np.int64)))
        if parts:
            spans += _group_spans([np.concatenate(x) for x in zip(*parts)], length, buckets, hot)
        out = []
        if spans:
            ids, prints, counts, starts, ends = _owned(*(np.concatenate(x) for x in zip(*spans)))
            press = zstandard.ZstdCompressor(level=3)
            begin = np.cumsum(counts) - counts
            for part, (i, p, n, b) in _pack((mix(ids.astype(np.uint64)) % np.uint64(shares)).astype(np.int64), shares, [ids, prints, counts, begin]):
                own = _gather(np.arange(len(starts)), b, n)
                out.append((part, press.compress(_dump([i, p.astype(np.uint32), n.astype(np.uint32), starts[own].astype(np.int32), ends[own].astype(np.int32)]))))
        return pa.table({"part": pa.array([x for x, _ in out], pa.int32()), "packed": pa.array([x for _, x in out], pa.binary())})

    return run


def _assembled(table: pa.Table) -> pa.Table:
    """All packed spans of a part of the documents -> (doc_id, print, spans), one row per document."""
    unpack = zstandard.ZstdDecompressor()
    frames = [_load(unpack.decompress(x), _SPAN_KINDS) for x in table.column("packed").to_pylist()]
    ids, prints, counts, starts, ends = (np.concatenate(x) for x in zip(*frames))
    ids, prints, counts, starts, ends = _owned(np.repeat(ids, counts), np.repeat(prints.astype(np.int64), counts), starts.astype(np.int64), ends.astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["start", "end"]))
    return pa.table({"doc_id": pa.array(ids), "print": pa.array(prints), "spans": lists})


def _anchors(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, length: int, hot: HotAnchors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each fragment: content hash, smallest hash, and the context hashes (left, right) around its place.

    A window of ``length`` bytes that holds the place has at least half of the other bytes on one side of
    it, so two fragments with a common window share their left or their right context. Fragments too
    short on a side, or with several places, get no filter there (context 0).
    """
    hashes = SpanHash(data)
    short = hot.set_back(hashes.windows(_ANCHOR))
    reach = length - _ANCHOR + 1
    edges = np.stack((begin, begin + reach), axis=1).ravel()
    low = np.minimum.reduceat(np.append(short, np.full(_ANCHOR, np.uint64(2**64 - 1))), edges)[::2]
    owner = np.repeat(np.arange(len(begin)), lengths)[: len(short)]
    hits = np.flatnonzero(short == low[owner])
    hits = hits[hits + _ANCHOR <= (begin + lengths)[owner[hits]]]
    where = owner[hits]
    times = np.bincount(where, minlength=len(begin))
    place = np.zeros(len(begin), np.int64)
    place[where] = hits
    side = (length - _ANCHOR + 1) // 2
    left_ok, right_ok = place - side >= begin, place + _ANCHOR + side <= begin + lengths
    stop = len(data)
    left = hashes.of(np.maximum(place - side, 0), place + _ANCHOR)
    right = hashes.of(place, np.minimum(place + _ANCHOR + side, stop))
    several = times > 1
    left, right = np.where(left_ok, left, 0), np.where(right_ok, right, 0)
    return hashes.of(begin, begin + lengths), low, np.stack((left, right)), several


def _group_spans(columns: list[np.ndarray], length: int, buckets: int, hot: HotAnchors) -> list[tuple[np.ndarray, ...]]:
    """Spans of all buckets of a group, one bucket after the other."""
    data, lengths, ids, prints, places = columns
    begin = np.cumsum(lengths) - lengths
    step = np.searchsorted(begin, np.arange(0, len(data), _SLICE))  # hashes of a slice at a time
    blocks = [(i, j) for i, j in zip(step, np.append(step[1:], len(begin))) if i < j]
    hashed = [_anchors(data[begin[i] : begin[j - 1] + lengths[j - 1]], begin[i:j] - begin[i], lengths[i:j], length, hot) for i, j in blocks]
    content, low, context, several = (np.concatenate(x, axis=-1) for x in zip(*hashed))
    spans = []
    for _, found in _pack(((low >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64), buckets, [begin, lengths, ids, prints, places, content, low, *context, several]):
        spans += _bucket_spans(data, *found[:7], np.stack(found[7:9]), found[9], length)
    return spans


def _bucket_spans(data, begin, lengths, ids, prints, places, content, low, context, several, length: int) -> list[tuple[np.ndarray, ...]]:
    # Equal fragments of several slices: all but those of the smallest id are settled.
    order = np.lexsort((ids, content))
    first = np.ones(len(order), bool)
    first[1:] = content[order][1:] != content[order][:-1]
    lead = order[first]
    text = np.empty(len(order), np.int64)  # distinct text of each fragment
    text[order] = np.cumsum(first) - 1
    hit = ids > ids[lead][text]
    spans = [(ids[hit], prints[hit], places[hit], places[hit] + lengths[hit])]
    # Distinct texts can share a window only if they share the smallest hash and a context beside it.
    near = several[lead].copy()
    for side in context[:, lead]:
        seen, inverse, counts = np.unique(side, return_inverse=True, return_counts=True)
        near |= (counts[inverse] > 1) & (seen[inverse] != 0)
    group = np.unique(low[lead], return_inverse=True)[1]
    earliest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(earliest, group[near], ids[lead][near])
    with_several = np.bincount(group, weights=several[lead]) > 0
    near |= with_several[group]
    np.minimum.at(earliest, group[near], ids[lead][near])
    streamed = near & (ids[lead] > earliest[group])
    indexed = near & np.isin(group, group[streamed])
    if not streamed.any():
        return spans
    index = RunIndex(_gather(data, begin[lead[indexed]], lengths[lead[indexed]]), lengths[lead[indexed]], ids[lead[indexed]], length)
    chosen = lead[streamed]
    sizes = lengths[chosen]
    matched, rows = index.matching_statistics(_gather(data, begin[chosen], sizes), sizes)
    pattern = np.repeat(np.arange(len(chosen)), sizes)
    hits = np.flatnonzero(matched >= length)
    hits = hits[index.smallest_label(rows[hits]) < ids[chosen][pattern[hits]]]
    at = hits - (np.cumsum(sizes) - sizes)[pattern[hits]]
    which, starts, ends = _merged(pattern[hits], at, at + length)
    # Spans of a text go to every fragment that holds it and is not settled yet.
    text_of = np.full(len(lead), -1, np.int64)
    text_of[streamed] = np.arange(len(chosen))
    mine = text_of[text]
    open_ = np.flatnonzero((mine >= 0) & ~hit)
    edges = np.searchsorted(which, np.arange(len(chosen) + 1))
    many = np.diff(edges)[mine[open_]]
    source = np.repeat(open_, many)
    span = np.repeat(edges[mine[open_]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    spans.append((ids[source], prints[source], places[source] + starts[span], places[source] + ends[span]))
    return spans


def _cut(text: bytes, spans: list[dict] | None, characters: bool) -> tuple[bytes, list[dict]]:
    """The bytes outside the spans and the maximal spans, narrowed to whole characters if asked."""
    if not spans:
        return text, []
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if merged and s["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
        else:
            merged.append(dict(s))
    if characters:
        merged = [s for s in (_narrowed(text, s) for s in merged) if s["start"] < s["end"]]
    kept, at = [], 0
    for s in merged:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, text[at:]]), merged


def _narrowed(text: bytes, span: dict) -> dict:
    start, end = span["start"], span["end"]
    while start < end and text[start] & 0xC0 == 0x80:  # inside a character
        start += 1
    while start < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return {"start": start, "end": end}


def remove_repeats(
    docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", length: int = 50, removed: str = "removed", kept: str = "kept", characters: bool = False
) -> DataFrame:
    """All columns of every row plus ``removed`` (maximal byte spans, in order) and ``kept`` (the other bytes).

    With ``characters`` a span leaves out characters of which it covers a part only, so ``kept`` is valid text.
    Null text counts as empty. A row whose id is null neither loses bytes nor makes others lose any;
    rows that share an id never count as earlier than each other. Columns named ``removed`` or
    ``kept`` are replaced. Inside a slice and a bucket, fragments count as equal by 64-bit hashes.
    """
    narrow = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"), F.crc32(docs[text]).alias("print"))
    size = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(-(-size // GROUP_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, -(-size // (groups * BUCKET_BYTES)))
    hot = _hot_anchors(narrow, size, length)
    fragments = narrow.mapInArrow(_split(groups, length, hot), "bucket int, packed binary")
    shares = max(-(-groups // 8), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # About one group per task, so tasks stay as large as a group whatever the input.
    packed = fragments.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_resolve(length, buckets, hot, shares), "part int, packed binary")
    spans = packed.groupBy("part").applyInArrow(_assembled, f"doc_id long, print long, spans {_SPANS}")
    spans = scratch.write(spans, "spans").withColumnRenamed("spans", "__spans")
    keep = [c for c in docs.columns if c not in (removed, kept)]
    renamed = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)])
    key, body = f"__k{keep.index(id)}", f"__k{keep.index(text)}"
    joined = renamed.join(
        spans.hint("shuffle_hash").withColumnsRenamed({"doc_id": "__id", "print": "__print"}),
        (F.col(key).cast("long") == F.col("__id")) & (F.crc32(body) == F.col("__print")),
        "left",
    )

    def run(batches):
        names = [*keep, removed, kept]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in text_slices(batches, body):
            texts = [b"" if t is None else t.encode() for t in batch.column(body).to_pylist()]
            cut = [_cut(t, s, characters) for t, s in zip(texts, batch.column("__spans").to_pylist())]
            columns = [batch.column(f"__k{i}") for i in range(len(keep))]
            columns += [pa.array([s for _, s in cut], kind), pa.array([t for t, _ in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([docs.schema[c] for c in keep])
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = schema.add(removed, spans_type).add(kept, T.BinaryType())
    return joined.select(*renamed.columns, "__spans").mapInArrow(run, schema)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
