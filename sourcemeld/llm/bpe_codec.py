"""Byte-level BPE encoding and decoding.

Two tiers per piece of text: a minimal perfect hash over the vocabulary answers pieces that are
whole tokens; all others go through merges that a heap picks from a linked list of bytes. Every
step is per row, so the operator has no shuffle; each task keeps what it learned about pieces
in a bounded memory.
"""

from __future__ import annotations

from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcemeld.llm.batches import text_slices
from sourcemeld.llm.vocabulary import PieceSplitter, Vocabulary

_PIECES = 100_000  # remembered pieces per task; beyond that the memory starts anew
_CHUNKS = 174_000  # blank-separated chunks remembered per task, and as many older ones beside them
_SLICE = 2 << 20  # bytes of text encoded at once


class PerfectHash:
    """Minimal perfect hash: n keys, n slots. Keys share a bucket; each bucket stores the seed that sends
    its keys to free slots, or for a single key the slot itself (as -slot - 1)."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        grouped: dict[int, list[bytes]] = {}
        for key in keys:
            grouped.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.seeds = array("q", bytes(8 * self.buckets))
        self.slots: list[bytes | None] = [None] * self.n
        singles = []
        for bucket, members in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            hashes = [xxhash.xxh3_64_intdigest(k) for k in members]
            seed = 0
            while True:
                seed += 1
                found = {self._slot(h, seed) for h in hashes}
                if len(found) == len(members) and all(self.slots[s] is None for s in found):
                    break
            self.seeds[bucket] = seed
            for key, h in zip(members, hashes):
                self.slots[self._slot(h, seed)] = key
        free = (i for i in range(self.n) if self.slots[i] is None)
        for (bucket, key), slot in zip(singles, free):
            self.seeds[bucket] = -slot - 1
            self.slots[slot] = key

    def _slot(self, h: int, seed: int) -> int:
        z = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (z >> 24) % self.n

    def find(self, key: bytes) -> int:
        """Slot of a key, -1 for anything that is no key."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        slot = -seed - 1 if seed < 0 else self._slot(h, seed)
        return slot if self.slots[slot] == key else -1


class Merges:
    """What merging needs of a vocabulary: ids of single bytes and the id that each pair of ids joins to.

    A pair stands for its bytes, so every split of a token into two tokens is an entry. A lower id merges first.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = [ranks[bytes((b,))] for b in range(256)]
        self.first = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]  # by two bytes
        none: dict[int, int] = {}
        self.joined = [none] * (max(ranks.values()) + 1)  # by left id: right id -> id of both
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    if not self.joined[left]:
                        self.joined[left] = {}
                    self.joined[left][right] = rank


_PLACES = list(range(-1, 258))


def merge(piece: bytes, merges: Merges) -> list[int]:
    """Ids of a piece: join the adjacent pair of lowest id, leftmost first, until none is left.

    Parts are a linked list over the bytes. ``joins`` holds what a part and its neighbour join to now; a
    heap entry is that id and the part's place in one integer, and is stale once the two differ.
    """
    n = len(piece)
    single, first, joined = merges.bytes, merges.first, merges.joined
    ids = [single[b] for b in piece]
    if n == 1:
        return ids
    places = _PLACES if n <= 256 else list(range(-1, n + 1))
    after, before, bits = places[2 : n + 2], places[:n], n.bit_length()
    joins = [first[a][b] for a, b in zip(piece, piece[1:])]
    heap = [join << bits | i for i, join in enumerate(joins) if join >= 0]
    joins.append(-1)
    heapify(heap)
    place = (1 << bits) - 1
    while heap:
        entry = heappop(heap)
        i, new = entry & place, entry >> bits
        if joins[i] != new:
            continue
        gone = after[i]
        end = after[gone]
        ids[i], after[i], joins[gone], ids[gone] = new, end, -1, -1
        join = -1
        if end < n:
            before[end] = i
            join = joined[new].get(ids[end], -1)
            if join >= 0:
                heappush(heap, join << bits | i)
        joins[i] = join
        left = before[i]
        if left >= 0:
            join = joins[left] = joined[ids[left]].get(new, -1)
            if join >= 0:
                heappush(heap, join << bits | left)
    return [i for i in ids if i >= 0]


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    """Encoder and decoder of one vocabulary. Ids of remembered pieces and chunks are packed, four bytes each."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ranks = vocabulary.ranks
        self.merges = Merges(self.ranks)
        self.whole = PerfectHash(sorted(self.ranks, key=self.ranks.get))
        self.slot_ids = [_packed([self.ranks[k]]) for k in self.whole.slots]
        self.token_bytes = {i: k for k, i in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.splitter = PieceSplitter(vocabulary.pattern, self._piece, b"".join, _CHUNKS)

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode()
            slot = self.whole.find(raw)
            ids = self.slot_ids[slot] if slot >= 0 else _packed(merge(raw, self.merges))
            if piece[0] != " ":  # words after a blank are remembered by the splitter
                if len(self.known) >= _PIECES:
                    self.known.clear()
                if len(piece) <= 256:
                    self.known[piece] = ids
        return ids

    def packed(self, text: str) -> bytes:
        return b"".join(self.splitter.parts(text))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: list[str] | None = None, ids: str = "token_ids", decoded: str | None = None
) -> DataFrame:
    """``keep`` columns of every row plus its token ids (array<int>).

    The whole text is encoded, special strings as ordinary text. A null or empty text has no
    ids. With ``decoded`` the ids are also turned back into bytes, in a column of that name.
    Rows are neither merged nor dropped; clashing names are the caller's choice of ``ids``,
    ``decoded`` and ``keep``. An id stands for one byte at least, so the result follows the text.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(Codec(vocabulary))
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
        + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else [])
    )

    def run(batches):
        codec = shared.value
        for batch in text_slices(batches, "__text", _SLICE):
            coded = [codec.packed(t) if t else b"" for t in batch.column("__text").to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
            columns = [batch.column(f"__k{i}") for i in range(len(keep))]
            flat = np.frombuffer(b"".join(coded), np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
            names = [*keep, ids]
            if decoded:
                columns.append(pa.array([codec.decode(array("i", x)) for x in coded], pa.binary()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _narrow(docs, text, keep).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, *, ids: str = "token_ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """``keep`` columns plus the bytes of the ids. Null ids give null; an unknown id is an error."""
    keep = [c for c in rows.columns if c != ids] if keep is None else keep
    shared = rows.sparkSession.sparkContext.broadcast({i: k for k, i in vocabulary.ranks.items()})
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(out, T.BinaryType(), True)])

    def run(batches):
        token_bytes = shared.value.__getitem__
        for batch in batches:
            found = [None if x is None else b"".join(map(token_bytes, x)) for x in batch.column("__text").to_pylist()]
            columns = [batch.column(f"__k{i}") for i in range(len(keep))] + [pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return _narrow(rows, ids, keep).mapInArrow(run, schema)


def _narrow(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Only what Python needs, under names that clash with nothing."""
    return df.select(df[value].alias("__text"), *[df[c].alias(f"__k{i}") for i, c in enumerate(keep)])
