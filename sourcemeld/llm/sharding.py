"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table: offset + i * skip modulo
the size. Shards take turns; at its turn a shard claims the first slot of its permutation that is
still free, until no slot is left. Slots per shard differ by one at most, and if a shard goes, few
slots of the others change hands. The table is as large as its parameter says, whatever the
corpus, so it is broadcast; a document is placed by one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime well above 100 slots per shard for up to a few hundred shards.
TABLE_SIZE = 65_537
#: Largest table that is broadcast (two integers a slot).
MAX_TABLE_SIZE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> position in ``shards``."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    if size > MAX_TABLE_SIZE or not _is_prime(size):
        raise ValueError(f"{size} is no prime up to {MAX_TABLE_SIZE}")
    place = [_digest(f"offset {s}") % size for s in shards]
    skip = [_digest(f"skip {s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    claimed = 0
    while True:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % size
            table[place[shard]] = shard
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key of any type, from 60 bits of the MD5 of its text; null as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, key: str, shards: list[str], *, size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All columns of every row plus its slot (int) and shard (string).

    Equal keys share a slot; a null key has the slot of the empty text. Columns of ``docs`` named as
    ``slot`` or ``shard`` are replaced. Nothing is dropped, merged or shuffled.
    """
    rows = [(i, shards[s]) for i, s in enumerate(fill_table(shards, size))]
    schema = T.StructType([T.StructField("__slot", T.IntegerType(), False), T.StructField("__shard", T.StringType(), False)])
    table = docs.sparkSession.createDataFrame(rows, schema)
    keep = [docs[c] for c in docs.columns if c not in (slot, shard)]
    placed = docs.select(*keep, slot_of(docs[key], size).alias("__slot_of"))
    joined = placed.join(F.broadcast(table), F.col("__slot_of") == F.col("__slot"))
    return joined.select(*[c for c in docs.columns if c not in (slot, shard)], F.col("__slot").alias(slot), F.col("__shard").alias(shard))
