"""Exact duplicates by a Grace hash join of a table with itself.

Records are dealt to buckets by a hash of their content; a bucket that fits the memory of a task goes through an open-addressing
table that compares whole contents. A bucket that does not fit is dealt again, by further bits of the hash and in pieces of
bounded size whose copies are merged first, until each one does. The spill files between the levels are tables in
the shared folder, so a lost executor repeats some tasks of one level.

Copies are merged inside every slice of the input before anything is shuffled: a text that a third of all rows hold
is sent once per slice. Which rows a slice has merged stays behind in its own rows, and only the digest of the text is looked
up for them at the end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.llm.batches import text_slices
from sourcemeld.session import Scratch

#: Bytes of distinct content that a bucket is planned for, and those up to which it fits a task.
BUCKET_BYTES, FITTING_BYTES = 16 << 20, 64 << 20
_FAN_OUT = 16  # buckets that one level makes of a bucket that does not fit
_GROUP = "digest binary, content binary, n_bytes long, id long, place long, size long"


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of the first row of its content."""

    def __init__(self, content: pa.Array, hashes: np.ndarray) -> None:
        self.content, self.hashes = content, hashes
        self.mask = (1 << max(4, (2 * len(hashes)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)

    def _same(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two rows have the same content, all bytes of it."""
        same = self.hashes[left] == self.hashes[right]
        for i in np.flatnonzero(same & (left != right)):
            same[i] = self.content[int(left[i])].as_buffer().equals(self.content[int(right[i])].as_buffer())
        return same

    def first_rows(self) -> np.ndarray:
        """For every row the first one with the same content."""
        first = np.arange(len(self.hashes))
        at = (self.hashes & np.uint64(self.mask)).astype(np.int64)
        waiting = first.copy()
        while len(waiting):
            free = waiting[self.slots[at[waiting]] < 0][::-1]
            self.slots[at[free]] = free  # of several rows the first one stays, as it is written last
            holder = self.slots[at[waiting]]
            same = self._same(holder, waiting)
            first[waiting[same]] = holder[same]
            waiting = waiting[~same]
            at[waiting] = (at[waiting] + 1) & self.mask
        return first


def _merge(content: pa.Array, digests: pa.Array, ids: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order of content and then of id, where each content starts, first row of each content)."""
    fixed = digests.cast(pa.binary(32))
    whole = np.frombuffer(fixed.buffers()[1], np.uint8, 32 * len(fixed), 32 * fixed.offset).reshape(-1, 32)
    hashes = whole[:, 24:].copy().view(np.uint64).ravel()  # bytes that deal no bucket
    first = ContentTable(content, hashes).first_rows()
    known = np.asarray(ids.is_valid())
    order = np.lexsort((places, ids.fill_null(0).to_numpy(zero_copy_only=False), ~known, first))
    starts = np.flatnonzero(np.r_[True, np.diff(first[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    return order, starts, order[starts]


def _slices(batches):
    """Rows -> one row per content of a slice, with the ids of its rows in ascending order, null ids last."""
    names = ["digest", "content", "n_bytes", "id", "place", "size", "ids"]
    for batch in text_slices(batches, "content"):
        places = batch.column("place").to_numpy()
        order, starts, lead = _merge(batch.column("content"), batch.column("digest"), batch.column("id"), places)
        lead = pa.array(lead)
        ids = batch.column("id").take(pa.array(order))
        sizes = np.diff(np.r_[starts, len(order)])
        columns = [batch.column(c).take(lead) for c in ("digest", "content", "n_bytes", "id", "place")]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), ids)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), lists], names=names)


def _bucket(table: pa.Table) -> pa.Table:
    """All rows of a bucket -> one row per content."""
    table = table.select(["digest", "content", "n_bytes", "id", "place", "size"]).combine_chunks()
    column = lambda c: table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.field(c).type)
    order, starts, lead = _merge(column("content"), column("digest"), column("id"), column("place").to_numpy(zero_copy_only=False))
    size = np.add.reduceat(column("size").to_numpy(zero_copy_only=False)[order], starts) if len(order) else np.zeros(0, np.int64)
    return table.take(pa.array(lead)).set_column(5, "size", pa.array(size))


def _resolved(table: pa.Table) -> pa.Table:
    return _bucket(table).select(["digest", "id", "place", "size"])


def _bits(level: int, count: int) -> Column:
    """Bucket out of ``count`` by bits of the digest that no other level uses (32 of them for the first, 8 for each later one)."""
    start, digits = (1, 8) if level == 0 else (7 + 2 * level, 2)
    return F.conv(F.substring(F.hex("digest"), start, digits), 16, 10).cast("long") % count


def _groups(pieces: DataFrame, scratch: Scratch, slots: int) -> DataFrame:
    """(digest, id, place, size) per content: its first row and its number of rows."""
    total = pieces.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    dealt = pieces.withColumn("bucket", _bits(0, max(slots, -(-total // BUCKET_BYTES))).cast("string"))
    done, level = [], 0
    while True:
        sizes = dealt.groupBy("bucket").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("longest"))
        # Two of the longest contents always fit, or copies of one could not be merged.
        sizes = sizes.withColumn("pieces", F.ceil(F.col("bytes") / F.greatest(F.lit(FITTING_BYTES), 2 * F.col("longest"))))
        sizes = scratch.write(sizes.where("pieces > 1").select("bucket", "pieces"), "large-buckets")
        large = sizes.count()
        fitting = dealt if not large else dealt.join(sizes, "bucket", "left_anti")
        done.append(fitting.groupBy("bucket").applyInArrow(_resolved, "digest binary, id long, place long, size long"))
        if not large:
            return reduce(DataFrame.unionByName, done)
        level += 1
        again = dealt.join(sizes, "bucket").withColumns(
            {
                "bucket": F.concat_ws("/", "bucket", _bits(min(level, 27), _FAN_OUT)),
                "piece": F.pmod(F.xxhash64("place", F.lit(level)), F.col("pieces")),
            }
        )
        kind = T.StructType.fromDDL(_GROUP + ", bucket string")
        dealt = scratch.write(again.groupBy("bucket", "piece").applyInArrow(_keyed, kind), "spill")


def _keyed(key, table):
    """The same, with the bucket that the rows go on in."""
    merged = _bucket(table)
    return merged.append_column("bucket", pa.array([key[0].as_py()] * merged.num_rows, pa.string()))


def find_copies(
    docs: DataFrame, scratch: Scratch, *, content: Column | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of every row: one per input row.

    Rows are equal if ``content`` (by default the text as it is) is, byte for byte; null counts as empty. Of equal rows the one with
    the smallest id stays, so an id that is null stays only where no row of the group has one, and of rows that share the id exactly
    one. ``digest`` is the SHA-256 of the content; two different contents with one digest are reported as an error,
    not merged. An empty table has no rows.
    """
    body = F.coalesce(F.col(text) if content is None else content, F.lit(""))
    rows = docs.select(docs[id].cast("long").alias("id"), body.alias("body"), F.monotonically_increasing_id().alias("place"))
    rows = rows.select(
        "id", "place", F.unhex(F.sha2("body", 256)).alias("digest"), F.encode("body", "UTF-8").alias("content"), F.octet_length("body").cast("long").alias("n_bytes")
    )
    pieces = scratch.write(rows.mapInArrow(_slices, _GROUP + ", ids array<long>"), "pieces")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = scratch.write(_groups(pieces.drop("ids"), scratch, slots), "groups")
    once = groups.groupBy("digest").agg(
        F.min_by("id", "place").alias("keep_id"), F.first("place").alias("keep_place"), F.first("size").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    one = F.when(F.col("contents") > 1, F.raise_error(F.lit("different contents share a SHA-256")).cast("long")).otherwise(F.col("group_size"))
    found = pieces.select("digest", "place", "ids").join(once.withColumn("group_size", one), "digest")
    return found.select("place", "keep_id", "keep_place", "group_size", "digest", F.posexplode("ids").alias("nth", "id")).select(
        F.col("id").alias(id), "keep_id", "group_size", ((F.col("nth") == 0) & (F.col("place") == F.col("keep_place"))).alias("kept"), "digest"
    )
