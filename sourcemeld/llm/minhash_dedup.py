"""Groups of near-duplicate documents by a join of signature coordinates.

Each distinct shingle set has a MinHash signature of ``COORDINATES`` values. A document is posted
under each (coordinate, value); two sets whose signatures agree on at least ``MATCHES``
coordinates share a posting among any ``COORDINATES - MATCHES + 1`` of either, so each document
is posted under its rarest ones only (the prefix). Sets of similarity 0.75 agree on fewer than
``MATCHES`` = 30 of 64 coordinates with probability below 2e-6. All links are confirmed on whole sets.

Groups are wanted, not pairs, so lists are merged with skips: the document of a list that shares
most values with others is its head and meets every member once; then only documents that
are still in different groups meet, as pairs in lists of up to ``LONG_LIST`` members and inside tiles of the
list beyond. No link is lost, and a list of n near copies costs n comparisons, not n squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemeld.llm.batches import HASH_SLICE, mix, text_slices
from sourcemeld.llm.shingles import multipliers, shingle_sets, signatures
from sourcemeld.operators.components import connected_components
from sourcemeld.session import Scratch

COORDINATES, MATCHES = 64, 30
WORDS, PERCENT = 5, 75
#: Members up to which a list is compared pair by pair; longer ones go through tiles of this many members.
LONG_LIST, TILE = 128, 1024


def shingle_signatures(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, hash of the text, n_shingles, fingerprint of the set (two longs) and signature (array; null for an empty set) per row."""
    factors = multipliers(COORDINATES)

    def run(batches):
        for batch in text_slices(batches, "text", HASH_SLICE):
            hashes, offsets = shingle_sets(batch.column("text"), WORDS)
            sizes = np.diff(offsets)
            signs = signatures(hashes, offsets, factors).view(np.int64)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt))))) for salt in (0, 0x5DEECE66D)]
            prints = [pa.array((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64)) for s in sums]
            filled = sizes > 0
            places = np.concatenate((np.zeros(1, np.int32), np.cumsum(np.where(filled, COORDINATES, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(places, pa.array(signs[filled].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(sizes), *prints, lists], names=["doc_id", "print", "n", "p1", "p2", "sig"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("print")).mapInArrow(
        run, "doc_id long, print long, n long, p1 long, p2 long, sig array<long>"
    )


def _postings(reps: DataFrame) -> DataFrame:
    """(item, node, n, weight): the prefix postings under values that at least two sets share."""
    items = reps.select("node", "n", F.posexplode("sig").alias("at", "value")).select("node", "n", F.xxhash64("at", "value").alias("item"))
    shared = items.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    own = items.join(shared, "item").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "item"))).alias("own"))  # at most 64
    rare = COORDINATES - MATCHES + 1 - (COORDINATES - F.size("own"))  # values of one set alone come first in the prefix
    prefix = own.where(rare > 0).select("node", "n", F.explode(F.slice("own", 1, rare)).alias("p"), F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["freq"]).alias("weight"))
    return prefix.select("p.item", "node", "n", "weight")


def _sizes_fit(a: str, b: str):
    """Sets whose sizes alone rule out the threshold can't be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree on enough coordinates."""
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    agreed = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return pairs.where(agreed >= MATCHES).select("a", "b")


def _texts_of(nodes: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the sets in question; an id may have several texts, so the text's hash tells which is meant."""
    wanted = names.join(nodes, "node")
    return texts.join(wanted.hint("shuffle_hash"), ["doc_id", "print"]).select("node", "text")


def _links(pairs: DataFrame, names: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs confirmed on the whole sets of their texts.

    The texts in question are written, so that both joins shuffle for themselves and a head with very many
    partners is split at run time.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = scratch.write(_texts_of(wanted, names, texts), "texts")
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def run(batches):
        for batch in text_slices(text_slices(batches, "text_a", HASH_SLICE), "text_b", HASH_SLICE):
            (left, lo), (right, ro) = (shingle_sets(batch.column(c), WORDS) for c in ("text_a", "text_b"))
            linked = []
            for i in range(batch.num_rows):
                x, y = left[lo[i] : lo[i + 1]], right[ro[i] : ro[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _list_links(table: pa.Table) -> pa.Table:
    """One tile pair of a list -> links between different groups that make them one; the rest are skipped."""
    hashes, offsets = shingle_sets(table.column("text").combine_chunks(), WORDS)
    nodes, comps = (table.column(c).to_numpy() for c in ("node", "comp"))
    sizes = np.diff(offsets)
    _, vocabulary = np.unique(hashes, return_inverse=True)
    present = np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 1, np.int64)
    group = np.unique(comps, return_inverse=True)[1]
    members = np.bincount(group)
    met = group == members.argmax()  # one largest group as it is now: all others meet it, so its own members need not start
    a, b = [], []
    for i in np.argsort(members[group], kind="stable"):
        if met[i]:
            continue
        mine = vocabulary[offsets[i] : offsets[i + 1]]
        present[mine] = 1
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(present[vocabulary])))
        present[mine] = 0
        common = sums[offsets[1:]] - sums[offsets[:-1]]
        linked = (common > 0) & (100 * common >= PERCENT * (sizes + sizes[i] - common)) & (group != group[i])
        for j in np.flatnonzero(linked):
            if group[j] != group[i]:
                a.append(nodes[i])
                b.append(nodes[j])
                old, new = group[i], group[j]
                group[group == old] = new
                members[new] += members[old]
                members[old] = 0
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the smallest id that links lead to, kept tells whether it is the row's own. Null,
    empty and blank texts have no shingles and are linked with nothing. Rows that share an id are
    judged by their own texts. A row without an id is linked with nothing, has no component and is kept.
    """
    rows = scratch.write(shingle_signatures(docs, id, text), "signatures")
    known = rows.where("doc_id is not null and n > 0")
    classes = known.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("first"), F.min_by("print", "doc_id").alias("print"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # one id may stand for several texts
    own = classes.withColumnRenamed("print", "own").hint("shuffle_hash")
    reps = rows.join(own, ["n", "p1", "p2"]).where("doc_id = first and print = own").select("node", "n", "sig").dropDuplicates(["node"])
    reps = scratch.write(reps, "reps")
    postings = scratch.write(_postings(reps), "postings")
    names = scratch.write(classes.select("node", F.col("first").alias("doc_id"), "print"), "names")
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))

    heads = postings.groupBy("item").agg(F.max(F.struct("weight", F.negative("node").alias("order"), "node", "n")).alias("head"))
    led = postings.join(heads, "item").where((F.col("node") != F.col("head.node")) & _sizes_fit("n", "head.n"))
    first = led.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
    first = scratch.write(first, "pairs")
    links = scratch.write(_links(scratch.write(_agreeing(first, reps), "agreeing"), names, texts, scratch), "links")

    groups = scratch.write(connected_components(links, scratch), "groups")
    grouped = postings.join(groups.select("node", F.col("root").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    grouped = scratch.write(grouped, "grouped")
    open_lists = grouped.groupBy("item").agg(F.count(F.lit(1)).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    left = scratch.write(grouped.join(open_lists.select("item", "members"), "item"), "open")

    short = left.where(F.col("members") <= LONG_LIST)
    x, y = short.alias("x"), short.alias("y")
    apart = (F.col("x.item") == F.col("y.item")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _sizes_fit("x.n", "y.n")
    second = x.join(y, apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = scratch.write(_agreeing(second, reps), "agreeing")
    links = links.unionByName(scratch.write(_links(second, names, texts, scratch), "links"))

    tiles = F.ceil(F.col("members") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    long = left.where(F.col("members") > LONG_LIST).select("item", "node", "comp", tile.alias("tile"), tiles.alias("tiles"))
    long = long.select("item", "node", "comp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    units = long.select("item", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "comp")
    located = units.join(_texts_of(units.select("node").distinct(), names, texts), "node")
    links = links.unionByName(located.groupBy("item", "i", "j").applyInArrow(_list_links, "a long, b long"))

    groups = scratch.write(connected_components(links, scratch), "groups")
    smallest = scratch.write(groups.join(names, "node").groupBy("root").agg(F.min("doc_id").alias("component")), "smallest")
    named = groups.join(smallest, "root").select("node", "component")
    root = classes.join(named, "node", "left").select("n", "p1", "p2", F.coalesce("component", "first").alias("component"))
    judged = rows.select("doc_id", "n", "p1", "p2").join(root.hint("shuffle_hash"), ["n", "p1", "p2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they are.

    Of rows that share an id, all stay if one of their texts is kept. Rows without an id stay.
    """
    gone = components(docs, scratch, id=id, text=text).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("shuffle_hash"), docs[id].cast("long") == F.col("__gone"), "left_anti")
