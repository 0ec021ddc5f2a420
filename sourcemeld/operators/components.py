"""Connected components by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemeld.operators.skew import lookup_join
from sourcemeld.session import Scratch

#: Edges that are contracted together inside a task.
LOCAL_EDGES = 1 << 19


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer hops: edges of near parents lie in one task, which ties their nodes to the smallest one it sees."""
    schema = edges.select("child", "parent").schema

    def local_stars(child: np.ndarray, parent: np.ndarray, nodes: int) -> np.ndarray:
        """Smallest node of each node's component; nodes are numbers in their order.

        Each round hooks the larger of two roots to the smaller one and then halves all paths until they are flat.
        """
        root = np.arange(nodes)
        while True:
            a, b = root[child], root[parent]
            apart = a != b
            if not apart.any():
                return root
            child, parent, a, b = child[apart], parent[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = root[root]
                if np.array_equal(shorter, root):
                    break
                root = shorter

    def stars(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        both = pa.chunked_array([*table["child"].chunks, *table["parent"].chunks], type=table["child"].type).combine_chunks()
        coded = both.dictionary_encode()
        order = pa.compute.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        root = local_stars(codes[: len(table)], codes[len(table) :], len(order))
        nodes = coded.dictionary.take(pa.array(order))
        inner = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(inner)), nodes.take(pa.array(root[inner]))], names=["child", "parent"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= LOCAL_EDGES:
                yield stars(waiting)
                waiting, n = [], 0
        if n:
            yield stars(waiting)

    return edges.select("child", "parent").repartitionByRange("parent").sortWithinPartitions("parent").mapInArrow(run, schema)


def _smallest_parent(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.min("parent").alias("top"), F.count(F.lit(1)).alias("parents"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    tops = _smallest_parent(edges)
    split = tops.where("parents > 1").select(F.col("child").alias("node"))
    inner = edges.select(F.col("parent").alias("node")).distinct().join(
        tops.select(F.col("child").alias("node")), "node", "left_semi"
    )
    return split.unionByName(inner).isEmpty()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hook a child's other parents to its smallest one."""
    tops = _smallest_parent(edges)
    many = tops.where("parents > 1").select("child", "top")
    moved = lookup_join(edges, many, "child", rows).where("top is not null and parent <> top")
    return (
        tops.select("child", F.col("top").alias("parent"))
        .unionByName(moved.select(F.col("parent").alias("child"), F.col("top").alias("parent")))
        .distinct()
    )


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Hook a child to the smallest parent of its parent."""
    tops = _smallest_parent(edges).select(F.col("child").alias("parent"), "top")
    return (
        lookup_join(edges, tops, "parent", rows)
        .select("child", F.coalesce("top", "parent").alias("parent"))
        .distinct()
    )


def _rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (child, parent), a written table."""
    current = edges
    while not _is_star_forest(current):
        rows = current.count()
        hooked = _large_star(_small_star(current, rows), 2 * rows)
        following = scratch.write(_large_star(hooked, 2 * rows), "edges")
        scratch.drop(current)
        current = following
    children = current.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    roots = current.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return children.unionByName(roots)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node.

    Tasks contract the edges that they hold. Then every child hangs on its smallest parent, and only what that leaves open is
    joined by rounds: parents that share a child, and parents that are children themselves. Chains of records with near ids leave little
    open; other chains lose some hops.

    Rounds of small-star and large-star steps (Kiveris et al., 2014) need a number of rounds
    that grows with the logarithm of the longest chain. All steps are minima and lookups, so
    no neighbourhood is ever gathered. Each round is a written table: lineage stays short and
    lost executors cost at most one round.
    """
    directed = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    pairs = scratch.write(directed, "pairs")
    current = scratch.write(_contracted(pairs), "edges")
    scratch.drop(pairs)
    tops = scratch.write(_smallest_parent(current), "tops")
    parents = scratch.write(current.select("parent").distinct(), "parents")
    many = tops.where("parents > 1")
    shared = lookup_join(current, many, "child", counted="parents").where("top is not null and parent <> top").select(F.col("parent").alias("child"), F.col("top").alias("parent"))
    inner = tops.join(parents.withColumnRenamed("parent", "child"), "child", "left_semi").select("child", F.col("top").alias("parent"))
    open_ = scratch.write(shared.unionByName(inner).distinct(), "open")
    highest = parents.join(tops.select(F.col("child").alias("parent")), "parent", "left_anti")
    below = tops.select(F.col("child").alias("node"), "top").unionByName(highest.select(F.col("parent").alias("node"), F.col("parent").alias("top")))
    if open_.isEmpty():
        return below.withColumnRenamed("top", "root")
    roots = _rounds(open_, scratch).withColumnRenamed("node", "top")
    return lookup_join(below, roots, "top").select("node", F.coalesce("root", "top").alias("root"))
