"""Vectors as short codes: one codebook per part position, fitted by a dual-tree version of Lloyd's rounds.

Blocks of vectors are turned into trees once: for every part position a balanced tree over the block's
parts, kept with the boxes and the sums of its leaves. A round walks the tree of the parts and the tree of the codebook's
entries together, level by level. Bounds on the distances between two boxes drop the combinations that can
hold no nearest entry; a node with one entry left is assigned as a whole by its cached sum; leaves
that stay uncertain compare their parts with the entries left, in whole numbers. Boxes hold whole numbers
too, so the result is that of comparing everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.llm.integers import CELLS, LONGEST, cells, finite, fits, floors, gathered, matrix, saturated
from sourcemeld.session import Scratch

#: Vectors of one block, and components at the most; parts in a leaf of a tree.
BLOCK, BLOCK_VALUES, LEAF = 4096, 1 << 20, 32


class BoxTree:
    """A balanced binary tree over points: every level is a row of nodes with boxes, sums and sizes.

    ``points`` are in the order of the leaves; ``order`` tells where they were.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, edges: np.ndarray, leaves: np.ndarray | None = None) -> None:
        self.points, self.order, self.edges = points, order, edges
        at = edges[:-1]
        if leaves is None:
            leaves = np.stack((np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.add.reduceat(points, at)))
        self.leaves = leaves
        low, high, sums = leaves
        sizes = np.diff(edges)
        self.levels = [(low, high, sums, sizes)]
        while len(low) > 1:  # two children each
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            sums, sizes = sums[::2] + sums[1::2], sizes[::2] + sizes[1::2]
            self.levels.insert(0, (low, high, sums, sizes))

    @staticmethod
    def edges_of(n: int, leaves: int) -> list[np.ndarray]:
        """Where the nodes of every level start and end, down to a power of two of leaves."""
        edges = [np.array([0, n])]
        while len(edges[-1]) <= leaves:
            mid = (edges[-1][:-1] + edges[-1][1:]) // 2
            edges.append(np.sort(np.concatenate((edges[-1], mid))))
        return edges

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> BoxTree:
        n = len(points)
        order, levels = np.arange(n), cls.edges_of(n, 1 << max(0, (n // leaf).bit_length() - 1))
        for edges in levels[:-1]:  # halve every node across its widest side
            node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            placed = points[order]
            wide = np.maximum.reduceat(placed, edges[:-1]) - np.minimum.reduceat(placed, edges[:-1])
            order = order[np.lexsort((placed[np.arange(len(order)), wide.argmax(axis=1)[node]], node))]
        return cls(points[order], order, levels[-1])


def _apart(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance between points of two boxes."""
    over, under = a[0] - b[1], b[0] - a[1]
    near = np.maximum(np.maximum(over, under), 0)
    far = np.maximum(np.abs(over), np.abs(under))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class DualWalk:
    """One walk over a tree of parts and the tree of the entries; the same for a round and for the final codes."""

    def __init__(self, tree: BoxTree, entries: BoxTree) -> None:
        self.tree, self.entries = tree, entries
        self.whole: list[tuple[int, np.ndarray, np.ndarray]] = []  # (level, nodes, entry of each)
        self.points = np.zeros(0, np.int64)  # parts of uncertain leaves, and the entry of each
        self.chosen = np.zeros(0, np.int64)
        self._walk()

    def _box(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of entry nodes; below the leaves every entry is a node of its own."""
        if level < len(self.entries.levels):
            low, high = self.entries.levels[level][:2]
            return low[nodes], high[nodes]
        return self.entries.points[nodes], self.entries.points[nodes]

    def _walk(self) -> None:
        last, single = len(self.tree.levels) - 1, len(self.entries.levels)
        part = entry = np.zeros(1, np.int64)
        i = j = 0
        while len(part):
            low, high = self.tree.levels[i][:2]
            near, far = _apart((low[part], high[part]), self._box(j, entry))
            best = np.full(len(low), LONGEST)
            np.minimum.at(best, part, far)
            keep = near <= best[part]
            part, entry = part[keep], entry[keep]
            if j == single:
                alone = np.bincount(part, minlength=len(low))[part] == 1
                self.whole.append((i, part[alone], self.entries.order[entry[alone]]))
                part, entry = part[~alone], entry[~alone]
                if i == last:
                    break
            if i < last:
                part, entry = np.concatenate((2 * part, 2 * part + 1)), np.concatenate((entry, entry))
                i += 1
            if j + 1 < single:
                part, entry = np.concatenate((part, part)), np.concatenate((2 * entry, 2 * entry + 1))
            elif j < single:
                edges = self.entries.edges
                sizes = np.diff(edges)[entry]
                part, entry = np.repeat(part, sizes), _ranges(edges[:-1][entry], sizes)
            j = min(j + 1, single)
        if len(part):
            self._compare(part, self.entries.order[entry])

    def _compare(self, leaf: np.ndarray, entry: np.ndarray) -> None:
        """Parts of the leaves left against the entries left for each, ties to the lower entry."""
        edges, k = self.tree.edges, len(self.entries.points)
        leaves = np.unique(leaf)
        sizes = np.diff(edges)[leaves]
        self.points = _ranges(edges[:-1][leaves], sizes)
        numbers = np.empty_like(self.entries.points)
        numbers[self.entries.order] = self.entries.points
        points = self.tree.points[self.points]
        left = np.zeros((len(leaves), k), bool)
        left[np.searchsorted(leaves, leaf), entry] = True
        left = np.repeat(left, sizes, axis=0)
        if 4 * len(leaf) > len(leaves) * k:  # many are left: whole columns are quicker than single pairs
            distances = np.zeros(left.shape, np.int64)
            for d in range(points.shape[1]):
                apart = points[:, d, None] - numbers[:, d]
                distances += apart * apart
            distances[~left] = LONGEST
        else:
            rows, against = np.nonzero(left)
            apart = points[rows] - numbers[against]
            distances = np.full(left.shape, LONGEST)
            distances[rows, against] = (apart * apart).sum(axis=1)
        self.chosen = distances.argmin(axis=1)

    def totals(self) -> np.ndarray:
        """Per entry the sums of its parts' components and, last, their number."""
        k, width = self.entries.points.shape
        out = np.zeros((k, width + 1), np.int64)
        for level, nodes, entry in self.whole:
            sums, sizes = self.tree.levels[level][2:]
            np.add.at(out, entry, np.column_stack((sums[nodes], sizes[nodes])))
        mine = self.tree.points[self.points]
        for e in np.unique(self.chosen):
            took = self.chosen == e
            out[e, :width] += mine[took].sum(axis=0)
            out[e, width] += int(took.sum())
        return out

    def codes(self) -> np.ndarray:
        """Entry of every part, in the order of the block."""
        placed = np.zeros(len(self.tree.points), np.int64)
        placed[self.points] = self.chosen
        for level, nodes, entry in self.whole:
            starts = np.concatenate(([0], np.cumsum(self.tree.levels[level][3])[:-1]))
            sizes = self.tree.levels[level][3][nodes]
            placed[_ranges(starts[nodes], sizes)] = np.repeat(entry, sizes)
        out = np.empty_like(placed)
        out[self.tree.order] = placed
        return out


class PlainWalk:
    """The same answers for parts so large that only Python integers hold their distances."""

    def __init__(self, points: np.ndarray, entries: np.ndarray) -> None:
        self.points, self.entries = points.astype(object), entries.astype(object)
        self.chosen = np.stack([((self.points - e) ** 2).sum(axis=1) for e in self.entries], axis=1).argmin(axis=1)

    def totals(self) -> np.ndarray:
        out = np.zeros((len(self.entries), self.entries.shape[1] + 1), object)
        for e in np.unique(self.chosen):
            mine = self.points[self.chosen == e]
            out[e] = [*mine.sum(axis=0), len(mine)]
        return out

    def codes(self) -> np.ndarray:
        return self.chosen


def _in_place(tree: BoxTree) -> np.ndarray:
    """The points in the order of the block."""
    points = np.empty_like(tree.points)
    points[tree.order] = tree.points
    return points


def _walk(tree: BoxTree, entries: np.ndarray) -> DualWalk | PlainWalk:
    if fits(entries.shape[1], tree.points, entries):
        return DualWalk(tree, BoxTree.build(entries, 1))
    return PlainWalk(_in_place(tree), entries)


_BLOCK_FIELDS = "dim int, rows long, points array<binary>, orders array<binary>, leaves array<binary>"


def _trees(parts: int, scale: int, names: list[str]):
    """Vectors -> blocks of one length each, with the tree of every part position and the other columns of the rows."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                step = int(max(1, min(BLOCK, BLOCK_VALUES // dim)))
                for start in range(0, same.num_rows, step):
                    yield block(same.slice(start, step), int(dim))

    def block(rows: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        n, width = rows.num_rows, dim // parts
        raw = matrix(rows.column("v"), n)
        points, orders, leaves = [], [], []
        for p in range(parts):
            mine = raw[:, p * width : (p + 1) * width]
            whole = floors(mine, scale)
            if fits(width, whole):
                tree = BoxTree.build(whole, LEAF)
                points.append(tree.points.tobytes())
                orders.append(tree.order.astype(np.int32).tobytes())
                leaves.append(tree.leaves.tobytes())
            else:  # no boxes: such parts are compared one by one
                points.append(np.ascontiguousarray(mine).tobytes())
                orders.append(b"")
                leaves.append(b"")
        others = [rows.column(c) for c in names]
        packed = pa.StructArray.from_arrays(others, fields=[pa.field(c, a.type) for c, a in zip(names, others)]) if names else pa.array([{}] * n)
        columns = [pa.array([dim], pa.int32()), pa.array([n]), *[pa.array([x], pa.list_(pa.binary())) for x in (points, orders, leaves)]]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), packed)], names=["dim", "rows", "points", "orders", "leaves", "kept"])

    return run


def _loaded(batch: pa.RecordBatch, parts: int, scale: int):
    """(place in the batch, length, tree of every part position) of each block."""
    for i in range(batch.num_rows):
        dim, n = batch.column("dim")[i].as_py(), batch.column("rows")[i].as_py()
        width, trees = dim // parts, []
        stored = [batch.column(c)[i].as_py() for c in ("points", "orders", "leaves")]
        for points, order, leaves in zip(*stored):
            if order:
                boxes = np.frombuffer(leaves, np.int64).reshape(3, -1, width)
                edges = BoxTree.edges_of(n, boxes.shape[1])[-1]
                trees.append(BoxTree(np.frombuffer(points, np.int64).reshape(n, width), np.frombuffer(order, np.int32), edges, boxes))
            else:
                whole = floors(np.frombuffer(points).reshape(n, width), scale)
                trees.append(BoxTree(whole, np.arange(n), np.array([0, n]), np.zeros((3, 1, width), np.int64)))
        yield i, dim, trees


def _round(books: dict[int, np.ndarray], parts: int, scale: int):
    """Blocks -> sums and counts of every entry, per length."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, dim, trees in _loaded(batch, parts, scale):
                found = np.stack([_walk(t, e).totals().astype(object) for t, e in zip(trees, books[dim])])
                totals[dim] = totals[dim] + found if dim in totals else found
        for dim, found in totals.items():
            yield cells(dim, found)

    return run


def _final(books: dict[int, np.ndarray], parts: int, scale: int, names: list[str]):
    """Blocks -> the rows of their vectors with length, codes and error."""

    def run(batches):
        for batch in batches:
            for i, dim, trees in _loaded(batch, parts, scale):
                kept = batch.column("kept").slice(i, 1).flatten()
                codes = np.empty((len(kept), parts), np.int32)
                error = np.zeros(len(kept), object)
                for p, (tree, entries) in enumerate(zip(trees, books[dim])):
                    codes[:, p] = _walk(tree, entries).codes()
                    points = _in_place(tree)
                    wide = np.int64 if fits(dim // parts, points, entries) else object
                    apart = points.astype(wide) - entries.astype(wide)[codes[:, p]]
                    error = error + (apart * apart).sum(axis=1).astype(object)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts).cast(pa.list_(pa.int32()))
                columns = [*[kept.field(c) for c in range(len(names))], pa.array(np.full(len(kept), dim, np.int32)), lists, pa.array(saturated(error))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "dim", "codes", "error"])

    return run


def compress(
    vectors: DataFrame,
    scratch: Scratch,
    *,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id: str = "vec_id",
    vector: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(coded rows, codebooks).

    Coded rows have all columns but the vector plus ``dim`` (its length), ``codes`` (the entry of each part) and ``error`` (squared distance
    to the coded vector, at most the largest long); columns of these names are replaced. Codebooks are (dim, part, entry, numbers), as
    decimal texts. A component x counts as floor(scale * x).

    Vectors that are null, empty, of a length that ``parts`` does not divide, or that hold a null, NaN or infinite component are
    left out. Vectors of different lengths have codebooks of their own. A codebook starts from the vectors with the smallest ids; null ids come
    last, rows that share an id go by their components. With fewer vectors than ``entries`` it has fewer entries; an
    entry without parts stays as it is. An empty table gives two empty tables.
    """
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c not in (vector, "dim", "codes", "error")]
    fields = T.StructType([T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(names)])
    good = vectors.where((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite(F.col(vector)))
    good = good.select(*[good[c].alias(f"k{i}") for i, c in enumerate(names)], good[id].alias("id"), F.size(vector).alias("dim"), good[vector].cast("array<double>").alias("v"))
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("id"), "v")
    first = good.select("dim", "id", "v").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= entries).select("dim", "nth", "v").collect()
    books: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in first}):
        whole = floors(np.array([r["v"] for r in sorted(first, key=lambda r: r["nth"]) if r["dim"] == dim]), scale)
        books[dim] = np.ascontiguousarray(whole.reshape(len(whole), parts, dim // parts).transpose(1, 0, 2))
    kind = T.StructType.fromDDL(_BLOCK_FIELDS).add("kept", T.ArrayType(fields))
    blocks = good.select(*[f.name for f in fields], "dim", "v").mapInArrow(_trees(parts, scale, [f.name for f in fields]), kind)
    blocks = scratch.write(blocks, "trees")
    narrow = blocks.drop("kept")
    for _ in range(rounds if books else 0):
        sums = gathered(narrow.mapInArrow(_round(books, parts, scale), CELLS))
        for dim, book in books.items():
            whole = book.astype(object)
            step = book.shape[2] + 1
            for at, (p, e) in enumerate(np.ndindex(*book.shape[:2])):
                count = sums.get((dim, at * step + step - 1), 0)
                if count:
                    whole[p, e] = [sums.get((dim, at * step + d), 0) // count for d in range(step - 1)]
            small = max(abs(x) for x in whole.ravel()) < 2**62
            books[dim] = whole.astype(np.int64) if small else whole
    out = T.StructType(list(fields.fields)).add("dim", T.IntegerType()).add("codes", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    coded = scratch.write(blocks.mapInArrow(_final(books, parts, scale, [f.name for f in fields]), out), "coded")
    coded = coded.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "dim", "codes", "error")
    rows = [(dim, p, e, [str(x) for x in book[p, e]]) for dim, book in books.items() for p, e in np.ndindex(*book.shape[:2])]
    return coded, spark.createDataFrame(rows, "dim int, part int, entry int, numbers array<string>")
