"""Clusters, vector codes and exact copies against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcemeld.llm import exact_dedup, vector_codes
from sourcemeld.llm.centroid_clusters import ScalarTables, clusters
from sourcemeld.llm.exact_dedup import ContentTable, find_copies
from sourcemeld.llm.integers import LONGEST, floors
from sourcemeld.llm.vector_codes import BoxTree, DualWalk, compress

#: Vectors and columns whose names the operators use themselves.
VECTORS = "vec_id long, embedding array<double>, label string, cluster string, distance int, dim int, codes int, error string, k0 int, v int"


def vector_rows(seed, n, width, most=1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-most, most) for _ in range(width)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, f"l{(i or 0) % 3}" if (i or 0) % 7 else None, "c", 1, 2, 3, "e", 4, 5) for i, v in rows], VECTORS).repartition(3)


def odd_vectors(width):
    base = vector_rows(1, 90, width)
    copies = [(200 + i, base[5][1]) for i in range(40)]
    bad = [(300, None), (301, []), (302, [None] + [0.0] * (width - 1)), (303, [math.nan] + [0.0] * (width - 1)), (304, [math.inf] * width)]
    return base + copies + [(None, base[7][1]), (3, base[3][1]), (3, base[4][1]), (305, [0.0] * width), (306, [-0.0] * width)], bad


def whole(vector, scale):
    return [math.floor(Fraction(x) * scale) for x in vector]


def lloyd(points, centroids, rounds):
    """Plain rounds over whole numbers; (centroids, assignment, distances)."""
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    nearest = lambda p: min(range(len(centroids)), key=lambda c: (far(p, centroids[c]), c))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for p in points:
            mine[nearest(p)].append(p)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    best = [nearest(p) for p in points]
    return centroids, best, [far(p, centroids[b]) for p, b in zip(points, best)]


def plain_clusters(rows, k, rounds, scale):
    chance = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    start = [whole(v, scale) for _, v in sorted(rows, key=chance)[:k]]
    centroids, best, far = lloyd([whole(v, scale) for _, v in rows], start, rounds)
    return centroids, sorted((-1 if i is None else i, b, min(d, LONGEST)) for (i, _), b, d in zip(rows, best, far))


def found_clusters(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in df.collect())


def test_clusters_of_odd_vectors(spark, scratch):
    good, bad = odd_vectors(6)
    rows = table(spark, good + bad + [(307, [0.5] * 5)])
    out, centroids = clusters(rows, scratch, k=7, rounds=3, scale=64, width=6)
    want, assigned = plain_clusters(good, 7, 3, 64)
    assert centroids == want and found_clusters(out) == assigned
    assert set(out.columns) == set(rows.columns) and {r["label"] for r in out.collect()} == {"l0", "l1", "l2", None}
    none, no_centroids = clusters(rows.limit(0), scratch, k=7, rounds=2, scale=64, width=6)
    assert none.collect() == [] and no_centroids == []
    few, three = clusters(rows.where("vec_id in (0, 1, 2)"), scratch, k=7, rounds=2, scale=64, width=6)
    assert len(three) == 3 and few.count() == 3


@pytest.mark.parametrize("most", [300.0, 1e6, 1e12, 1e30])
def test_clusters_of_large_components(spark, scratch, most):
    rows = vector_rows(2, 40, 4, most) + [(100, [0.25] * 4), (101, [-most] * 4)]
    out, centroids = clusters(table(spark, rows), scratch, k=5, rounds=2, scale=64, width=4)
    assert (centroids, found_clusters(out)) == plain_clusters(rows, 5, 2, 64)


def test_tables_grow_with_the_values():
    rng = np.random.default_rng(3)
    tables = ScalarTables(rng.integers(-9, 9, (4, 3)))
    for span in (5, 50, 20, 10**6):
        vectors = rng.integers(-span, span, (100, 3))
        apart = ((vectors[:, None] - tables.centroids[None]) ** 2).sum(axis=2)
        best, far = tables.nearest(vectors)
        assert (best == apart.argmin(axis=1)).all() and (far == apart.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds, scale):
    width = len(rows[0][1]) // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, codes, error = [], [[] for _ in rows], [0] * len(rows)
    for p in range(parts):
        cut = lambda v: whole(v, scale)[p * width : (p + 1) * width]  # noqa: E731, B023
        book, best, far = lloyd([cut(v) for _, v in rows], [cut(v) for _, v in first], rounds)
        books.append(book)
        for i, (b, d) in enumerate(zip(best, far)):
            codes[i].append(b)
            error[i] += d
    return books, sorted((-1 if i is None else i, c, min(e, LONGEST)) for (i, _), c, e in zip(rows, codes, error))


def found_codes(coded):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], list(r["codes"]), r["error"]) for r in coded.collect())


def found_books(books):
    out = {}
    for r in sorted(books.collect(), key=lambda r: (r["dim"], r["part"], r["entry"])):
        out.setdefault(r["dim"], {}).setdefault(r["part"], []).append([int(x) for x in r["numbers"]])
    return {dim: list(b.values()) for dim, b in out.items()}


def test_codes_of_odd_vectors(spark, scratch, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    monkeypatch.setattr(vector_codes, "LEAF", 4)
    good, bad = odd_vectors(8)
    other = vector_rows(5, 30, 4)
    rows = table(spark, good + bad + [(i + 400, v) for i, v in other] + [(500, [1.0] * 7)])
    coded, books = compress(rows, scratch, parts=4, entries=6, rounds=3, scale=4096)
    want_books, want = plain_codes(good, 4, 6, 3, 4096)
    more_books, more = plain_codes([(i + 400, v) for i, v in other], 4, 6, 3, 4096)
    assert found_books(books) == {8: want_books, 4: more_books} and found_codes(coded) == sorted(want + more)
    assert set(coded.columns) == set(rows.columns) - {"embedding"}
    empty, no_books = compress(rows.limit(0), scratch)
    assert empty.collect() == [] and no_books.collect() == []
    few, small = compress(rows.where("vec_id in (0, 1)"), scratch, parts=4, rounds=1)
    assert few.count() == 2 and small.count() == 8


@pytest.mark.parametrize("most", [300.0, 1e12, 1e30])
def test_codes_of_large_components(spark, scratch, most):
    rows = vector_rows(6, 40, 4, 1.0) + [(100 + i, v) for i, v in vector_rows(7, 10, 4, most)]
    coded, books = compress(table(spark, rows), scratch, parts=2, entries=5, rounds=2, scale=4096)
    want_books, want = plain_codes(rows, 2, 5, 2, 4096)
    assert found_books(books) == {4: want_books} and found_codes(coded) == want


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_walk_is_exact_and_assigns_whole_nodes(k):
    rng = np.random.default_rng(k)
    centres = rng.integers(-4000, 4000, (k, 3))
    points = np.concatenate((centres[rng.integers(0, k, 600)] + rng.integers(-30, 30, (600, 3)), rng.integers(-5, 5, (200, 3)), np.repeat(centres[:1], 50, axis=0)))
    entries = np.concatenate((centres, centres[:1]))  # a tie throughout
    walk = DualWalk(BoxTree.build(points, 8), BoxTree.build(entries, 1))
    best = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (walk.codes() == best).all()
    totals = walk.totals()
    assert all((totals[e, :3] == points[best == e].sum(axis=0)).all() and totals[e, 3] == (best == e).sum() for e in range(len(entries)))
    assert k < 5 or sum(len(nodes) for _, nodes, _ in walk.whole) > 0 and len(walk.points) < len(points)


def test_floors_are_exact():
    values = np.array([0.1, -0.1, 1e300, -1e300, 2.0**53 + 2, -0.0, 5e-324, -5e-324])
    assert [int(x) for x in floors(values, 4096)] == whole(values.tolist(), 4096)


def plain_copies(rows):
    """(id, keep_id, group_size, kept) of every row, as often as the row occurs."""
    groups = {}
    for i, body in rows:
        groups.setdefault(body, []).append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def found_copies(df, id="doc_id"):
    return sorted(((r[id], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def test_copies_of_odd_documents(odd, none, scratch):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    out = find_copies(odd, scratch)
    assert found_copies(out) == plain_copies(rows)
    assert {bytes(r["digest"]).hex() for r in out.collect()} == {hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    assert find_copies(none, scratch).collect() == []
    spaced = find_copies(odd, scratch, content=F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    assert spaced.where("doc_id in (8, 9)").select("keep_id").distinct().count() == 2  # empty is not a blank


def test_buckets_that_do_not_fit_are_dealt_again(spark, scratch, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", 1 << 20)
    monkeypatch.setattr(exact_dedup, "FITTING_BYTES", 2000)
    rng = random.Random(4)
    texts = [f"{'x' * rng.randint(1, 60)}{rng.randint(0, 300)}" for _ in range(900)] + ["the same words " * 20] * 500 + ["y" * 5000] * 9 + ["z" * 7000]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "nobody"), (None, "nobody"), (1, texts[1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    written = []
    write = scratch.write
    monkeypatch.setattr(scratch, "write", lambda df, name: written.append(name) or write(df, name))
    assert found_copies(find_copies(docs, scratch)) == plain_copies(rows)
    assert written.count("spill") >= 2


def test_table_compares_contents_not_hashes():
    texts = ["a", "b", "a", "c", "b", "", "a", ""]
    content = pa.array([t.encode() for t in texts], pa.binary())
    for hashes in (np.zeros(8, np.uint64), np.arange(8, dtype=np.uint64) * 0 + np.uint64(2**64 - 1)):
        assert list(ContentTable(content, hashes).first_rows()) == [0, 1, 0, 3, 1, 5, 0, 5]
