"""URL rules, shard tables, benchmark items and top-k against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import words

from sourcemeld.llm import top_k
from sourcemeld.llm.decontaminate import find_leaks
from sourcemeld.llm.queries import BLOCKED_HOSTS, URL_RULES
from sourcemeld.llm.sharding import _digest, fill_table, place
from sourcemeld.llm.url_filter import build_cascade, filter_urls


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:end]
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in URL_RULES if inside(r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        rule = max(fits, key=lambda r: (len(r), len(r.partition("/")[0])))
        return host, path, rule, URL_RULES[rule]
    return host, path, None, "block" if any(inside(h) for h in BLOCKED_HOSTS) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://a.ORG/x", "http://example.org/es/1", "http://m.EXAMPLE.org/es", "ftp://example.org/en/12?q=/es/",
    "http://notexample.org/es/", "http://x.com/fr/1#de", "http://x.com/de/", "http://x.com?/de/", "http://com/de/x", "http://a://b.org/", "http://spam-farm.example.com/en",
    "http://x.cheap-pills.example.com:80/", "http://cheap-pills.example.com", "http://É.org/ü\n/x", "://org/en", "http://org.com/fr", "http://" + "a." * 400 + "org/" + "x" * 5000, "http://free-bets.example.org/en/1",
]


def test_urls_of_every_shape(spark, scratch):
    rows = [(i, u, "extra") for i, u in enumerate(URLS)] + [(None, "http://org/", "x"), (3, "http://org/", "x"), (3, "http://org/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = filter_urls(pages, URL_RULES, BLOCKED_HOSTS, scratch, keep=["page_id"])
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out.collect())
    assert got == sorted(((i if i is not None else -1), *(x or "" if k == 2 else x for k, x in enumerate(judge(u)))) for i, u, _ in rows)
    empty = filter_urls(pages.limit(0), URL_RULES, BLOCKED_HOSTS, scratch, keep=["page_id"])
    assert empty.collect() == []
    assert {r["rule"] for r in filter_urls(pages, {}, [], scratch, keep=["page_id"]).collect()} == {None}


@pytest.mark.parametrize("listed", [0, 1, 7, 400])
def test_cascade_is_exact_over_its_universe(spark, scratch, listed):
    universe = spark.range(3000).selectExpr("cast(id as string) as key").unionByName(spark.createDataFrame([(None,), ("5",)], "key string"))
    keys = spark.range(listed).selectExpr("cast(id * 7 as string) as key").unionByName(spark.createDataFrame([(None,)], "key string"))
    cascade = build_cascade(keys, universe, scratch)
    found = {r["key"] for r in universe.where(cascade.contains(universe["key"])).collect()}
    assert found == {str(i * 7) for i in range(listed) if i * 7 < 3000}
    assert listed < 400 or len(cascade.levels) > 2


def plain_table(shards, size):
    wishes = [[(_digest(f"offset {s}") + i * (_digest(f"skip {s}") % (size - 1) + 1)) % size for i in range(size)] for s in shards]
    table, turn = {}, 0
    while len(table) < size:
        s = turn % len(shards)
        table[next(w for w in wishes[s] if w not in table)] = s
        turn += 1
    return [table[i] for i in range(size)]


def test_shard_tables():
    shards = [f"s{i}" for i in range(7)]
    table = fill_table(shards, 211)
    assert table == plain_table(shards, 211)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    fewer = fill_table(shards[:-1], 211)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 211  # few others move
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill_table(bad, 211)
    with pytest.raises(ValueError):
        fill_table(shards, 212)


def test_placement_of_odd_documents(odd, none):
    out = place(odd, "doc_id", ["a", "b", "c"], size=211)
    assert sorted(out.columns) == sorted([*odd.columns, "shard"]) and out.count() == odd.count()
    assert len({(r["doc_id"], r["slot"], r["shard"]) for r in out.collect()}) == len({r["doc_id"] for r in odd.collect()})
    assert place(none, "doc_id", ["a"], size=211).collect() == []


QUESTION = "A train leaves the station at noon and Alice drives 40 km in 3 hours while Robert walks 40 km along the river to meet her friend at the old bridge."


def test_reworded_questions(spark, odd, none, scratch):
    filler = words(50, 60)
    texts = [
        (1, f"{filler} {QUESTION} {filler}"),
        (2, f"{filler} " + QUESTION.replace("40", "75").replace("Alice", "Carol").replace("3", "8").replace("km", "miles")),
        (3, f"{filler} " + QUESTION.replace("40 km in", "75 km in").replace("Alice", "Robert")),  # two fillers for one, one for two
        (4, filler),
        (5, " ".join(QUESTION.split()[:6])),
        (6, QUESTION.upper()),
        (7, None),
        (8, ""),
        (1, "again " + filler),
    ]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, item_id int, hash int")
    items = spark.createDataFrame([(1, QUESTION, 1), (2, None, 1), (3, "", 1), (4, "too short an item", 1), (5, "seven words are one window here once", 1), (6, QUESTION, 1)], "item_id long, text string, pos int")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in find_leaks(docs, items, scratch).collect()}
    assert got == {(1, 1): False, (1, 6): False, (2, 1): True, (2, 6): True, (6, 1): False, (6, 6): False}
    short = spark.createDataFrame([(9, "well, Seven words are one window here once more")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(short, items, scratch).collect()] == [(9, 5)]
    assert find_leaks(odd, items, scratch).collect() == []
    assert find_leaks(none, items, scratch).collect() == [] and find_leaks(docs, items.limit(0), scratch).collect() == []


def test_documents_are_ids_with_their_texts(spark, scratch):
    """Two halves of an item make no leak, whether their rows have no id or share one; a whole item in a row without id does."""
    half = QUESTION.split()
    halves = [" ".join(half[:12]), " ".join(half[12:])]
    texts = [(None, halves[0]), (None, halves[1]), (7, halves[0]), (7, halves[1]), (None, f"{words(54, 20)} {QUESTION}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    whole = {r["print"]: r["doc_id"] for r in find_leaks(docs, items, scratch).collect() if r["coverage"] == 1.0}
    (row,) = docs.where(F.length("text") > len(QUESTION)).select(F.xxhash64("text").alias("print")).collect()
    assert whole == {row["print"]: None}
    apart = find_leaks(docs, items, scratch).where("coverage > 0.6")
    assert apart.count() == 1


def leaks(spark, scratch, text, item):
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, item)], "item_id long, text string")
    return [r["reworded"] for r in find_leaks(docs, items, scratch).collect()]


def test_names_at_sentence_starts_and_slots_of_other_length(spark, scratch):
    tom = "Tom has 12 apples. Anna gives Tom 7 apples. How many apples does Tom have now?"
    assert leaks(spark, scratch, "Bob has 30 apples. Mary gives Bob 4 apples. How many apples does Bob have now?", tom) == [True]
    trip = "we drive 40 km from Rome to the sea in 3 hours"
    assert leaks(spark, scratch, "we drive forty five km from New York to the sea in 8 hours", trip) == [True]
    assert leaks(spark, scratch, words(51, 40), tom) == []


def test_dense_and_short_items_are_found_as_they_are(spark, scratch):
    items = ["Evaluate 3 + 5 - 8 + 13 - 21 + 34", "Add 12 cm, 7 cm, 30 cm and 4 cm", "too short an item", "Solve for Tom Smith now please"]
    docs = spark.createDataFrame([(i, f"{words(52, 20)}, {t}, {words(53, 20)}") for i, t in enumerate(items)], "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["reworded"]) for r in find_leaks(docs, table, scratch).collect()) == [(i, i, False) for i in range(4)]


def test_given_items_are_found(spark, scratch):
    """All documents that share eight words in a row with an item, as a plain scan finds them."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    grams = lambda t: {tuple(w[k : k + 8]) for w in [t.lower().split()] for k in range(len(w) - 7)}
    known = [(r["item_id"], grams(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for g in [grams(r["text"])] for i, k in known if k and len(g & k) >= 0.5 * len(k)}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items, scratch).collect()} == want


def test_top_k_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 40)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, [0] * 6), (301, [1, 2]), (302, [2, 1])]
    odd = [(400, None), (401, []), (402, [1, None, 2, 3, 4, 5]), (None, rows[0][1]), (3, rows[3][1])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, v array<long>").repartition(3)
    queries = vectors.where("vec_id in (0, 3, 50, 100, 205, 300, 301, 400, 402)")
    got = {}
    for r in top_k.nearest(queries, vectors, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = dict(rows)
    for q in (0, 50, 100, 205, 300, 301):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in rows + [(3, rows[3][1])] if i != q and len(v) == len(good[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert 400 not in got and 402 not in got
    assert top_k.nearest(queries.limit(0), vectors, k=5).collect() == [] and top_k.nearest(queries, vectors.limit(0), k=5).collect() == []


@pytest.mark.parametrize("most", [10**6, 10**9, 2**62])
def test_top_k_of_large_components(spark, most):
    rng = random.Random(most)
    rows = [(i, [rng.randint(-most, most) for _ in range(5)]) for i in range(40)] + [(50, [1, 0, -1, 2, 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in top_k.nearest(vectors.where("vec_id in (3, 50)"), vectors, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (3, 50):
        exact = {i: sum(a * b for a, b in zip(dict(rows)[q], v)) for i, v in rows if i != q}
        best = sorted(exact, key=lambda i: (-exact[i], i))[:4]
        assert {(i, max(-(2**63), min(2**63 - 1, exact[i]))) for i in best} == set(got[q])


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-20, 20, (3000, 2)).astype(float)
    vectors[17] = 500, 400
    ids, scores, depth = top_k.SortedLists(np.arange(3000), vectors).best(np.array([3.0, 2.0]), -1, 1)
    assert ids[0] == 17 and scores[0] == 2300 and depth < 3000 and math.isfinite(depth)
