"""Near duplicates and repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from samples import words

from sourcemeld.llm import minhash_dedup, repeat_removal
from sourcemeld.llm.batches import SpanHash
from sourcemeld.llm.run_index import RunIndex


def brute_components(rows):
    """Smallest reachable id of each text by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        s = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())
        sets[i] = s
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect() if r["doc_id"] is not None}


def test_odd_documents(odd, none, scratch):
    out = minhash_dedup.components(odd, scratch)
    assert found(out) == brute_components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert out.count() == odd.count()
    assert {(r["component_id"], r["kept"]) for r in out.where("doc_id is null").collect()} == {(None, True)}
    assert minhash_dedup.components(none, scratch).collect() == []
    kept = minhash_dedup.keep_one_of_each(odd, scratch)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.where("kept").collect()}


def chains(seed, groups=3, size=14):
    """Groups of near copies that drift, so that far members are linked through others only."""
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        text = words(100 * seed + g, 60).split()
        for _ in range(size):
            text = list(text)
            for _ in range(rng.choice((0, 1, 1, 2))):
                text[rng.randrange(len(text))] = words(rng.randrange(10**6), 1)
            rows.append((i, " ".join(text)))
            i += 1
    shared = words(7, 25)
    rows += [(i + k, f"{words(900 + k, 12)} {shared}") for k in range(12)]
    rng.shuffle(rows)
    return rows


def test_drifting_copies_and_long_lists(spark, scratch, monkeypatch):
    rows = chains(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    assert found(minhash_dedup.components(docs, scratch)) == want
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", 2)
    monkeypatch.setattr(minhash_dedup, "TILE", 5)
    assert found(minhash_dedup.components(docs, scratch)) == want


def test_several_texts_of_one_id(spark, scratch):
    """Each text of a repeated id has its own near copies, whichever of them comes first."""
    near = lambda seed: words(seed, 80) + " end"
    rows = [(5, words(k, 80)) for k in range(60, 66)] + [(10 + k, near(k)) for k in range(60, 66)] + [(3, near(61)), (200, words(99, 80)), (5, words(62, 80))]
    want = {(3, 3), (200, 200)} | {(10 + k, 3 if k == 61 else 5) for k in range(60, 66)}
    for parts in (1, 4):
        out = minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), scratch).collect()
        assert len(out) == len(rows) and {(r["doc_id"], r["component_id"]) for r in out if r["doc_id"] != 5} == want
        assert sorted(r["component_id"] for r in out if r["doc_id"] == 5) == [3, 5, 5, 5, 5, 5, 5]


@pytest.mark.parametrize("comps", [[0, 1, 2, 3], [0, 0, 2, 2], [0, 0, 2, 3]])
def test_one_tile_links_groups_of_equal_size(comps):
    """All singletons, two groups of equal size, and one largest group."""
    base = words(5, 60).split()
    texts = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in (0, 59, 0, 59)]  # near copies of each other
    tile = pa.table({"node": [0, 1, 2, 3], "comp": comps, "text": texts})
    out = minhash_dedup._list_links(tile)
    root = list(comps)
    for x, y in zip(out["a"].to_pylist(), out["b"].to_pylist()):
        root = [root[y] if r == root[x] else r for r in root]
    assert len(set(root)) == 1


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            if i is not None and (g not in first or first[g] > i):
                first[g] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((i or 0, spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def spans_of(df):
    return sorted((r["doc_id"] or 0, [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in df.collect())


def test_repeats_of_odd_documents(odd, none, scratch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = repeat_removal.remove_repeats(odd, scratch)
    assert spans_of(out) == brute_repeats(rows, 50)
    assert set(out.columns) == set(odd.columns)
    assert repeat_removal.remove_repeats(none, scratch).collect() == []


def test_repeats_over_many_slices_and_buckets(spark, scratch, monkeypatch):
    monkeypatch.setattr(repeat_removal, "_SLICE", 700)
    monkeypatch.setattr(repeat_removal, "BUCKET_BYTES", 1500)
    rng = random.Random(4)
    passages = [words(40 + k, 14) for k in range(6)] + ["ab" * 70, "z" * 90]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.6 else words(rng.randrange(10**6), 12) for _ in range(4)]
        rows.append((rng.randrange(50), "é".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert spans_of(repeat_removal.remove_repeats(docs, scratch)) == brute_repeats(rows, 50)
    for r in repeat_removal.remove_repeats(docs, scratch, characters=True).collect():
        bytes(r["kept"]).decode()  # whole characters only


def marked_texts(n, length=400):
    """Texts in which one string of twelve bytes, of a very small hash, stands in every window, between words that differ."""
    rng = random.Random(9)
    letters = "".join(chr(97 + k) for k in range(26))
    tried = [f"<m{k:09d}>" for k in range(20_000)]
    hashes = SpanHash(np.frombuffer("".join(tried).encode(), np.uint8)).windows(12)[::12]
    marker = tried[int(hashes.argmin())]
    return ["".join(marker + "".join(rng.choice(letters) for _ in range(24)) for _ in range(length // 36)) for _ in range(n)]


@pytest.mark.parametrize("hot_bytes", [200, 4 << 20])
def test_repeats_around_a_string_that_is_everywhere(spark, scratch, monkeypatch, hot_bytes):
    monkeypatch.setattr(repeat_removal, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(repeat_removal, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeat_removal, "BUCKET_BYTES", 500)
    texts = marked_texts(40)
    rows = [(i, t + texts[(7 * i) % 13][50:150] + t[:12] * (i % 5)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert spans_of(repeat_removal.remove_repeats(docs, scratch)) == brute_repeats(rows, 50)


def shipped(texts, groups, hot):
    """Packed bytes per group."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["doc_id", "text", "print"])
    sizes = {}
    for out in repeat_removal._split(groups, 50, hot)([batch]):
        for b, x in zip(out.column("bucket").to_pylist(), out.column("packed")):
            sizes[b] = sizes.get(b, 0) + len(x.as_buffer())
    return sizes


def test_a_string_in_every_window_does_not_fill_one_group(spark, monkeypatch):
    texts = marked_texts(2000, 1000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as print")
    size = sum(map(len, texts))
    monkeypatch.setattr(repeat_removal, "HOT_BYTES", size // 100)
    hot = repeat_removal._hot_anchors(docs, size, 50)
    assert 1 <= len(hot.hashes) < 10
    before = shipped(texts, 64, repeat_removal.HotAnchors(np.zeros(0, np.uint64)))
    after = shipped(texts, 64, hot)
    assert max(before.values()) > 0.2 * size and max(after.values()) < 0.06 * sum(after.values())


def test_packing_does_not_suffer_from_the_number_of_groups():
    texts = [words(i, 700) for i in range(1200)]
    nobody = repeat_removal.HotAnchors(np.zeros(0, np.uint64))
    few = sum(shipped(texts, 200, nobody).values())  # half a gigabyte
    assert sum(shipped(texts, 960, nobody).values()) < 1.15 * few  # 30 GB
    assert sum(shipped(texts, 2500, nobody).values()) < 1.2 * few  # five megabytes of text at a time


def test_matching_statistics():
    rng = random.Random(3)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abcd"
        base = "".join(rng.choice(letters) for _ in range(200))

        def piece():
            at = rng.randrange(150)
            s = list(base[at : at + rng.randrange(1, 100)])
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.choice(letters)
            return "".join(s).encode()

        held, asked = [piece() for _ in range(rng.randrange(1, 12))], [piece() + rng.choice([b"", b"z"]) for _ in range(5)]
        labels = np.array([rng.randrange(100) for _ in held])
        flat = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.array([len(s) for s in x]))
        index = RunIndex(*flat(held), labels)
        sizes, rows = index.matching_statistics(*flat(asked))
        smallest, at = index.smallest_label(rows), 0
        for q in asked:
            for i in range(len(q)):
                most = max(k for k in range(len(q) - i + 1) if k == 0 or any(q[i : i + k] in r for r in held))
                assert sizes[at] == most
                if most >= 50:
                    assert smallest[at] == min(x for r, x in zip(held, labels) if q[i : i + 50] in r)
                at += 1
