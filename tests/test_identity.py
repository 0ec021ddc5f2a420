import random

import pytest
from pyspark.sql import functions as F

from sourcemeld.contract import Entity, Field
from sourcemeld.functions.kernels import lcs_lengths, ratios
from sourcemeld.operators import components, fuzzy, identity
from sourcemeld.operators.components import connected_components
from sourcemeld.operators.fuzzy import EXACT_FIELDS, NAME_FIELDS, best_candidates, block_plan, fuzzy_identity
from sourcemeld.operators.identity import exact_identity, group_evidence, record_key

PERSON = Entity(
    "employee",
    (
        Field("employee_id", required=True, unique=True), Field("first_name"), Field("last_name"),
        Field("email", unique=True), Field("department"),
    ),
    source_precedence=("legacy.csv", "crm.csv"),
)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
@pytest.mark.parametrize("hot", [False, True])
def test_components(spark, scratch, request, shape, hot):
    if hot:
        request.getfixturevalue("tiny_limits")
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "chain": [(i, i + 1) for i in range(70)],
        "star": [(5, i) for i in range(60)] + [(i, i + 100) for i in range(20)],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in connected_components(df, scratch).collect()} == union_find(edges)


def test_near_chains_leave_little_to_the_rounds(spark, scratch, monkeypatch):
    """Chains of 120 near ids: rounds see only what lies over the edges of tasks."""
    seen, rounds = [], components._is_star_forest
    monkeypatch.setattr(components, "_is_star_forest", lambda e: (seen.append(e.count()), rounds(e))[1])
    nodes = spark.range(12_000).where("id % 120 > 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = connected_components(nodes.repartition(7, "a"), scratch)
    assert found.where("root <> node - node % 120").count() == 0 and found.count() == 12_000
    assert max(seen, default=0) < 60, seen


@pytest.mark.parametrize("size", [1, 7])
def test_components_from_few_edges_at_a_time(spark, scratch, monkeypatch, size):
    monkeypatch.setattr(components, "LOCAL_EDGES", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        rng = random.Random(5)
        edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(130)]
        found = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.node: r.root for r in found} == union_find(edges) and len(found) == len(union_find(edges))


def test_components_do_not_depend_on_order_or_partitions(spark, scratch):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    results = []
    for n in (1, 5):
        rng.shuffle(edges)
        df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long").repartition(n)
        results.append(sorted(map(tuple, connected_components(df, scratch).collect())))
    assert results[0] == results[1]


def people(spark, rows):
    return spark.createDataFrame(
        rows, "record_id string, employee_id string, first_name string, last_name string, email string, department string"
    )


def test_exact_group_and_matched_fields(spark, scratch):
    df = people(
        spark,
        [("r1", "E1", "A", "B", "a@x", "D"), ("r2", " e1 ", "A", "B", "b@x", "D"), ("r3", "E2", "A", "B", "B@X", "D"), ("r4", "E9", "C", "D", None, "D")],
    )
    groups = exact_identity(df, PERSON, scratch)
    assert {r.record_id: (r.group_id, r.method) for r in groups.collect()} == {
        "r1": ("r1", "exact"), "r2": ("r1", "exact"), "r3": ("r1", "exact"), "r4": ("r4", "single"),
    }
    evidence = {r.group_id: (r.n_members, r.matched_fields) for r in group_evidence(df.join(groups, "record_id"), PERSON).collect()}
    assert evidence == {"r1": (3, []), "r4": (1, [])}


@pytest.mark.parametrize("hot", [False, True])
def test_keys_are_not_counted_again_to_find_hot_ones(spark, scratch, tiny_limits, tmp_path, monkeypatch, hot):
    rows = [(f"r{i:02d}", f"E{i // 2}", "A", "B", " \t" if i % 3 else f"m:{i}", "D") for i in range(12)]
    rows += [(f"s{i}", None, "A", "B", "Hot:" if i % 2 else " hot: ", "D") for i in range(5 if hot else 2)]
    people(spark, rows).write.parquet(str(tmp_path / "records"))
    own, plans = identity.connected_components, []

    def watched(edges, scratch):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return own(edges, scratch)

    monkeypatch.setattr(identity, "connected_components", watched)
    groups = exact_identity(spark.read.parquet(str(tmp_path / "records")), PERSON, scratch, rows=len(rows))
    assert {r.record_id: r.group_id for r in groups.collect()} == {
        r[0]: "s0" if r[0][0] == "s" else f"r{int(r[0][1:]) // 2 * 2:02d}" for r in rows
    }
    assert "Aggregate" not in plans[0]
    assert hot or plans[0].count("Relation") == 2


def test_same_names_with_other_keys_stay_apart(spark, scratch):
    df = people(spark, [("r1", "E1", "John", "Smith", "a@x", "D"), ("r2", "E2", "John", "Smith", "b@x", "D")])
    groups = exact_identity(df, PERSON, scratch)
    assert groups.select("group_id").distinct().count() == 2
    fuzzy_groups, reviews = fuzzy_identity(df, scratch)
    assert fuzzy_groups.where("method = 'fuzzy'").count() == 0 and reviews.count() == 0


def test_pair_decision_joins(spark, scratch):
    df = people(spark, [("r1", "E1", "J", "S", None, "D"), ("r2", "E2", "J", "S", None, "D")])
    same = spark.createDataFrame([("r2", "r1")], "record_a string, record_b string")
    assert {r.group_id for r in exact_identity(df, PERSON, scratch, same).collect()} == {"r1"}


def test_record_key_order(spark):
    df = people(spark, [("r1", " ", "J", "S", "m@x", "D"), ("r2", None, "J", "S", None, "D")])
    keys = {r.record_id: r.k for r in df.select("record_id", record_key(PERSON, df.columns).alias("k")).collect()}
    assert keys["r2"] is None


def test_lcs_kernel_against_plain_programme():
    rng = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for ch in a:
            new = [0]
            for j, other in enumerate(b):
                new.append(max(row[j] + (ch == other), row[j + 1], new[j]))
            row = new
        return row[-1]

    pairs = [("".join(rng.choice("abcé ") for _ in range(rng.randrange(15))), "".join(rng.choice("abcé ") for _ in range(rng.randrange(30)))) for _ in range(300)]
    left, right = zip(*pairs)
    assert list(lcs_lengths(left, right)) == [plain(a, b) for a, b in pairs]
    assert ratios(["", "ab"], ["", "ba"]).tolist() == [1.0, 0.5]


def brute_force(rows, floor=0.72):
    def score(a, b):
        parts = []
        for k in range(5):
            x, y = a[k + 1], b[k + 1]
            if x is not None and y is not None:
                parts.append(float(ratios([x], [y])[0]) if k < 2 else float(x == y))
        return sum(parts) / len(parts) if parts else 0.0

    best = {}
    for a in rows:
        ranked = sorted((score(a, b) for b in rows if b is not a), reverse=True)
        if ranked[0] >= floor - 1e-12:
            partners = {b[0] for b in rows if b is not a and abs(score(a, b) - ranked[0]) < 1e-9}
            best[a[0]] = (round(ranked[0], 6), round(ranked[1], 6) if ranked[1] >= floor - 1e-12 else 0.0, partners)
    return best


SCHEMA = "record_id string, first_name string, last_name string, email string, phone string, date_of_birth string"


@pytest.mark.parametrize("seed, tile", [(1, 2000), (2, 6), (3, 6)])
def test_fuzzy_candidates_equal_brute_force(spark, scratch, seed, tile):
    rng = random.Random(seed)
    first = ["John", "Jon", "Johnny", "Maria", "Marie", "Mary", "Al", "A", "Christopher", "Kristopher", "Zoë", None]
    last = ["Smith", "Smyth", "Smithe", "Garcia", "Garza", "Li", "O", "Featherstone", "Fetherstone", None]
    rows = [
        (
            f"r{i:04d}", rng.choice(first), rng.choice(last), rng.choice(["a@x", "b@x", None, None]),
            # one phone holds more than a third of the rows
            rng.choice(["1", "1", "1", "1", "2", "3", None, None]), rng.choice(["d1", "d2", None, None]),
        )
        for i in range(110)
    ]
    expected = brute_force(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.record_id: r for r in best_candidates(df, scratch, list(NAME_FIELDS), list(EXACT_FIELDS), tile_rows=tile).collect()}
    assert set(found) == set(expected)
    for record, (score, second, partners) in expected.items():
        assert (round(found[record].score, 6), round(found[record].second, 6)) == (score, second)
        assert found[record].partner in partners


@pytest.mark.parametrize("floor, tile", [(0.4, 2000), (0.5, 7), (0.6, 7), (0.7, 7)])
def test_low_floors_equal_brute_force(spark, scratch, floor, tile):
    rng = random.Random(int(floor * 10))
    first = ["ab", "ba", "bc", "a", "abcd", "Jon", "John", "x" * 50, "x" * 49 + "y", None, None]
    rows = [(f"r{i:04d}", rng.choice(first), rng.choice(["Li", "L", "Lo", "Smith", None]), None, rng.choice(["1", "1", "2", None]), rng.choice(["d", None])) for i in range(60)]
    expected = brute_force(rows, floor)
    found = {r.record_id: r for r in best_candidates(spark.createDataFrame(rows, SCHEMA), scratch, list(NAME_FIELDS), list(EXACT_FIELDS), floor=floor, tile_rows=tile).collect()}
    assert {k: (round(r.score, 6), round(r.second, 6)) for k, r in found.items()} == {k: v[:2] for k, v in expected.items()}
    assert all(found[k].partner in v[2] for k, v in expected.items())


def test_rows_of_a_hot_block_grow_with_its_records(spark, scratch, monkeypatch):
    """One phone on a third of all customers, whose names are much alike: rows that leave the tiles, per record."""
    left, compared = [], fuzzy._compared
    monkeypatch.setattr(fuzzy, "_compared", lambda *a: (out := scratch.write(compared(*a), "left"), left.append(out.count()))[0])
    share = []
    for sf in ("sf0.01", "sf0.1"):
        left.clear()
        customers = spark.read.parquet(f"/root/testdata/{sf}/customer.parquet").where("c_custkey % 3 = 0")
        people = customers.selectExpr(
            "concat('r', lpad(c_custkey, 9, '0')) as record_id", "c_name as first_name", "c_mktsegment as last_name", "'0' as phone",
        )
        n = people.count()
        assert best_candidates(people, scratch, ["first_name", "last_name"], ["phone"], tile_rows=100).count() == n
        share.append(sum(left) / n)
    assert share[1] < 1.6 * share[0], share


def test_big_blocks_take_only_name_sets_that_a_pair_has(spark, scratch):
    rows = [("a", 7, "Jon", "Li"), ("b", 7, "Joe", "Li"), ("c", 3, "Al", "Ek"), ("d", 3, "Ed", "Ek"), ("d", 1, "Ed", None)]
    big = spark.createDataFrame([(b, m if m < 7 else 3, x, y, 1, 1) for b, m, x, y in rows], "block string, nmask int, n0 string, n1 string, common bigint, agree bigint")
    found = {(r["block"][0], r["both"]) for r in fuzzy._by_names(big, scratch, 2).collect()}
    assert found == {("a", 3), ("b", 3), ("c", 3), ("d", 3), ("d", 1)}


def test_fuzzy_pairs_copies_and_apart(spark, scratch):
    rows = [
        ("a1", "Katherine", "Jones", None, "555", None), ("a2", "Kathrine", "Jones", None, "555", None),
        ("b1", "Bo", "Ek", None, "777", None), ("b2", "Bo", "Ek", None, "777", None),
        ("c1", "Copy", "Cat", None, "9", None), ("c2", "Copy", "Cat", None, "9", None), ("c3", "Copy", "Cat", None, "9", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    groups, reviews = fuzzy_identity(df, scratch)
    assert {r.record_id: r.group_id for r in groups.where("method = 'fuzzy'").collect()} == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1"}
    assert {r.record_id for r in reviews.collect()} == {"c1", "c2", "c3"}
    apart = spark.createDataFrame([("b2", "b1")], "record_a string, record_b string")
    groups, _ = fuzzy_identity(df, scratch, apart=apart)
    assert {r.record_id for r in groups.where("method = 'fuzzy'").collect()} == {"a1", "a2"}


def test_block_plan_is_the_weakest_that_is_enough():
    plan = block_plan([(7, 3)])
    assert {(b.common, b.agree) for b in plan} == {(7, 3), (7, 5), (7, 6), (7, 7)}
    assert {(b.common, b.agree) for b in block_plan([(0, 3)])} == {(0, 0)}


def test_letter_keys_miss_no_pair(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé Z") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", fuzzy.letter_keys(F.col("w")).alias("k"))
    keys = {r.w: set(r.k) for r in df.collect()}
    for a in keys:
        for b in keys:
            if a < b and ratios([a], [b])[0] >= 0.72:
                assert keys[a] & keys[b], (a, b)


def test_single_letters_serve_low_ratios(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé Z") for _ in range(rng.randrange(1, 7))) for _ in range(80)}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for floor in (0.4, 0.55, 0.66):
        keys = {r.w: set(r.k) for r in df.select("w", fuzzy.letter_keys(F.col("w"), floor).alias("k")).collect()}
        assert all(keys[a] & keys[b] for a in keys for b in keys if a < b and ratios([a], [b])[0] >= floor)


def test_near_texts_share_what_is_left(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for letters in (1, 2):
        keys = {r.w: set(r.k) for r in df.select("w", fuzzy.dropped(F.col("w"), letters).alias("k")).collect()}
        for a in keys:
            for b in keys:
                lcs = lcs_lengths([a], [b])[0]
                assert bool(keys[a] & keys[b]) == (max(len(a), len(b)) - lcs <= letters), (a, b)
