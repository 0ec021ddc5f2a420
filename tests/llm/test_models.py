"""Language, quality and the whole pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, odd_rows, words

import corpus_pipeline
from sourcemeld.llm import language_id, quality
from sourcemeld.llm.language_id import held_out, identify, learn, least_score
from sourcemeld.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def read(spark, name, sf_dir=SF_DIR):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op10_language_id"](spark, SF_DIR).join(read(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(spark, odd, none):
    network = language_id.learn(read(spark, "documents").limit(300))
    out = language_id.identify(odd, network)
    assert out.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"] and out.count() == odd.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.identify(none, network).collect() == [] and language_id.learn(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 5, raising=False)
    rows = [(i, words(i, 8), f"l{i % 70:02d}") for i in range(700)]
    network = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert network.languages == [f"l{i:02d}" for i in range(70)]


def test_every_window_counts():
    data = np.arange(1, 1 + 600, dtype=np.uint64).astype(np.uint8)
    windows, rows = language_id._windows(data, np.array([0, 0, 256, 599, 600]))
    assert rows.tolist() == [1, 2, 2, 3] and windows[2][87:].sum() == 0
    assert b"".join(w.tobytes() for w in windows).replace(b"\0", b"") == data.tobytes().replace(b"\0", b"")


def test_network_gradient():
    """Training lowers the loss on a separable toy problem."""
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 80)
    windows = np.where(labels[:, None] == 1, rng.integers(65, 75, (80, 256)), rng.integers(70, 90, (80, 256))).astype(np.uint8)
    net = language_id.train(windows, labels, ["a", "b"], steps=60, batch=16)
    assert (net.log_probabilities(windows).argmax(axis=1) == labels).mean() > 0.95


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op6_quality"](spark, SF_DIR).join(read(spark, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_documents(spark, odd, none, scratch):
    labels = read(spark, "labels")
    model = quality.fit(quality.measure(read(spark, "documents"), scratch), labels, scratch)
    assert np.all(np.diff(model.levels) >= 0)
    rows = quality.score(quality.measure(odd, scratch), model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit(quality.measure(none, scratch), labels, scratch) is None
    assert quality.score(quality.measure(none, scratch), None).collect() == []
    assert {r["score"] for r in quality.score(quality.measure(odd, scratch), None).collect()} == {0.5}


def test_isotonic_is_the_best_rising_fit():
    totals, positives = np.array([2.0, 2, 2, 4, 1]), np.array([1.0, 0, 2, 1, 1])
    fit = quality.isotonic(totals, positives)
    assert np.all(np.diff(fit) >= 0)
    loss = lambda f: (totals * (f - positives / totals) ** 2).sum()
    rng = np.random.default_rng(0)
    assert all(loss(fit) <= loss(np.sort(rng.random(5))) + 1e-12 for _ in range(300))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Given documents beside planted and odd ones, with extra columns."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang = 'en'").limit(120).withColumn("doc_id", F.col("doc_id") + 10_000)
    given = given.select(*[F.col(c) if c in given.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    passage = words(77, 70)
    planted = [(100_001, words(78, 90) + " " + item), (100_002, words(79, 90) + " " + passage), (100_003, words(80, 90) + " " + passage), (100_004, "12 34 56"), (None, words(81, 90) + " " + item)]
    planted = [(i, t, "en", "s", len(t), None, None, None, None, None, None, None, None) for i, t in planted]
    extra = spark.createDataFrame(planted + odd_rows(), SCHEMA)
    given.unionByName(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    read(spark, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_decide(spark, corpus, scratch):
    docs = read(spark, "documents", corpus)
    columns, passage = docs.columns, words(77, 70)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, corpus), name)
        assert docs.columns == columns and docs.schema == read(spark, "documents", corpus).schema
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {7, 8, 9, 17, 100_004} & set(seen["language_id"])
    assert {1, 100_001, 100_002, 100_003} <= set(seen["language_id"])
    assert {2, 3, 4} & set(seen["near_duplicates"]) == set() and 1 in seen["near_duplicates"]
    assert passage in seen["repeat_removal"][100_002] and passage[5:-5] not in seen["repeat_removal"][100_003]
    assert 100_001 not in seen["decontamination"] and {100_002, 100_003, 1} <= set(seen["decontamination"])
    assert docs.where(F.contains("text", F.lit(read(spark, "benchmark").first()["text"]))).count() == 0  # rows without id included
    assert all(r["n_chars"] == len(r["text"]) for r in docs.where("doc_id = 100003").collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert sorted(x or 0 for x in seen["decontamination"]) == sorted({r["doc_id"] or 0 for r in coded.collect()})


def test_least_score_follows_held_out_texts(spark, none):
    docs = read(spark, "documents")
    network = learn(docs)
    least = least_score(docs, network)
    right = identify(docs.where(held_out(F.col("doc_id"))), network).where("lang_pred = lang")
    assert 0.9 / len(network.languages) <= least <= right.agg(F.min("score")).first()[0]
    assert identify(docs, network).where(F.col("lang_pred") == F.col("lang")).where(F.col("score") < least).count() == 0
    assert least_score(none, network) == 0.0 and least_score(docs, None) == 0.0


def test_least_score_sees_every_held_out_text(spark):
    docs = read(spark, "documents", "/root/testdata/sf0.1")
    network = learn(docs)
    right = identify(docs.where(held_out(F.col("doc_id"))), network).where("lang_pred = lang")
    scores = sorted(r["score"] for r in right.select("score").collect())
    exact = max(scores[len(scores) // 1000], 1 / len(network.languages))
    assert 0 <= 0.9 * exact - least_score(docs, network) < 1 / language_id.SCORE_STEPS


def test_run_is_the_stages_in_turn(spark, corpus):
    docs = read(spark, "documents", corpus)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeat_removal", "decontamination", "encoding"]
    out = corpus_pipeline.run(spark, corpus)
    assert 0 < out.count() < docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
