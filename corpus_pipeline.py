"""From raw documents to token ids: five stages, each on all that its predecessor kept.

language_id       texts without a letter, or less sure of their language than held-out texts are, go
near_duplicates   one document of each group of near copies stays, the one with the smallest id
repeat_removal    passages of 50 bytes and more that an earlier document holds are cut out of texts
decontamination   documents that hold a benchmark item, also a reworded one, go
encoding          token ids of what is left

Every stage but the last returns the columns of its input, extra ones included. Null ids: such rows are
no duplicates; leaks are told by id and text, so they go like any other. Null and empty texts go at the first stage; a text that loses all its
passages stays as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.llm.bpe_codec import encode
from sourcemeld.llm.decontaminate import find_leaks
from sourcemeld.llm.language_id import UNKNOWN, identify, learn, least_score
from sourcemeld.llm.minhash_dedup import keep_one_of_each
from sourcemeld.llm.repeat_removal import remove_repeats
from sourcemeld.llm.vocabulary import load_vocabulary
from sourcemeld.session import Scratch

#: Bytes of a passage that counts as repeated.
PASSAGE = 50
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    network = learn(docs)
    sure = least_score(docs, network)
    predicted = identify(docs, network, lang_out="__lang", score_out="__score")
    return predicted.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= sure)).drop("__lang", "__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    return keep_one_of_each(docs, scratch or Scratch(spark))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    cut = remove_repeats(docs, scratch or Scratch(spark), length=PASSAGE, removed="__removed", kept="__kept", characters=True)
    touched = F.size("__removed") > 0
    text = F.when(touched, F.col("__kept").cast("string")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch or Scratch(spark))
    gone = leaks.select(F.col("doc_id").alias("__gone"), F.col("print").alias("__print")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__print"))
    return docs.join(gone, same, "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    coded = encode(docs, load_vocabulary(RANKS), keep=keep)
    return coded.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A learned model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each is written as Parquet and read again."""
    outputs = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        inner = Scratch(spark)
        before, docs = docs, outputs.write(stage(spark, docs, sf_dir, inner), name)
        inner.close()  # the stage's own tables are not needed once its output is written
        outputs.drop(before)
    return docs
