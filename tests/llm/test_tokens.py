"""Encoding, decoding and counting against the public libraries."""

import base64
import random
import sys
from itertools import chain

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sourcemeld.llm import bpe_codec
from sourcemeld.llm.bpe_codec import Codec, PerfectHash, decode, encode
from sourcemeld.llm.token_counts import PrefixCounter, count_tokens, truncate
from sourcemeld.llm.vocabulary import load_vocabulary

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(load_vocabulary(JSON))


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key {i}".encode() for i in range(3001)]
    table = PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(len(keys)))
    assert all(table.find(f"other {i}".encode()) == -1 for i in range(500))


def test_codec_equals_the_library(spark, odd, encoding):
    rows = encode(odd.select("doc_id", "text"), load_vocabulary(RANKS), decoded="decoded").join(odd.select("doc_id"), "doc_id", "left_semi").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    assert rows
    for r in rows:
        assert r["token_ids"] == encoding.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_codec_keeps_rows_and_clashing_columns(odd, none):
    vocabulary = load_vocabulary(RANKS)
    out = encode(odd, vocabulary)
    assert out.count() == odd.count() and "n_tokens" in out.columns and "kept" in out.columns
    back = decode(out, vocabulary, keep=["doc_id"])
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert encode(none, vocabulary).collect() == []


@pytest.mark.parametrize("text", ["  a   b \n\n c\t d  ", " \n", "'re's don't '' 'x", "a" * 3000, " " * 300, "　x  　 y", "\x85 \x1c \x1d x", "ab  \ncd", " x", "x ", "\n"])
def test_pieces_split_like_the_library(text, encoding):
    assert Codec(load_vocabulary(RANKS)).encode(text) == encoding.encode_ordinary(text)


def test_codec_remembers_a_bounded_number_of_bytes():
    codec = Codec(load_vocabulary(RANKS))
    for start in range(0, 400_000, 1000):
        codec.encode(" ".join(f"q{k:x}z" for k in range(start, start + 1000)))
    memories = codec.splitter.known, codec.splitter.older, codec.known
    held = sum(sys.getsizeof(m) + sum(map(sys.getsizeof, chain(m, m.values()))) for m in memories)
    assert held < 60 << 20


def test_a_word_before_a_line_end_is_merged_once(monkeypatch, encoding):
    merged = []
    monkeypatch.setattr(bpe_codec, "merge", lambda piece, merges, own=bpe_codec.merge: merged.append(piece) or own(piece, merges))
    codec = Codec(load_vocabulary(RANKS))
    for text in ("x qwzzky, y", "x qwzzky.\nXqzzv y", "x qwzzky\nXqzzv?\nXqzzv y"):
        assert codec.encode(text) == encoding.encode_ordinary(text)
    assert sorted(merged) == sorted(set(merged))


def test_line_ends_split_like_the_library(encoding):
    codec, rng = Codec(load_vocabulary(RANKS)), random.Random(3)
    parts = ["\n", "\n", "\n", " ", " ", " ", "a", "Word", "été", "中文", ".", "'s", "'", "12", "?!", "\t", "\r", "\x85", "\u3000", "\x1c", "🙂", "e\u0301"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert codec.encode(text) == encoding.encode_ordinary(text), repr(text)


def test_counts_equal_the_library(odd, none, tokenizer):
    counted = count_tokens(odd, load_vocabulary(JSON))
    assert counted.columns == [c for c in odd.columns if c not in ("text", "n_tokens")] + ["n_bytes", "n_tokens"]
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in counted.collect()) == want
    assert count_tokens(none, load_vocabulary(JSON)).collect() == []


@pytest.mark.parametrize("text", ["it's  we'll <|endoftext|> x", "a   b 'v 've <|endoft", "<|<|endoftext|>|>\n\n é🙂", "1234 56  78 !!?", "  ", ""])
def test_every_prefix_is_exact(text, counter, tokenizer):
    want = [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == want


def test_truncation_is_the_longest_fitting_prefix(odd, tokenizer):
    for r in truncate(odd.select("doc_id", "text").where("length(text) < 2000 or text is null"), load_vocabulary(JSON), 12, keep=["doc_id"]).collect():
        if r["truncated"]:
            assert len(tokenizer.encode(r["truncated"], add_special_tokens=False).ids) == r["n_tokens"] <= 12
