"""Exact token counts of whole texts and of all their prefixes.

A dynamic programme over a piece of text stores, for every prefix, the count and the last token
of its encoding. A prefix ending in token t has the encoding of the shorter prefix plus t exactly
if the last token before it and t stay apart when encoded together; at most one t does, so each
end of the piece costs one look at the tokens that end there (an Aho-Corasick automaton lists
them). Counts of prefixes of a text add up from its pieces, so truncation and budgets are lookups.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourcemeld.llm.batches import byte_lengths, text_slices
from sourcemeld.llm.bpe_codec import Merges, merge
from sourcemeld.llm.vocabulary import PieceSplitter, Vocabulary

_PIECES = 100_000  # remembered pieces per task; beyond that the memory starts anew
_JOINTS = 2_000_000  # remembered pairs of neighbouring tokens


class PrefixCounter:
    """Counts of one vocabulary. Special strings inside a text count as one token each."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ranks = vocabulary.ranks
        self.merges = Merges(self.ranks)
        self.token_bytes = {i: k for k, i in self.ranks.items()}
        self.shift = max(self.token_bytes).bit_length()
        self.joints: dict[int, bool] = {}
        self.known: dict[str, int] = {}
        self.splitter = PieceSplitter(vocabulary.pattern, self._piece, sum)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}  # built where it is used

    def _matches(self, piece: str):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for token, i in self.ranks.items():
                if merge(token, self.merges) == [i]:  # tokens no merge reaches never occur
                    self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self.automaton.make_automaton()
        return self.automaton.iter(piece)

    def _apart(self, left: int, right: int) -> bool:
        both = self.token_bytes[left] + self.token_bytes[right]
        found = merge(both, self.merges) == [left, right]
        if len(self.joints) >= _JOINTS:
            self.joints.clear()
        self.joints[left << self.shift | right] = found
        return found

    def piece_prefixes(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ... for one piece."""
        n = len(raw)
        counts, last = [0] * (n + 1), [0] * (n + 1)
        known, shift, apart = self.joints.get, self.shift, self._apart
        done = -1
        for end, (token, length) in self._matches(raw.decode("latin-1")):
            if end == done:
                continue  # a longer token was right for this end
            start = end + 1 - length
            if start:
                before = last[start]
                ok = known(before << shift | token)
                if ok is None:
                    ok = apart(before, token)
                if not ok:
                    continue
            last[end + 1], counts[end + 1], done = token, counts[start] + 1, end
        return counts

    def _piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.piece_prefixes(piece.encode())[-1]
            if len(self.known) >= _PIECES:
                self.known.clear()
            if len(piece) <= 256:
                self.known[piece] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.cut is None:
            return sum(self.splitter.parts(text))
        parts = self.cut(text)  # texts between special strings, and those at odd places
        return sum(sum(self.splitter.parts(p)) for p in parts[::2] if p) + len(parts) // 2

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ... text[:len]: one exact count per character prefix.

        A prefix may cut a piece, and then splits as its own text does: white space up to its end
        is one piece, an apostrophe suffix falls apart into apostrophe and letters, and an unfinished
        special string is ordinary text.
        """
        counts = np.zeros(len(text) + 1, np.int64)
        at, total = 0, 0
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:  # a special string: its own proper prefixes belong to the text before it
                start = at - len(before)
                for n in range(1, len(part)):
                    whole = before + part[:n]
                    counts[start + len(whole)] = total_before + self.count(whole)
                total += 1
                at += len(part)
                counts[at] = total
            else:
                before, total_before = part, total
                counts[at : at + len(part) + 1] = total + self._plain_prefixes(part)
                at += len(part)
                total = int(counts[at])
        return counts

    def _plain_prefixes(self, text: str) -> np.ndarray:
        counts = np.zeros(len(text) + 1, np.int64)
        total, at = 0, 0
        blank, blank_total = -1, 0  # where the white space around ``at`` began, and the count before it
        for piece in self.splitter.find(text):
            raw = piece.encode()
            widths = [len(c.encode()) for c in piece]
            own = np.array(self.piece_prefixes(raw))[np.cumsum(widths)]
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # 'll as ' and then letters
                letters = np.array(self.piece_prefixes(raw[1:]))[1:]
                own[1:-1] = own[0] + letters[: len(own) - 2]
            counts[at + 1 : at + 1 + len(piece)] = total + own
            lead = len(piece) - len(piece.lstrip())
            if lead:
                if blank < 0:
                    blank, blank_total = at, total
                run = text[blank : at + lead]
                ends = np.cumsum([len(c.encode()) for c in run])
                together = np.array(self.piece_prefixes(run.encode()))[ends]
                counts[at + 1 : at + 1 + lead] = blank_total + together[at - blank :]
            if lead < len(piece):
                blank = -1
            total += int(own[-1])
            at += len(piece)
            if lead < len(piece):
                counts[at] = total
        counts[at] = total  # the whole text as it stands
        return counts


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row plus n_bytes and n_tokens (long) of the whole text.

    Null and empty texts count 0 and 0. Rows are neither merged nor dropped; there is no shuffle.
    """

    def measure(counter: PrefixCounter, batch: pa.RecordBatch) -> list[pa.Array]:
        tokens = [counter.count(t) if t else 0 for t in batch.column("__text").to_pylist()]
        return [pa.array(byte_lengths(batch.column("__text"))), pa.array(tokens, pa.int64())]

    return _mapped(docs, vocabulary, text, keep, measure, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def truncate(docs: DataFrame, vocabulary: Vocabulary, budget: int, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus the longest prefix of at most ``budget`` tokens: truncated, n_tokens, over_limit.

    Counts need not grow with the prefix, so the last fitting one is taken. Null gives null, 0, false.
    """

    def measure(counter: PrefixCounter, batch: pa.RecordBatch) -> list[pa.Array]:
        cut, tokens, over = [], [], []
        for t in batch.column("__text").to_pylist():
            counts = counter.prefixes(t or "")
            end = int(np.flatnonzero(counts <= budget)[-1])
            cut.append(None if t is None else t[:end])
            tokens.append(int(counts[end]))
            over.append(bool(counts[-1] > budget))
        return [pa.array(cut, pa.string()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())]

    fields = [T.StructField("truncated", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return _mapped(docs, vocabulary, text, keep, measure, fields)


def _mapped(docs: DataFrame, vocabulary: Vocabulary, text: str, keep: list[str] | None, measure, fields: list[T.StructField]) -> DataFrame:
    keep = [c for c in docs.columns if c != text and c not in {f.name for f in fields}] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(PrefixCounter(vocabulary))
    names = [*keep, *[f.name for f in fields]]

    def run(batches):
        counter = shared.value
        for batch in text_slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(f"__k{i}") for i in range(len(keep))] + measure(counter, batch), names=names)

    narrow = docs.select(docs[text].alias("__text"), *[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)])
    return narrow.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + fields))
