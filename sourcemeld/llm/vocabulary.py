"""Vocabulary files of byte-level BPE, read once on the driver and sent to the tasks.

A file has a fixed number of entries (about 50,000), so what is broadcast does not grow with
the corpus.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

import regex

#: The pattern that splits text before any merge, as the public tokenizers define it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary that is sent to tasks.
MAX_ENTRIES = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes -> id, where a lower id merges first, and special strings -> id."""

    ranks: dict[bytes, int]
    special: dict[str, int] = field(default_factory=dict)
    pattern: str = PATTERN


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in JSON vocabularies: itself if visible, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    """Read a ``.tiktoken`` rank file or a ``.json`` file with the merges in id order."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    else:
        special = {}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_ENTRIES:
        raise ValueError(f"{path} has {len(ranks)} entries, more than {MAX_ENTRIES}")
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} lacks single bytes {missing[:5]}")
    return Vocabulary(ranks, special, pattern)


class PieceSplitter:
    """Cuts texts into pieces by the pattern, with the work per distinct blank-separated chunk done once.

    A single blank between two characters that are no white space always starts a piece, so such
    chunks can be split apart from their surroundings and remembered. Texts with longer runs of
    white space around a blank are split as a whole. Values must add up with ``+``.
    """

    def __init__(self, pattern: str, value_of, join, limit: int = 600_000) -> None:
        self.find = regex.compile(pattern).findall
        self.value_of, self.join, self.limit = value_of, join, limit
        self.cuts = pattern == PATTERN
        self.ends = frozenset(".,;:!?") if self.cuts else frozenset()  # pieces of their own after a letter
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}  # what was known before; chunks still in use come back from there

    def _remember(self, chunk: str, value) -> None:
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        if len(chunk) <= 256:
            self.known[chunk] = value

    def _chunk(self, chunk: str):
        """The joined value of ``" " + chunk``, or None if blanks around it are not safe cuts.

        A word with a mark at its end is put together from the word, so only the word is remembered. So is a
        chunk with a line end inside: between characters that are no white space it is a piece of its own.
        """
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk[-1] in self.ends and chunk[-2:-1].isalpha():
            return self._inner(chunk[:-1]) + self.value_of(chunk[-1])
        return self._inner(chunk)

    def _inner(self, chunk: str):
        value = self.known.get(chunk)
        if value is not None:
            return value
        if self.cuts and "\n" in chunk:
            head, tail = chunk.split("\n", 1)
            if not head[-1].isspace() and not tail[0].isspace():
                rest = self.value_of(tail) if tail.isascii() and tail.isalpha() else self.join([self.value_of(p) for p in self.find(tail)])
                return self._chunk(head) + self.value_of("\n") + rest
        value = self.older.get(chunk)
        if value is None:
            value = self.join([self.value_of(p) for p in self.find(" " + chunk)])
        self._remember(chunk, value)
        return value

    def parts(self, text: str) -> list:
        """Values of consecutive parts of the text; joined they are the value of the whole."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            values = list(map(self.known.get, rest))
            for i, v in enumerate(values):
                if v is None:
                    v = values[i] = self._chunk(rest[i])
                    if v is None:
                        break
            else:
                return [self.value_of(p) for p in self.find(first)] + values
        return [self.value_of(p) for p in self.find(text)]
