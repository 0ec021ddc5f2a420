"""Benchmark items inside documents, also with other numbers, names or units.

Texts become templates: numbers, names and units turn into typed placeholders, all other words are
lower-cased. Windows of ``WINDOW`` template tokens are joined by hash with those of the benchmark.
A document holds an item if enough windows match at offsets that are in order and the fillers of the
placeholders map one to one between item and document, so a question with other numbers is found, and a
chance likeness of frames is not.

Every text is read in three forms, each matched with itself: capitalised starts of sentences as plain words, the
same starts as names, and the bare words, which find exact copies of items that are short or full of placeholders.

Before the join, windows are tested against a bitmap of the benchmark's hashes of bounded size; windows that pass by chance
find no partner in the join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemeld.llm.batches import HASH_SLICE, SpanHash, flat_bytes, mix, text_slices
from sourcemeld.session import Scratch

WINDOW = 8  # template tokens
SHORTEST = 5  # items with fewer template tokens are looked for by their words only; up to 7 tokens are one window
LITERALS = 3  # words in a window that are no placeholders
ENOUGH = 6  # matching template windows (13 tokens in a row), or
COVERAGE = 0.5  # this share of the item's windows that can match
_BITS, _MOST_BITS = 22, 26  # of the bitmap: 512 KiB, and more for a benchmark of very many windows, up to 8 MiB

#: Words that are units or numbers in any text.
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds "
    "ml cl l litre litres liter liters gallon gallons ms sec second seconds minute minutes hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz kb mb gb tb byte bytes bit bits volt volts watt watts joule joules newton newtons degree degrees celsius fahrenheit "
    "dollar dollars euro euros cent cents usd eur gbp percent"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_WORD = _DIGIT | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_BREAK = np.isin(_BYTES, [ord(c) for c in '.!?:;\n"'])
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_PLAIN, _NAMED, _WORDS = range(3)  # the forms of a text


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = flat_bytes(pa.array(words))
    return np.sort(SpanHash(data).of(offsets[:-1], offsets[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _hash_words(UNITS), _hash_words(NUMBERS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Templates:
    """Tokens of the texts of a column in one form: row, kind, hash of the template token, hash of the words themselves.

    Placeholders of one kind with a blank or hyphen between them are one token ("forty five", "New York").
    """

    def __init__(self, column: pa.Array, form: int = _PLAIN) -> None:
        self.form = form
        data, offsets = flat_bytes(column)
        n = len(data)
        self.count = len(column)
        if not n:
            self.rows = np.zeros(0, np.int64)
            self.kinds, self.tokens, self.words = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        digit, inside = _DIGIT[data], _WORD[data]
        point = (data == ord(".")) | (data == ord(","))
        point[1:] &= digit[:-1]
        point[:-1] &= digit[1:]
        point[0] = point[-1] = False
        inside = inside | point
        new = inside.copy()
        new[1:] &= ~inside[:-1] | ((digit[:-1] | point[:-1]) & ~digit[1:] & ~point[1:])  # "5km" is two tokens
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        new[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        rows = np.searchsorted(offsets, starts, side="right") - 1
        lower = data.copy()
        lower[_UPPER[data]] += 32
        accented = np.zeros(n, bool)  # capital letters of Latin-1: 0xC3 and 0x80-0x9E
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower[accented] += 32
        spans = SpanHash(lower)
        words = spans.of(starts, ends)
        numeric = np.concatenate(([0], np.cumsum(digit | point)))
        number = numeric[ends] - numeric[starts] == ends - starts
        capital = _UPPER[data] | np.append(accented[1:], False)
        capitals = np.concatenate(([0], np.cumsum(capital)))
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        before = np.concatenate(([0], ends[:-1]))
        sentence = breaks[starts] > breaks[before]
        sentence[np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))] = True
        name = capital[starts] & (capitals[ends] - capitals[starts] == 1) & (ends - starts > 1)
        if form == _PLAIN:
            name &= ~sentence
        kinds = np.where(number | _among(words, _NUMBER_HASHES), _NUMBER, np.where(_among(words, _UNIT_HASHES), _UNIT, np.where(name, _NAME, _LITERAL)))
        if form == _WORDS:
            kinds = np.full(len(words), _LITERAL)
        else:
            gap = np.isin(data[np.minimum(before, n - 1)], (0x20, 0x2D)) & (starts - before == 1)
            again = gap & (kinds != _LITERAL)
            again[1:] &= (kinds[1:] == kinds[:-1]) & (rows[1:] == rows[:-1])
            again[:1] = False
            first = np.flatnonzero(~again)
            last = np.append(first[1:], len(kinds))[: len(first)] - 1
            rows, kinds, words = rows[first], kinds[first], spans.of(starts[first], ends[last])
        self.rows, self.kinds, self.words = rows, kinds, words
        self.tokens = np.where(kinds == _LITERAL, words, mix(kinds.astype(np.uint64)))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first token, hash) of the windows with enough literal words, or of all windows of bare words."""
        n = len(self.tokens) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = np.full(n, width + 16 * self.form, np.uint64)
        for k in range(width):
            hashes = mix(hashes + self.tokens[k : k + n] * np.uint64(2 * k + 3))
        literal = np.concatenate(([0], np.cumsum(self.kinds == _LITERAL)))
        ok = self.rows[width - 1 :] == self.rows[:n]
        if self.form != _WORDS:
            ok &= literal[width:] - literal[:n] >= LITERALS
        return np.flatnonzero(ok), hashes[ok]

    def fillers(self, firsts: np.ndarray, width: int) -> pa.ListArray:
        """Words behind the placeholders of each window, in order."""
        at = firsts[:, None] + np.arange(width)
        slot = self.kinds[at] != _LITERAL if len(firsts) else np.zeros((0, width), bool)
        offsets = np.concatenate(([0], np.cumsum(slot.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(self.words[at][slot].view(np.int64) if len(firsts) else np.zeros(0, np.int64)))


def _template_windows(texts: DataFrame, widths, test=None) -> DataFrame:
    """(id, print, form, width, hash, pos, total, fillers): one row per window, with the number of windows of its text that can match.
    ``widths`` picks the windows by form, width and the number of tokens of a text; ``test`` keeps those with certain hashes."""

    def run(batches):
        for batch in text_slices(batches, "text", HASH_SLICE):
            for form in (_PLAIN, _NAMED, _WORDS):
                found = Templates(batch.column("text"), form)
                sizes = np.bincount(found.rows, minlength=found.count)
                begins = np.cumsum(sizes) - sizes
                for width in range(1 if form == _WORDS else SHORTEST, WINDOW + 1):
                    wanted = widths(form, width, sizes)
                    if not wanted.any():
                        continue
                    firsts, hashes = found.windows(width)
                    rows = found.rows[firsts]
                    totals = np.bincount(rows, minlength=found.count)
                    ok = wanted[rows]
                    if test is not None:
                        ok = ok & test(hashes)
                    firsts, hashes, rows = firsts[ok], hashes[ok], rows[ok]
                    columns = [
                        batch.column("id").take(pa.array(rows)),
                        batch.column("print").take(pa.array(rows)),
                        pa.array(np.full(len(rows), form, np.int32)),
                        pa.array(np.full(len(rows), width, np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array((firsts - begins[rows]).astype(np.int32)),
                        pa.array(totals[rows].astype(np.int32)),
                        found.fillers(firsts, width),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "print", "form", "width", "hash", "pos", "total", "fillers"])

    return texts.mapInArrow(run, "id long, print long, form int, width int, hash long, pos int, total int, fillers array<long>")


def _one_to_one(slots: set) -> bool:
    return len({i for i, _ in slots}) == len(slots) == len({d for _, d in slots})


def _best_chain(runs: list[dict], total: int) -> tuple[int, set]:
    """(windows, fillers) of the best sequence of offsets in order, among those at most an item apart."""
    runs = sorted(runs, key=lambda r: r["offset"])
    offsets = [r["offset"] for r in runs]
    slots = [{(s["item"], s["doc"]) for s in r["slots"]} for r in runs]
    best = (0, set())
    for start, r in enumerate(runs):
        near = range(bisect_left(offsets, r["offset"] - total - WINDOW), bisect_right(offsets, r["offset"] + total + WINDOW))
        n, held, last = r["n"], slots[start], r
        for k in sorted(near, key=lambda k: runs[k]["low"]):
            x = runs[k]
            if x["low"] > last["high"] and x["low"] + x["offset"] > last["high"] + last["offset"] and _one_to_one(held | slots[k]):
                n, held, last = n + x["n"], held | slots[k], x
        if n > best[0]:
            best = n, held
    return best


def _chains(found: DataFrame) -> DataFrame:
    """(doc_id, print, item_id, form, total, n_windows, n_slots, reworded) from the runs of each document and item."""

    def run(batches):
        for batch in batches:
            best = [_best_chain(r, t) for r, t in zip(batch.column("runs").to_pylist(), batch.column("total").to_pylist())]
            more = [pa.array([n for n, _ in best], pa.int64()), pa.array([len(s) for _, s in best], pa.int64()), pa.array([any(i != d for i, d in s) for _, s in best], pa.bool_())]
            kept = ["doc_id", "print", "item_id", "form", "total"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, "n_windows", "n_slots", "reworded"])

    return found.mapInArrow(run, "doc_id long, print long, item_id long, form int, total int, n_windows long, n_slots long, reworded boolean")


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, reworded, print) for every document that holds an item.

    ``coverage`` is the share of the item's windows found in the best form, ``n_slots`` the different
    fillers in them, ``reworded`` tells whether any differs from the item's. Null and empty texts hold
    nothing; a document is an id, null or not, with its text, so rows that share an id are judged by their own texts and ``print``, the xxhash64
    of the text, tells them apart. Items with fewer than
    five template tokens are found as exact copies of their words, and repeated items are found each.
    """
    printed = lambda c: F.xxhash64(c).alias("print")
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"), printed(item_text))
    wanted = scratch.write(_template_windows(items, lambda form, width, sizes: width == np.minimum(sizes, WINDOW)), "items")
    used = {(r["form"], r["width"]) for r in wanted.select("form", "width").distinct().collect()}  # at most 16 rows
    bits = min(_MOST_BITS, max(_BITS, (16 * wanted.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    # Bits are set in the engine; what comes here are words of 64 of them.
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("set")).toPandas()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    bitmap = docs.sparkSession.sparkContext.broadcast(filled)

    def test(hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - bits)
        return (bitmap.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    found = _template_windows(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), printed(text)), lambda form, width, sizes: (sizes >= width) & ((form, width) in used), test)
    met = found.select(F.col("id").alias("doc_id"), "print", "hash", F.col("pos").alias("at"), F.col("fillers").alias("own")).join(
        wanted.select(F.col("id").alias("item_id"), "form", "hash", "pos", "total", "fillers"), "hash"
    )
    pairs = F.arrays_zip(F.col("fillers").alias("item"), F.col("own").alias("doc"))
    at_offset = met.groupBy("doc_id", "print", "item_id", "form", (F.col("at") - F.col("pos")).alias("offset")).agg(
        F.countDistinct("pos").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.first("total").alias("total"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
    )
    kinds = F.size("slots")
    one_to_one = (F.size(F.array_distinct("slots.item")) == kinds) & (F.size(F.array_distinct("slots.doc")) == kinds)
    runs = at_offset.where(one_to_one).groupBy("doc_id", "print", "item_id", "form").agg(F.first("total").alias("total"), F.collect_list(F.struct("offset", "low", "high", "n", "slots")).alias("runs"))
    copied = F.col("n_windows") >= F.col("total")  # bare words count as exact copies only
    alike = (F.col("form") != _WORDS) & ((F.col("n_windows") >= ENOUGH) | (F.col("n_windows") >= COVERAGE * F.col("total")))
    held = _chains(runs).where(copied | alike)
    best = held.groupBy("doc_id", "print", "item_id").agg(F.max(F.struct("n_windows", "total", "n_slots", "reworded")).alias("best"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.n_windows").alias("n_windows"),
        (F.col("best.n_windows") / F.col("best.total")).alias("coverage"),
        F.col("best.n_slots").alias("n_slots"),
        F.col("best.reworded").alias("reworded"),
        "print",
    )
