"""Quality of a text from statistics of the document.

Random Fourier features stand for a Gaussian kernel over the statistics; normal equations are summed
per partition and give ridge weights; isotonic regression turns ridge scores into probabilities.
All labelled documents that are not held out take part in the sums. What reaches the driver is fixed:
one matrix per fold and one row per score bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcemeld.llm.batches import HASH_SLICE, SpanHash, flat_bytes, lowered, text_slices, word_spans
from sourcemeld.llm.language_id import held_out
from sourcemeld.session import Scratch

FEATURES, WIDTH, RIDGE, BINS, FOLDS = 192, 3.0, 1.0, 1024, 3
STATISTICS = 20
_BYTES = np.arange(256)
_CLASSES = (
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES >= 128,
    (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    _BYTES == 10,
    np.isin(_BYTES, [ord(c) for c in ".,;:?'\"-"]),
    np.isin(_BYTES, [ord(c) for c in "#$%&*@^~+=_"]),
    np.isin(_BYTES, [ord(c) for c in "|<>[]{}()/\\"]),
    _BYTES == ord("!"),
)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text, from all of its bytes, words and lines; zeros for null and empty texts."""
    data, offsets = flat_bytes(column)
    count = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    out = np.zeros((count, STATISTICS))
    if not len(data):
        return out
    bytes_ = np.maximum(sizes, 1)

    def per_text(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values, minlength=count)

    for k, members in enumerate(_CLASSES):
        sums = np.concatenate(([0], np.cumsum(members[data], dtype=np.int64)))
        out[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / bytes_
    lower = lowered(data)
    hashes = SpanHash(lower)
    starts, ends, rows = word_spans(data, offsets)
    lengths = (ends - starts).astype(float)
    words = np.bincount(rows, minlength=count).astype(float)
    some = np.maximum(words, 1)
    mean = per_text(lengths, rows) / some
    upper = np.concatenate(([0], np.cumsum(_CLASSES[0][data], dtype=np.int64)))
    out[:, 10] = np.log1p(sizes)
    out[:, 11] = mean
    out[:, 12] = np.sqrt(np.maximum(per_text(lengths**2, rows) / some - mean**2, 0))
    out[:, 13] = per_text(lengths <= 3, rows) / some
    out[:, 14] = per_text((upper[ends] - upper[starts]) >= np.maximum(2, lengths / 2), rows) / some
    out[:, 15] = _distinct(hashes.of(starts, ends), rows, count) / np.maximum(words, 1) ** 0.8
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1][sizes > 0], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[1:][line_rows])
    lines = np.bincount(line_rows, minlength=count)
    out[:, 16] = _distinct(hashes.of(line_starts, line_ends), line_rows, count) / np.maximum(lines, 1)
    out[:, 17] = np.log1p(words / np.maximum(lines, 1))
    out[:, 18] = np.log1p(words)
    ended = np.isin(data[ends - 1], [ord(c) for c in ".!?"]) if len(ends) else np.zeros(0, bool)
    out[:, 19] = per_text(ended, rows) / some
    return out


def _distinct(hashes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Different values of each text."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=count)


@dataclass
class Scorer:
    """A fitted model: scaling, frequencies, ridge weights and the isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequencies + self.phases) * (2 / FEATURES) ** 0.5
        return np.column_stack((waves, np.ones(len(x))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(totals: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Best non-decreasing rates for bins in order (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for n, p in zip(totals, positives):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks]) if blocks else np.zeros(0)


def measure(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) per row, written once: the texts are read for this alone."""

    def run(batches):
        for batch in text_slices(batches, "text", HASH_SLICE):
            stats = statistics(batch.column("text")).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), STATISTICS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "stats"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return scratch.write(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<float>"), "stats")


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(float)


def fit(measured: DataFrame, labels: DataFrame, scratch: Scratch, *, label: str = "quality", seed: int = 3) -> Scorer | None:
    """Learn from the measured rows with a label that are not held out; None if there are none.

    Null labels and ids teach nothing; a document with several label rows counts once for each.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id"), F.col(label).cast("double").alias("y"))
    rows = measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS))).cast("int").alias("fold"))
    rows = scratch.write(rows, "labelled")
    moments = rows.select(*[F.col("stats")[k].cast("double").alias(f"s{k}") for k in range(STATISTICS)]).agg(
        F.count(F.lit(1)).alias("n"), *[f(f"s{k}").alias(f"{n}{k}") for k in range(STATISTICS) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    ).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{k}"] for k in range(STATISTICS)])
    scale = np.array([moments[f"d{k}"] or 1.0 for k in range(STATISTICS)])
    frequencies = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
    model = Scorer(mean, scale, frequencies, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 2  # features, the constant and the label

    def sums(batches):
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            z = np.column_stack((model.features(_stats(batch)), batch.column("y").to_numpy()))
            folds = batch.column("fold").to_numpy()
            for f in range(FOLDS):
                total[f] += z[folds == f].T @ z[folds == f]
        for f in range(FOLDS):
            if total[f].any():
                yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * size, pa.int32()), "line": pa.array(np.arange(size, dtype=np.int32)), "v": pa.array(list(total[f]), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(sums, "fold int, line int, v array<double>")
    cells = parts.select("fold", "line", F.posexplode("v").alias("at", "v")).groupBy("fold", "line", "at").agg(F.sum("v").alias("v"))
    gram = np.zeros((FOLDS, size, size))
    found = cells.toPandas()  # FOLDS * size**2 rows
    gram[found["fold"], found["line"], found["at"]] = found["v"]

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:-1, :-1] + RIDGE * np.eye(size - 1), m[:-1, -1])

    everything = gram.sum(axis=0)
    model.weights = solve(everything)
    others = [solve(everything - gram[f]) for f in range(FOLDS)]

    def binned(batches):
        """Counts and sums of the labels by bins of scores that the row's own fold had no part in."""
        for batch in batches:
            z, folds = model.features(_stats(batch)), batch.column("fold").to_numpy()
            raw = np.choose(folds, [z @ w for w in others])
            bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    curve = rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).orderBy("bin").toPandas()
    model.knots = (curve["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(curve["n"].to_numpy(float), curve["p"].to_numpy(float))
    return model


def score(measured: DataFrame, model: Scorer | None, *, out: str = "score") -> DataFrame:
    """(doc_id, score) of every measured row; 0.5 if nothing was learned."""
    shared = measured.sparkSession.sparkContext.broadcast(model)
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = shared.value.score(_stats(batch)) if shared.value and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", out])

    return measured.mapInArrow(run, f"doc_id {kind}, {out} double")
