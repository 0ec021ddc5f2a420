"""Language of a text by a convolutional network over its bytes.

Bytes are embedded, filters of several widths slide over them, each filter's largest answer in a
window is kept, and a softmax over these gives the language. The network is trained in numpy on the
driver from windows of a bounded sample of labelled documents, a few hundred kilobytes of weights
go to the tasks, and every window of every text is scored there; there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.llm.batches import byte_lengths, flat_bytes, text_slices

WINDOW = 256  # bytes a window holds; the last one of a text is filled up with zeros
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Bounds of the training sample: documents of each language and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
#: Training steps; beyond so many languages they grow with the languages.
STEPS, STEP_LANGUAGES = 500, 64
UNKNOWN = "und"
#: Steps in which scores are counted for the least one; as many rows go to the driver.
SCORE_STEPS = 10_000
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights of one trained model."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width (width * EMBEDDING, FILTERS)
    offsets: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def _answers(self, windows: np.ndarray):
        """Patches and pooled answers of each width."""
        vectors = self.embedding[windows]
        out = []
        for width, weights, offset in zip(WIDTHS, self.filters, self.offsets):
            n = WINDOW - width + 1
            patches = np.concatenate([vectors[:, k : k + n] for k in range(width)], axis=2)
            answers = patches.reshape(-1, width * EMBEDDING) @ weights
            answers = answers.reshape(len(windows), n, FILTERS)
            out.append((patches, answers))
        return out

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 64):
            pooled = [np.maximum(a.max(axis=1) + o, 0) for (_, a), o in zip(self._answers(windows[at : at + 64]), self.offsets)]
            out[at : at + 64] = _log_softmax(np.concatenate(pooled, axis=1) @ self.dense + self.bias)
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, steps: int = 500, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """Fit by Adam on random batches. The gradient of a pooled answer goes to its largest place only."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        rng.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [net.embedding, *net.filters, *net.offsets, net.dense, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        bytes_, target = windows[pick], labels[pick]
        answers = net._answers(bytes_)
        tops = [a.argmax(axis=1) for _, a in answers]
        pooled = [np.take_along_axis(a, t[:, None], 1)[:, 0] + o for (_, a), t, o in zip(answers, tops, net.offsets)]
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        delta = np.exp(_log_softmax(hidden @ net.dense + net.bias))
        delta[np.arange(batch), target] -= 1
        delta /= batch
        back = (delta @ net.dense.T) * (hidden > 0)
        embedding_grad = np.zeros_like(net.embedding)
        filter_grads, offset_grads = [], []
        rows = np.arange(batch)[:, None]
        for i, (width, (patches, _)) in enumerate(zip(WIDTHS, answers)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = patches[rows, tops[i]]  # (batch, FILTERS, width * EMBEDDING)
            filter_grads.append(np.einsum("nf,nfd->df", own, chosen))
            offset_grads.append(own.sum(axis=0))
            into = own[:, :, None] * net.filters[i].T[None]
            for k in range(width):
                np.add.at(embedding_grad, bytes_[rows, tops[i] + k], into[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        grads = [embedding_grad, *filter_grads, *offset_grads, hidden.T @ delta, delta.sum(axis=0)]
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, index of their text): all bytes of all texts."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][rows] + nth * WINDOW
    at = starts[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][rows][:, None]
    padded = np.append(data, 0)
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), rows


def held_out(id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id's text modulo 4 is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from the labelled rows that are not held out; None if there are none.

    The sample takes documents of each language by the hash of their ids, about ``SAMPLE_DOCS`` of each, and
    from each up to ``SAMPLE_WINDOWS`` windows anywhere in the text. Rows without id, text or language teach nothing.
    """
    usable = docs.where(F.col(id).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(id)))
    usable = usable.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = usable.groupBy("lang").count().orderBy("lang").collect()  # all languages
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], SAMPLE_DOCS / r["count"])])
    picked = usable.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def cut(batches):
        for batch in text_slices(batches, "text"):
            windows, rows = _windows(*flat_bytes(batch.column("text")))
            sizes = np.bincount(rows, minlength=batch.num_rows)
            nth = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
            step = -(-sizes // SAMPLE_WINDOWS)
            take = np.flatnonzero(nth % step[rows] == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows[take])), pa.array(nth[take]), batch.column("lang").take(pa.array(rows[take])), pa.array([w.tobytes() for w in windows[take]], pa.binary())],
                names=["id", "nth", "lang", "window"],
            )

    sample = picked.mapInArrow(cut, "id string, nth long, lang string, window binary").toPandas().sort_values(["id", "nth"])
    if not len(sample):
        return None
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    place = {x: i for i, x in enumerate(languages)}
    steps = STEPS * max(STEP_LANGUAGES, len(languages)) // STEP_LANGUAGES
    return train(windows, sample["lang"].map(place).to_numpy(), languages, steps=steps)


def identify(docs: DataFrame, network: Network | None, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of every row plus the predicted language and its score (0 to 1; such names are replaced).

    The score is the mean probability over all windows, each weighted by its bytes. Texts that are null or
    have no letter, and all texts if nothing was learned, are ``und`` with score 0.
    """
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([docs.schema[c] for c in keep]).add(lang_out, T.StringType()).add(score_out, T.DoubleType())
    body = f"__k{keep.index(text)}"

    def run(batches):
        net = shared.value
        for batch in text_slices(batches, body, 2 << 20):
            column = batch.column(body)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if net is not None:
                windows, rows = _windows(*flat_bytes(column))
                weights = np.minimum(byte_lengths(column)[rows] - (np.arange(len(rows)) - np.searchsorted(rows, rows)) * WINDOW, WINDOW)
                total = np.zeros((batch.num_rows, len(net.languages)))
                np.add.at(total, rows, np.exp(net.log_probabilities(windows)) * weights[:, None])
                for i, t in enumerate(column.to_pylist()):
                    if t and _LETTER.search(t):
                        best = int(total[i].argmax())
                        names[i], scores[i] = net.languages[best], min(1.0, total[i][best] / total[i].sum())
            columns = [batch.column(f"__k{i}") for i in range(len(keep))] + [pa.array(names), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, lang_out, score_out])

    return docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)]).mapInArrow(run, schema)


def least_score(docs: DataFrame, network: Network | None, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score that all but a few of the held-out texts of a known language reach: below it, no learned language fits.

    A thousandth of the right predictions on all held-out labelled rows, at the most, may lie below the score that is lowered by a
    tenth; it never is under the chance level by more than that. Scores are counted exactly in ``SCORE_STEPS`` equal
    steps, and the lowest of the step in question is taken. Without such rows it is 0.
    """
    if network is None:
        return 0.0
    rows = docs.where(F.col(id).isNotNull() & F.col(lang).isin(network.languages) & (F.length(text) > 0) & held_out(F.col(id)))
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    right = identify(rows, network).where(F.col("lang_pred") == F.col("lang"))
    step = F.least(F.floor(F.col("score") * SCORE_STEPS), F.lit(SCORE_STEPS - 1)).alias("step")
    steps = right.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).orderBy("step").collect()
    if not steps:
        return 0.0 if rows.isEmpty() else 0.9 / len(network.languages)
    allowed, low = sum(r["n"] for r in steps) // 1000, 0.0
    for r in steps:
        low, allowed = r["low"], allowed - r["n"]
        if allowed < 0:
            break
    return 0.9 * max(low, 1 / len(network.languages))
