"""Language identification by a convolutional network over bytes.

A text's bytes (A-Z as a-z) are cut into windows of fixed length.  Filters of several widths
run over each window's byte embeddings, the largest response of each filter is kept, and a
softmax over those gives the languages' probabilities; a text's are the mean of its windows',
weighted by their bytes.  The network is trained in numpy on a bounded sample of labelled
texts, with windows drawn from the whole of each; every language of the training rows is learned.  For prediction, embeddings and filters are multiplied out into tables over pairs of
bytes, so a filter response is a sum of table rows.

Rows: a text that is null or has no letter gets ``und`` with score 0; so does every text when
there is no labelled text to learn from.  Rows without id or language are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready
from folio.llm.text import slices, text_bytes
from folio.llm.training import Adam, bounded_sample, draw, fold, softmax
from folio.session import settle

WINDOW = 128
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 8, 8
#: Texts per language, texts of all languages (but one of each), and windows of a text, that training sees at most.
SAMPLE_TEXTS, SAMPLE_ALL, SAMPLE_WINDOWS = 600, 8000, 24
STEPS, BATCH, RATE = 700, 96, 0.01

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def windows(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-filled; which text each is of, and how many bytes it has."""
    length = np.diff(at)
    count = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), count)
    begin = np.repeat(at[:-1], count) + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    size = np.minimum(at[1:][text] - begin, WINDOW)
    padded = np.concatenate([_FOLD[body], np.zeros(WINDOW, np.uint8)])
    out = padded[begin[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= size[:, None]] = 0
    return out, text, size


def train(bytes_: np.ndarray, labels: np.ndarray, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned from windows and the class of each."""
    rng = np.random.default_rng(seed)
    weights = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
    for k in WIDTHS:
        weights[f"filter{k}"] = rng.normal(0, (2 / (k * EMBEDDING)) ** 0.5, (k * EMBEDDING, FILTERS)).astype(np.float32)
        weights[f"bias{k}"] = np.zeros(FILTERS, np.float32)
    weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
    weights["out_bias"] = np.zeros(classes, np.float32)
    adam = Adam(weights, RATE)
    # as many windows of each class
    members = [np.flatnonzero(labels == c) for c in range(classes)]
    for step in range(STEPS):
        adam.rate = RATE * (1 - step / STEPS) + 1e-4
        chosen = np.array([rng.choice(members[c]) for c in rng.integers(classes, size=BATCH)])
        x, y = bytes_[chosen], labels[chosen]
        embedded = weights["embed"][x]
        pooled, where = [], []
        for k in WIDTHS:
            seen = np.concatenate([embedded[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
            response = seen @ weights[f"filter{k}"] + weights[f"bias{k}"]
            best = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
            where.append(best)
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        error = softmax(features @ weights["out"] + weights["out_bias"])
        error[np.arange(BATCH), y] -= 1
        error /= BATCH
        gradients = {"out": features.T @ error, "out_bias": error.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
        back = (error @ weights["out"].T) * (features > 0)
        for i, k in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = where[i][:, :, None] + np.arange(k)
            symbols = x[np.arange(BATCH)[:, None, None], at]
            inputs = weights["embed"][symbols].reshape(BATCH, FILTERS, k * EMBEDDING)
            gradients[f"filter{k}"] = np.einsum("bf,bfi->if", own, inputs)
            gradients[f"bias{k}"] = own.sum(axis=0)
            down = (own[:, :, None] * weights[f"filter{k}"].T).reshape(BATCH, FILTERS, k, EMBEDDING)
            np.add.at(gradients["embed"], symbols, down)
        adam.step(gradients)
    return weights


class Network:
    """The trained network as tables over single bytes and pairs of bytes."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.out, self.out_bias = weights["out"], weights["out_bias"]
        self.bias = {k: weights[f"bias{k}"] for k in WIDTHS}
        self.single = {k: [weights["embed"] @ weights[f"filter{k}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(k)] for k in WIDTHS}
        self.pairs: dict | None = None

    def _pairs(self) -> dict:
        if self.pairs is None:
            self.pairs = {k: [(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)] for k, t in self.single.items()}
        return self.pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pairs = self._pairs()
        both = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
        pooled = []
        for k in WIDTHS:
            span = WINDOW - k + 1
            response = pairs[k][0][both[:, :span]]
            for i, table in enumerate(pairs[k][1:], 1):
                response += table[both[:, 2 * i : 2 * i + span]]
            if k % 2:
                response += self.single[k][-1][x[:, k - 1 :]]
            pooled.append(response.max(axis=1) + self.bias[k])
        return softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias)


def has_letter(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_LETTER[body])])[at]
    found = np.diff(letters) > 0
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in body[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _predict(weights: dict[str, np.ndarray] | None, languages: list[str]):
    def run(batches):
        network = Network(weights) if weights else None
        for batch in batches:
            for low, high in slices(batch.column(1), 1 << 20):
                body, at = text_bytes(batch.column(1)[low:high])
                n = high - low
                total = np.zeros((n, max(1, len(languages))))
                if network:
                    x, text, size = windows(body, at)
                    for i in range(0, len(x), 512):
                        np.add.at(total, text[i : i + 512], network.probabilities(x[i : i + 512]) * size[i : i + 512, None])
                mean = total / np.maximum(np.diff(at), 1)[:, None]
                known = has_letter(body, at) & bool(network)
                best = mean.argmax(axis=1)
                names = [languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                held = batch.column(2)[low:high].fill_null(False)
                yield pa.record_batch([batch.column(0)[low:high], held, pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _drawn(batches):
    """Windows drawn from the whole of each text, and their sizes."""
    for batch in batches:
        for low, high in slices(batch.column(2)):
            x, text, size = windows(*text_bytes(batch.column(2)[low:high]))
            at = np.searchsorted(text, np.arange(high - low + 1))
            ids = batch.column(0)[low:high].to_pylist()
            own = [a + draw(b - a, SAMPLE_WINDOWS, i) for a, b, i in zip(at[:-1].tolist(), at[1:].tolist(), ids, strict=True)]
            columns = [pa.array([v[rows].tobytes() for rows in own], pa.binary()) for v in (x, size.astype("<i8"))]
            yield pa.record_batch([batch.column(0)[low:high], batch.column(1)[low:high], *columns], names=["doc_id", "lang", "windows", "sizes"])


def fit(docs: DataFrame, held_out) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    """The network, and its languages, learned from a bounded sample of the rows not held out."""
    known = docs.withColumn("lang", F.col("lang").cast("string")).filter(held_out.isNotNull() & ~held_out & F.col("lang").isNotNull() & (F.length("text") > 0))
    names = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not names:
        return None, []
    each = max(1, min(SAMPLE_TEXTS, SAMPLE_ALL // len(names)))
    # ids are sampled before any text is fetched
    chosen = settle(bounded_sample(known.select("doc_id", "lang"), "lang", each, "doc_id").distinct(), "sample")
    drawn = known.join(chosen, ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text").mapInArrow(_drawn, "doc_id long, lang string, windows binary, sizes binary")
    rows = drawn.orderBy("lang", "doc_id", "windows").collect()
    x = np.frombuffer(b"".join(r.windows for r in rows), np.uint8).reshape(-1, WINDOW)
    size = np.frombuffer(b"".join(r.sizes for r in rows), "<i8")
    number = {name: i for i, name in enumerate(names)}
    labels = np.repeat([number[r.lang] for r in rows], [len(r.sizes) // 8 for r in rows])
    whole = (size >= WINDOW // 4) | ~np.isin(labels, labels[size >= WINDOW // 4])
    return train(x[whole], labels[whole], len(names)), names


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    held_out = fold("doc_id", folds) == held
    weights, languages = fit(rows, held_out)
    return rows.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        _predict(weights, languages), "doc_id long, held_out boolean, lang_pred string, score double"
    )
