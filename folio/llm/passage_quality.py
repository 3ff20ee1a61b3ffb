"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of fixed length.  Each passage is described by its words, hashed, and by
what its bytes and words look like; it is encoded by a layer and weighted by gated attention; the weighted
sum is scored by a logistic unit.  Only documents have labels: the attention weights are learned from
them, in numpy, on a bounded sample of labelled documents, with passages drawn from the whole of each.

Rows: null and empty texts are a bag of one empty passage.  Rows without id, and labels that
are null, are not learned from; without any label every score is 0.5.  Of several labels of a
document the largest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready
from folio.llm.text import slices, text_bytes, text_hash, words
from folio.llm.training import Adam, bounded_sample, draw, fold, sigmoid
from folio.session import settle

PASSAGE = 512
#: Labelled documents of each class that training sees at most, and passages of each.
SAMPLE_DOCS, SAMPLE_PASSAGES = 2500, 40
HIDDEN, GATE, EPOCHS, BATCH, RATE = 16, 8, 30, 64, 0.01
KEEP_FROM = 0.7

#: Byte classes whose shares describe a passage.
_SYMBOLS = b"|*%&$#!?.,:;-_/<>{}[]()=+@\"'"
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[32], _CLASS[10], _CLASS[[9, 11, 12, 13]] = 5, 6, 7
for _i, _b in enumerate(_SYMBOLS):
    _CLASS[_b] = 8 + _i
_CLASSES = 8 + len(_SYMBOLS)
#: Buckets of hashed words, and labelled documents with which they have half their weight.
WORDS, FEW_DOCS = 64, 1000
FEATURES = _CLASSES + 7 + WORDS


def passages(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage, and the text each is of."""
    length = np.diff(at)
    count = np.maximum(-(-length // PASSAGE), 1)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(length)), count)
    total = len(text)
    begin = at[:-1][text] + (np.arange(total) - first[text]) * PASSAGE
    size = np.minimum(at[1:][text] - begin, PASSAGE)
    owner = np.repeat(np.arange(total), size)
    shares = np.bincount(owner * _CLASSES + _CLASS[body], minlength=total * _CLASSES).reshape(total, _CLASSES) / np.maximum(size, 1)[:, None]
    start, end, _ = words(body, at)
    name = text_hash(body, start, end, folded=True)
    own = owner[start] if len(start) else np.zeros(0, np.int64)
    per = np.bincount(own, minlength=total)
    many = np.maximum(per, 1)
    size_of = end - start
    again = np.zeros(len(start))
    again[1:] = (name[1:] == name[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((name, own))
    fresh = np.ones(len(start))
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (own[order][1:] != own[order][:-1])
    marked = _CLASS[body[end - 1]] >= 8 if len(end) else np.zeros(0, bool)
    more = [
        np.log1p(size), np.bincount(own, size_of, total) / many / 10, np.bincount(own, again, total) / many, np.bincount(own[order], fresh, total) / many,
        np.bincount(own, marked, total) / many, np.bincount(own, size_of > 20, total) / many, np.bincount(own, size_of == 1, total) / many,
    ]
    hashed = np.bincount(own * WORDS + (name % np.uint64(WORDS)).astype(np.int64), minlength=total * WORDS).reshape(total, WORDS) / many[:, None]
    out = np.concatenate([shares, hashed, np.stack(more, axis=1)], axis=1)
    # shares are small: their roots spread them
    out[:, : _CLASSES + WORDS] = np.sqrt(out[:, : _CLASSES + WORDS])
    return out.astype(np.float32), text


class Bags:
    """Scores of bags of passages, and the gradients of their loss."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @staticmethod
    def fresh(mean: np.ndarray, spread: np.ndarray, seed: int = 11) -> Bags:
        rng = np.random.default_rng(seed)

        def layer(a, b):
            return rng.normal(0, (1 / a) ** 0.5, (a, b)).astype(np.float32)

        return Bags({
            "mean": mean, "spread": spread, "encode": layer(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32),
            "gate_v": layer(HIDDEN, GATE), "gate_u": layer(HIDDEN, GATE), "attend": layer(GATE, 1), "out": layer(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
        })

    def forward(self, features: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - w["mean"]) / w["spread"]
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, u = np.tanh(h @ w["gate_v"]), sigmoid(h @ w["gate_u"])
        e = ((v * u) @ w["attend"])[:, 0]
        # passages of a bag stand together: attention is a softmax over each stretch
        first = np.searchsorted(bag, np.arange(bags))
        top = np.maximum.reduceat(e, first)
        a = np.exp(e - top[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "score": sigmoid((z @ w["out"])[:, 0] + w["out_bias"][0])}

    def scores(self, features: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        """Scores in double precision, rounded: the texts that share a batch do not show in them."""
        wide = Bags({k: v.astype(np.float64) for k, v in self.weights.items()})
        return np.round(wide.forward(features, bag, bags)["score"], 9)

    def gradients(self, features: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(features, bag, len(labels))
        d = ((f["score"] - labels) / len(labels)).astype(np.float32)
        out = {"out": f["z"].T @ d[:, None], "out_bias": d.sum(keepdims=True)}
        dz = d[:, None] * w["out"].T
        da = (dz[bag] * f["h"]).sum(axis=1)
        first = np.searchsorted(bag, np.arange(len(labels)))
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
        gated = f["v"] * f["u"]
        out["attend"] = gated.T @ de[:, None]
        dg = de[:, None] * w["attend"].T
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        out["gate_v"], out["gate_u"] = f["h"].T @ dv, f["h"].T @ du
        dh = f["a"][:, None] * dz[bag] + dv @ w["gate_v"].T + du @ w["gate_u"].T
        dx = dh * (1 - f["h"] ** 2)
        out["encode"], out["encode_bias"] = f["x"].T @ dx + 1e-4 * w["encode"], dx.sum(axis=0)
        return out


def train(features: np.ndarray, bag: np.ndarray, labels: np.ndarray, seed: int = 11) -> Bags:
    """Bags learned from the passages (in bag order) of labelled documents."""
    spread = features.std(axis=0) + 0.02
    # few documents say little about single words: until there are more, words weigh less
    spread[_CLASSES : _CLASSES + WORDS] *= 1 + FEW_DOCS / len(labels)
    model = Bags.fresh(features.mean(axis=0), spread, seed)
    learned = {k: v for k, v in model.weights.items() if k not in ("mean", "spread")}
    adam, rng = Adam(learned, RATE), np.random.default_rng(seed)
    at = np.searchsorted(bag, np.arange(len(labels) + 1))
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS) + 5e-4
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            size = at[chosen + 1] - at[chosen]
            rows = np.concatenate([np.arange(at[c], at[c + 1]) for c in chosen])
            adam.step(model.gradients(features[rows], np.repeat(np.arange(len(chosen)), size), labels[chosen]))
    return model


def _features(batches):
    for batch in batches:
        for low, high in slices(batch.column(1)):
            rows, text = passages(*text_bytes(batch.column(1)[low:high]))
            at = np.searchsorted(text, np.arange(high - low + 1))
            ids = batch.column(0)[low:high].to_pylist()
            keep = [rows[a + draw(b - a, SAMPLE_PASSAGES, i)].tobytes() for a, b, i in zip(at[:-1].tolist(), at[1:].tolist(), ids, strict=True)]
            yield pa.record_batch([batch.column(0)[low:high], batch.column(2)[low:high], pa.array(keep, pa.binary())], names=["doc_id", "quality", "rows"])


def fit(docs: DataFrame, labels: DataFrame, held_out) -> Bags | None:
    """The model learned from a bounded sample, equally of both classes if there are enough, of the rows not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    # written, so that the planner knows how small it is
    chosen = settle(bounded_sample(known.filter(~held_out), "quality", SAMPLE_DOCS, "doc_id"), "sample")
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "quality").mapInArrow(_features, "doc_id long, quality int, rows binary")
    found = rows.orderBy("doc_id", "rows").collect()
    if not found:
        return None
    parts = [np.frombuffer(r.rows, np.float32).reshape(-1, FEATURES) for r in found]
    labels_ = np.array([float(r.quality > 0) for r in found], np.float32)
    return train(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), labels_)


def _score(model: Bags | None, keep_from: float):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1), 2 << 20):
                n = high - low
                rows, bag = passages(*text_bytes(batch.column(1)[low:high]))
                score = model.scores(rows, bag, n) if model else np.full(n, 0.5)
                columns = [batch.column(0)[low:high], batch.column(2)[low:high].fill_null(False), pa.array(score), pa.array((score >= keep_from).astype(np.int32))]
                yield pa.record_batch(columns, names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = fold("doc_id", folds) == held
    model = fit(rows, labels, held_out)
    return rows.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_score(model, keep_from), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model: Bags | None, keep_from: float, text_at: int):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(text_at), 2 << 20):
                rows, bag = passages(*text_bytes(batch.column(text_at)[low:high]))
                score = model.scores(rows, bag, high - low) if model else np.ones(high - low)
                yield batch.slice(low, high - low).filter(pa.array(score >= keep_from))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; all, if there is no label."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows, labels, fold("doc_id", folds) == held)
    return docs.mapInArrow(_keep(model, keep_from, docs.columns.index("text")), docs.schema)
