"""Scores of whole texts by a gated recurrent language model over words.

Words (A-Z as a-z) are counted over all training documents.  The most frequent words, and the
end of a text, have outputs of their own, factored into classes of neighbouring frequency; all
other words share one further class, inside which a word's probability is its share of the
counts, with one added for every word and for the unknown one.  So the model gives every text a
probability, and without what the network learned it would equal the smoothed counts.

The network (numpy, truncated backpropagation, state carried from window to window) learns from
the whole texts of all training documents, in one pass; its output biases start from the counts of all.
Rounds of shards train side by side from the same weights and moments, which are then averaged by
tokens.  The frequent words, their classes and what is gathered for them grow with the fourth root of the
tokens.  A text is scored whole: its state is carried across windows to its end.
Texts are dealt to shards; a shard is sent the counts of the words that it holds.

Rows: a null text is empty and still has its end.  Rows without id are scored, not held out and
not learned from.  Without training documents every token has probability one.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready, shard_of, text_total
from folio.llm.text import FOLDED_VALUES, binary_column, mix, slices, text_bytes, text_hash, words
from folio.llm.training import Adam, fold
from folio.session import settle

SHARD_BYTES = 16 << 20
#: Words with outputs of their own, counting the end, for each unit of the fourth root of all tokens; rows are
#: 16-bit numbers.  Inputs for all other words.
SHORTLIST, MOST_ROWS, TAILS = 16, 65_000, 64
HIDDEN, STEPS, STREAMS, RATE = 16, 16, 256, 0.012
#: A shard with fewer tokens for each stream has fewer streams, so that it still takes many steps.
STREAM_TOKENS = 4096
#: Shards that train side by side before their weights are averaged, at least; rounds, at most; pieces in which
#: weights are averaged.
ROUND_SHARDS, MOST_ROUNDS, PIECES = 16, 32, 16
WINDOW = 48
#: Texts that are scored side by side.
TOGETHER = 512

#: The end of a text as a word; no word has this hash.
END = np.uint64(0)

_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def text_words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail (a small hash of the last two bytes) of all words, and n+1 offsets."""
    start, end, first = words(body, at)
    hashes = np.maximum(text_hash(body, start, end, folded=True), np.uint64(1))
    last = FOLDED_VALUES[body[end - 1]] if len(end) else np.zeros(0, np.uint64)
    before = np.where(end - start > 1, FOLDED_VALUES[body[np.maximum(end - 2, 0)]], np.uint64(0)) if len(end) else last
    return hashes, (mix(last * np.uint64(3) + before) % np.uint64(TAILS)).astype(np.int32), first


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values with ``end`` after each text's, and the new offsets."""
    return np.insert(values, first[1:], end), first + np.arange(len(first))


# ---- network ---------------------------------------------------------------------------------


def _places(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where each value stands among the names, -1 if nowhere: by a hash table, which beats searching sorted names."""
    return pc.index_in(pa.array(values), value_set=pa.array(names)).fill_null(-1).to_numpy().astype(np.int64)


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each class in turn, and where each class begins; numbers of 16 bits are sorted by their digits."""
    by = np.argsort(cls.astype(np.uint16), kind="stable")
    return by, np.append(0, np.cumsum(np.bincount(cls, minlength=classes)))


class Vocabulary:
    """Counts of all training tokens, and the frequent ones by rank."""

    def __init__(self, total: int, distinct: int, names: np.ndarray, counts: np.ndarray):
        self.total, self.distinct = total, distinct
        self.names, self.counts = names, counts  # by falling count
        # as many classes as words in a class
        self.class_words = max(1, int(np.ceil(len(names) ** 0.5)))
        self.classes = -(-len(names) // self.class_words)

    def chance(self, counts) -> np.ndarray:
        return (np.asarray(counts, np.float64) + 1) / (self.total + self.distinct + 1)

    def rest(self) -> float:
        """The probability of all words without an output of their own, the unknown one with them."""
        return max(1 - float(self.chance(self.counts).sum()), 1e-12)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of every word that has its own output, -1 for others."""
        return _places(hashes, self.names)


class Network:
    """A recurrent unit whose gate says how much of each value is kept, with class-factored output."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, c, per = len(vocabulary.names), vocabulary.classes, vocabulary.class_words
        padded = np.full(c * per, -1e9)
        padded[:n] = np.log(vocabulary.chance(vocabulary.counts))
        mass = np.exp(padded.reshape(c, per)).sum(axis=1)
        self.class_words, self.rest = per, c  # the last class is that of all other words
        self.weights = {
            "input": rng.normal(0, 0.1, (n + TAILS, 2 * HIDDEN)).astype(np.float32), "state": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2 * HIDDEN)).astype(np.float32),
            "bias": np.zeros(2 * HIDDEN, np.float32), "classes": np.zeros((HIDDEN, c + 1), np.float32),
            "classes_bias": np.log(np.append(mass, vocabulary.rest())).astype(np.float32), "words": np.zeros((c, HIDDEN, per), np.float32),
            "words_bias": padded.reshape(c, per).astype(np.float32),
        }
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        self.steps = 0

    def copy(self) -> Network:
        other = copy.copy(self)
        other.weights, other.first, other.second = ({k: v.copy() for k, v in part.items()} for part in (self.weights, self.first, self.second))
        return other

    def flat(self) -> np.ndarray:
        """All weights and their moments end to end, and the steps taken."""
        parts = [v.ravel() for part in (self.weights, self.first, self.second) for v in part.values()]
        return np.concatenate([*parts, [np.float32(self.steps)]])

    def set_flat(self, values: np.ndarray) -> None:
        shapes = [(k, v.shape) for k, v in self.weights.items()]
        cuts = np.cumsum([v.size for v in self.weights.values()] * 3)
        parts = iter(np.split(values, cuts))
        self.weights, self.first, self.second = ({k: next(parts).reshape(shape).copy() for k, shape in shapes} for _ in range(3))
        self.steps = int(next(parts)[0])

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """State after the inputs ``x`` (rows of ``input``)."""
        w, s = self.weights, HIDDEN
        a = h @ w["state"]
        a += w["input"][x]
        a += w["bias"]
        a[:, :s] *= 0.5  # the gate's logistic curve is half a tanh
        np.tanh(a, out=a)
        keep, fresh = a[:, :s], a[:, s:]
        keep += 1
        keep *= 0.5
        after = h - fresh
        after *= keep
        after += fresh
        return after, keep, fresh

    def log_chances(self, states: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target; of its class only for words of the rest."""
        w = self.weights
        cls = np.where(ranks >= 0, ranks // self.class_words, self.rest)
        logits = states @ w["classes"]
        logits += w["classes_bias"]
        chosen = logits[np.arange(len(cls)), cls]
        out = (chosen - _log_sum(logits)).astype(np.float64)
        by, edges = _by_class(cls, self.rest + 1)
        ordered, place = states[by], ranks[by] % self.class_words
        for c in range(self.rest):
            own = slice(edges[c], edges[c + 1])
            if edges[c] < edges[c + 1]:
                inner = ordered[own] @ w["words"][c]
                inner += w["words_bias"][c]
                chosen = inner[np.arange(len(inner)), place[own]]
                out[by[own]] += chosen - _log_sum(inner)
        return out


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Of each row; the rows are used up."""
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    np.exp(logits, out=logits)
    return np.log(logits.sum(axis=1)) + top[:, 0]


def _shares(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The softmax of each row plus the bias, in place."""
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def deal(length: np.ndarray, streams: int) -> list[list[int]]:
    """Whole texts, longest first, each to the stream that is shortest so far; longest stream first."""
    heap = [(0, i) for i in range(min(streams, len(length)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for text in np.argsort(-length, kind="stable").tolist():
        size, i = heap[0]
        dealt[i].append(text)
        heapq.heapreplace(heap, (size + int(length[text]), i))
    return [dealt[i] for _, i in sorted(heap, key=lambda x: (-x[0], x[1]))]


def train(network: Network, inputs: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One pass of truncated backpropagation over whole texts, dealt to parallel streams.

    ``inputs`` are the rows of all tokens, each text's end included.  State is carried between
    windows, gradients are not; every text starts anew from the end before it.
    """
    streams = deal(np.diff(at), min(STREAMS, max(8, int(at[-1]) // STREAM_TOKENS)))
    own = [np.concatenate([inputs[at[t] : at[t + 1]] for t in texts]).astype(np.int64) for texts in streams]
    size = np.array([len(x) for x in own])
    if not len(size):
        return
    w, s = network.weights, HIDDEN
    y = np.zeros((size[0], len(size)), np.int64)
    for i, column in enumerate(own):
        y[: len(column), i] = column
    x = np.vstack([np.full((1, len(size)), network.end, np.int64), y[:-1]])
    ends = x == network.end
    some_end = ends.any(axis=1)
    known = len(w["input"]) - TAILS
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # streams longer than t
    adam = Adam(w, rate, network.first, network.second, network.steps)
    h = np.zeros((len(size), s), np.float32)
    for low in range(0, int(size[0]), STEPS):
        high = min(low + STEPS, int(size[0]))
        kept, states = [], []
        for t in range(low, high):
            n = active[t]
            h = np.where(ends[t, :n, None], np.float32(0), h[:n]) if some_end[t] else h[:n]  # the end's own row starts the next text
            after, *gates = network.step(x[t, :n], h)
            kept.append((h, *gates))
            states.append(after)
            h = after
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        target = np.concatenate([y[t, : active[t]] for t in range(low, high)])
        edges = np.append(0, np.cumsum(active[low:high]))
        down = _output_gradients(network, np.concatenate(states), np.where(target < known, target, -1), grads)
        back = np.zeros((active[high - 1], s), np.float32)
        gates_down = np.empty((len(target), 2 * s), np.float32)
        state_t = w["state"].T
        for t in reversed(range(high - low)):
            before, keep, fresh = kept[t]
            here = slice(edges[t], edges[t + 1])
            d = down[here]
            d[: len(back)] += back  # streams that go on
            back = d * keep
            d -= back
            g = gates_down[here]
            np.subtract(before, fresh, out=g[:, :s])
            g[:, :s] *= d
            g[:, :s] *= keep
            np.multiply(fresh, fresh, out=g[:, s:])
            np.subtract(1, g[:, s:], out=g[:, s:])
            g[:, s:] *= d
            back += g @ state_t
            if some_end[low + t]:
                back[ends[low + t, : len(back)]] = 0
        grads["state"] = np.concatenate([k[0] for k in kept]).T @ gates_down
        rows = np.concatenate([x[t, : active[t]] for t in range(low, high)])
        by = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[by]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        grads["input"][rows[first]] = np.add.reduceat(gates_down[by], first, axis=0)
        grads["bias"] += gates_down.sum(axis=0)
        for g in grads.values():
            np.clip(g, -1, 1, out=g)
        adam.step(grads)
    network.steps = adam.steps


def _output_gradients(network: Network, states: np.ndarray, ranks: np.ndarray, grads: dict) -> np.ndarray:
    w, n = network.weights, len(ranks)
    cls = np.where(ranks >= 0, ranks // network.class_words, network.rest)
    error = _shares(states @ w["classes"], w["classes_bias"])
    error[np.arange(n), cls] -= 1
    error /= n
    grads["classes"] += states.T @ error
    grads["classes_bias"] += error.sum(axis=0)
    down = error @ w["classes"].T
    by, edges = _by_class(cls, network.rest + 1)
    ordered, place, inner_down = states[by], ranks[by] % network.class_words, np.zeros_like(down)
    for c in np.flatnonzero(np.diff(edges[:-1])):
        own = slice(edges[c], edges[c + 1])
        inner = _shares(ordered[own] @ w["words"][c], w["words_bias"][c])
        inner[np.arange(len(inner)), place[own]] -= 1
        inner /= n
        grads["words"][c] = ordered[own].T @ inner
        grads["words_bias"][c] = inner.sum(axis=0)
        inner_down[own] = inner @ w["words"][c].T
    down[by] += inner_down
    return down


def score_texts(network: Network, inputs: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability (of its classes, for words of the rest).

    Texts of like length advance together; states are kept for a window, whose outputs are
    then computed at once, and carried into the next.
    """
    by_length = np.argsort(-np.diff(at), kind="stable")
    out = np.zeros(len(by_length))
    for low in range(0, len(by_length), TOGETHER):
        texts = by_length[low : low + TOGETHER]
        out[texts] = _score_together(network, inputs, ranks, at[:-1][texts], np.diff(at)[texts])
    return out


def _score_together(network: Network, inputs: np.ndarray, ranks: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of texts in order of length, longest first."""
    out = np.zeros(len(size))
    h = np.zeros((len(size), HIDDEN), np.float32)
    low = 0
    previous, every = np.full(len(size), network.end, np.int64), np.arange(len(size))
    while low < size[0]:
        high = min(low + WINDOW, int(size[0]))
        states, targets, rows = [], [], []
        longer = np.searchsorted(-size, -np.arange(low, high), "left")  # texts longer than t
        for t, active in zip(range(low, high), longer.tolist(), strict=True):
            h = network.step(previous[:active], h[:active])[0]
            states.append(h)
            place = start[:active] + t
            targets.append(ranks[place])
            rows.append(every[:active])
            previous = inputs[place]
        logs = network.log_chances(np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(rows), logs, len(out))
        low = high
    return out


# ---- on Spark --------------------------------------------------------------------------------


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values as they come, and which of them each value is."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _list_words(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """The distinct words of a shard, and how often its training documents have them."""
    learned = docs.column("learned").to_numpy(zero_copy_only=False)
    texts = docs.column("text").combine_chunks()
    names, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in slices(texts):
        hashes, _, first = text_words(*text_bytes(texts[low:high]))
        own = np.repeat(learned[low:high], np.diff(first))
        name, place = _distinct(hashes)
        names.append(name)
        counts.append(np.bincount(place, own, len(name)).astype(np.int64))
    name, place = _distinct(np.concatenate(names))
    count = np.bincount(place, np.concatenate(counts), len(name)).astype(np.int64)
    return pa.table({"shard": pa.array(np.full(len(name), key[0].as_py(), np.int32)), "word": pa.array(name.view(np.int64)), "n": pa.array(count)})


def _rows_of(ranks: np.ndarray, tails: np.ndarray, own: int) -> np.ndarray:
    return np.where(ranks >= 0, ranks, own + tails)


def _encode(vocabulary: Vocabulary):
    """Each learned document as the rows of its tokens (16 bits each), its end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                hashes, tails, first = text_words(*text_bytes(texts[low:high]))
                hashes, at = with_ends(hashes, first, END)
                tails, _ = with_ends(tails, first, 0)
                rows = _rows_of(vocabulary.ranks(hashes), tails, len(vocabulary.names)).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column("shard")[low:high], batch.column("doc_id")[low:high], binary_column(rows, at)], ["shard", "doc_id", "tokens"])

    return run


def _pack(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """A shard's documents as one row, in an order that does not depend on how they arrived."""
    texts = sorted(zip(docs.column("doc_id").to_pylist(), docs.column("tokens").to_pylist(), strict=True))
    length = np.array([len(t) // 2 for _, t in texts], "<i8")
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "length": pa.array([length.tobytes()]), "tokens": pa.array([b"".join(t for _, t in texts)])})


def _train(network: Network, rate: float):
    """The weights after each shard's pass, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, length, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "length", "tokens")), strict=True):
                own = network.copy()
                at = np.append(0, np.cumsum(np.frombuffer(length, "<i8")))
                train(own, np.frombuffer(tokens, "<u2"), at, rate)
                pieces = [p.tobytes() for p in np.array_split(own.flat(), PIECES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(PIECES, shard, np.int32)), pa.array(np.full(PIECES, at[-1])), pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(pieces)],
                    ["shard", "n", "piece", "weights"])

    return run


def _average(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """One piece of the weights of all shards, averaged by their tokens."""
    parts = parts.sort_by("shard")
    n = parts.column("n").to_numpy()
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) * k for p, k in zip(parts.column("weights").to_pylist(), n, strict=True))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([(total / n.sum()).astype(np.float32).tobytes()])})


def learned_shards(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per shard with the whole texts of its learned documents: shard, length, tokens."""
    coded = docs.filter("learned").select("shard", "doc_id", "text").mapInArrow(_encode(vocabulary), "shard int, doc_id long, tokens binary")
    return coded.groupBy("shard").applyInArrow(_pack, "shard int, length binary, tokens binary")


def fit(docs: DataFrame, vocabulary: Vocabulary, shards: int) -> Network | None:
    """The network trained on the whole texts of all learned documents."""
    if not vocabulary.total:
        return None
    network = Network(vocabulary)
    network.end = int(vocabulary.ranks(np.array([END]))[0])
    # with more shards than fill so many rounds, each round has more of them
    rounds = min(-(-shards // ROUND_SHARDS), MOST_ROUNDS)
    packed = settle(learned_shards(docs, vocabulary), "learned")
    for r in range(rounds):
        own = packed.filter(F.col("shard") % rounds == r).repartitionById(-(-shards // rounds), F.floor(F.col("shard") / rounds).cast("int"))
        trained = own.mapInArrow(_train(network, RATE * (1 - 0.75 * r / rounds)), "shard int, n long, piece int, weights binary")
        pieces = trained.groupBy("piece").applyInArrow(_average, "piece int, weights binary").collect()
        if pieces:  # a round's shards may hold no learned document
            network.set_flat(np.concatenate([np.frombuffer(p.weights, np.float32) for p in sorted(pieces, key=lambda p: p.piece)]))
    return network


def _score(network: Network | None, vocabulary: Vocabulary, end_count: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, counts: pa.Table) -> pa.Table:
        names = counts.column("word").to_numpy().view(np.uint64)
        number = np.append(counts.column("n").to_numpy(), 0)  # the last: of a word that is not there
        # in one order however they arrived: a row's place in a product may show in its last digits
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = docs.column("text").combine_chunks()
        parts = []
        for low, high in slices(texts):
            hashes, tails, first = text_words(*text_bytes(texts[low:high]))
            parts.append((with_ends(hashes, first, END)[0], with_ends(tails, first, 0)[0], np.diff(first) + 1))
        if not parts:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        hashes, tails, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        count = np.where(hashes == END, end_count, number[_places(hashes, names)])
        at = np.append(0, np.cumsum(length))
        text = np.repeat(np.arange(len(length)), length)
        logs = np.log(vocabulary.chance(count))
        base = np.bincount(text, logs, len(length)) / np.log(10)
        score = base
        if network:
            ranks = vocabulary.ranks(hashes)
            inside = np.where(ranks >= 0, 0.0, logs - np.log(vocabulary.rest()))
            whole = score_texts(network, _rows_of(ranks, tails, len(vocabulary.names)), ranks, at)
            score = (whole + np.bincount(text, inside, len(length))) / np.log(10)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(length),
            "n_known": pa.array(np.bincount(text, count > 0, len(length)).astype(np.int64)), "train_tokens": pa.array(np.full(len(length), vocabulary.total)),
            "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ready(docs.sparkSession)
    held_out = fold("doc_id", folds) == held
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"held_out": F.coalesce(held_out, F.lit(False)), "learned": F.coalesce(~held_out, F.lit(False))})
    shards = max(1, -(-text_total(docs) // shard_bytes))
    rows = rows.withColumn("shard", shard_of(shards, "doc_id", "text"))
    listed = rows.groupBy("shard").applyInArrow(_list_words, "shard int, word long, n long")
    listed = settle(listed, "listed")
    counts = settle(listed.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "counts")
    ends = rows.filter("learned").count()
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shortlist = min(int(SHORTLIST * (found[0] + ends) ** 0.25) + 1, MOST_ROWS)
    frequent = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(shortlist - 1).collect()
    both = [(r.n, np.int64(r.word).astype(np.uint64)) for r in frequent] + ([(ends, END)] if ends else [])
    both.sort(key=lambda x: (-x[0], int(x[1])))
    vocabulary = Vocabulary(found[0] + ends, found[1] + bool(ends), np.array([w for _, w in both], np.uint64), np.array([n for n, _ in both], np.int64))
    network = fit(rows, vocabulary, shards)
    # both sides are plain reads: a word that every shard has is split by AQE
    wanted = listed.select("shard", "word").join(counts, "word")
    return rows.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_score(network, vocabulary, ends), _RESULT)
