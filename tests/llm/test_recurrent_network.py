"""The recurrent network against a plain forward pass and finite differences."""

from __future__ import annotations

import numpy as np
import pytest

from folio.llm import recurrent_lm


@pytest.fixture
def network():
    """Random weights in double precision; eleven words with outputs of their own, the end among them."""
    rng = np.random.default_rng(7)
    counts = np.array([40, 30, 22, 15, 9, 8, 7, 5, 4, 2, 1])
    vocabulary = recurrent_lm.Vocabulary(200, 20, np.append(np.arange(10, 20), [recurrent_lm.END]).astype(np.uint64), counts)
    made = recurrent_lm.Network(vocabulary)
    made.end = int(vocabulary.ranks(np.array([recurrent_lm.END]))[0])
    made.weights = {k: np.where(v < -1e8, v, v + rng.normal(0, 0.3, v.shape)) for k, v in ((k, v.astype(np.float64)) for k, v in made.weights.items())}
    return made


def texts(network, lengths, seed=1):
    """Rows of tokens (each text ends with the end) and offsets; some are words without outputs of their own."""
    rng = np.random.default_rng(seed)
    known = len(network.weights["input"]) - recurrent_lm.TAILS
    parts = [np.append(rng.choice([*range(known - 1), known + 3, known + 9], n), network.end) for n in lengths]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def plain(network, rows):
    """Natural logarithm of a text's probability, token by token."""
    w, s, known = network.weights, recurrent_lm.HIDDEN, len(network.weights["input"]) - recurrent_lm.TAILS
    h, previous, out = np.zeros(s), network.end, 0.0
    for row in rows:
        a = w["input"][previous] + h @ w["state"] + w["bias"]
        keep, fresh = 1 / (1 + np.exp(-a[:s])), np.tanh(a[s:])
        h = keep * h + (1 - keep) * fresh
        logits = h @ w["classes"] + w["classes_bias"]
        cls = row // network.class_words if row < known else network.rest
        out += logits[cls] - np.log(np.exp(logits).sum())
        if row < known:
            inner = h @ w["words"][cls] + w["words_bias"][cls]
            out += inner[row % network.class_words] - np.log(np.exp(inner).sum())
        previous = row
    return out


def test_scores_are_those_of_a_plain_forward_pass(network, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "TOGETHER", 3)
    rows, at = texts(network, [0, 1, 5, 130, 49, 48, 47, 2])
    known = len(network.weights["input"]) - recurrent_lm.TAILS
    got = recurrent_lm.score_texts(network, rows, np.where(rows < known, rows, -1), at)
    want = [plain(network, rows[a:b]) for a, b in zip(at, at[1:])]
    assert got == pytest.approx(want, rel=1e-5)


def test_the_chances_of_all_words_sum_to_one(network):
    state = np.random.default_rng(2).normal(0, 1, (1, recurrent_lm.HIDDEN))
    known = len(network.weights["input"]) - recurrent_lm.TAILS
    ranks = np.append(np.arange(known), -1)
    assert np.exp(network.log_chances(np.repeat(state, len(ranks), axis=0), ranks)).sum() == pytest.approx(1)


def test_gradients_are_those_of_finite_differences(network, monkeypatch):
    taken = []

    class Recorder:
        def __init__(self, *args):
            self.steps = 0

        def step(self, grads):
            taken.append({k: v.copy() for k, v in grads.items()})

    monkeypatch.setattr(recurrent_lm, "Adam", Recorder)
    monkeypatch.setattr(recurrent_lm, "STREAMS", 3)
    monkeypatch.setattr(recurrent_lm, "STEPS", 64)  # nothing is truncated
    rows, at = texts(network, [4, 9, 0, 7, 3])
    recurrent_lm.train(network, rows, at, 0.1)
    assert len(taken) == 1

    def loss():
        return -sum(plain(network, rows[a:b]) for a, b in zip(at, at[1:])) / len(rows)

    rng = np.random.default_rng(3)
    for name, values in network.weights.items():
        for _ in range(12):
            i = tuple(rng.integers(0, n) for n in values.shape)
            if values[i] < -1e8:
                continue
            old = values[i]
            values[i] = old + 1e-5
            up = loss()
            values[i] = old - 1e-5
            slope = (up - loss()) / 2e-5
            values[i] = old
            assert taken[0][name][i] == pytest.approx(slope, rel=1e-3, abs=2e-6), name


def test_weights_moments_and_steps_travel_together(network):
    rows, at = texts(network, [30, 20, 10])
    network.weights = {k: v.astype(np.float32) for k, v in network.weights.items()}
    recurrent_lm.train(network, rows, at, 0.01)
    other = network.copy()
    other.set_flat(network.flat())
    assert other.steps == network.steps > 0
    for part in ("weights", "first", "second"):
        assert all((getattr(other, part)[k] == v).all() for k, v in getattr(network, part).items())


def test_training_brings_the_loss_down(network):
    rows, at = texts(network, [200] * 6)
    rows[: at[-1] - 1 : 2] = 0  # every other word is the same
    rows[at[1:] - 1] = network.end
    network.weights = {k: v.astype(np.float32) for k, v in network.weights.items()}
    before = sum(plain(network, rows[a:b]) for a, b in zip(at, at[1:]))
    for _ in range(5):
        recurrent_lm.train(network, rows, at, 0.02)
    assert sum(plain(network, rows[a:b]) for a, b in zip(at, at[1:])) > 0.8 * before


def test_words_are_found_by_their_hashes():
    names = np.array([7, 0, 2**64 - 1, 3], np.uint64)
    assert recurrent_lm._places(np.array([3, 7, 5, 2**64 - 1, 0], np.uint64), names).tolist() == [3, 0, -1, 2, 1]
    assert recurrent_lm._places(np.zeros(0, np.uint64), names).tolist() == []
    values, which = recurrent_lm._distinct(np.array([9, 2, 9, 2**63], np.uint64))
    assert values[which].tolist() == [9, 2, 9, 2**63] and len(values) == 3
    by, edges = recurrent_lm._by_class(np.array([2, 0, 2, 4]), 5)
    assert by.tolist() == [1, 0, 2, 3] and edges.tolist() == [0, 1, 1, 3, 3, 4]
