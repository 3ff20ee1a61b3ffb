"""Classifiers learn from the whole of a text and from every class, wherever it shows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from folio.llm import byte_cnn, passage_quality
from folio.llm.training import draw


def learned(n, folds=4, held=2):
    """The first n ids that are learned from."""
    return [i for i in range(1, 10 * n) if zlib.crc32(str(i).encode()) % folds != held][:n]


def test_draws_cover_all_rows_and_stay_the_same():
    assert draw(5, 9, 1).tolist() == [0, 1, 2, 3, 4]
    drawn = draw(1000, 40, 7)
    assert (drawn == draw(1000, 40, 7)).all() and len(set(drawn.tolist())) == 40 and drawn[-1] > 800 and drawn[0] < 200
    assert len(draw(100, 10, None)) == len(draw(100, 10, -5)) == 10


def test_a_document_that_is_bad_only_later_teaches(spark):
    draw_ = random.Random(1)
    good = [" ".join(draw_.choice(["river", "stone", "garden", "window", "letter"]) for _ in range(400)) for _ in range(40)]
    # sixty clean passages, then junk: a prefix of forty would teach clean text as bad
    bad = [("river stone garden window letter " * 1000)[: 512 * 60] + "$$$ !!! ### " * 1500 for _ in range(40)]
    ids = learned(80)
    docs = spark.createDataFrame(list(zip(ids, good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n < 40), 0) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    clean = ("river stone garden window letter " * 200)[:5000]
    extra = spark.createDataFrame([(-1, clean), (-2, clean + "$$$ !!! ### " * 800)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in passage_quality.quality_scores(docs.unionByName(extra), labels).collect()}
    assert got[-1] > 0.7 > 0.5 > got[-2]
    assert np.mean([got[i] for i in ids[:40]]) > 0.8 > 0.2 > np.mean([got[i] for i in ids[40:]])


def test_201_languages_are_all_learned(spark):
    draw_ = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:03d}" for i in range(201)]
    rows, ids = [], iter(learned(201 * 3))
    for i, name in enumerate(names):
        for _ in range(3):
            rows.append((next(ids), " ".join(letters[i % 26] + letters[i // 26] + draw_.choice("xyz") for _ in range(60)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    weights, languages = byte_cnn.fit(docs, byte_cnn.fold("doc_id", 4) == 2)
    assert languages == names and weights["out"].shape[1] == 201


def test_windows_come_from_the_whole_of_a_long_text(spark):
    ids = learned(40)
    # what tells the languages apart comes after the first 3,000 characters
    rows = [(i, "0123456789 " * 400 + ("la rivière à côté " if n % 2 else "der fluß über ") * 900, "fr" if n % 2 else "de") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in byte_cnn.identify(docs).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 38
