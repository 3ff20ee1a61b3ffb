"""What is learned comes from whole texts of all documents."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from folio.llm import recurrent_lm


def test_language_model_learns_from_whole_texts(spark):
    noise = np.random.default_rng(3)
    texts = {i: " ".join([*(f"n{k}" for k in noise.integers(300, size=1200)), *["ping pong"] * 800]) for i in range(30)}
    assert all(len(" ".join(t.split()[:1200])) > 4000 for t in texts.values())
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([*texts.items(), (held, " ".join(["ping pong"] * 200))], "doc_id long, text string")
    row = recurrent_lm.score_documents(docs).filter(F.col("doc_id") == held).first()
    assert row.held_out and (row.score - row.base_score) / row.n_tokens > 0.15


def test_language_model_learns_every_document(spark):
    rows = [(i, "" if i % 9 == 0 else " ".join(f"w{(i * j) % 41}" for j in range(i % 50))) for i in range(900)] + [(901, "long " * 5000)]
    docs = spark.createDataFrame([(i, t, i % 7) for i, t in rows], "doc_id long, text string, shard int").withColumn("learned", F.lit(True))
    names = np.array([recurrent_lm.END], np.uint64)
    packed = recurrent_lm.learned_shards(docs, recurrent_lm.Vocabulary(1, 1, names, np.array([1]))).collect()
    length = np.concatenate([np.frombuffer(r.length, "<i8") for r in packed])
    ends = sum(int((np.frombuffer(r.tokens, "<u2") == 0).sum()) for r in packed)
    assert sorted(length) == sorted(len(t.split()) + 1 for _, t in rows) and ends == len(rows)
