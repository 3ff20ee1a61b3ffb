"""Hard negatives against brute force, with small blocks, odd rows and pruned indexes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, block string, q string, place string"


def plain(rows, every=5, positives=5, negatives=3):
    usable = []
    for vec_id, vector, label in rows:
        if None not in (vec_id, vector, label) and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(x))))) for x in vector], label))
    out = []
    anchors = {(v, tuple(q), label) for v, q, label in usable if v % every == 0}
    for anchor_id, own, label in anchors:
        scored = [(-sum(a * b for a, b in zip(own, q)), v, other == label) for v, q, other in usable if v != anchor_id]
        for score, positive, _ in sorted(s for s in scored if s[2])[:positives]:
            window = sorted(s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score)
            out.extend((anchor_id, positive, rank + 1, v, -score, -s) for rank, (s, v, _) in enumerate(window[:negatives]))
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, *"abqp") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 5 == 0, **more).collect())


def clustered(n, parts, labels, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, parts))
    rows = []
    for i in range(n):
        v = centres[draw.integers(6)] + 0.6 * draw.normal(size=parts)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(draw.integers(labels))))
    return rows


@pytest.mark.parametrize("cells", [300, 1 << 18])
def test_equals_brute_force(spark, cells):
    rows = clustered(240, 21, 3, 1)
    assert mined(spark, rows, block_cells=cells, group_cells=cells) == plain(rows)


def test_odd_rows(spark):
    rows = clustered(60, 9, 2, 2)
    same = [0.5, 0.25, 0.0]
    rows += [
        (None, same, 1), (61, None, 1), (62, same, None), (63, [0.5, None], 1), (64, [float("nan")], 0), (65, [float("inf")], 0), (66, [], 1), (70, [], 0),
        (71, same, 0), (72, same, 0), (73, same, 1), (75, same, 0), (75, same, 0), (75, same, 1), (74, same, 0), (74, same, 0),
        (80, [3e38, -3e38], 0), (81, [1e30], 0), (82, [2.5e37, 1.0], 1), (85, [-0.5, -0.5], 7), (86, [0.0] * 40, 7),
    ]
    assert mined(spark, rows) == plain(rows)


def test_no_rows_and_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.9], 2)]) == [(5, 6, 1, 7, 65536, 58880)]


def test_a_group_of_equal_vectors(spark):
    rows = [(i, [0.6, 0.8, 0.0], i % 2) for i in range(200)] + [(200 + i, [0.5, 0.6, 0.1], i % 2) for i in range(60)]
    assert mined(spark, rows, block_cells=60) == plain(rows)


def test_the_index_omits_what_cannot_reach_the_threshold():
    draw = random.Random(5)
    # energy falls from dimension to dimension, so norms of what is left do too
    values = np.array([[int(256 * draw.gauss(0, 1) * 0.9**d) for d in range(64)] for _ in range(500)], np.int64)
    block = hard_negatives.Block(np.arange(500), np.zeros(500, np.int64), values)
    anchors, norms = block.prepared(values[:20])
    level, least = 2, 0.45 * block.longest
    holds = block.index(level, least)[1]
    assert 0 < sum(holds) < 0.7 * 500 * len(holds)
    for anchor, own in zip(anchors, norms, strict=True):
        exact = block.values @ anchor
        found, scores = block.search(level, least, least * own[0], anchor, own, lambda labels: labels == 0)
        assert sorted(found) == sorted(np.flatnonzero(exact >= least * own[0])) and (exact[found] == scores).all()
