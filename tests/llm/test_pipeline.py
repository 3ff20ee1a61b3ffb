"""Each stage against a plain version on the rows the stage before it kept."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from folio.session import settle  # noqa: E402


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        docs = settle(stage(spark, docs, data_dir), name)
        assert docs.columns == columns
        out[name] = before, {r.doc_id: r.text for r in docs.collect()}
    before, after = out["quality"]
    judged = [d for d in before if d in labels]
    assert sum((d in after) == (labels[d] == 1) for d in judged) >= 0.9 * len(judged)
    before, after = out["exact_dedup"]
    first = {}
    for doc in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[doc]), doc)
    assert set(after) == set(first.values())
    before, after = out["near_dedup"]
    assert set(after) == {doc for doc, (_, root) in plain.near(before.items(), 5, 80).items() if doc == root}
    before, after = out["suffix_dedup"]
    want = plain.repeats(before.items())
    assert set(after) == {d for d, (n, removed, *_) in want.items() if removed < n or not n}
    assert all(after[d] == before[d] for d in after if not want[d][1])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)
