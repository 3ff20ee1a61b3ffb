"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bitsliced_topk, byte_cnn, catalog, odd_sketch, packing, passage_quality, recurrent_lm, sentencepiece_index, suffix_dedup, trie_dedup, warc
from folio.llm.cluster import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, key string, text_key string, others string"
SENTENCE = " ".join(f"word{i}" for i in range(40))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def rows():
    texts = [(1, SENTENCE), (2, SENTENCE), (2, SENTENCE), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (None, SENTENCE), (None, None), (7, "été 日本 🙂 " * 30), (8, "12 34 !!")]
    return [(d, t, None if t is None else "en", None, None, "s", "k", "y", "t", "o") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, None), (None, 1, 1), (7, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


def piece_path():
    return catalog.tokenizer_path("piece_bpe_32k.model")


def bpe_path():
    return catalog.tokenizer_path("byte_bpe_50k.json")


def operators(labels):
    return {
        "encode": lambda d: sentencepiece_index.round_trip(d, piece_path()),
        "score": recurrent_lm.score_documents,
        "repeats": suffix_dedup.repeated_spans,
        "language": byte_cnn.identify,
        "near": odd_sketch.near_groups,
        "quality": lambda d: passage_quality.quality_scores(d, labels),
        "exact": trie_dedup.exact_groups,
    }


@pytest.mark.parametrize("name", ["encode", "score", "repeats", "language", "near", "quality", "exact"])
def test_a_row_for_every_row_and_none_for_none(docs, none, labels, name):
    run = operators(labels)[name]
    got = run(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    assert run(none).count() == 0
    assert sorted(map(str, run(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_defined_results(docs, labels):
    language = {r.doc_id: r for r in byte_cnn.identify(docs).collect()}
    assert all((language[d].lang_pred, language[d].score) == ("und", 0.0) for d in (3, 4, 5, 8)) and language[1].lang_pred == "en"
    near = {r.doc_id: r for r in odd_sketch.near_groups(docs).collect() if r.doc_id}
    assert (near[2].component_id, near[2].kept, near[3].n_shingles, near[4].component_id) == (1, False, 0, 4)
    exact = trie_dedup.exact_groups(docs).filter("doc_id = 1").first()
    assert (exact.keep_id, exact.group_size, exact.kept) == (1, 4, True)
    spans = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs).collect()}
    assert spans[2].n_removed == spans[2].n_bytes == len(SENTENCE) and spans[1].n_removed == 0
    score = {r.doc_id: r for r in recurrent_lm.score_documents(docs).collect()}
    assert score[3].n_tokens == 1 and score[3].score < 0


def test_rows_that_stay_keep_all_columns(docs, none, labels):
    for stage in (trie_dedup.deduplicate, odd_sketch.deduplicate, suffix_dedup.remove_repeats, lambda d: passage_quality.keep_good(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns and out.filter("shard <> 's' or kept <> 'k'").count() == 0
        assert stage(none).count() == 0
    assert sorted(str(r.doc_id) for r in trie_dedup.deduplicate(docs).collect()) == ["1", "3", "5", "6", "7", "8"]
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).filter("doc_id is not null").collect()}
    assert 2 not in left and left[1] == SENTENCE and left[6] == LONG


def test_without_labels_or_languages(docs, labels):
    assert {r.score for r in passage_quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.lang_pred for r in byte_cnn.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    alone = recurrent_lm.score_documents(docs.filter("doc_id is null"))
    assert {(r.base_score, r.score, r.train_tokens) for r in alone.collect()} == {(0.0, 0.0, 0)}


def test_packing_repeated_rows(docs, none):
    out = packing.packed_documents(docs, bpe_path())
    assert out.filter("piece = 0").count() == docs.count() and packing.packed_documents(none, bpe_path()).count() == 0
    assert out.filter("length < 1 or length > 1024 or offset + length > 1024").count() == 0
    assert out.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame(
        [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-3.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0])],
        "vec_id long, embedding array<float>")
    got = [tuple(r) for r in bitsliced_topk.top_k(table, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    five = 64 * 64 * 5
    assert got == [(0, 1, 1, five), (0, 2, 20, five), (0, 3, 7, 64 * 64), (20, 1, 0, five), (20, 2, 1, five), (20, 3, 7, 64 * 64)]
    assert bitsliced_topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pages(spark):
    body = "x\r\n\r\ny WARC/1.1 " * 20
    table = spark.createDataFrame(
        [(1, "u", body), (2, None, body), (2, None, body), (3, "u\r\nA: b", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", body)],
        "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(table).collect()}
    n = len(body)
    assert got == {(1, n, "response", None), (2, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, n, "response", None)}
    assert warc.archive_round_trip(table).count() == 8 and warc.archive_round_trip(table.limit(0)).count() == 0


def test_batches_that_go_to_python_are_small(spark):
    ready(spark)
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 3000) as text")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 30_000_000 and max(r.n for r in sizes) <= 12 << 20
