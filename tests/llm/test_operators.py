"""Every query against SQL, a plain version, a library or held-out labels, on whole small tables."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402
from compare import connect, differences  # noqa: E402
from folio.llm import bitsliced_topk, catalog, odd_sketch, packing, passage_quality, sentencepiece_index, suffix_dedup, trie_dedup, warc  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, data_dir, name):
    assert differences(catalog.QUERIES[name](spark, data_dir), connect(data_dir), catalog.ORACLES[name]) == ""


def test_sentencepiece_equals_the_library(spark, data_dir, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_path("piece_bpe_32k.model"))
    odd = ["", " ", "  a  b ", "▁a", "a" * 300, "<s> </s>", "🙂 ﬁ \0 é", "\n\n x\t", "the" + " " * 9 + "end"]
    docs = spark.createDataFrame([*texts.items(), *((10_000 + i, t) for i, t in enumerate(odd)), (20_000, None)], "doc_id long, text string")
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepiece_index.encode(docs, path)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    back = {r.doc_id: r.text for r in sentencepiece_index.decode(encoded, path).collect()}
    for doc, text in [(r.doc_id, r.text) for r in docs.collect()]:
        assert got[doc] == model.encode(text or ""), text
        assert back[doc] == (text or "").replace("▁", " ")


def test_bit_slices_add_and_select_exactly():
    rng = np.random.default_rng(3)
    values = rng.integers(-40, 41, (300, 7))
    low, width, slices = bitsliced_topk.build_slices(values)
    ids = np.arange(300) * 2
    for _ in range(30):
        query = rng.integers(-3, 4, 7)  # few values: many ties
        found, scores = bitsliced_topk.search_block(ids, low, width, slices, 10, query, 12)
        want = sorted(((-int(v @ query), int(i)) for i, v in zip(ids, values, strict=True) if i != 10))[:12]
        assert sorted((-s, int(i)) for i, s in zip(found, scores, strict=True)) == want


def test_topk_of_many_blocks(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    whole = bitsliced_topk.top_k(table, F.col("vec_id") % 20 == 0, k=5)
    cut = bitsliced_topk.top_k(table, F.col("vec_id") % 20 == 0, k=5, block_rows=60, block_queries=4)
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_language_model(spark, data_dir, texts):
    rows = catalog.op3_lm_score(spark, data_dir).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(t for d, text in texts.items() if not held[d] for t in plain.tokens(text))
    total = sum(counts.values())
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        own = plain.tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(t in counts for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own))
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


@pytest.mark.parametrize("shard_bytes,common", [(6 << 20, 16384), (40_000, 16384), (40_000, 4)])
def test_repeats(documents, texts, monkeypatch, shard_bytes, common):
    monkeypatch.setattr(suffix_dedup, "COMMON_RUNS", common)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 100_000)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeated_spans(documents, shard_bytes).collect()}
    assert got == plain.repeats(texts.items())


@pytest.mark.parametrize("text", [b"", b"a", b"banana" * 40, bytes(300), b"ab" * 200 + b"\0" * 9, bytes(range(256)) * 2])
def test_suffix_array_and_common_prefixes(text):
    body = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_array(body, depth=len(text) + 1)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    if len(text) > 1:
        common = suffix_dedup.common_prefixes(body, order, enough=50)
        for before, at in zip(order, order[1:], strict=False):
            n = 0
            while max(at, before) + n < len(text) and text[at + n] == text[before + n]:
                n += 1
            assert common[at] == n or (n >= 50 and 50 <= common[at] <= n)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(documents, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch.near_groups(documents, k, 80).collect()}
    assert got == plain.near(texts.items(), k, 80)


def test_near_duplicates_of_a_large_bucket(spark):
    """Variants of one text, chains among them, and a common opening that links nothing."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            own[at] = f"v{rng.integers(5)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base[:30] + [f"x{i}-{j}" for j in range(30)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch.near_groups(docs, 4, 80).collect()}
    assert got == plain.near(rows, 4, 80)


def test_packing(spark, data_dir, texts):
    tokenizers = pytest.importorskip("tokenizers")
    path = catalog.tokenizer_path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    documents = spark.read.parquet(f"{data_dir}/documents.parquet")
    placed = packing.packed_documents(documents, path)
    rows = placed.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total, ids_of = 0, {}
    for doc, text in texts.items():
        ids = ids_of[doc] = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        total, at = total + len(ids), 0
        for n, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            own = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(own)) and (n == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids) and len(pieces[doc]) == -(-len(ids) // 1024)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 2
    written = {r.sequence_id: r.ids for r in packing.sequences(documents, placed, path).collect()}
    for r in rows:
        assert written[r.sequence_id][r.offset : r.offset + r.length] == ids_of[r.doc_id][r.start : r.start + r.length]


def test_genetic_packing_beats_its_start():
    import random

    chance = random.Random(4)
    sizes = sorted((chance.choice([201, 251, 261, 333, 341, 512, 520]) for _ in range(300)), reverse=True)
    start = packing.Packing(sizes, 1024)
    start.best_fit(list(range(len(sizes))))
    best = packing.evolve(sizes, 1024, 1, [], generations=40)
    assert best.cost() <= start.cost()
    assert sorted(i for g in best.groups for i in g) == list(range(300)) and all(sum(sizes[i] for i in g) <= 1024 for g in best.groups)


def test_archives_hold_each_payload_once(spark, data_dir, tmp_path):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet").select("page_id", "url", "html")
    copies = pages.filter("page_id < 20").select((F.col("page_id") + 100_000).alias("page_id"), F.lit("http://a b\r\n").alias("url"), "html")
    both = pages.unionByName(copies)
    warc.write_archives(both, str(tmp_path / "archives"), date="2024-05-06T07:08:09Z", file_records=30)
    read = warc.read_archives(spark, str(tmp_path / "archives"))
    assert {(r.page_id, r.payload.decode()) for r in read.filter("payload_bytes >= 100").collect()} == {(r.page_id, r.html) for r in both.collect() if len(r.html.encode()) >= 100}
    again = read.filter("page_id >= 100000")
    assert again.filter("record_type = 'revisit' and refers_to = page_id - 100000 and url = 'http://a%20b%0D%0A'").count() == again.count()


def test_language(spark, data_dir):
    found = catalog.op5_language(spark, data_dir).join(spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found)


def test_quality(spark, data_dir):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    found = catalog.op9_quality(spark, data_dir).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found)


def test_gradients_of_the_bags():
    rng = np.random.default_rng(2)
    features, bag, labels = rng.normal(size=(9, passage_quality.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model = passage_quality.Bags.fresh(np.zeros(passage_quality.FEATURES), np.ones(passage_quality.FEATURES))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        s = model.forward(features, bag, 3)["score"]
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    for name, gradient in model.gradients(features, bag, labels).items():
        w = model.weights[name]
        at = (0,) * w.ndim
        before = w[at]
        w[at] = before + 1e-5
        up = loss()
        w[at] = before - 1e-5
        down = loss()
        w[at] = before
        decay = 1e-4 * before if name == "encode" else 0
        assert gradient[at] - decay == pytest.approx((up - down) / 2e-5, abs=1e-5), name


def test_trie():
    trie = trie_dedup.ByteTrie()
    words = [b"", b"a", b"abc", b"abd", b"ab", b"abc", b"xyz", b"a"]
    for i, w in enumerate(words):
        trie.insert(w, 10 - i)
    first = {t: (o, n) for t, o, _, n in trie.take(ord("a"))}
    assert first == {b"a": (3, 2), b"abc": (5, 2), b"abd": (7, 1), b"ab": (6, 1)}
    assert {t for t, *_ in trie.take()} == {b"", b"xyz"} and trie.held == 0


def test_spilled_tries_give_the_same_owners(spark, documents):
    whole = {r.sha: tuple(r) for r in trie_dedup.text_owners(documents).collect()}
    spilled = {r.sha: tuple(r) for r in trie_dedup.text_owners(documents.repartition(3), budget=2000).collect()}
    assert whole == spilled
