"""Texts of a regular build that a polynomial hash takes for one."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import plain
from folio.llm import catalog, odd_sketch, recurrent_lm, sentencepiece_index, text


def regular(n):
    """The Thue-Morse word over a and b, of length n, and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate({97: "b", 98: "a"})


@pytest.fixture(scope="module")
def docs(spark):
    one, two = regular(2048)
    rows = [(1, one), (2, two), (3, f"x {one} y"), (4, f"x {two} y"), (5, one + " " + "c" * 3000), (6, one + " " + "d" * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_differ_and_equal_words_do_not():
    one, two = regular(2048)
    items = [one, two, "c" * 3000, "d" * 3000, "a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefgh\0", "", "A", one, "abcdefgh"]
    body = np.frombuffer("".join(items).encode(), np.uint8)
    end = np.cumsum([len(i) for i in items])
    start = np.append(0, end[:-1])
    hashes = text.text_hash(body, start, end)
    assert [[hashes[i] == hashes[j] for j in range(len(items))] for i in range(len(items))] == [[a == b for b in items] for a in items]
    folded = text.text_hash(body, start, end, folded=True)
    assert folded[items.index("A")] == folded[items.index("a")] == hashes[items.index("a")]


def test_a_hash_shared_by_two_units_changes_nothing(monkeypatch):
    from tokenizers import Tokenizer

    from folio.llm import byte_bpe

    path = catalog.tokenizer_path("byte_bpe_50k.json")
    texts = ["the cat sat on the mat", "the dog sat", "the the cat", "", " mat"]
    body, at = text.text_bytes(__import__("pyarrow").array(texts))
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(path))
    encoder.encode(*text.text_bytes(__import__("pyarrow").array(["warm up the cache"])))
    # every unit has the hash of its length
    monkeypatch.setattr(text, "text_hash", lambda body, start, end, folded=False: (end - start).astype(np.uint64))
    ids, cuts = encoder.encode(body, at)
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_pieces_are_those_of_the_library(docs):
    from sentencepiece import SentencePieceProcessor

    path = catalog.tokenizer_path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    for r in sentencepiece_index.encode(docs, path).join(docs, "doc_id").collect():
        assert r.ids == library.encode(r.text)


def test_packed_ids_are_those_of_the_library(docs):
    from folio.llm import packing
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in packing.packed_documents(docs, path).collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_documents_that_share_nothing_are_not_linked(docs):
    want = plain.near([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch.near_groups(docs, 4, 80).collect()}
    assert got == want and got[2][1] == 2


def test_a_word_that_was_never_learned_is_not_known(spark):
    one, two = regular(2048)
    held = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learned = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 7 != 2)
    table = spark.createDataFrame([(learned, one), (held, two)], "doc_id long, text string")
    got = {r.doc_id: r for r in recurrent_lm.score_documents(table).collect()}
    assert (got[learned].n_known, got[held].n_known) == (2, 1)  # the end is known to both
