"""Archives bounded by bytes, read in pieces, and payloads that very many pages share."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from folio.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string, refers_to string, value string"


def expected(rows):
    out, first = set(), {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        original = first.setdefault(digest, page)
        revisit = len(body) >= 100 and original != page
        out.add((page, len(body), digest, "revisit" if revisit else "response", original if revisit else None))
    return out


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_SIZES", ((1000, 50), (100_000, 4), (1 << 62, 1)))
    rows = [(i, "http://a.org/", "x" * (10 * i)) for i in range(60)] + [(100 + i, None, f"{i % 3}" * 40_000) for i in range(9)] + [(200 + i, "u", "é" * 300_000) for i in range(3)]
    pages = spark.createDataFrame([(*r, "d", "r", "v") for r in rows], SCHEMA).coalesce(1)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    sizes = [len(gzip.decompress(bytes(f.content))) for f in files]
    assert len(sizes) >= 60 // 50 + 9 // 4 + 3 and sorted(sizes)[-4] < 200_000
    read = warc.read_archives(spark, path)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()} == expected(rows)
    assert {r.page_id: hashlib.sha256(r.payload).hexdigest() for r in read.collect()} == {r[0]: hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows}


def test_one_payload_for_a_third_of_all_pages(spark):
    rows = [(i, f"http://a.org/{i}", "same " * 40 if i % 3 == 0 else f"page {i} " * 20) for i in range(900)]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "d", "r", "v") for r in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == expected(rows) and len(got) == 900


def record(page, payload):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = hashlib.sha256(payload).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [7, 1000, 1 << 18])
def test_members_and_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    bodies = [b"", b"\r\n\r\n" * 5, b"x" * 5000, bytes(range(256)) * 9]
    whole = b"".join(record(i, b) for i, b in enumerate(bodies))
    one = gzip.compress(whole)
    many = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    for content in (one, many):
        assert [(r[0], bytes(r[-1])) for r in warc.parse(warc.inflate(content))] == list(enumerate(bodies))
    with pytest.raises(ValueError):
        list(warc.parse([whole[:-3000]]))
    with pytest.raises(ValueError):
        list(warc.parse([whole.replace(b"xxxx", b"xxxy", 1)]))
    assert list(warc.parse(warc.inflate(b""))) == []
