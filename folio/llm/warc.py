"""WARC archives in which a payload seen before is written as a revisit record.

Headers alone (id, address, length, digest) are shuffled by payload digest: of records with
equal payloads of at least ``MIN_PAYLOAD`` bytes, the smallest page id is the response and
the others revisit it.  Archives are written by Spark's text writer, whose commit protocol
survives lost tasks, in files bounded by bytes (``FILE_SIZES``); a record's closing line
breaks are the line separator.  Reading takes the archives as binary files, inflates them piece by piece, cuts
them by Content-Length, digests what it finds and joins revisits to their responses.

Rows: a null html is an empty payload, a null address gives no WARC-Target-URI, a row
without page id is always a response; rows that repeat the smallest page id are all responses.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio.llm.cluster import ready
from folio.session import join_small, scratch_path, settle

#: Smaller payloads are never replaced by a revisit record.
MIN_PAYLOAD = 100
#: Records in an archive file, for payloads of up to so many bytes: 256 MB, or one larger record.
FILE_SIZES = ((1 << 16, 4000), (1 << 22, 64), (1 << 62, 1))
#: Bytes read from an archive at once.
PIECE = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes and payload_digest of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, payload_digest and refers_to of the pages whose payload an earlier page holds."""
    known = headers(pages).filter((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull())
    first = known.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"))
    shared = first.filter(F.col("_last") > F.col("refers_to")).drop("_last")
    # both sides are plain shuffles, so a payload that very many pages have is split
    joined = join_small(known.select("page_id", "payload_digest"), shared, ["payload_digest"], "inner")
    return joined.filter(F.col("page_id") > F.col("refers_to")).dropDuplicates(["page_id", "payload_digest"])


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters and spaces are percent-encoded."""
    value = value.cast("string")
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        value = F.replace(value, F.lit(char), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, date: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """One WARC record per page, without its closing line breaks, as ``value``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
    ).join(revisits(pages, min_payload), ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(_END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    rows = rows.withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        F.lit("WARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\n"), _line("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(_END),
    )
    return rows.select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, date: str | None = None, file_records: int | None = None) -> None:
    """Write ``pages`` as deduplicated, compressed archives below ``path``.

    Equal payloads have equal sizes, so they are written together.  ``file_records`` lowers the records of a file further.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    lows = [0, *(most + 1 for most, _ in FILE_SIZES[:-1])]
    own = [(size >= low) & (size <= most) for low, (most, _) in zip(lows, FILE_SIZES, strict=True)]
    held = pages.agg(*[F.count_if(c) for c in own]).first()
    for i, (_, most) in enumerate(FILE_SIZES):
        if held[i] or (i == 0 and not any(held)):
            writer = records(pages.filter(own[i]), date, min_payload).write.mode("append").option("lineSep", _END).option("compression", "gzip")
            writer.option("maxRecordsPerFile", min(most, file_records or most)).text(path)


_ID = re.compile(r"<urn:page:(-?\d+)>")
_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a compressed file of any number of members, in pieces."""
    stream = zlib.decompressobj(wbits=47)
    for at in range(0, len(content), PIECE):
        data = content[at : at + PIECE]
        while data:
            out = stream.decompress(data, 4 * PIECE)
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(wbits=47)
    out = stream.flush()
    if out:
        yield out


class _Buffer:
    """Bytes that arrive in pieces; what has been used up is let go."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data, self.at = iter(pieces), b"", 0

    def more(self, wanted: int = 1) -> bool:
        """Bring at least so many more bytes, if there are any."""
        parts, got = [self.data[self.at :]], 0
        self.at = 0
        for piece in self.pieces:
            parts.append(piece)
            got += len(piece)
            if got >= wanted:
                break
        self.data = b"".join(parts)
        return got > 0

    def find(self, mark: bytes) -> int:
        stop = self.data.find(mark, self.at)
        while stop < 0 and self.more():
            stop = self.data.find(mark, self.at)
        return stop

    def take(self, size: int) -> bytes:
        missing = self.at + size - len(self.data)
        if missing > 0:
            self.more(missing)
        out = self.data[self.at : self.at + size]
        self.at += size
        return out


def parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of one archive, cut by their Content-Length; what they declare is checked."""
    buffer = _Buffer(pieces)
    while buffer.at < len(buffer.data) or buffer.more():
        stop = buffer.find(b"\r\n\r\n")
        version, *lines = buffer.take(max(0, stop - buffer.at)).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:80]}")
        buffer.take(4)
        head = dict(line.split(": ", 1) for line in lines)
        body = buffer.take(int(head["Content-Length"]))
        if len(body) != int(head["Content-Length"]):
            raise ValueError(f"{head['WARC-Record-ID']}: the archive ends within the record")
        buffer.take(4)
        payload = memoryview(body)[body.index(b"\r\n\r\n") + 4 :]
        page = _ID.fullmatch(head["WARC-Record-ID"])
        refers = _ID.fullmatch(head.get("WARC-Refers-To", ""))
        if refers is None and f"sha256:{hashlib.sha256(payload).hexdigest()}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
        yield (
            int(page[1]) if page else None, head.get("WARC-Target-URI"), head["WARC-Type"], len(payload) if refers is None else None,
            head["WARC-Payload-Digest"].removeprefix("sha256:"), int(refers[1]) if refers else None, payload,
        )


def _read(payloads: bool):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [x.split(" ")[0] for x in _READ.split(", ")]

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for files in batches:
            for content in files.column(0):
                rows, held = [], 0
                for record in parse(inflate(content.as_py())):
                    rows.append((*record[:-1], bytes(record[-1]) if payloads and record[2] == "response" else None))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) == 5000 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record; a revisit gets the length, and with ``payloads`` the payload, of its response."""
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(_read(payloads), _READ)
    payload = ["payload"] if payloads else []
    if not payloads:
        found = settle(found.drop("payload"), "records")
    wanted = found.filter("record_type = 'revisit'")
    originals = found.filter("record_type = 'response'")
    # rows that repeat a page and its payload are one original
    held = originals.join(wanted.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
    held = held.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", *payload).dropDuplicates(["refers_to", "payload_digest"])
    resolved = wanted.drop("payload_bytes", "payload").join(held, ["refers_to", "payload_digest"], "left")
    return originals.unionByName(resolved.select(*originals.columns))


def archive_round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write the pages to the shared folder and read them back: one row per page, without payloads."""
    spark = ready(pages.sparkSession)
    path = scratch_path(spark, "archives")
    write_archives(pages, path, min_payload)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
