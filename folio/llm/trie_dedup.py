"""Exact deduplication with compressed radix tries.

Texts are equal when identical after each run of white space became one space.  Every
task inserts its texts into a Patricia trie whose terminal nodes hold the smallest
identifier and the number of rows, so only one record per distinct text and task is
shuffled, by length and content hash; a copy held by a third of all rows costs no more
than any other.  A second trie per partition merges those records.  A trie that outgrows
its budget hands its largest subtree on and forgets it.

Rows: a null text counts as empty.  A null id is larger than any other.  Rows that repeat
both id and text cannot be told apart and are all marked as kept; ``deduplicate`` leaves one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready
from folio.session import settle

#: Bytes of labels a trie may hold before it hands a subtree on.
TRIE_BYTES = 48 << 20
_FLUSH_ROWS = 2000
_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(rb"  +")
SPACES = "[\\x20\\x09-\\x0D]+"

_PARTIAL = "length long, content_hash long, sha string, text binary, keep_id long, ties long, group_size long"
_OWNER = "sha string, keep_id long, ties long, group_size long"


def normalised(text: bytes) -> bytes:
    text = text.translate(_WHITE)
    return _RUNS.sub(b" ", text) if b"  " in text else text


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("label", "children", "owner", "ties", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.ties, self.rows = label, {}, None, 0, 0


class ByteTrie:
    """A compressed radix trie over whole byte strings."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, owner: int | None, ties: int = 1, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(child.label)
                node, at = child, len(text)
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                shared = common_length(child.label, text[at : at + len(child.label)])
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = upper
                node, at = upper, at + shared
        if not node.rows or (owner is not None and (node.owner is None or owner < node.owner)):
            node.owner, node.ties = owner, ties
        elif owner == node.owner:
            node.ties += ties
        node.rows += rows

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int, int]]:
        """Remove and return the terminals below the root's child ``first``, or all of them."""
        if first is None:
            stack, self.root, self.held = [(b"", self.root)], Node(b""), 0
        else:
            stack = [(b"", self.root.children.pop(first))]
        dropped = 0
        while stack:
            path, node = stack.pop()
            path += node.label
            dropped += len(node.label)
            if node.rows:
                yield path, node.owner, node.ties, node.rows
            stack += [(path, child) for child in node.children.values()]
        if first is not None:
            self.held -= dropped

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label)
            stack += node.children.values()
        return total

    def heaviest(self) -> int:
        """First byte of the largest subtree."""
        return max(self.root.children, key=lambda first: self.weight(self.root.children[first]))


def _records(terminals) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for text, owner, ties, n in terminals:
        sha = hashlib.sha256(text)
        rows.append((len(text), int.from_bytes(sha.digest()[:8], "big", signed=True), sha.hexdigest(), text, owner, ties, n))
        held += len(text)
        if len(rows) == _FLUSH_ROWS or held > 8 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("length", "content_hash", "sha", "text", "keep_id", "ties", "group_size")
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _local(budget: int):
    def run(batches):
        trie = ByteTrie()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_buffer()
                trie.insert(normalised(value.to_pybytes() if value is not None else b""), doc)
                while trie.held > budget and trie.root.children:
                    yield from _records(trie.take(trie.heaviest()))
        yield from _records(trie.take())

    return run


def _merge(budget: int):
    """Records come sorted by length and hash: when the key changes, all held texts are complete."""

    def owners(terminals):
        rows = [(hashlib.sha256(text).hexdigest(), owner, ties, n) for text, owner, ties, n in terminals]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sha", "keep_id", "ties", "group_size"])

    def run(batches):
        trie, key = ByteTrie(), None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("length", "content_hash", "text", "keep_id", "ties", "group_size")]
            for length, content, text, owner, ties, n in zip(*columns, strict=True):
                if (length, content) != key and trie.held > budget:
                    yield from owners(trie.take())
                key = (length, content)
                trie.insert(text, owner, ties, n)
        yield from owners(trie.take())

    return run


def text_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``sha``, ``keep_id`` (smallest id), ``ties`` (rows with it), ``group_size``."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    partial = rows.mapInArrow(_local(budget), _PARTIAL)
    placed = partial.repartition("length", "content_hash").sortWithinPartitions("length", "content_hash")
    return placed.mapInArrow(_merge(budget // 4), _OWNER)


def text_sha(text: str = "text"):
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    owners = text_owners(docs).withColumnRenamed("sha", "text_sha256")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha().alias("text_sha256"))
    return rows.join(owners, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays."""
    owners = settle(text_owners(docs), "owners").select(
        F.col("sha").alias("_folio_sha"), F.col("keep_id").alias("_folio_keep"), F.col("ties").alias("_folio_ties")
    )
    marked = docs.withColumn("_folio_sha", text_sha())

    def staying(some: DataFrame) -> DataFrame:
        same = (marked["_folio_sha"] == some["_folio_sha"]) & marked["doc_id"].cast("long").eqNullSafe(some["_folio_keep"])
        return marked.join(some, same, "left_semi")

    once = staying(owners.filter("_folio_ties = 1"))
    repeated = staying(owners.filter("_folio_ties > 1")).dropDuplicates(["doc_id", "_folio_sha"])
    return once.unionByName(repeated).drop("_folio_sha")
