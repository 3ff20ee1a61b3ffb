"""Exact top-k by integer inner product on a bit-sliced index.

Components are quantised to ``floor(scale * x)``.  The index holds, for each block of
vectors and each component, one bitmap per binary digit.  A query's scores of a whole
block are the sum of those bitmaps, shifted by the set digits of the query's components
and added with carry-save adders on 64 rows at a time; a negative component adds the
complements.  The top rows are selected from the most significant slice of the sum
downward, and rows that tie at the boundary are taken by smallest id, which is bit order.

Every block of queries meets every block of the index, so both sides of a task are
bounded; each block hands on k rows per query.

Rows: vectors that are null or hold a null or non-finite component, and rows without id,
take no part; missing trailing components count as zero.  Ids should be unique: rows that
repeat one are all candidates, except for the query of the same id, whose vector is the
smallest of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.cluster import ready, shard_of
from folio.session import settle

#: Vectors in an index block and queries in a query block, about.
BLOCK_ROWS = 32768
BLOCK_QUERIES = 128

_INDEX = "block int, ids binary, low binary, width binary, slices binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    def usable(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    values = F.transform(vector, lambda x: x.cast("double"))
    return F.when(F.forall(values, usable), F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def build_slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and digits of each component, and the bitmaps of all digits, 64 rows to a word."""
    rows, parts = len(values), values.shape[1]
    low = values.min(axis=0) if rows else np.zeros(parts, np.int64)
    high = (values - low).astype(np.uint64)
    width = np.array([int(x).bit_length() for x in high.max(axis=0)] if rows else [0] * parts, np.int64)
    words = (rows + 63) // 64
    maps = np.zeros((int(width.sum()), words * 64), bool)
    at = 0
    for d in range(parts):
        for b in range(width[d]):
            maps[at, :rows] = (high[:, d] >> np.uint64(b)) & np.uint64(1)
            at += 1
    return low, width, np.packbits(maps, axis=1, bitorder="little").view(np.uint64).reshape(len(maps), words)


def add_slices(slices: np.ndarray, width: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The bitmaps of the sum of query[d] * value[d] minus a constant, least digit first, and the constant."""
    columns: dict[int, list[np.ndarray]] = {}
    first = np.concatenate([[0], np.cumsum(width)])
    constant = 0
    for d, q in enumerate(query.tolist()):
        constant += q * int(low[d])
        if q < 0:
            constant += q * ((1 << int(width[d])) - 1)
        own = slices[first[d] : first[d + 1]]
        own = ~own if q < 0 else own
        for j in range(abs(q).bit_length()):
            if abs(q) >> j & 1:
                for b in range(len(own)):
                    columns.setdefault(j + b, []).append(own[b])
    out, carries, k = [], [], 0
    while columns or carries:
        rows = columns.pop(k, [])
        now = np.concatenate([*([np.stack(rows)] if rows else []), *carries]) if rows or carries else np.zeros((0, slices.shape[1]), np.uint64)
        carries = []
        while len(now) > 2:
            t = len(now) // 3
            a, b, c = now[:t], now[t : 2 * t], now[2 * t : 3 * t]
            half = a ^ b
            carry = a & b
            carry |= half & c
            carries.append(carry)
            half ^= c
            now = np.concatenate([half, now[3 * t :]])
        if len(now) == 2:
            carries.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(slices.shape[1], np.uint64))
        k += 1
    return out, constant


def bit_positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """The k positions of ``among`` with the highest sums; ties go to the lower position."""
    sure, open_ = np.zeros_like(among), among
    for digit in reversed(total):
        ones = open_ & digit
        found = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(ones).sum())
        if found > k:
            open_ = ones
        else:
            sure = sure | ones
            open_ = open_ & ~digit
            if found == k:
                return bit_positions(sure)
    chosen = bit_positions(sure)
    return np.concatenate([chosen, bit_positions(open_)[: k - len(chosen)]])


def search_block(ids: np.ndarray, low, width, slices, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """Ids and scores of the k best rows of one block; ids are sorted."""
    among = np.zeros(slices.shape[1] * 64, bool)
    among[: len(ids)] = True
    among[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, "right")] = False
    among = np.packbits(among, bitorder="little").view(np.uint64)
    parts = max(len(low), len(query))
    # components that only one side has add nothing
    query = np.pad(query, (0, parts - len(query)))[: len(low)]
    total, constant = add_slices(slices, width, low, query)
    rows = select_top(total, among, k)
    scores = np.zeros(len(rows), object)
    for digit, bitmap in enumerate(total):
        scores += ((bitmap[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(object) << digit
    return ids[rows], [int(s) + constant for s in scores]


def _index(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    vectors = table.column("q").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    parts = int(lengths.max(initial=0))
    values = np.zeros((len(ids), parts), np.int64)
    values[np.arange(parts) < lengths[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    low, width, slices = build_slices(values[order])
    row = (key[0].as_py(), ids[order].astype(np.int64).tobytes(), low.astype(np.int64).tobytes(), width.tobytes(), slices.tobytes())
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "ids", "low", "width", "slices"])


def bit_sliced_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block of (vec_id, q): its ids in order, and its bitmaps."""
    placed = vectors.withColumn("block", shard_of(blocks, "vec_id", "q"))
    return placed.groupBy("block").applyInArrow(_index, _INDEX)


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, low, width = (np.frombuffer(row[c], np.int64) for c in ("ids", "low", "width"))
                slices = np.frombuffer(row["slices"], np.uint64).reshape(int(width.sum()), -1) if len(row["slices"]) else np.zeros((0, (len(ids) + 63) // 64), np.uint64)
                out: tuple[list, list, list] = ([], [], [])
                for query in row["queries"]:
                    found, scores = search_block(ids, low, width, slices, query["vec_id"], np.array(query["q"], np.int64), k)
                    out[0].extend([query["vec_id"]] * len(found))
                    out[1].extend(found.tolist())
                    out[2].extend(scores)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, queries: Column, k: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row that fulfils ``queries`` (over vec_id)."""
    spark = ready(embeddings.sparkSession)
    vectors = settle(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("q")).filter("vec_id is not null and q is not null"),
        "vectors",
    )
    blocks = max(1, -(-vectors.count() // block_rows))
    index = settle(bit_sliced_index(vectors, blocks), "index")
    asked = settle(vectors.filter(queries).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    groups = max(1, -(-asked.count() // block_queries))
    asked = asked.groupBy(shard_of(groups, "vec_id").alias("asked")).agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    # each block of queries is sent once to each block of the index
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = pairs.join(index, "block").repartition("block", "asked")
    found = met.select("queries", "ids", "low", "width", "slices").mapInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
