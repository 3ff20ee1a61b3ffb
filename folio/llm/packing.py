"""Packing of documents into sequences of bounded length by a grouping genetic algorithm.

Documents are tokenized, end with an end id, and are cut into pieces if longer than a
sequence.  Pieces are dealt to shards of some thousand.  For each shard several islands evolve
packings of their own: a packing's genes are whole sequences; crossover injects well-filled
sequences of one parent into another, removes those that hold the same pieces, and best-fits
the displaced pieces; mutation empties the least filled sequences.  After an epoch the islands'
elites migrate to all islands of the shard, which evolve again; the best packing is taken.  An
island stops at the fewest sequences that the pieces' lengths allow.

Rows: a null text is empty and still has its end id; rows that repeat an id are documents of
their own.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folio.llm.byte_bpe import Encoder, read_ranks
from folio.llm.cluster import ready, shard_of
from folio.llm.text import slices, text_bytes
from folio.session import settle

CAPACITY, END_ID = 1024, 2
SHARD_PIECES, ISLANDS, EPOCHS = 8192, 2, 2
POPULATION, GENERATIONS = 6, 12

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- pieces ----------------------------------------------------------------------------------


def _pieces(ranks: dict[bytes, int], capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        encoder = Encoder(ranks)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids, at = encoder.encode(*text_bytes(batch.column(1)[low:high]))
                rows = ([], [], [], [], [], [])
                for doc, a, b in zip(batch.column(0)[low:high].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    count = -(-len(whole) // capacity)
                    edge = len(whole) - capacity * (count - 1)
                    start = 0
                    for piece in range(count):
                        own = whole[start:edge]
                        for column, value in zip(rows, (doc, piece, start, len(own), zlib.crc32(own), own if with_ids else None), strict=True):
                            column.append(value)
                        start, edge = edge, edge + capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.record_batch(arrays if with_ids else arrays[:5], names=names if with_ids else names[:5])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(read_ranks(tokenizer), capacity, end_id, with_ids), _PIECE + (", ids array<long>" if with_ids else ""))


# ---- the genetic algorithm -------------------------------------------------------------------


class Packing:
    """Sequences (lists of pieces) and the room each has left; best fit by a bit set of rooms."""

    def __init__(self, sizes: list[int], capacity: int, groups: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.groups = [list(g) for g in groups]
        self.rooms = [capacity - sum(sizes[i] for i in g) for g in self.groups]

    def best_fit(self, pieces: list[int]) -> None:
        """Put each piece, longest first, into the sequence with the least sufficient room."""
        by_room: dict[int, list[int]] = {}
        present = 0
        for g, room in enumerate(self.rooms):
            by_room.setdefault(room, []).append(g)
            present |= 1 << room
        sizes = self.sizes
        for i in sorted(pieces, key=lambda i: -sizes[i]):
            size = sizes[i]
            fitting = present >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                group = by_room[room].pop()
                if not by_room[room]:
                    present ^= 1 << room
                self.groups[group].append(i)
            else:
                group, room = len(self.groups), self.capacity
                self.groups.append([i])
                self.rooms.append(room)
            room -= size
            self.rooms[group] = room
            by_room.setdefault(room, []).append(group)
            present |= 1 << room

    def cost(self) -> tuple[int, int]:
        """Fewer sequences, then fuller ones."""
        return len(self.groups), -sum((self.capacity - r) ** 2 for r in self.rooms)

    def by_fill(self) -> list[int]:
        return sorted(range(len(self.groups)), key=self.rooms.__getitem__)


def cross(one: Packing, other: Packing, chance: random.Random) -> Packing:
    """``one`` with a section of the well-filled sequences of ``other``."""
    full = other.by_fill()[: max(1, len(other.groups) // 2)]
    a, b = sorted(chance.randrange(len(full) + 1) for _ in range(2))
    injected = [other.groups[g] for g in full[a : b + 1]]
    held = {i for g in injected for i in g}
    kept, displaced = [], []
    for group in one.groups:
        if held.isdisjoint(group):
            kept.append(group)
        else:
            displaced += [i for i in group if i not in held]
    child = Packing(one.sizes, one.capacity, [*kept, *injected])
    child.best_fit(displaced)
    return child


def mutate(packing: Packing, chance: random.Random) -> Packing:
    """Empty the least filled sequences and a few others, and best-fit their pieces."""
    order = packing.by_fill()
    out = set(order[-max(1, len(order) // 50) :]) | set(chance.sample(order, min(len(order), 3)))
    fresh = Packing(packing.sizes, packing.capacity, [g for i, g in enumerate(packing.groups) if i not in out])
    fresh.best_fit([i for g in out for i in packing.groups[g]])
    return fresh


def fewest(sizes: list[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing of an island that starts from ``elites``, or from best fits."""
    chance = random.Random(seed)
    bound = fewest(sizes, capacity)
    living = [Packing(sizes, capacity, groups) for groups in elites]
    while len(living) < population:
        if living and min(p.cost() for p in living)[0] <= bound:
            break
        if living:
            living.append(mutate(chance.choice(living), chance))
        else:
            living.append(Packing(sizes, capacity))
            living[0].best_fit(list(range(len(sizes))))
    for _ in range(generations):
        living.sort(key=Packing.cost)
        if not living or living[0].cost()[0] <= bound:
            break
        one, other = (min(chance.sample(living, 2), key=Packing.cost) for _ in range(2))
        child = cross(one, other, chance)
        living[-1] = min(child, mutate(child, chance), key=Packing.cost)
    return min(living, key=Packing.cost) if living else Packing(sizes, capacity)


# ---- on Spark --------------------------------------------------------------------------------


def _sorted_pieces(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])


def _groups(places: bytes) -> list[list[int]]:
    place = np.frombuffer(places, np.int32)
    out: list[list[int]] = [[] for _ in range(int(place.max(initial=-1)) + 1)]
    for i, g in enumerate(place.tolist()):
        out[g].append(i)
    return out


def _island(capacity: int, epoch: int):
    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table, elites: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        sizes = sorted(pieces.column("length").to_pylist(), reverse=True)
        best = evolve(sizes, capacity, hash((shard, island, epoch)), [_groups(x) for x in elites.column("places").to_pylist()])
        place = np.zeros(len(sizes), np.int32)
        for g, group in enumerate(best.groups):
            place[group] = g
        used, fill = best.cost()
        return pa.table({"shard": pa.array([shard], pa.int32()), "island": pa.array([island], pa.int32()), "used": pa.array([used], pa.int64()), "fill": pa.array([fill], pa.int64()), "places": pa.array([place.tobytes()], pa.binary())})

    return run


def _placed(key: tuple[pa.Scalar, ...], pieces: pa.Table, elites: pa.Table) -> pa.Table:
    if not pieces.num_rows:
        return pieces.drop_columns(["shard"]).append_column("sequence_id", pa.array([], pa.int64())).append_column("offset", pa.array([], pa.int64()))
    pieces = _sorted_pieces(pieces)
    place = np.frombuffer(elites.column("places")[0].as_py(), np.int32).astype(np.int64)
    length = pieces.column("length").to_numpy()
    order = np.argsort(place, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    new = np.append(True, np.diff(place[order]) != 0)
    offset = np.empty(len(place), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
    sequence = (np.int64(key[0].as_py()) << 32) | place
    return pieces.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    ready(pieces.sparkSession)
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = settle(pieces.withColumn("shard", shard_of(shards, "doc_id", "piece", "ids_crc32")), "pieces")
    # islands see lengths only
    spread = dealt.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    kind = "shard int, island int, used long, fill long, places binary"
    elites = pieces.sparkSession.createDataFrame([], kind)
    for epoch in range(epochs):
        # elites migrate to every island of their shard
        moved = elites.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "places")
        both = spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island"))
        elites = settle(both.applyInArrow(_island(capacity, epoch), kind), "elites")
    best = elites.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("used", "fill", "island"))).filter("_n = 1")
    both = dealt.groupBy("shard").cogroup(best.select("shard", "places").groupBy("shard"))
    return both.applyInArrow(_placed, _PIECE + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settle(tokenized_pieces(docs, tokenizer, capacity, end_id), "tokenized"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The ids of each sequence: sequence_id, ids."""
    pieces = tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "length", "ids")
    where = placed.select("doc_id", "piece", "ids_crc32", "length", "sequence_id", "offset").dropDuplicates(["sequence_id", "offset"])
    keys = ["doc_id", "piece", "ids_crc32", "length"]
    # rows that repeat a document have equal pieces: any of them may fill any of their places
    filled = where.join(pieces.dropDuplicates(keys), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return filled.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
