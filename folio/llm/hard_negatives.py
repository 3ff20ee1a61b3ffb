"""Hard negatives by threshold joins on pruned inverted indexes.

A row's score is the inner product of quantised vectors with an anchor.  An anchor's positives
are its best rows of the same label; its negatives are the best rows of other labels whose score
lies in a window below each positive's.  Both are threshold searches.

Rows are dealt to blocks.  A block holds its dimensions by falling energy and, for each row,
the norm of what is left after every step.  The index of a threshold omits a row's dimensions from
where that norm, times the anchor's, cannot reach the threshold.  A search adds partial
scores step by step, drops rows whose partial score and remaining norms stay below, and computes what is
left exactly.  A block lowers the threshold until its windows are filled or end, so that
merging the best rows of all blocks gives the best rows of all.

Every block meets every group of anchors once for positives and once for negatives; blocks and groups
are bounded, and a block hands on at most a window's rows per anchor and positive.

Rows: a null id, label or vector, or a vector with a null or non-finite component, takes no
part.  Missing trailing components count as zero.  Quantised components are held within
+-2**24, so that all sums are exact.  A row is known by its id: rows of the anchor's id are neither its
positives nor its negatives; rows that repeat another id are all candidates; equal rows of one
anchor id are one anchor, unequal ones are an anchor each.  A positive with a negative score has an
empty window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.bitsliced_topk import quantised
from folio.llm.cluster import ready, shard_of
from folio.operators.ranking import top_per
from folio.session import settle

#: Components in a block, and in a group of anchors.
BLOCK_CELLS = 1 << 20
GROUP_CELLS = 1 << 16
#: Quantised components are held within this.
LARGEST = 1 << 24
#: Dimensions added before rows are pruned again.
STEP = 16
#: The first threshold as a share of the highest possible score, and what each next one is of it.
FIRST, LOWER = 0.6, 0.7

_POSITIVES = "anchor long, anchor_id long, positive_id long, score long"
_NEGATIVES = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _matrix(column: pa.ChunkedArray, parts: int) -> np.ndarray:
    vectors = column.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    values = np.zeros((len(lengths), parts), np.int64)
    values[np.arange(parts) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return values


def _parts(*columns: pa.ChunkedArray) -> int:
    """The components of the longest vector."""
    return max([int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns if len(c)], default=0)


class Block:
    """Rows with their labels, their dimensions by falling energy, and an index for each threshold asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.by_energy = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.ids, self.labels, self.values = ids, labels, values[:, self.by_energy]
        self.rest = self._norms(self.values)
        self.longest = float(self.rest[:, 0].max(initial=0.0))
        self._indexes: dict[int, tuple] = {}

    @staticmethod
    def _norms(values: np.ndarray) -> np.ndarray:
        """Norms of what is left of each row at every step, the whole row first and nothing last."""
        steps = -(-values.shape[1] // STEP)
        squares = np.zeros((len(values), steps * STEP))
        squares[:, : values.shape[1]] = values.astype(np.float64) ** 2
        left = squares.reshape(len(values), steps, STEP).sum(axis=2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([left, np.zeros((len(values), 1))], axis=1))

    def index(self, level: int, threshold: float) -> tuple:
        """Rows by falling number of indexed steps, how many rows each step holds, their values and the norms left by step, and labels."""
        if level not in self._indexes:
            indexed = (self.rest[:, :-1] >= threshold).sum(axis=1) if threshold > 0 else np.full(len(self.ids), self.rest.shape[1] - 1)
            order = np.argsort(-indexed, kind="stable")
            holds = [int((indexed > s).sum()) for s in range(self.rest.shape[1] - 1)]
            lists = [np.ascontiguousarray(self.values[order[:n], s * STEP : (s + 1) * STEP].astype(np.float64)) for s, n in enumerate(holds)]
            norms = [np.ascontiguousarray(self.rest[order[:n], s + 1]) for s, n in enumerate(holds)]
            self._indexes[level] = order, holds, lists, norms, self.labels[order]
        return self._indexes[level]

    def search(self, level: int, floor: float, at_least: float, anchor: np.ndarray, norms: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a score of ``at_least`` among those whose label is ``wanted``, and their exact scores.

        ``floor`` is the least norm a row needs at this level: the index omits what is below.
        """
        order, holds, lists, rest, labels = self.index(level, floor)
        everything = at_least == -np.inf
        if everything or not holds:
            alive = np.flatnonzero(wanted(labels)) if everything or at_least <= 0 else np.zeros(0, np.int64)
        else:
            partial = np.zeros(holds[0])
            alive = np.flatnonzero(wanted(labels[: holds[0]]))
            # sums are rounded to doubles: nothing within this of the bound is dropped
            slack = 1e-9 * (1 + norms[0] * self.longest)
            done = []
            for step, (n, rows) in enumerate(zip(holds, lists, strict=True)):
                ended = np.searchsorted(alive, n)
                done.append(alive[ended:])
                alive = alive[:ended]
                if not len(alive):
                    break
                x = anchor[step * STEP : (step + 1) * STEP].astype(np.float64)
                if len(alive) * 4 > n:
                    partial[:n] += rows @ x
                    alive = alive[(partial[:n] + norms[step + 1] * rest[step] >= at_least - slack)[alive]]
                else:
                    partial[alive] += rows[alive] @ x
                    alive = alive[partial[alive] + norms[step + 1] * rest[step][alive] >= at_least - slack]
            alive = np.concatenate([*done, alive])
        found = order[alive]
        scores = self.values[found] @ anchor
        kept = np.ones(len(found), bool) if everything else scores >= at_least
        return found[kept], scores[kept]

    def thresholds(self, norm: float, floor: float, ceiling: float = np.inf) -> Iterator[tuple[int, float, float]]:
        """Level, least norm of a row and score, falling from the highest possible score, or ``ceiling``, to ``floor``, which is the last.

        The norms belong to the level, whatever the anchor: anchors of a block share its indexes.
        """
        level, least = 0, FIRST * self.longest
        while norm and least * norm > max(floor, 1e-3 * norm * self.longest):
            if least * norm <= ceiling:
                yield level, least, least * norm
            level, least = level + 1, least * LOWER
        # the index of this level, or all dimensions if even the floor is below every level
        yield (level, least, floor) if norm and floor >= least * norm else (-1, 0.0, floor)

    def ordered(self, anchor_id: int, found: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores by falling score and rising id, without the anchor's own id."""
        ids = self.ids[found]
        other = ids != anchor_id
        ids, scores = ids[other], scores[other]
        order = np.lexsort((ids, -scores))
        return ids[order], scores[order]

    def prepared(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = values[:, self.by_energy]
        return values, self._norms(values)


def best(block: Block, anchor_id: int, anchor: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's ``k`` best rows."""
    for level, least, score in block.thresholds(norms[0], -np.inf):
        ids, scores = block.ordered(anchor_id, *block.search(level, least, score, anchor, norms, lambda own: own == own))
        if len(ids) >= k:
            break
    return ids[:k], scores[:k]


def best_in_windows(block: Block, anchor_id: int, label: int, anchor: np.ndarray, norms: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score) the block's ``k`` best rows of other labels."""
    out: list = [None] * len(windows)
    floor, ceiling = min(low for low, _ in windows), max(high for _, high in windows)
    for level, least, score in block.thresholds(norms[0], floor, ceiling):
        ids, scores = block.ordered(anchor_id, *block.search(level, least, score, anchor, norms, lambda own: own != label))
        for i, (low, high) in enumerate(windows):
            if out[i] is None:
                fit = (scores >= low) & (scores <= high)
                if score <= low or fit.sum() >= k:
                    out[i] = ids[fit][:k], scores[fit][:k]
        if all(o is not None for o in out):
            break
    return out


def _rows(table: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("q"), parts)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _find_positives(k: int):
    def run(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        parts = _parts(index.column("q"), asked.column("q"))
        ids, labels, values = _rows(index, parts)
        anchor_ids, anchor_labels, anchors = _rows(asked, parts)
        numbers = asked.column("anchor").to_pylist()
        # positives are searched among the rows of their label only
        for label in np.intersect1d(labels, anchor_labels):
            own = labels == label
            block = Block(ids[own], labels[own], values[own])
            asking = np.flatnonzero(anchor_labels == label)
            for i, anchor, norms in zip(asking.tolist(), *block.prepared(anchors[asking]), strict=True):
                found, scores = best(block, int(anchor_ids[i]), anchor, norms, k)
                out.extend((numbers[i], int(anchor_ids[i]), int(p), int(s)) for p, s in zip(found, scores, strict=True))
        return _table(out, _POSITIVES)

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(asked):
            parts = _parts(index.column("q"), asked.column("q"))
            block = Block(*_rows(index, parts))
            values, norms = block.prepared(_matrix(asked.column("q"), parts))
            columns = (asked.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "positives"))
            for i, (number, anchor_id, label, positives) in enumerate(zip(*columns, strict=True)):
                # scores are whole: the least and the greatest that fulfil low * p <= 100 * n <= high * p
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                for p, (ids, scores) in zip(positives, best_in_windows(block, anchor_id, label, values[i], norms[i], windows, k), strict=True):
                    out.extend((number, anchor_id, p["place"], p["positive_id"], p["score"], int(n), int(s)) for n, s in zip(ids, scores, strict=True))
        return _table(out, _NEGATIVES)

    return run


def mine(
    rows: DataFrame, anchors: Column, label: Column | str = "label", vector: str = "embedding", key: str = "vec_id", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_cells: int = BLOCK_CELLS, group_cells: int = GROUP_CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for every row that fulfils ``anchors`` (over vec_id).

    Components become floor(scale * x).  A negative's score is ``low`` to ``high`` percent of the positive's.
    """
    ready(rows.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    held = F.transform(quantised(F.col(vector), scale), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)).cast("int"))
    vectors = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), held.alias("q"))
    vectors = settle(vectors.filter("vec_id is not null and label is not null and q is not null"), "vectors")
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("parts")).first()
    blocks = max(1, -(-size.n * size.parts // block_cells))
    # a number of its own for every distinct anchor: an id may be repeated
    asked = vectors.filter(anchors).distinct().withColumn("anchor", F.monotonically_increasing_id())
    asked = settle(asked, "anchors")
    groups = max(1, -(-asked.count() * size.parts // group_cells))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    place = ["block", "anchors"]
    # each group of anchors meets each block once
    index = vectors.withColumn("block", shard_of(blocks, "vec_id", "q")).withColumn("anchors", every(groups)).groupBy(*place)

    def sent(queries: DataFrame) -> DataFrame:
        return queries.withColumn("anchors", shard_of(groups, "anchor")).withColumn("block", every(blocks)).groupBy(*place)

    found = index.cogroup(sent(asked)).applyInArrow(_find_positives(positives), _POSITIVES)
    best = top_per(found, ["anchor"], [F.col("score").desc(), F.col("positive_id").asc()], positives, "place")
    # high percent of a negative score is above low percent of it: no window
    listed = best.filter("score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "score")).alias("positives"))
    with_windows = settle(asked.join(listed, "anchor"), "windows")
    found = index.cogroup(sent(with_windows)).applyInArrow(_find_negatives(negatives, low, high), _NEGATIVES)
    ranked = top_per(found, ["anchor", "place"], [F.col("negative_score").desc(), F.col("negative_id").asc()], negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
