"""Near-duplicates: MinHash bands for candidates, odd sketches to estimate them, full sets to confirm.

A document is the set of its distinct shingles of words.  Documents with equal sets are one
class, represented by the smallest id.  MinHash samples are cut into bands; classes that share
a band meet in a bucket.  The samples are also folded into a bitmap of parities (an odd
sketch): the population count of two sketches' XOR tells how many samples differ, precisely
where similarity is high, and pairs well below the threshold are dropped.  The rest is
confirmed on the full sets.

Shingles that no other candidate has bound a document's similarity to any of them exactly; that
leaves out the many variants of a text that have changed a little too much to be linked.

No bucket is expanded into all its pairs.  First each class meets only the smallest class of
its buckets; then, in buckets whose members still belong to several components, pivots meet
the members of other components, eight times as many pivots each round, until every member
of each such bucket was a pivot or the bucket is one component.  A pair meets once: in its
first common bucket, when the first of the two is a pivot.  So a link between different
components is never lost to a bucket's size.

Rows: null, empty and wordless texts have an empty set and are linked with nothing.  Rows
without id are linked with nothing and kept.  Rows that repeat an id are one vertex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready
from folio.llm.components import merge_labels, no_labels
from folio.llm.text import binary_column, mix, slices, text_bytes, text_hash, words
from folio.operators.ranking import GROUP_LIMIT, number_rows, top_per
from folio.session import settle

#: At a similarity of 0.8 a pair shares no band with a probability of 5e-6, and its sketches differ too much with
#: one of about 2e-6; at 0.4 it shares a band with 0.15.
BANDS, BAND_ROWS = 40, 6
SKETCH_BITS = 1024
#: Standard deviations that an estimate may fall short before a pair is dropped.
MARGIN = 5.0
FIRST_PIVOTS, MORE_PIVOTS = 8, 8
#: What meets several others of its bucket gets a sketch of so many times the samples and bits: half the deviation.
FINER = 4

_SAMPLES = BANDS * BAND_ROWS
_SEEDS = mix(np.arange(1, 2 * _SAMPLES + 1, dtype=np.uint64))
_XOR = (_SEEDS[:_SAMPLES] >> np.uint64(32)).astype(np.uint32)
_TIMES = (_SEEDS[_SAMPLES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FINE = mix(np.arange(1, 2 * FINER * _SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FINE_XOR = (_FINE[: FINER * _SAMPLES] >> np.uint64(32)).astype(np.uint32)
_FINE_TIMES = (_FINE[FINER * _SAMPLES :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def shingle_sets(body: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    start, end, first = words(body, at)
    hashes = text_hash(body, start, end, folded=True)
    places = _PLACES if k <= len(_PLACES) else mix(np.arange(1, k + 1, dtype=np.uint64))
    n = len(hashes)
    joined = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        joined += hashes[j : j + len(joined)] * places[j]
    joined = mix(joined)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= k:
            # sorting, then comparing neighbours, beats np.unique's hash table here
            some = np.sort(joined[low : high - k + 1])
            keep = np.empty(len(some), bool)
            keep[:1] = True
            np.not_equal(some[1:], some[:-1], out=keep[1:])
            out.append(some[keep])
        elif high > low:
            short = (hashes[low:high] * places[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            out.append(mix(np.array([short ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(items: np.ndarray, xor: np.ndarray = _XOR, times: np.ndarray = _TIMES) -> np.ndarray:
    low = (items >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        block = low[at : at + 512, None] ^ xor
        block *= times
        np.minimum(best, block.min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit words) of rows of MinHash samples."""
    places = mix(samples.astype(np.uint64) + (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    counts = np.zeros((len(samples), bits), np.uint8)
    np.add.at(counts, (np.arange(len(samples))[:, None], places.astype(np.int64)), 1)
    return np.packbits(counts & 1, axis=1, bitorder="little").view(np.int64)


def most_differing(similarity: float, finer: int = 1) -> int:
    """Differing bits beyond which an estimate is below ``similarity`` by more than the margin.

    Both draws vary: which samples differ, and which of their places in the sketch coincide.
    """
    bits = finer * SKETCH_BITS
    differing = finer * _SAMPLES * (1 - similarity)
    kept = np.exp(-4 * differing / bits)
    of_samples = 2 * kept * (differing * similarity) ** 0.5
    # two of the 2d places coincide in about 2d * d / bits pairs, each of which hides two
    of_places = 2 * (2 * differing * differing / bits) ** 0.5
    return int(np.ceil(bits / 2 * (1 - kept) + MARGIN * (of_samples**2 + of_places**2) ** 0.5))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                ids = batch.column(0)[low:high]
                sets = shingle_sets(*text_bytes(batch.column(1)[low:high]), k)
                samples = np.stack([min_hashes(s) for s in sets])
                keys = np.zeros((len(sets), BANDS), np.uint64)
                for r in range(BAND_ROWS):
                    keys = mix(keys * np.uint64(31) + samples[:, r::BAND_ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
                sketches = odd_sketch(samples)
                whole = np.array([[s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys.view(np.int64), sketches)]
                columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), *lists]
                yield pa.record_batch(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                sets = shingle_sets(*text_bytes(batch.column(1)[low:high]), k)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([batch.column(0)[low:high], binary_column(flat, at)], names=["doc_id", "items"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def _items(batches):
    for batch in batches:
        at = np.diff(text_bytes(batch.column(1))[1]) // 8
        flat = np.frombuffer(text_bytes(batch.column(1))[0].tobytes(), np.int64)
        yield pa.record_batch([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), at))], names=["item", "rep"])


def _fine_sketches(batches):
    for batch in batches:
        body, at = text_bytes(batch.column(1))
        items = np.frombuffer(body.tobytes(), np.uint64)
        fine = [odd_sketch(min_hashes(items[a:b], _FINE_XOR, _FINE_TIMES)[None], FINER * SKETCH_BITS)[0] for a, b in zip(at[:-1] // 8, at[1:] // 8, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array([f.tolist() for f in fine], pa.list_(pa.int64()))], names=["rep", "fine"])


def own_items(sets: DataFrame) -> DataFrame:
    """rep and n_own, the number of its items that no other of these sets has."""
    items = sets.mapInArrow(_items, "item long, rep long")
    once = items.groupBy("item").agg(F.count("*").alias("_n"), F.min("rep").alias("rep")).filter("_n = 1")
    return once.groupBy("rep").agg(F.count("*").alias("n_own"))


def _could_share(n_a, own_a, n_b, own_b, percent: int):
    """Whether the items that others have as well are enough for the similarity: an exact bound."""
    most = F.least(n_a - own_a, n_b - own_b)
    return 100 * most >= percent * (n_a + n_b - most)


def _may_link(n_a, s_a, n_b, s_b, percent: int, finer: int = 1):
    """Whether sizes and sketches allow the similarity."""
    differing = F.aggregate(F.zip_with(s_a, s_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differing <= most_differing(percent / 100, finer))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    wanted = settle(pairs, "pairs")
    full = wanted.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    full = full.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a").select("a", "b", "items_a", "items_b")
    return settle(full.mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_groups(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(texts.mapInArrow(_signatures(shingle), _SIGNED), "signatures")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "set_a", "set_b"]
    reps = settle(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    placed = reps.select("rep", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last")
    members = settle(placed.join(shared, "key").select("key", "rep", "first"), "members")
    chosen = members.select(F.col("rep").alias("doc_id")).distinct()
    # a class's own text has its representative's id; ids may repeat, so the set decides
    chosen = chosen.join(reps.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), "doc_id")
    some = texts.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, items binary")
    sets = settle(some.dropDuplicates(["doc_id"]), "sets")

    # one vertex per id: classes that share an id through repeated rows are one already
    labels = no_labels(spark)
    first = members.filter("rep > first").groupBy(F.col("rep").alias("b")).agg(F.min("first").alias("a"))
    sketches = reps.select("rep", "n_shingles", "sketch", "bands")
    own, other = (sketches.select(*(F.col(c).alias(f"{c}_{end}") for c in sketches.columns)) for end in "ab")
    first = first.join(own, F.col("a") == F.col("rep_a")).join(other, F.col("b") == F.col("rep_b"))
    first = first.filter(_may_link(F.col("n_shingles_a"), F.col("sketch_a"), F.col("n_shingles_b"), F.col("sketch_b"), percent)).select("a", "b")
    labels = merge_labels(labels, _confirmed(first, sets, percent))
    done, pivots, known_own = 0, FIRST_PIVOTS, None
    while True:
        named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        named = settle(named, "named")
        open_ = named.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_size")).filter("_low < _high")
        members = named.join(open_.select("key", "_size"), "key")
        if known_own is None:
            # counted once, over all that may still meet
            rest = sets.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            known_own = settle(sketches.join(own_items(rest), "rep", "left").na.fill(0, ["n_own"]), "own")
            known_own = known_own.filter(100 * (F.col("n_shingles") - F.col("n_own")) >= percent * F.col("n_shingles"))
            fine = sets.join(known_own.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_fine_sketches, "rep long, fine array<long>")
            known_own = settle(known_own.drop("sketch").join(fine, "rep"), "fine")
        members = settle(members.join(known_own, "rep"), "open")
        if members.isEmpty():
            break
        # rows get their place among all members of the bucket, which no later round changes
        order = [F.xxhash64("rep").asc(), F.col("rep").asc()]
        if pivots <= GROUP_LIMIT:
            centres = top_per(members, ["key"], order, pivots, "_place")
        else:
            # a bucket this large is numbered over range partitions, by its keys alone
            placed = number_rows(members.select("key", "rep"), ["key"], order, "_place").filter((F.col("_place") <= pivots) & (F.col("_place") > done))
            centres = members.join(settle(placed, "placed"), ["key", "rep"])
        columns = ["key", "component", *known_own.columns]
        centres = settle(centres.select("_place", *(F.col(c).alias(f"_{c}") for c in columns)), "pivots")
        likely = _may_link(F.col("n_shingles"), F.col("fine"), F.col("_n_shingles"), F.col("_fine"), percent, FINER)
        likely &= _could_share(F.col("n_shingles"), F.col("n_own"), F.col("_n_shingles"), F.col("_n_own"), percent)
        common = F.array_position(F.zip_with("bands", "_bands", lambda x, y: x == y), True)
        likely &= F.element_at("bands", common.cast("int")) == F.col("key")
        # members that are pivots before this one have met it
        after = (F.xxhash64("rep") > F.xxhash64("_rep")) | ((F.xxhash64("rep") == F.xxhash64("_rep")) & (F.col("rep") > F.col("_rep")))
        met = members.join(
            centres.filter(F.col("_place") > done),
            (F.col("key") == F.col("_key")) & (F.col("component") != F.col("_component")) & after & likely,
        )
        met = met.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b")).distinct()
        labels = merge_labels(labels, _confirmed(met, sets, percent))
        members = members.filter(F.col("_size") > pivots).select("key", "rep")
        done = pivots
        pivots *= MORE_PIVOTS
    return _assigned(signed, reps, labels)


def _assigned(signed: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    same = ["n_shingles", "set_a", "set_b"]
    # as plain reads of written tables these joins let a hot class be split
    classes = reps.select(*same, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("_component"))
    rows = signed.select("doc_id", *same).join(settle(classes, "components"), same, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group, with all their columns."""
    dropped = settle(near_groups(docs, shingle, percent).filter("not kept").select(F.col("doc_id").alias("_folio_drop")), "dropped")
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_folio_drop"], "left_anti")
