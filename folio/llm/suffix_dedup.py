"""Removal of repeated passages: every byte of a 100-byte string that also starts earlier.

Documents are dealt to shards of a few megabytes.  A string of ``SPAN`` bytes has an anchor,
the ``GRAM``-byte string inside it with the smallest hash, which depends on its bytes alone;
equal strings have equal anchors.  That keeps the work near what repeats:

1. each shard lists its distinct anchors and whole texts; those listed by several shards are
   returned to them.  All but the first of equal texts repeat as a whole and go no further;
2. strings whose anchor repeats inside a shard are ordered by a suffix array, refined by
   doubling in the way of Larsson and Sadakane (only groups still tied are sorted again), and
   neighbours' common prefixes follow Kasai's rule: they are compared in full only where the
   previous position's neighbour is not the position before, and are one less elsewhere.
   All but the first of equal strings are marked;
3. strings that are first in their shard and whose anchor other shards have too are sent to
   where that anchor's strings meet.  There the sorted strings of all shards are merged by
   binary search and all but the earliest are marked;
4. marks return to the shards, where documents are cut.

A very frequent anchor (a line found everywhere) sends single strings by their own hash instead
of runs by the anchor, so what meets in a task is bounded: by that frequency, or by the shards.
Strings that meet are told apart by 128 bits of hash (anchor and string).

Rows: a null text is empty.  Documents are ordered by id, without id last.  Rows that repeat
an id and its text are one document and get the same result; rows of one id with different
texts are ordered by text hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready, shard_of, text_total
from folio.llm.text import POWERS, binary_column, mix, ragged, running_hash, slices, span_hash, text_bytes

SPAN, GRAM = 100, 24
SHARD_BYTES = 4 << 20
#: Anchors with as many runs in all shards send single strings.
COMMON_RUNS = 16384
#: Bytes of strings merged at once in a task, cut between anchors.
MERGE_BYTES = 3 << 20

_PLACE = "shard int, doc_id long, text_key long, start int, count int"
_RECORD = f"route long, anchor long, string long, {_PLACE}, body binary"
_STATS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_LAST = np.iinfo(np.int64).max


# ---- anchors ---------------------------------------------------------------------------------


def anchor_runs(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor: first start, number, and the anchor's hash."""
    positions = len(body) - SPAN + 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if positions <= 0:
        return empty
    running = running_hash(body)
    _, down = POWERS.first(len(running))
    grams = (running[GRAM:] - running[:-GRAM]) * down[: len(running) - GRAM]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    # smallest hash, then leftmost, of each window of grams
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, window = 1, SPAN - GRAM + 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # strings that stay inside their text
    length = np.maximum(np.diff(at) - SPAN + 1, 0)
    starts = ragged(at[:-1], length)
    if not len(starts):
        return empty
    anchor = anchor[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), mix(grams[anchor[first]])


def shard_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and offsets of a shard, and its anchor runs, made a slice of texts at a time."""
    body, at = text_bytes(texts)
    parts = []
    for low, high in slices(texts, 1 << 20):
        start, count, anchor = anchor_runs(body[at[low] : at[high]], at[low : high + 1] - at[low])
        parts.append((start + at[low], count, anchor))
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    return body, at, *(np.concatenate(x) for x in zip(*parts, strict=True))


# ---- suffix array of a shard -----------------------------------------------------------------


def eight_bytes(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(body)].copy().view(">u8").reshape(-1).astype(np.uint64)


def suffix_array(body: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes (all, if not less than the length)."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    # seven bytes and how many of them there are: a suffix that ends comes before a longer one
    keys = eight_bytes(body) & np.uint64(0xFFFFFFFFFFFFFF00) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while h < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        beyond = at + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[tied] = at
        fresh = np.empty(len(tied), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        new[tied] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2
    return order


def common_prefixes(body: np.ndarray, order: np.ndarray, enough: int = SPAN) -> np.ndarray:
    """For every position, the bytes its suffix has in common with the one ordered before it.

    Exact below ``enough``; from there on a lower bound that is not below ``enough``.
    """
    n, stretch = len(body), 256
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    keys = eight_bytes(body)
    # one less than at the position before, where the neighbour moved along; compared elsewhere,
    # as far as a whole stretch needs to stay above ``enough``
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    follows[::stretch] = False
    fresh = ~follows
    while True:
        heads = np.flatnonzero(fresh & (before >= 0))
        common[heads] = _compare(body, keys, heads, before[heads], enough + stretch)
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
        common = np.where(follows, common[start] - (np.arange(n) - start), common)
        lost = follows & (common < 0)
        if not lost.any():
            return common
        # nothing is known after a common prefix of none: the first of each such stretch starts anew
        fresh = lost & ~np.append(False, lost[:-1])
        follows[fresh] = False


def _compare(body, keys, a, b, most):
    n, out = len(body), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        room = n - np.maximum(x, y)
        differ = keys[np.minimum(x, n - 1)] ^ keys[np.minimum(y, n - 1)]
        # leading equal bytes: from the exponent of the highest differing bit
        bits = np.frexp((differ >> np.uint64(8)).astype(np.float64))[1]
        same = np.where(differ >> np.uint64(8) > 0, (56 - bits) // 8, np.where(differ > 0, 7, 8))
        same = np.clip(np.minimum(same, room), 0, 8)
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < most)]
    return out


def repeated_inside(body: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of the strings that start in the runs [start, start + count), in text order: those that an earlier one equals."""
    if not len(start):
        return np.zeros(0, np.int64)
    end = start + count - 1 + SPAN
    new = np.append(True, start[1:] > end[:-1])
    region = np.flatnonzero(new)
    low, high = start[region], end[np.append(region[1:] - 1, len(start) - 1)]
    place = ragged(low, high - low)
    order = suffix_array(body[place])
    equal = common_prefixes(body[place], order)[order] >= SPAN
    string = np.zeros(len(body) + 1, bool)
    string[ragged(start, count)] = True
    string = string[place]
    firsts = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(np.where(string[order], order, len(place)), firsts)
    repeated = string[order] & (order != np.repeat(earliest, np.diff(np.append(firsts, len(order)))))
    return place[np.sort(order[repeated])]


# ---- tasks -----------------------------------------------------------------------------------


def _ordered(table: pa.Table) -> pa.Table:
    """Documents by id, then text hash; repeated rows once."""
    ids = np.where(table.column("doc_id").is_null().to_numpy(), _LAST, table.column("doc_id").fill_null(0).to_numpy())
    keys = table.column("text_key").to_numpy()
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return table.select(["doc_id", "text_key", "text"]).take(pa.array(order[keep]))


def _names(docs: pa.Table, at: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each whole text and its document's place in the order (id, then text hash)."""
    texts = docs.column("text").combine_chunks()
    parts = [np.zeros(0, np.uint64)]
    for low, high in slices(texts, 1 << 20):
        own = at[low : high + 1] - at[low]
        parts.append(span_hash(running_hash(body[at[low] : at[high]]), own[:-1], own[1:]))
    second = np.concatenate(parts).view(np.int64)
    ids = np.where(docs.column("doc_id").is_null().to_numpy(), _LAST, docs.column("doc_id").fill_null(0).to_numpy())
    return docs.column("text_key").to_numpy(), second, ids


def _list_names(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """The anchors of a shard with their runs, and its texts with their first documents."""
    docs = _ordered(docs)
    body, at, _, _, anchor = shard_runs(docs.column("text").combine_chunks())
    anchor, runs = np.unique(anchor, return_counts=True)
    text, second, ids = _names(docs, at, body)
    long = np.flatnonzero(np.diff(at) >= SPAN)
    # documents are in order: the first of equal texts is the smallest
    _, first = np.unique(np.stack([text[long], second[long]]), axis=1, return_index=True)
    first = long[first]
    n = len(anchor)
    return pa.table({
        "shard": pa.array(np.full(n + len(first), key[0].as_py(), np.int32)), "name": pa.array(np.concatenate([anchor.view(np.int64), text[first]])),
        "second": pa.array(np.concatenate([np.zeros(n, np.int64), second[first] | 1])), "runs": pa.array(np.concatenate([runs, np.zeros(len(first), np.int64)])),
        "doc_id": pa.array(np.concatenate([np.full(n, _LAST), ids[first]])),
    })


def _empty_records() -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array([], k) for k in kinds], names=[x.split(" ")[0] for x in _RECORD.split(", ")])


def _records(shard: int, docs: pa.Table, at: np.ndarray, start: np.ndarray, count: np.ndarray, anchor, route, string, body) -> pa.Table:
    doc = np.searchsorted(at, start, "right") - 1
    n = len(start)
    none = pa.nulls(n, pa.int64())
    return pa.table({
        "route": pa.array(route), "anchor": none if anchor is None else pa.array(anchor), "string": none if string is None else pa.array(string),
        "shard": pa.array(np.full(n, shard, np.int32)), "doc_id": docs.column("doc_id").combine_chunks().take(pa.array(doc)),
        "text_key": docs.column("text_key").combine_chunks().take(pa.array(doc)), "start": pa.array((start - at[doc]).astype(np.int32)),
        "count": pa.array(count.astype(np.int32)), "body": pa.nulls(n, pa.binary()) if body is None else body,
    })


def _later_copies(docs: pa.Table, at: np.ndarray, body: np.ndarray, whole: pa.Table) -> np.ndarray:
    """Whether an earlier document, of this shard or another, has the same whole text of at least ``SPAN`` bytes."""
    text, second, ids = _names(docs, at, body)
    second |= 1
    order = np.lexsort((np.arange(len(text)), second, text))
    same = np.append(False, (np.diff(text[order]) == 0) & (np.diff(second[order]) == 0)) if len(text) else np.zeros(0, bool)
    later = np.zeros(len(text), bool)
    later[order[same]] = True
    elsewhere = dict(zip(zip(whole.column("name").to_pylist(), whole.column("second").to_pylist(), strict=True), whole.column("doc_id").to_pylist(), strict=True))
    for i in np.flatnonzero(np.isin(text, whole.column("name").to_numpy())).tolist():
        later[i] |= elsewhere.get((int(text[i]), int(second[i])), _LAST) < ids[i]
    return later & (np.diff(at) >= SPAN)


def _inside_and_shared(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
    """Marks of strings that repeat inside the shard, and records of first strings that other shards may have."""
    if not docs.num_rows:
        return _empty_records()
    shard = key[0].as_py()
    docs = _ordered(docs)
    whole = shared.filter(pa.array(shared.column("second").to_numpy() != 0))
    shared = shared.filter(pa.array(shared.column("second").to_numpy() == 0))
    body, at = text_bytes(docs.column("text").combine_chunks())
    later = _later_copies(docs, at, body, whole)
    gone = np.flatnonzero(later)
    size = np.diff(at)[gone] - SPAN + 1
    parts = [_records(shard, docs, at, at[gone], size, None, mix(gone.astype(np.uint64) + np.uint64(shard)).view(np.int64), None, None)]
    docs = docs.filter(pa.array(~later))
    body, at, start, count, anchor = shard_runs(docs.column("text").combine_chunks())
    order = np.argsort(anchor)
    same = anchor[order][1:] == anchor[order][:-1]
    here = np.zeros(len(anchor), bool)
    here[order[1:][same]] = here[order[:-1][same]] = True
    # a run's own strings may repeat one another only if they overlap, and then their anchors repeat too
    marked = repeated_inside(body, start[here], count[here])
    breaks = np.flatnonzero(np.append(True, (np.diff(marked) != 1) | (np.diff(np.searchsorted(at, marked, "right")) != 0))) if len(marked) else np.zeros(0, np.int64)
    first = marked[breaks]
    spread = mix(np.arange(len(first), dtype=np.uint64) + np.uint64(shard)).view(np.int64)
    parts.append(_records(shard, docs, at, first, np.diff(np.append(breaks, len(marked))), None, spread, None, None))

    names = shared.column("name").to_numpy()
    by = np.argsort(names)
    names, runs = names[by], shared.column("runs").to_numpy()[by]
    found = np.minimum(np.searchsorted(names, anchor.view(np.int64)), max(0, len(names) - 1))
    wanted = np.flatnonzero(names[found] == anchor.view(np.int64)) if len(names) else np.zeros(0, np.int64)
    begin = start[wanted]
    strings = ragged(begin, count[wanted])
    own = np.repeat(wanted, count[wanted])
    taken = np.zeros(len(body) + 1, bool)
    taken[marked] = True
    fresh = ~taken[strings]
    strings, own = strings[fresh], own[fresh]
    everywhere = runs[found[own]] >= COMMON_RUNS if len(own) else np.zeros(0, bool)
    if everywhere.any():
        single, name = strings[everywhere], anchor[own[everywhere]]
        hashes = span_hash(running_hash(body), single, single + SPAN)
        parts.append(_records(shard, docs, at, single, np.ones(len(single)), name.view(np.int64), hashes.view(np.int64), hashes.view(np.int64), None))
        strings, own = strings[~everywhere], own[~everywhere]
    if len(strings):
        new = np.append(True, (np.diff(strings) != 1) | (np.diff(own) != 0))
        first = np.flatnonzero(new)
        low, number = strings[first], np.diff(np.append(first, len(strings)))
        name = anchor[own[first]].view(np.int64)
        size = number - 1 + SPAN
        bodies = binary_column(body[ragged(low, size)], np.append(0, np.cumsum(size)))
        parts.append(_records(shard, docs, at, low, number, name, name, None, bodies))
    return pa.concat_tables(parts)


def later_than_first(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings of records that meet: record and offset of each that is not the earliest of its equals."""
    ids = np.where(table.column("doc_id").is_null().to_numpy(), _LAST, table.column("doc_id").fill_null(0).to_numpy())
    keys, start = table.column("text_key").to_numpy(), table.column("start").to_numpy().astype(np.int64)
    count = table.column("count").to_numpy().astype(np.int64)
    anchor = table.column("anchor").to_numpy()
    # places in (document, start) order as one number
    order = np.lexsort((keys, ids))
    moved = np.append(False, (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0))
    document = np.empty(len(ids), np.int64)
    document[order] = np.cumsum(moved)
    place = (document << 32) | start
    bodies = table.column("body").combine_chunks()
    packed = bodies.is_valid().to_numpy(zero_copy_only=False)
    body, at = text_bytes(bodies)
    running = running_hash(body)
    single = table.column("string").fill_null(0).to_numpy().view(np.uint64)

    # records that are equal as a whole: only the earliest is looked into, all strings of the others are later
    whole = np.where(packed, span_hash(running, at[:-1], at[1:]), single)
    by = np.lexsort((place, anchor, whole))
    equal = np.append(False, (np.diff(whole[by]) == 0) & (np.diff(anchor[by]) == 0) & (np.diff(count[by]) == 0))
    leader = by[np.maximum.accumulate(np.where(equal, 0, np.arange(len(by))))]
    copies = by[equal & (place[by] != place[leader])]
    later = [(np.repeat(copies, count[copies]), ragged(np.zeros(len(copies)), count[copies]))]

    kept = by[~equal]
    record = np.repeat(kept, count[kept])
    offset = ragged(np.zeros(len(kept)), count[kept])
    strings = np.where(packed[record], span_hash(running, at[:-1][record] + offset, np.minimum(at[:-1][record] + offset + SPAN, len(body))), single[record])
    # merge: each string's place in the sorted list of all is found by binary search
    listed = np.sort(strings)
    twice = np.append(listed[1:] == listed[:-1], False)
    names = np.unique(listed[twice])
    slot = np.minimum(np.searchsorted(names, strings), max(0, len(names) - 1))
    meets = np.flatnonzero(names[slot] == strings) if len(names) else np.zeros(0, np.int64)
    record, offset, slot = record[meets], offset[meets], slot[meets]
    if len(meets):
        where = place[record] + offset
        by = np.lexsort((where, anchor[record], slot))
        record, offset, where, slot = record[by], offset[by], where[by], slot[by]
        same = np.append(False, (np.diff(slot) == 0) & (np.diff(anchor[record]) == 0))
        earliest = where[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        after = where != earliest
        later.append((record[after], offset[after]))
    return tuple(np.concatenate(x) for x in zip(*later, strict=True))


def _merge_shards(batches):
    """Records come sorted by route; those of one route are merged together."""
    place = [x.split(" ")[0] for x in _PLACE.split(", ")]

    def marks(table: pa.Table):
        done = table.column("anchor").is_null().to_numpy()
        yield from table.filter(pa.array(done)).select(place).combine_chunks().to_batches()
        table = table.filter(pa.array(~done)).combine_chunks()
        if not table.num_rows:
            return
        record, offset = later_than_first(table)
        if not len(record):
            return
        by = np.lexsort((offset, record))
        record, offset = record[by], offset[by]
        first = np.flatnonzero(np.append(True, (np.diff(record) != 0) | (np.diff(offset) != 1)))
        number = np.diff(np.append(first, len(record)))
        rows = table.select(place).take(pa.array(record[first]))
        begin = rows.column("start").to_numpy() + offset[first]
        rows = rows.set_column(3, "start", pa.array(begin.astype(np.int32))).set_column(4, "count", pa.array(number.astype(np.int32)))
        yield from rows.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        route = batch.column(0).to_numpy()
        body = batch.column(batch.schema.get_field_index("body"))
        weight = np.cumsum(np.diff(text_bytes(body)[1]) + 64)
        low = 0
        if not len(route):
            continue
        # cut where the route changes and enough is held
        changed = np.append(bool(held) and held[-1].column(0)[-1].as_py() != route[0], np.diff(route) != 0)
        for change in np.flatnonzero(changed):
            more = int(weight[change - 1]) - (int(weight[low - 1]) if low else 0) if change > low else 0
            if size + more >= MERGE_BYTES:
                held.append(batch.slice(low, change - low))
                yield from marks(pa.Table.from_batches([x for x in held if x.num_rows]))
                held, size, low = [], 0, int(change)
        if batch.num_rows > low:
            held.append(batch.slice(low))
            size += int(weight[-1]) - (int(weight[low - 1]) if low else 0)
    if held:
        yield from marks(pa.Table.from_batches(held))


def covered(at: np.ndarray, marks: np.ndarray, size: int) -> np.ndarray:
    """Whether each byte is inside one of the strings that ``marks`` (position, number) start."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, marks[:, 0], 1)
    np.add.at(change, marks[:, 0] + marks[:, 1] - 1 + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(rewrite: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        body, at = text_bytes(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.binary()))
        # a mark counts for every row of its document
        rows = pa.table({"doc_id": docs.column("doc_id").fill_null(_LAST), "text_key": docs.column("text_key"), "row": pa.array(np.arange(docs.num_rows))})
        found = pa.table({"doc_id": marks.column("doc_id").fill_null(_LAST), "text_key": marks.column("text_key"), "start": marks.column("start"), "count": marks.column("count")})
        found = found.join(rows, ["doc_id", "text_key"], join_type="inner")
        spans = np.stack([at[found.column("row").to_numpy()] + found.column("start").to_numpy(), found.column("count").to_numpy()], axis=1).astype(np.int64)
        gone = covered(at, spans, len(body))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begins = at[:-1][at[:-1] < len(body)]
        edge[begins] = gone[begins]
        sums = [np.concatenate([[0], np.cumsum(x)])[at] for x in (gone, edge)]
        left = body[~gone]
        kept_at = at - sums[0]
        removed, spans_of = np.diff(sums[0]), np.diff(sums[1])
        if rewrite:
            texts = [left[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
            out = docs.drop_columns(["shard", "text_key"])
            out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            return out.append_column("removed", pa.array(removed))
        digests = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed), "n_spans": pa.array(spans_of), "kept_sha256": pa.array(digests, pa.string())})

    return run


def _marks(docs: DataFrame) -> DataFrame:
    """Document and place of every string that also starts earlier, in runs; ``docs`` have a shard."""
    names = docs.groupBy("shard").applyInArrow(_list_names, "shard int, name long, second long, runs long, doc_id long")
    shared = names.groupBy("name", "second").agg(F.collect_list("shard").alias("shard"), F.sum("runs").alias("runs"), F.min("doc_id").alias("doc_id"))
    shared = shared.filter(F.size("shard") > 1).select(F.explode("shard").alias("shard"), "name", "second", "runs", "doc_id")
    records = docs.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_inside_and_shared, _RECORD)
    return records.repartition("route").sortWithinPartitions("route").mapInArrow(_merge_shards, _PLACE)


def _sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": text}).withColumn("text_key", F.xxhash64("text"))
    shards = max(1, -(-text_total(docs) // shard_bytes))
    return rows.withColumn("shard", shard_of(shards, "doc_id", "text_key"))


def repeated_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ready(docs.sparkSession)
    rows = _sharded(docs.select("doc_id", "text"), shard_bytes)
    return rows.groupBy("shard").cogroup(_marks(rows).groupBy("shard")).applyInArrow(_cut(False), _STATS)


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without their repeated passages, with all their columns.

    A character that loses one of its bytes goes as a whole; ``n_chars``, where there is such
    a column, counts what is left.  A document of which nothing is left is dropped.
    """
    ready(docs.sparkSession)
    # other columns travel under names that cannot clash
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = _sharded(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for c, name in others.items())), shard_bytes)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "doc_id long, text string, " + "".join(f"{name} {kinds[name]}, " for name in others.values()) + "removed long"
    cut = rows.groupBy("shard").cogroup(_marks(rows).groupBy("shard")).applyInArrow(_cut(True), schema)
    cut = cut.filter("removed = 0 or text <> ''")
    if "n_chars" in others:
        count = F.when(F.col("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(others["n_chars"]))
        cut = cut.withColumn(others["n_chars"], count)
    return cut.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))
