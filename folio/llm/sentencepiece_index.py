"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary is a SentencePiece model of the BPE kind with byte fallback.  No piece continues
across a word's beginning, so texts are cut there and each distinct unit of a task is encoded
once.  The units of a batch are concatenated and indexed by a suffix array; every piece is
binary-searched in it, which yields all its occurrences.  These are the edges of a lattice.
They are sorted by position and relaxed: a position's state is the last piece of the encoding of
the text before it, and an edge extends it if merging would leave that piece and the edge's
apart.  That is so for exactly one edge into each position, because the encoding of a prefix
does not depend on what follows.  Whether two pieces stay apart is decided by undoing their
merges in order of priority.  Characters without a piece are edges of their own and become bytes.

Decoding concatenates the pieces, bytes for byte pieces, and drops the leading space.

Rows: a null text is empty and has no ids; rows that repeat an id are texts of their own.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.cluster import ready
from folio.llm.suffix_dedup import eight_bytes, suffix_array
from folio.llm.text import UnitCache, ragged, slices, text_bytes

_MARK = "▁"
#: Units that a task remembers before it starts anew.
CACHE_UNITS = 1_500_000


class Pieces:
    """The pieces of a model, their priorities and merges."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        if any(_MARK in name.lstrip(_MARK) for name in names.values()):
            raise ValueError(f"{path}: a piece continues across the beginning of a word")
        self.bytes_of = {i: (" " * (len(n) - len(n.lstrip(_MARK))) + n.lstrip(_MARK)).encode() for i, n in names.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.size = model.vocab_size()
        # a lower rank merges earlier; single characters need no merge
        by = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.rank[by] = np.arange(len(by))
        ids_of = {v: i for i, v in self.bytes_of.items()}
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        pairs, merged = [], []
        for i, value in self.bytes_of.items():
            text = value.decode()
            if len(text) > 1:
                for cut in range(1, len(text)):
                    a, b = ids_of.get(text[:cut].encode()), ids_of.get(text[cut:].encode())
                    if a is not None and b is not None:
                        pairs.append(a << 32 | b)
                        merged.append(i)
                last = self._last_merge(text, ids_of)
                if last:
                    self.left[i], self.right[i] = last
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.merged = np.array(pairs, np.int64)[order], np.array(merged, np.int64)[order]
        # a piece that its own merges do not produce is never part of an encoding
        whole = [i for i, v in self.bytes_of.items() if len(v.decode()) == 1 or self.left[i] >= 0]
        whole.sort(key=lambda i: self.bytes_of[i])
        self.searched = np.array(whole, np.int64)
        self.lengths = np.array([len(self.bytes_of[i]) for i in whole], np.int64)
        self.depth = int(self.lengths.max())
        self.words = -(-self.depth // 8)
        padded = np.zeros((len(whole), self.words * 8), np.uint8)
        for row, i in enumerate(whole):
            padded[row, : len(self.bytes_of[i])] = np.frombuffer(self.bytes_of[i], np.uint8)
        self.keys = padded.view(">u8").astype(np.uint64)
        masks = np.where(np.arange(self.words * 8) < self.lengths[:, None], 255, 0).astype(np.uint8)
        self.masks = masks.view(">u8").astype(np.uint64)
        self.values = {**{i: v for i, v in self.bytes_of.items()}, **{int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}}

    def _last_merge(self, text: str, ids_of: dict[bytes, int]) -> tuple[int, int] | None:
        """The two pieces that a piece is merged from last, or None if merging does not produce it."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank[i], at) for at in range(len(parts) - 1) if (i := ids_of.get((parts[at] + parts[at + 1]).encode())) is not None]
            if not ranked:
                return None
            _, at = min(ranked)
            if len(parts) == 2:
                a, b = ids_of.get(parts[0].encode()), ids_of.get(parts[1].encode())
                return None if a is None or b is None else (a, b)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what two pieces merge to; very large if to nothing."""
        name = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, name), len(self.pairs) - 1)
        return np.where(self.pairs[at] == name, self.rank[self.merged[at]], 1 << 40)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of two pieces leaves just these two.

        Walks back in time: the later merge of the two is undone first, and at no time may what
        stands at the border merge earlier than the merge undone last.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 39)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            # on equal rank the merge further left comes first: that of the border before one to its right
            meets = self.merge_rank(x, y)
            bad = meets < limit[open_]
            good[open_[bad]] = False
            made_x = np.where(self.left[x] >= 0, self.rank[x], -1)
            made_y = np.where(self.left[y] >= 0, self.rank[y], -1)
            over = (made_x < 0) & (made_y < 0)
            undo_x = made_x > made_y
            a[open_] = np.where(undo_x & ~over, self.right[x], x)
            b[open_] = np.where(~undo_x & ~over, self.left[y], y)
            # the border merges before an equal merge to its right, not before one to its left
            limit[open_] = np.where(undo_x, made_x, made_y + 1)
            open_ = open_[~bad & ~over]
        return good


def occurrences(pieces: Pieces, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece occurs in ``body``: positions and the pieces' rows, by binary search in its suffix array."""
    order = suffix_array(body, pieces.depth)
    keys = np.concatenate([eight_bytes(body), np.zeros(pieces.words * 8 + 1, np.uint64)])

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces.searched), np.int64), np.full(len(pieces.searched), len(body))
        for _ in range(int(len(body)).bit_length()):
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(body) - 1)]
            less = np.zeros(len(low), bool)
            equal = np.ones(len(low), bool)
            for w in range(pieces.words):
                seen = keys[at + 8 * w] & pieces.masks[:, w]
                less |= equal & (seen < pieces.keys[:, w])
                equal &= seen == pieces.keys[:, w]
            up = (less | equal if after else less) & (low < high)
            low = np.where(up, mid + 1, low)
            high = np.where(up, high, mid)
        return low

    first, last = bound(False), bound(True)
    count = last - first
    return order[ragged(first, count)], np.repeat(np.arange(len(count)), count)


def encode_units(pieces: Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and how many each has."""
    # units are kept apart by a byte that no piece holds, where a text has it it is a character without piece
    body = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
    length = np.array([len(u) for u in units], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    n = len(body)
    at, row = occurrences(pieces, body)
    piece, size = pieces.searched[row], pieces.lengths[row]
    # characters without a piece of their own
    lead = (body & 0xC0) != 0x80
    lone = np.ones(n, bool)
    single = np.zeros(n, bool)
    single[begin + length] = True  # separators are no characters
    lone[at[size == _char_length(body, at)]] = False
    alone = np.flatnonzero(lead & lone & ~single)
    at = np.concatenate([at, alone])
    piece = np.concatenate([piece, np.full(len(alone), pieces.size)])
    size = np.concatenate([size, _char_length(body, alone)])

    owner = np.searchsorted(begin, at, "right") - 1
    depth = at - begin[owner]
    by = np.argsort(depth, kind="stable")
    at, piece, size, depth = at[by], piece[by], size[by], depth[by]
    # last[p] is the last piece of the encoding of a unit's text before p
    start_of = -2
    last, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    last[begin] = start_of
    known_pairs, known_good = np.zeros(0, np.int64), np.zeros(0, bool)
    edges = np.append(np.flatnonzero(np.append(True, np.diff(depth) != 0)), len(depth)) if len(depth) else np.zeros(1, np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        here, what, long = at[low:high], piece[low:high], size[low:high]
        before = last[here]
        fits = before != -1
        free = (before == start_of) | (before == pieces.size) | (what == pieces.size)
        ask = np.flatnonzero(fits & ~free)
        if len(ask):
            name = (before[ask] << 32) | what[ask]
            asked, place = np.unique(name, return_inverse=True)
            slot = np.searchsorted(known_pairs, asked)
            have = slot < len(known_pairs)
            have[have] = known_pairs[slot[have]] == asked[have]
            new = asked[~have]
            if len(new):
                fresh = pieces.apart(new >> 32, new & 0xFFFFFFFF)
                known_pairs = np.insert(known_pairs, slot[~have], new)
                known_good = np.insert(known_good, slot[~have], fresh)
                slot = np.searchsorted(known_pairs, asked)
            fits[ask] = known_good[slot][place]
        end = here[fits] + long[fits]
        last[end], back[end] = what[fits], here[fits]

    # walk back from the ends of all units at once
    stop = begin + length
    found_at, found = [], []
    walk = np.flatnonzero(length > 0)
    position = stop[walk]
    while len(walk):
        if (last[position] == -1).any():
            raise ValueError("a text without encoding")
        found.append(last[position])
        found_at.append(back[position])
        position = back[position]
        more = position > begin[walk]
        walk, position = walk[more], position[more]
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
    where, ids = np.concatenate(found_at), np.concatenate(found)
    by = np.argsort(where)
    where, ids = where[by], ids[by]
    # characters without a piece become the ids of their bytes
    many = np.where(ids == pieces.size, _char_length(body, where), 1)
    flat = np.repeat(ids, many)
    bare = np.flatnonzero(flat == pieces.size)
    spread = ragged(where, many)
    flat[bare] = pieces.byte_ids[body[spread[bare]]]
    unit = np.repeat(np.searchsorted(begin, where, "right") - 1, many)
    return flat, np.bincount(unit, minlength=len(units))


def _char_length(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the characters that start at these positions."""
    lead = body[at]
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))).astype(np.int64)


class UnitEncoder:
    """Ids of slices of texts; remembers the units it has encoded."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache = UnitCache(self._units, np.int64, CACHE_UNITS)

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and n+1 offsets."""
        if not len(body):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        space = body == 32
        first = np.zeros(len(body), bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        begin = np.flatnonzero(first | (space & ~np.append(False, space[:-1])))
        end = np.append(begin[1:], len(body))
        # a text's first unit has a space put before it
        ids, count = self.cache.ids_of(body, begin, end, first[begin])
        total = np.append(0, np.cumsum(count))
        return ids, total[np.searchsorted(begin, at)]

    def _units(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = body.tobytes()
        return encode_units(self.pieces, [(b" " if f else b"") + data[a:b] for a, b, f in zip(begin.tolist(), end.tolist(), first.tolist(), strict=True)])


class Decoder:
    """Bytes of ids."""

    def __init__(self, values: dict[int, bytes], size: int):
        length = np.zeros(size, np.int64)
        for i, v in values.items():
            length[i] = len(v)
        self.length = length
        self.at = np.cumsum(length) - length
        self.flat = np.frombuffer(b"".join(values.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes end to end and n+1 offsets; the space before each text is dropped."""
        size = self.length[ids]
        body = self.flat[ragged(self.at[ids], size)]
        total = np.append(0, np.cumsum(size))[at]
        full = np.flatnonzero(total[:-1] < total[1:])
        keep = np.ones(len(body), bool)
        keep[total[:-1][full][body[total[:-1][full]] == 32]] = False
        return body[keep], np.append(0, np.cumsum(keep))[total]


def _encoded(pieces: Pieces, with_ids: bool):
    def run(batches):
        encoder = UnitEncoder(pieces)
        decoder = Decoder(pieces.values, pieces.size)
        for batch in batches:
            # a larger batch is indexed at once: every piece is searched once per index
            for low, high in slices(batch.column(1), 4 << 20):
                texts = batch.column(1)[low:high]
                ids, at = encoder.encode(*_plain(texts))
                docs = batch.column(0)[low:high]
                if with_ids:
                    yield pa.record_batch([docs, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])
                    continue
                body, text_at = decoder.decode(ids, at)
                small = ids.astype("<u4")
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), text_at[:-1].tolist(), text_at[1:].tolist(), strict=True))
                yield pa.record_batch([
                    docs, pa.array(np.diff(at)), pa.array([zlib.crc32(small[a:b]) for a, b, _, _ in spans], pa.int64()),
                    pa.array([hashlib.sha256(body[c:d]).hexdigest() for _, _, c, d in spans], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    return run


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a literal mark counts as the space it stands for."""
    body, at = text_bytes(texts)
    mark = _MARK.encode()
    if mark not in body.tobytes():
        return body, at
    return text_bytes(pa.array([(t or "").replace(_MARK, " ") for t in texts.to_pylist()], pa.string()))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of every text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(Pieces(model), True), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    ready(encoded.sparkSession)
    pieces = Pieces(model)
    values, size = pieces.values, pieces.size

    def run(batches):
        decoder = Decoder(values, size)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[at[0] : at[-1]]
            body, text_at = decoder.decode(ids, at - at[0])
            texts = [body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(text_at[:-1], text_at[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 of its ids, and decoded_sha256 of the text decoded from them."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(Pieces(model), False), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
