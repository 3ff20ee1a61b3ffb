"""Cheapest repair of the turn structure of conversations, by the method of four Russians.

A conversation is in order if its roles' first letters read ``(s?(ua)+)?``.  Each row is kept (0),
given the role user or assistant (2), or deleted (3); rows of either role with an empty text are
inserted (2).  Blank and repeated rows are deleted; a truncated row that stays costs 1.

The rows a conversation still has to come cost, from each of the four states of that pattern, a
vector of least costs.  Less their least entry there are few such vectors, so the step over every block of
``BLOCK`` row symbols is tabled for every vector: (block, vector to its right) -> (vector to its left,
cost).  A conversation is looked up block by block from its end.  Then blocks are expanded against
that direction, from the state each is entered in, always taking the edit whose letter is
smallest among those that keep the least cost: of all cheapest edit strings this gives the ASCII-least.

Rows are range-partitioned in conversation order and cut into chunks of bounded size, whatever the
conversation.  Repeats are found by digest, and a row becomes one byte.  One task holds one byte for each
row of a conversation, as its edit string, one value, does; texts are edited chunk by chunk and only
streamed, in order, through the digest of a conversation that spans chunks.

Rows: a null role or text is one space; a null turn comes first; rows of one turn are ordered by role and
text.  A null conversation id is a conversation.  A first letter other than s, u or a (upper case too), or an empty role,
cannot be kept.  Gaps of turns beyond the range of long are null.  Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.cluster import ready
from folio.session import settle

#: Row symbols in a tabled block.
BLOCK = 4
#: Bytes of role and text in a chunk, about; a longer text has one of its own.
CHUNK_BYTES = 4 << 20
ROW_BYTES = 64
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"

# States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.  0 and 3 may end.
_GIVEN = (2, 2, 3, 2)  # where a user or assistant row leads; each state takes one of the two
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LETTERS = "sua?"
#: Row symbols: a first letter, cut short or not, and last the row that has to go.
SYMBOLS = 2 * len(_LETTERS) + 1
MUST_GO = SYMBOLS - 1
_ROLES = {2: "user", 3: "assistant"}
_FAR = 1 << 40


def _inserted(cost: list[int]) -> tuple[int, ...]:
    """Costs of the states once rows may be inserted before going on."""
    two = min(cost[2], INSERT + cost[3])
    three = min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + two), min(cost[1], INSERT + two), two, three


END = _inserted([0, _FAR, _FAR, 0])


def _options(symbol: int, state: int, right: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """Edits of one row in a state: letter, cost to the end, next state; by letter."""
    yield "D", DELETE + right[state], state
    if symbol != MUST_GO:
        extra = TRUNCATED * (symbol % 2)
        kept = _KEPT.get((state, _LETTERS[symbol // 2]))
        if kept is not None:
            yield "K", extra + right[kept], kept
        yield "R", REROLE + extra + right[_GIVEN[state]], _GIVEN[state]


def step(symbol: int, right: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from each state before a row, from those after it."""
    return _inserted([min(cost for _, cost, _ in _options(symbol, state, right)) for state in range(4)])


class Tables:
    """Normalised vectors, and the steps over one symbol and over every block of ``size`` symbols."""

    def __init__(self, size: int = BLOCK):
        self.size = size
        self.vectors, known, found = [END], {END: 0}, []
        while len(found) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                left = step(symbol, self.vectors[len(found)])
                least = min(left)
                left = tuple(c - least for c in left)
                if left not in known:
                    known[left] = len(self.vectors)
                    self.vectors.append(left)
                row.append((known[left], least))
            found.append(row)
        one = np.array(found, np.int64)  # vector, symbol, (next, cost)
        self.next, self.cost = one[:, :, 0], one[:, :, 1]
        blocks = np.arange(SYMBOLS**size)
        at = np.broadcast_to(np.arange(len(self.vectors))[:, None], (len(self.vectors), len(blocks)))
        paid = np.zeros(at.shape, np.int64)
        for place in range(size):  # the last symbol of a block is its lowest digit
            symbol = blocks // SYMBOLS**place % SYMBOLS
            paid = paid + self.cost[at, symbol]
            at = self.next[at, symbol]
        self.block_next, self.block_cost = at.tolist(), paid.tolist()
        self._expanded: dict[tuple, tuple[str, int]] = {}

    def expand(self, symbols: tuple[int, ...], right: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits of some rows entered in a state, and the state they leave."""
        key = symbols, right, state
        if key not in self._expanded:
            costs = [self.vectors[right]]
            for symbol in reversed(symbols):
                costs.append(step(symbol, costs[-1]))
            costs.reverse()
            edits = []
            for i, symbol in enumerate(symbols):
                while True:
                    due = costs[i][state]
                    options = [*_options(symbol, state, costs[i + 1]), ("I", INSERT + costs[i][_GIVEN[state]], _GIVEN[state])]
                    letter, state = min((letter, after) for letter, cost, after in options if cost == due)
                    edits.append(letter)
                    if letter != "I":
                        break
            self._expanded[key] = "".join(edits), state
        return self._expanded[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost and edits of a conversation given as row symbols."""
        size, n = self.size, len(symbols)
        head = n % size
        body = symbols[head:].reshape(-1, size).astype(np.int64)
        codes = (body @ SYMBOLS ** np.arange(size - 1, -1, -1)).tolist()
        vector, cost, right = 0, 0, []
        for code in reversed(codes):
            right.append(vector)
            cost += self.block_cost[vector][code]
            vector = self.block_next[vector][code]
        first = vector
        for symbol in symbols[:head][::-1].tolist():
            cost += int(self.cost[vector, symbol])
            vector = int(self.next[vector, symbol])
        cost += self.vectors[vector][0]
        edits, state = self.expand(tuple(symbols[:head].tolist()), first, 0)
        pieces = [edits]
        for block, vector in zip(body.tolist(), reversed(right), strict=True):
            edits, state = self.expand(tuple(block), vector, state)
            pieces.append(edits)
        pieces.append("I" * (END[state] // INSERT))
        return cost, "".join(pieces)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _symbol(initial: Column, gone: Column, cut: Column) -> Column:
    """A letter for a row: its first letter times its fault (none, truncated, to be deleted)."""
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(97) + at * 3 + F.when(gone, 2).when(cut, 1).otherwise(0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of a sorted partition, and the rows of each chunk."""
    first = TaskContext.get().partitionId() << 32
    total, chunk, place = 0, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        long = [pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("role", "text")]
        ends = total + np.cumsum(long[0].astype(np.int64) + long[1] + ROW_BYTES)
        total = int(ends[-1])
        number = ends // CHUNK_BYTES
        starts = np.flatnonzero(np.diff(number, prepend=chunk))
        at = np.arange(len(number)) + place
        for s in starts:
            at[s:] = np.arange(len(number) - s)
        chunk, place = int(number[-1]), int(at[-1]) + 1
        yield batch.append_column("chunk", pa.array(first + number, pa.int64())).append_column("at", pa.array(at, pa.int64()))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text in order, cut into chunks: a row's place is (chunk, at)."""
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    ranged = rows.repartitionByRange(*order, F.substring("role", 1, 32)).sortWithinPartitions(*order, "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return settle(ranged.mapInArrow(_chunks, f"conv_id {kind}, turn long, role string, text string, chunk long, at long"), "turns")


def pieces_of(rows: DataFrame) -> DataFrame:
    """What each conversation has in each chunk: row symbols in order, faults and turns."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    light = rows.select(
        "conv_id", "chunk", "at", "turn", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), "role", F.sha2("text", 256).alias("digest"),
    )
    place = F.struct("chunk", "at")
    once = light.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("p")).select("p.*", F.lit(True).alias("_first"))
    flagged = light.join(once, ["chunk", "at"], "left")
    repeated = ~F.col("blank") & F.col("_first").isNull()
    gone = F.col("blank") | repeated
    flagged = flagged.withColumns({"repeated": repeated, "cut": ~gone & F.col("cut"), "symbol": _symbol(F.col("initial"), gone, F.col("cut"))})
    return flagged.groupBy("conv_id", "chunk").agg(
        F.min("at").alias("first_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"),
        *[F.count_if(F.col(f)).alias(f) for f in ("blank", "repeated", "cut")],
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )


def _entries(symbols: np.ndarray, edits: str, ends: np.ndarray) -> list[tuple[str, int]]:
    """The edits of each piece (rows up to ``ends``), and the state in which it is entered."""
    letters = np.frombuffer(edits.encode(), np.uint8)
    rows = np.cumsum(letters != ord("I"))
    cuts = np.searchsorted(rows, ends) + 1  # after the piece's last row
    cuts[-1] = len(letters)
    starts = np.concatenate([[0], cuts[:-1]])
    left = np.concatenate([[0], np.cumsum(letters != ord("D"))])
    kept = np.flatnonzero(letters != ord("D"))
    system = bool(len(kept)) and letters[kept[0]] == ord("K") and symbols[rows[kept[0]] - 1] // 2 == 0
    out = []
    for start, end in zip(starts.tolist(), cuts.tolist(), strict=True):
        turns = int(left[start]) - system
        state = 0 if not left[start] else 1 if turns == 0 else 3 - turns % 2
        out.append((edits[start:end], state))
    return out


_PLAN = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "pieces array<struct<chunk:long,first_at:long,edits:string,state:int,whole:boolean>>"
)
_PIECE_TYPE = pa.list_(pa.struct([("chunk", pa.int64()), ("first_at", pa.int64()), ("edits", pa.string()), ("state", pa.int32()), ("whole", pa.bool_())]))


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for pieces in batch.column("pieces").to_pylist():
            letters = np.frombuffer("".join(p["symbols"] for p in pieces).encode(), np.uint8) - 97
            initial, fault = letters // 3, letters % 3
            symbols = np.where(fault == 2, MUST_GO, initial * 2 + fault)
            cost, edits = tables().solve(symbols)
            ends = np.cumsum([len(p["symbols"]) for p in pieces])
            known = [p for p in pieces if p["turns"]]
            gaps = 0
            if known:
                shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(p["turns"] for p in known) + shared
            for column, value in zip(out, (
                gaps if gaps < 1 << 63 else None, sum(p["blank"] for p in pieces), sum(p["repeated"] for p in pieces), sum(p["cut"] for p in pieces),
                int((~legal[initial[:-1], initial[1:]]).sum()), cost, edits,
                [{"chunk": p["chunk"], "first_at": p["first_at"], "edits": e, "state": s, "whole": len(pieces) == 1} for p, (e, s) in zip(pieces, _entries(symbols, edits, ends), strict=True)],
            ), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 6 + [pa.string(), _PIECE_TYPE]
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"]
        yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["conv_id", *names])


def plan(rows: DataFrame) -> DataFrame:
    """Faults, least cost, edit string and edited pieces of every conversation of ``ordered_rows``."""
    one = F.struct("chunk", "first_at", "symbols", "blank", "repeated", "cut", "low", "high", "turns")
    grouped = pieces_of(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return settle(grouped.mapInArrow(_plan, f"conv_id {kind}, {_PLAN}"), "plans")


def edited(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of the rows that are left of a piece."""
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = _KEPT[state, role[:1]]
        else:
            state = _GIVEN[state]
            role = _ROLES[state]
        yield role, text, letter


def _pieces_with_rows(rows: pa.Table, pieces: pa.Table) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    rows, pieces = rows.sort_by("at"), pieces.sort_by("first_at").to_pylist()
    starts = [p["first_at"] for p in pieces] + [len(rows)]
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    for piece, start, end in zip(pieces, starts, starts[1:]):
        yield piece, iter(zip(roles[start:end], texts[start:end], strict=True))


def _turns(kind: pa.DataType):
    def run(key, rows: pa.Table, pieces: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for piece, own in _pieces_with_rows(rows, pieces):
            out.extend((piece["conv_id"], piece["chunk"], piece["first_at"], i, *turn) for i, turn in enumerate(edited(piece["edits"], piece["state"], own)))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [kind, *[pa.int64()] * 3, *[pa.string()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "chunk", "first_at", "place", "role", "text", "edit"])

    return run


def _digests(kind: pa.DataType):
    def run(key, rows: pa.Table, pieces: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for piece, own in _pieces_with_rows(rows, pieces):
            body = "\n".join(f"{role}:{text}" for role, text, _ in edited(piece["edits"], piece["state"], own)).encode()
            whole = piece["whole"]
            out.append((piece["conv_id"], piece["chunk"], hashlib.sha256(body).hexdigest() if whole else None, None if whole else body))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.binary()), strict=True)], names=["conv_id", "chunk", "sha", "body"])

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation whose pieces come one after another."""
    digest, kind, current, begun = None, None, None, False

    def done():
        return pa.record_batch([pa.array([current], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, body in zip(batch.column("conv_id").to_pylist(), batch.column("body"), strict=True):
            if digest is None or conv_id != current:
                if digest is not None:
                    yield done()
                digest, current, begun = hashlib.sha256(), conv_id, False
            if len(body.as_buffer()):
                digest.update(b"\n" if begun else b"")
                digest.update(body.as_buffer())
                begun = True
    if digest is not None:
        yield done()


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _by_chunk(rows: DataFrame, plans: DataFrame):
    pieces = plans.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", "p.*")
    return rows.select("chunk", "at", "role", "text").groupBy("chunk").cogroup(pieces.groupBy("chunk"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (chunk, first_at, place, in this order), role, text, edit."""
    ready(conversations.sparkSession)
    rows = ordered_rows(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, chunk long, first_at long, place long, role string, text string, edit string"
    return _by_chunk(rows, plan(rows)).applyInArrow(_turns(_arrow_kind(rows)), schema)


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, gaps, least cost, edit string, and digest of the repaired rows."""
    ready(conversations.sparkSession)
    rows = ordered_rows(conversations)
    plans = plan(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    digests = settle(_by_chunk(rows, plans).applyInArrow(_digests(_arrow_kind(rows)), f"conv_id {kind}, chunk long, sha string, body binary"), "digests")
    spread = digests.filter("sha is null").select("conv_id", "chunk", "body").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    all_digests = digests.filter("sha is not null").select("conv_id", "sha").unionByName(spread.mapInArrow(_streamed, f"conv_id {kind}, sha string"))
    named = all_digests.select(F.col("conv_id").alias("_conv"), F.col("sha").alias("repaired_sha256"))
    return plans.drop("pieces").join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
