"""Whole-column work on the UTF-8 bytes of texts, for use inside tasks.

A slice of a text column is one byte array and the places where its texts start.  Words and units
are identified by 64-bit hashes that scramble eight bytes at a time; a polynomial would give one value to
texts of a regular build, whatever its base.  Byte strings of a fixed, small length are read off one
running sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; one text is never cut.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, extended on demand; a copy sent to a task starts anew."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._run(base, n + n // 4) for base in (_BASE, _BASE_INVERSE))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte; folded: A-Z count as a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer text."""
    _, at = text_bytes(column)
    start, rows = 0, len(column)
    while start < rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield start, min(end, rows)
        start = end
    # the worker goes on to other tasks and stages: what earlier batches took goes back to the system
    pa.default_memory_pool().release_unused()


def running_hash(body: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """n+1 running sums from which ``span_hash`` reads the hash of any span."""
    up, _ = POWERS.first(len(body) + 1)
    out = np.empty(len(body) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[body] * up[:-1], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end)."""
    _, down = POWERS.first(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


#: Longer spans are hashed one by one.
LONG_SPAN = 1024
_TEXT_SEED = np.uint64(0x2545F4914F6CDD1D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_hash(body: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """A hash of each byte string [start, end); folded: A-Z count as a-z."""
    if folded:
        body = LOWER[body]
    size = end - start
    out = mix(size.astype(np.uint64) ^ _TEXT_SEED)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    # the eight bytes from any place on
    eight = np.ndarray((len(body) + 1,), "<u8", padded, 0, (1,))
    some = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(some):
        part = eight[start[some] + done]
        left = size[some] - done
        last = left < 8
        part[last] &= (np.uint64(1) << (left[last].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[some] = mix((out[some] ^ part) * np.uint64(0x9FB21C651E98DF25))
        some = some[left > 8]
        done += 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(body[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> bool:
    """Whether all spans of a and b are equal, one by one."""
    return bool((a[ragged(a_start, size)] == b[ragged(b_start, size)]).all())


class UnitCache:
    """Ids of units of text, kept by hash; a unit is the one that is kept only if all its bytes are.

    ``make`` takes bytes, starts, ends and kinds of units, and gives their ids end to end and how many each has.
    Units of different kinds differ.
    """

    def __init__(self, make: Callable[..., tuple[np.ndarray, np.ndarray]], kind: type, most: int):
        self.make, self.id_type, self.most = make, kind, most
        self.forget()

    def forget(self) -> None:
        self.hash, self.kind = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.id_type)
        self.text, self.text_start, self.text_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and how many each has."""
        kind = np.zeros(len(begin), bool) if kind is None else kind
        size = end - begin
        hashes = text_hash(body, begin, end)
        hashes = np.where(kind, mix(hashes ^ np.uint64(0x1F)), hashes)
        names, place, unit = np.unique(hashes, return_index=True, return_inverse=True)
        same = place[unit]
        if not ((size == size[same]).all() and (kind == kind[same]).all() and equal_spans(body, begin, body, begin[same], size)):
            return self.make(body, begin, end, kind)
        if len(self.hash) > self.most:
            self.forget()
        slot = np.searchsorted(self.hash, names)
        known = slot < len(self.hash)
        known[known] = self.hash[slot[known]] == names[known]
        held, mine = slot[known], place[known]
        if not (
            (self.text_size[held] == size[mine]).all() and (self.kind[held] == kind[mine]).all()
            and equal_spans(self.text, self.text_start[held], body, begin[mine], size[mine])
        ):
            return self.make(body, begin, end, kind)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            some = place[fresh]
            ids, count = self.make(body, begin[some], end[some], kind[some])
            text = body[ragged(begin[some], size[some])]
            new = (
                ("hash", names[fresh]), ("kind", kind[some]), ("count", count), ("start", len(self.ids) + np.cumsum(count) - count),
                ("text_size", size[some]), ("text_start", len(self.text) + np.cumsum(size[some]) - size[some]),
            )
            for field, values in new:
                setattr(self, field, np.insert(getattr(self, field), slot[fresh], values))
            self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, text])
            slot = np.searchsorted(self.hash, names)
        slot = slot[unit]
        return self.ids[ragged(self.start[slot], self.count[slot])], self.count[slot]


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run without white space) and n+1 offsets of the words of each text."""
    space = SPACE[body]
    before = np.empty(len(body) + 1, bool)
    before[0] = True
    before[1:] = space
    before[at] = True  # a text starts here
    after = np.empty(len(body) + 1, bool)
    after[-1] = True
    after[:-1] = space
    after[at] = True
    solid = ~space
    start = np.flatnonzero(solid & before[:-1])
    end = np.flatnonzero(solid & after[1:]) + 1
    return start, end, np.searchsorted(start, at)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of all spans [start, start + length), end to end."""
    length = length.astype(np.int64)
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start.astype(np.int64) - (ends - length), length)


def binary_column(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose values are flat[at[i]:at[i+1]] as bytes."""
    size = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
