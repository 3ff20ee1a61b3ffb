"""Byte-pair ids of whole columns of texts.

A text is cut before every single space between two other characters, where no token of the
byte-level pattern crosses.  Each distinct unit is encoded once per task; the ids of a text are
gathered from those of its units.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from folio.llm.text import SPACE, UnitCache, ragged

#: The pre-tokenizing pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units kept by a task before it starts anew.
CACHE_UNITS = 2_000_000

_LEAD = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])
_SECOND = np.isin(np.arange(256), [0x80, 0x81, 0x9A])
_LATIN = np.isin(np.arange(256), [0x85, 0xA0])


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks by token bytes from a byte-level BPE file, whose ids follow its merges."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    alphabet = byte_alphabet()
    special = {t["content"] for t in whole.get("added_tokens", [])}
    vocabulary, merges = whole["model"]["vocab"], whole["model"]["merges"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if [vocabulary[m] for m in merged] != sorted(vocabulary[m] for m in merged):
        raise ValueError(f"{path}: ids do not follow the merges")
    return {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def unit_starts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin: at every text, and before single spaces between two characters that are no white space."""
    n = len(body)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        around = np.concatenate([np.full(3, 32, np.uint8), body, np.full(3, 32, np.uint8)])
        spaces = np.flatnonzero(body == 32)
        p = spaces + 3
        open_ = ~SPACE[around[p - 1]] & ~SPACE[around[p + 1]]
        # white space of two or three bytes before or after: no cut, to be safe
        open_ &= ~((around[p - 2] == 0xC2) & _LATIN[around[p - 1]]) & ~(_LEAD[around[p - 3]] & _SECOND[around[p - 2]])
        open_ &= ~((around[p + 1] == 0xC2) & _LATIN[around[p + 2]]) & ~(_LEAD[around[p + 1]] & _SECOND[around[p + 2]])
        begin[spaces[open_]] = True
        # the space must be inside its text, with a character on both sides
        begin[at[1:-1][at[1:-1] > 0] - 1] = False
    begin[at[:-1]] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """Ids of slices of texts; remembers units."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.cache = UnitCache(lambda body, begin, end, kind: self._units(body, begin, end), np.uint32, CACHE_UNITS)

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and n+1 offsets."""
        begin = unit_starts(body, at)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(body))
        # an empty text has no unit; a unit ends with its text
        ids, count = self.cache.ids_of(body, begin, end)
        total = np.append(0, np.cumsum(count))
        return ids, total[np.searchsorted(begin, at)]

    def _units(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end and how many each has.

        Units that begin with a space and end with a character are encoded as one text.
        """
        data = body.tobytes()
        around = np.concatenate([np.full(3, 32, np.uint8), body, np.full(3, 32, np.uint8)])
        p, e = begin + 3, end + 3
        plain = (body[begin] == 32) & (end - begin > 1) & ~SPACE[around[p + 1]] & ~SPACE[around[e - 1]]
        plain &= ~((around[p + 1] == 0xC2) & _LATIN[around[p + 2]]) & ~(_LEAD[around[p + 1]] & _SECOND[around[p + 2]])
        plain &= ~((around[e - 2] == 0xC2) & _LATIN[around[e - 1]]) & ~(_LEAD[around[e - 3]] & _SECOND[around[e - 2]])
        counts = np.zeros(len(begin), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(begin)
        for i in np.flatnonzero(~plain).tolist():
            parts[i] = np.array(self.encoding.encode_ordinary(data[begin[i] : end[i]].decode()), np.uint32)
            counts[i] = len(parts[i])
        together = np.flatnonzero(plain)
        joined = body[ragged(begin[together], end[together] - begin[together])].tobytes().decode()
        flat = np.array(self.encoding.encode_ordinary(joined), np.uint32)
        reach = np.cumsum(self.size[flat])
        stop = np.cumsum(end[together] - begin[together])
        upto = np.searchsorted(reach, stop) + 1
        if len(stop) and not np.array_equal(reach[upto - 1], stop):
            raise ValueError("a token crosses two units")
        counts[together] = np.diff(np.append(0, upto))
        if len(together) == len(begin):
            return flat, counts
        # back in the order of the units
        out = np.zeros(int(counts.sum()), np.uint32)
        place = np.cumsum(counts) - counts
        out[ragged(place[together], counts[together])] = flat
        for i in np.flatnonzero(~plain).tolist():
            out[place[i] : place[i] + counts[i]] = parts[i]
        return out, counts
