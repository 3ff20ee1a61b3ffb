"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def near(rows, k: int, percent: int) -> dict:
    """doc_id -> (set size, smallest document reachable)."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for doc, own in sets.items():
        for s in own:
            holders[s].append(doc)
    shared = Counter((min(a, b), max(a, b)) for docs in holders.values() for i, a in enumerate(docs) for b in docs[:i])
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {doc: (len(own), find(doc)) for doc, own in sets.items()}


def repeats(rows, span: int = 100) -> dict:
    """doc_id -> (bytes, removed, runs, digest of the rest)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data, until, removed, runs, kept, inside = (text or "").encode(), -1, 0, 0, bytearray(), False
        for i in range(len(data)):
            piece = data[i : i + span]
            if len(piece) == span:
                if piece in seen:
                    until = i + span - 1
                seen.add(piece)
            if i <= until:
                removed, runs, inside = removed + 1, runs + (not inside), True
            else:
                kept.append(data[i])
                inside = False
        out[doc] = (len(data), removed, runs, hashlib.sha256(bytes(kept)).hexdigest())
    return out


def tokens(text) -> list:
    return [*WORD.findall((text or "").translate(FOLD)), None]
