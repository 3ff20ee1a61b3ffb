"""Repair of conversations against an exhaustive search, small chunks, and rows with nulls and ties."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from folio.llm import catalog, turn_repair

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least cost and ASCII-least edits of rows (first letter, must go, cut short), by trying all."""
    best = None

    def walk(i, roles, cost, edits):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and PATTERN.fullmatch(roles):
            best = min(best, (cost, edits)) if best else (cost, edits)
        if edits[-3:] != "III":
            for role in "ua":
                walk(i, roles + role, cost + 2, edits + "I")
        if i < len(rows):
            letter, gone, cut = rows[i]
            if not gone:
                if letter in "sua":
                    walk(i + 1, roles + letter, cost + cut, edits + "K")
                for role in "ua":
                    walk(i + 1, roles + role, cost + 2 + cut, edits + "R")
            walk(i + 1, roles, cost + 3, edits + "D")

    best = (3 * len(rows), "D" * len(rows))
    walk(0, "", 0, "")
    return best


def coded(rows):
    return np.array([turn_repair.MUST_GO if gone else 2 * "sua?".index(letter) + cut for letter, gone, cut in rows], np.int64)


def test_every_short_conversation_is_repaired_at_least_cost_with_the_least_edits():
    draw = random.Random(3)
    kinds = [(letter, gone, cut) for letter in "sua?" for gone, cut in ((False, False), (False, True), (True, False))]
    cases = [[]] + [[a] for a in kinds] + [[a, b] for a in kinds for b in kinds] + [[draw.choice(kinds) for _ in range(draw.choice((3, 4, 5)))] for _ in range(60)]
    for rows in cases:
        assert turn_repair.tables().solve(coded(rows)) == cheapest(rows), rows


def test_blocks_of_any_length_give_the_same_edits():
    draw = random.Random(4)
    one, three = turn_repair.Tables(1), turn_repair.Tables(3)
    for n in (0, 1, 7, 40, 1001):
        rows = np.array([draw.randrange(turn_repair.SYMBOLS) for _ in range(n)], np.int64)
        assert one.solve(rows) == three.solve(rows) == turn_repair.tables().solve(rows)
    assert len(one.vectors) < 100


def plain(rows: list[tuple]) -> dict:
    """conv_id -> result of rows (conv_id, turn, role, text), by the rules as they are written."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            solid = SPACE.findall(text)
            blank, again = not solid, (role, text) in seen
            seen.add((role, text))
            cut = not (blank or again) and solid[-1] not in ".!?"
            counts = [counts[0] + blank, counts[1] + (not blank and again), counts[2] + cut]
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "?", blank or again, cut))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = turn_repair.Tables(1).solve(coded(kinds))
        left, at = [], 0
        for letter in audit:
            if letter == "I":
                left.append((None, ""))
                continue
            if letter != "D":
                left.append((turns[at][1] if letter == "K" else None, turns[at][2]))
            at += 1
        system = bool(left) and (left[0][0] or "u")[:1] == "s"
        lines = [f"{role or ('user', 'assistant')[(i - system) % 2]}:{text}" for i, (role, text) in enumerate(left)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."),
    (2, 0, "user", "One."), (2, 0, "user", "One."), (2, 0, "assistant", "cut"), (2, 5, None, "Who?"), (2, None, "tool", None),
    (3, 4, "assistant", ""), (3, 4, "assistant", " \t\r\n\x0b\x0c"), (3, 9, "", "No role."),
    (None, None, None, None), (None, 1, "user", "Null conversation."), (None, None, "assistant", "Yes!"),
    (4, 1, "User", "Upper."), (4, 2, "assistant", "été 日本 🙂!"), (4, -3, "user", "x " * 200_000), (4, -3, "user", "x " * 200_000),
    (5, 2, "assistant", "Late."), (5, 1, "assistant", "Late."), (5, 3, "assistant", "\u00a0"),
    (6, 0, "user", "a:b\nc."), (6, 1, "sudo", "d."),
]
SCHEMA = "conv_id long, turn long, role string, text string, chunk string, pieces string, at string, sha string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "a", "s") for r in rows], SCHEMA)


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}


def test_nulls_ties_repeats_and_long_texts(spark):
    assert result(turn_repair.audits(frame(spark, ROWS))) == plain(ROWS)


@pytest.mark.parametrize("size", [100, 700])
def test_a_conversation_that_spans_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(turn_repair, "CHUNK_BYTES", size)
    draw = random.Random(size)
    words = ["Yes.", "No.", "", "why", "So!", "and then"]
    rows = [(conv if at % 3 else 7, at // 2 if at % 7 else None, draw.choice(("user", "assistant", "system", "tool", "")), draw.choice(words) + str(at % 11) + draw.choice((".", "")))
            for conv in range(4) for at in range(90)]
    assert result(turn_repair.audits(frame(spark, rows))) == plain(rows)
    turns = turn_repair.repaired(frame(spark, rows)).collect()
    turns.sort(key=lambda r: (r.chunk, r.first_at, r.place))
    for conv, expected in plain(rows).items():
        own = [r for r in turns if r.conv_id == conv]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == expected[-1]
        assert PATTERN.fullmatch("".join(r.role[:1] for r in own))


def test_no_rows(spark):
    empty = frame(spark, [])
    assert turn_repair.audits(empty).count() == 0 and turn_repair.repaired(empty).count() == 0
    assert turn_repair.audits(empty).columns == ["conv_id", *FIELDS]


def test_gaps_beyond_long_are_null(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert result(turn_repair.audits(frame(spark, rows)))[1][0] is None


def test_conversations_that_lose_all_rows_stay(spark, data_dir, tmp_path):
    import zlib

    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hi.") for c in gone] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in catalog.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {*gone, None}
    for c in gone:
        assert tuple(got[c][f] for f in FIELDS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
