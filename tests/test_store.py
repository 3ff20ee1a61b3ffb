"""Keyed tables: newest versions, restarted batches, crashes, compaction, pruned lookups."""

from __future__ import annotations

import random

import pytest

from conftest import collect
from folio.streaming.store import BUCKET, KeyedTable

SCHEMA = "k string, part int, v int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def table(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "table"), ["k"], **{"buckets": 4, **more})


def test_fifty_batches_read_as_one_copy_and_the_recent_ones(spark, tmp_path):
    store, draw, want = table(spark, tmp_path, compact_every=8), random.Random(1), {}
    for number in range(50):
        touched = {draw.choice([None, *"abcdefgh"]) for _ in range(3)}
        rows = [(k, part, number) for k in touched for part in range(draw.randrange(1, 3))]
        want.update({k: [r for r in rows if r[0] == k] for k in touched})
        assert store.commit(frame(spark, rows), number)
    manifest = store.manifest()
    assert manifest.base and len(manifest.batches) < 8 and manifest.through == 49
    assert collect(store.current()) == sorted([r for rows in want.values() for r in rows], key=repr)
    some = frame(spark, [("a", 0, 0), (None, 0, 0), ("z", 0, 0)])
    assert collect(store.current_of(some)) == sorted(want.get("a", []) + want.get(None, []), key=repr)


def test_a_batch_counts_once(spark, tmp_path):
    store = table(spark, tmp_path)
    assert store.current_of(frame(spark, [("a", 0, 0)])) is None
    assert store.commit(frame(spark, [("a", 0, 1)]), 0)
    assert not store.commit(frame(spark, [("a", 0, 2)]), 0)
    assert store.commit(frame(spark, []), 1)
    assert collect(store.current()) == [("a", 0, 1)] and store.through() == 1


@pytest.mark.parametrize("compact_every", [100, 2])
def test_a_crash_before_the_manifest_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, compact_every):
    store = table(spark, tmp_path, compact_every=compact_every)
    store.commit(frame(spark, [("a", 0, 1), ("b", 0, 1)]), 0)

    def crash(new):
        raise RuntimeError("power cut")

    real = store._publish
    monkeypatch.setattr(store, "_publish", crash if compact_every == 100 else lambda new: crash(new) if new.base else real(new))
    with pytest.raises(RuntimeError):
        store.commit(frame(spark, [("a", 0, 2)]), 1)
    again = table(spark, tmp_path)
    counted = compact_every == 2  # there only the compaction failed
    assert collect(again.current()) == [("a", 0, 2 if counted else 1), ("b", 0, 1)]
    assert again.commit(frame(spark, [("a", 0, 2)]), 1) is not counted
    assert collect(again.current()) == [("a", 0, 2), ("b", 0, 1)]
    left = again.expire(keep=1)
    assert len(left) == 1 and collect(again.current()) == [("a", 0, 2), ("b", 0, 1)]


def test_a_reader_keeps_the_folders_it_started_with(spark, tmp_path):
    store = table(spark, tmp_path, compact_every=2)
    store.commit(frame(spark, [("a", 0, 1)]), 0)
    before = store.current()
    store.commit(frame(spark, [("a", 0, 2)]), 1)
    assert collect(before) == [("a", 0, 1)] and collect(store.current()) == [("a", 0, 2)]
    assert store.expire(keep=1) and collect(store.current()) == [("a", 0, 2)]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    old = two.manifest()
    one.commit(frame(spark, [("a", 0, 1)]), 0)
    two.manifest = lambda: old
    with pytest.raises(Exception, match="exist"):
        two.commit(frame(spark, [("a", 0, 9)]), 0)
    assert collect(one.current()) == [("a", 0, 1)]


def test_other_columns_are_refused(spark, tmp_path):
    store = table(spark, tmp_path)
    store.commit(frame(spark, [("a", 0, 1)]), 0)
    with pytest.raises(ValueError):
        store.commit(frame(spark, [("a", 0, 1)]).drop("v"), 1)


def test_lookups_read_their_buckets_only(spark, tmp_path):
    store = table(spark, tmp_path, buckets=16, compact_every=3)
    for number in range(4):
        store.commit(frame(spark, [(f"k{i}", 0, number) for i in range(64)]), number)
    one = store.current_of(frame(spark, [("k5", 0, 0)]))
    assert collect(one) == [("k5", 0, 3)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and BUCKET in line]
    assert filters and all("IN (" in line or f"{BUCKET}" in line.split("PartitionFilters")[1] for line in filters)
