"""Reloads of changed files only, and repairs from a named state."""

from __future__ import annotations

import os
import time

import pytest

from conftest import collect
from folio.operators import repair
from folio.sources.reload import SpineStore

HEAD = "order_id,customer_id,order_date,shipping_date,delivery_status,order_sales\n"


def write(folder, name, rows, newer=0):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(HEAD + "".join(f"{i},C{i[-1]},2024-01-0{1 + int(i[-1]) % 9},2024-01-20,Shipping on time,{n}\n" for i, n in rows))
    if newer:
        os.utime(path, (time.time() + newer, time.time() + newer))


def folders(path):
    return sorted(os.listdir(f"{path}/data/orders"))


@pytest.fixture
def source(tmp_path):
    folder = str(tmp_path / "source" / "orders.csv")
    for part in range(3):
        write(folder, f"part-{part}.csv", [(f"O{part}{i}", i) for i in range(4)])
    return str(tmp_path / "source")


def test_only_the_changed_file_is_written(spark, source, tmp_path):
    store, kept = SpineStore(spark, str(tmp_path / "store")), str(tmp_path / "store")
    assert store.load(source, "acme", ("orders",)) == [f"acme/orders/part-{p}.csv" for p in range(3)]
    assert store.load(source, "acme", ("orders",)) == [] and store.newest() == 1
    before = folders(kept)

    # a newer time alone, or lines in another order, change nothing
    write(f"{source}/orders.csv", "part-0.csv", [(f"O0{i}", i) for i in (3, 1, 0, 2)], newer=10)
    assert store.load(source, "acme", ("orders",)) == [] and folders(kept) == before

    write(f"{source}/orders.csv", "part-1.csv", [("O10", 7), ("O19", 8)], newer=20)
    old = store.tables(names=("orders",))["orders"]
    assert store.load(source, "acme", ("orders",)) == ["acme/orders/part-1.csv"]
    assert len(folders(kept)) == 4 and set(before) < set(folders(kept))
    now = store.tables(names=("orders",))["orders"]
    assert collect(now, "order_id") == sorted([f"O{p}{i}" for p in (0, 2) for i in range(4)] + ["O10", "O19"])
    assert old.count() == 12  # who began with the old state still reads it

    os.remove(f"{source}/orders.csv/part-2.csv")
    assert store.load(source, "acme", ("orders",)) == ["acme/orders/part-2.csv"]
    assert store.tables(names=("orders",))["orders"].count() == 6


def test_tenants_do_not_touch_each_other(spark, source, tmp_path):
    store = SpineStore(spark, str(tmp_path / "store"))
    store.load(source, "acme", ("orders",))
    store.load(source, "bolt", ("orders", "customers"))
    assert store.load(source, "acme", ("orders",)) == []
    tables = store.tables(names=("orders", "customers"))
    assert sorted(set(collect(tables["orders"], "tenant_id"))) == ["acme", "bolt"] and tables["orders"].count() == 24
    assert tables["customers"].count() == 0


def test_a_repair_run_twice_starts_from_the_named_state(spark, source, tmp_path):
    store = SpineStore(spark, str(tmp_path / "store"))
    store.load(source, "acme", ("orders",))
    assert store.snapshot("before-repair") == 1

    def repaired():
        orders = store.tables_of("before-repair", ("orders", "support_tickets", "fulfillment_events"))
        return collect(repair.rebase_dates(orders, "2026-05-09")["orders"], "order_id", "order_date")

    once = repaired()
    write(f"{source}/orders.csv", "part-1.csv", [("O15", 7)], newer=30)
    store.load(source, "acme", ("orders",))
    assert store.newest() == 2 and store.snapshot("before-repair") == 1
    assert repaired() == once and len(once) == 12


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, source, tmp_path, monkeypatch):
    store = SpineStore(spark, str(tmp_path / "store"))
    store.load(source, "acme", ("orders",))
    write(f"{source}/orders.csv", "part-0.csv", [("O05", 1)], newer=10)
    with monkeypatch.context() as m:
        m.setattr(store.manifests, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.load(source, "acme", ("orders",))
    again = SpineStore(spark, str(tmp_path / "store"))
    assert again.tables(names=("orders",))["orders"].count() == 12
    assert again.load(source, "acme", ("orders",)) == ["acme/orders/part-0.csv"]
    assert again.tables(names=("orders",))["orders"].count() == 9
