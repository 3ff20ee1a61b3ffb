from __future__ import annotations

import __spark_entry__ as entry_points
from folio.plans import dashboard as plans
from folio.sources.binding import book


def test_entry_points_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship(spark, data_dir):
    df = entry_points.entry(spark)
    assert df.columns[0] == "tenant_id" and df.count() >= 1


def test_bundles(spark, data_dir):
    b = book(spark, data_dir)
    shown = plans.dashboard(b)
    assert {k for k, df in shown.items() if df.count()} >= {"summary", "accounts", "kpis", "tones"}
    panel = plans.account_panel(b, "C7")
    assert panel["profile"].count() == 1 and panel["timeline"].filter("customer_id <> 'C7'").count() == 0
    audit = plans.audit(b.spine(), "1998-01-01")
    assert audit["inventory"].count() == 14
