"""Dashboard figures from partial aggregates against the same figures from whole tables."""

from __future__ import annotations

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import ledger, portfolio
from folio.plans import kpi_store
from folio.sources.binding import book


def shown(df):
    return {r.tenant_id: {c: round(float(v), 6) for c, v in r.asDict().items() if c != "tenant_id"} for r in df.collect()}


def anew(spark, paths):
    t = {name: spark.read.parquet(path) for name, path in paths.items()}
    followups = portfolio.pending_followups(t["customer_review_logs"], t["review_outcomes"], t["customers"], 10)
    actions = ledger.pending_actions(ledger.action_state(t["ledger"]), 20)
    summary, mood = portfolio.portfolio_summary(t["customers"]), portfolio.portfolio_sentiment(t["customer_email_logs"], t["support_tickets"])
    return shown(portfolio.portfolio_kpis(summary, mood, portfolio.queue_counts(followups, actions)))


@pytest.fixture
def paths(spark, data_dir, tmp_path):
    """A small book in files of its own, three for each table."""
    b = book(spark, data_dir)
    out = {}
    for name in kpi_store.TABLES:
        out[name] = str(tmp_path / name)
        b[name].repartition(3).write.parquet(out[name])
    return out


def files(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


def test_only_new_files_are_read_and_figures_stay_those_of_whole_tables(spark, paths, tmp_path):
    store = kpi_store.KpiStore(spark, paths, str(tmp_path / "kept"))
    assert len(store.refresh()) == 3 * 3 + 3
    assert shown(store.kpis()) == anew(spark, paths)
    assert store.refresh() == [] and kpi_store.KpiStore(spark, paths, str(tmp_path / "kept")).refresh() == []

    # one more file of accounts: many equal sales, a new tenant, an account without sales
    some = spark.read.parquet(paths["customers"]).limit(40)
    fresh = some.withColumns({"customer_id": F.concat(F.lit("N"), "customer_id"), "tenant_id": F.when(F.col("total_orders") % 2 == 0, "t0").otherwise("new"), "total_sales": F.when(F.col("total_orders") % 3 > 0, 90_000.0)})
    old = files(paths["customers"])
    fresh.coalesce(1).write.mode("append").parquet(paths["customers"])
    added = [f"customers/{f}" for f in files(paths["customers"]) if f not in old]
    assert store.refresh() == sorted([*added, "revenue_top10"])
    got = shown(store.kpis())
    assert got == anew(spark, paths) and "new" in got

    # a file is gone, and another table's file was replaced by a longer one
    os.remove(f"{paths['customers']}/{old[0]}")
    mail = spark.read.parquet(paths["customer_email_logs"])
    extra = mail.withColumn("sentiment_hint", F.lit("angry")).coalesce(1)
    extra.write.parquet(str(tmp_path / "extra"))
    victim = files(paths["customer_email_logs"])[0]
    time.sleep(0.01)
    shutil.copy(f"{tmp_path}/extra/{files(str(tmp_path / 'extra'))[0]}", f"{paths['customer_email_logs']}/{victim}")
    crc = f"{paths['customer_email_logs']}/.{victim}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert store.refresh() == sorted([f"customer_email_logs/{victim}", "revenue_top10"])
    assert shown(store.kpis()) == anew(spark, paths)


def test_a_crash_before_the_parts_are_published_is_made_good(spark, paths, tmp_path, monkeypatch):
    store = kpi_store.KpiStore(spark, paths, str(tmp_path / "kept"))
    with monkeypatch.context() as m:
        m.setattr(store.parts, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.refresh()
    again = kpi_store.KpiStore(spark, paths, str(tmp_path / "kept"))
    assert len(again.refresh()) == 12 and shown(again.kpis()) == anew(spark, paths)


def test_buckets_grow_with_the_value(spark):
    draw = random.Random(3)
    values = sorted([draw.uniform(-1e6, 1e6) for _ in range(500)] + [0.0, -0.0, 1e-300, 1e300, -1e300, 5e-324] + [draw.uniform(0, 3) for _ in range(300)])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", kpi_store.sales_bucket(F.col("v")).alias("b")).collect()
    buckets = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert buckets == sorted(buckets) and len(set(buckets)) > 100


def test_figures_come_from_one_small_scan(spark, paths, tmp_path):
    store = kpi_store.KpiStore(spark, paths, str(tmp_path / "kept"))
    store.refresh()
    plan = store.kpis()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") <= 1 or plan.count("Scan parquet") == 1
    assert "Join" not in plan
