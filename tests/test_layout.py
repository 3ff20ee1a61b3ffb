"""Stored layouts: Bloom filters on record ids, and buckets by account."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import collect
from folio.operators import evidence
from folio.sources.binding import book
from folio.sources.bucketed import read_bucketed, write_bucketed
from folio.sources.spine import write_table

FEEDS = ("customers", "orders", "support_tickets", "customer_notes", "customer_email_logs", "fulfillment_events", "customer_review_logs")


def rows_scanned(df):
    """Rows that the scan handed on before any filter of Spark's own."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, total = [plan], 0
    while nodes:
        node = nodes.pop()
        if hasattr(node, "executedPlan") and node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def tables(spark, data_dir):
    b = book(spark, data_dir)
    return {t: b[t] for t in FEEDS}


def test_a_ticket_is_found_without_reading_all_row_groups(spark, tmp_path):
    path = str(tmp_path / "tickets")
    ids = F.concat(F.lit("T"), F.xxhash64("id").cast("string"))
    df = spark.range(20_000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("C"), (F.col("id") % 50).cast("string")).alias("customer_id"), ids.alias("ticket_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(df, path, "support_tickets")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == 8
    some = df.select("ticket_id").first().ticket_id
    hit = stored.filter(stored.ticket_id == some)
    assert collect(hit, "ticket_id") == [some]
    # every file's ids span the same range: only the filters tell
    assert 0 < rows_scanned(hit) <= 20_000 / 4
    assert rows_scanned(stored.filter(stored.ticket_id == "T5x")) <= 20_000 / 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bundles_of_bucketed_feeds_need_no_exchange(spark, tables, tmp_path):
    folder = str(tmp_path / "buckets")
    write_bucketed(tables, folder, buckets=4)
    stored = read_bucketed(spark, folder, FEEDS)
    for name, df in stored.items():
        assert collect(df) == collect(tables[name].select(*df.columns)), name
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed, plain = evidence.evidence_bundle(stored), evidence.evidence_bundle(tables)
        assert exchanges(bucketed) == 0 < exchanges(plain)
        assert sorted(bucketed.toJSON().collect()) == sorted(plain.toJSON().collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_another_session_knows_the_buckets(spark, tables, tmp_path):
    folder = str(tmp_path / "buckets")
    write_bucketed({"orders": tables["orders"]}, folder, buckets=4)
    for t in [t.name for t in spark.catalog.listTables() if t.name.endswith("_orders") and t.name.startswith("folio_")]:
        # only the name is forgotten: the files are the folder's own
        spark.sql(f"drop table {t}")
    again = read_bucketed(spark, folder, ("orders",))["orders"]
    counted = again.groupBy("tenant_id", "customer_id").count()
    assert exchanges(counted) == 0 and counted.count() == tables["orders"].select("tenant_id", "customer_id").distinct().count()
