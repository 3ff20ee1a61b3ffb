"""Queries that read a table once read it from the source, and shuffle no more than they need."""

from __future__ import annotations

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from folio.catalog.queries import all_queries
from folio.operators import evidence, name_index, quality
from folio.operators.name_index import PART, NameIndex, write_name_index
from folio.sources.binding import book


@pytest.fixture
def fresh(spark, data_dir, tmp_path):
    """A folder whose book holds nothing yet."""
    folder = str(shutil.copytree(data_dir, tmp_path / "tables"))
    return folder, book(spark, folder)


def stored(b):
    return sorted(os.listdir(b.root)) if os.path.isdir(b.root) else []


ONCE = ["table_counts", "audit_columns", "audit_duplicates", "fk_coverage", "scanned_dates", "load_spine", "open_ticket_counts", "validate_proposals", "score_predictions", "evidence_bundle_bucketed"]


@pytest.mark.parametrize("name", ONCE)
def test_tables_read_once_are_not_stored(spark, fresh, name):
    folder, b = fresh
    assert all_queries()[name](spark, folder).count() > 0
    assert stored(b) == []


def test_the_log_stores_what_it_reads_many_times(spark, fresh):
    folder, b = fresh
    assert all_queries()["repair_log"](spark, folder).count() > 0
    assert stored(b) == ["customers", "support_tickets"]


def test_scans_have_the_rows_of_stored_tables(fresh):
    b = fresh[1]
    scans = b.scans()
    for table, df in scans.items():
        assert df.schema.names == b[table].schema.names
        assert df.exceptAll(b[table]).isEmpty() and b[table].exceptAll(df).isEmpty(), table


def test_texts_of_accounts_are_made_after_the_exchanges(fresh):
    plan = fresh[1].scan("order_lines")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("AS customer_id")
    assert "AS customer_full_name" not in plan


def test_duplicates_shuffle_numbers_of_tables(spark):
    ids = spark.createDataFrame([("t", "O1"), ("t", "O1"), ("u", "O1"), ("t", None), ("t", None), (None, "O1")], "tenant_id string, order_id string")
    out = quality.audit_duplicates({"orders": ids, "support_tickets": ids.withColumnRenamed("order_id", "ticket_id")})
    assert {tuple(r) for r in out.collect()} == {("orders", "order_id", 2), ("support_tickets", "ticket_id", 2)}
    assert "hashpartitioning(table_name" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_needles_meet_few_accounts(spark, tmp_path):
    people = spark.range(3000).selectExpr("'t' as tenant_id", "concat('C', id) as customer_id", "'Mary Smith' as customer_full_name", "format_string('customer#%09d@example.com', id) as customer_email", "1.0D as risk_score")
    write_name_index(people, str(tmp_path))
    index = NameIndex(spark, str(tmp_path))
    needles = people.selectExpr("tenant_id", "split(customer_email, '@')[0] as needle")
    grams = index.rarest_grams(needles)
    assert index.postings.drop(PART).join(grams, ["tenant_id", "gram"]).count() <= 2 * 3000
    assert index.find_containing(needles).count() == 3000


@pytest.mark.parametrize("text, email, phone", [("a@b.org", 1, 0), ("a@b", 0, 0), ("call 555-123-4567", 0, 1), ("555-123-4567", 0, 1), ("555-123-456", 0, 0), (None, 0, 0)])
def test_patterns_are_found_in_short_cells_too(spark, text, email, phone):
    out = quality.audit_pii_patterns({"notes": spark.createDataFrame([(text,)], "note string")}).first()
    assert (out.email_cells, out.phone_cells) == (email, phone)


def test_feeds_join_the_rows_of_asked_accounts_only(fresh):
    b = fresh[1]
    scans = b.scans(*evidence.BUNDLE_FEEDS)
    asked = b.scan("customer_review_logs").select("tenant_id", "customer_id").limit(5)
    plan = evidence.record_ids(scans, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi, (concat(C, ") == len(scans)
    ids = asked.select("customer_id").distinct().localCheckpoint()
    for table, df in scans.items():
        some, same = b.scan_of(table, ids), df.join(ids, "customer_id", "left_semi").select(df.columns)
        assert some.schema == df.schema and some.exceptAll(same).isEmpty() and same.exceptAll(some).isEmpty(), table


def test_a_larger_index_is_sorted_by_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(name_index, "TASK_ROWS", 2000, raising=False)
    people = spark.range(1500).selectExpr("'t' as tenant_id", "concat('C', id) as customer_id", "'Mary Smith' as customer_full_name", "format_string('customer#%09d@example.com', id) as customer_email", "1.0D as risk_score")
    write_name_index(people, str(tmp_path))
    index = NameIndex(spark, str(tmp_path))
    of_file = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert sum(of_file) > 100_000 and max(of_file) < 10_000
    assert index.counts.agg(F.sum("rows")).first()[0] == sum(of_file)
    assert index.counts.count() == index.counts.select("tenant_id", "gram").distinct().count()


def test_accounts_are_cut_before_they_join_feeds(spark, fresh):
    b = fresh[1]
    ids = spark.createDataFrame([("C1",), ("C2",)], "customer_id string").localCheckpoint()
    for table in evidence.BUNDLE_FEEDS:
        plan = b.scan_of(table, ids)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Join LeftSemi, .*concat\(C, cast\((_k|c_custkey)#", plan), table


def test_accounts_are_not_shuffled_for_few_labels(spark, tmp_path):
    """Documents (repeated and missing ones too) too large to broadcast: the labels are, to the accounts."""
    tables = {
        "nation": spark.sql("select 0 n_nationkey, 'A' n_name, 1 n_regionkey"),
        "customer": spark.range(20000).selectExpr("id c_custkey", "0 c_nationkey", "'x' c_name", "0.0D c_acctbal", "'s' c_mktsegment"),
        "documents": spark.range(40000).selectExpr("id % 39999 doc_id", "id n_chars"),
        "labels": spark.createDataFrame([(0, 1, 0), (0, 0, 0), (5, 1, 0), (39999, 1, 0), (None, 1, 0), (90000, 1, 0)], "doc_id bigint, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        out = book(spark, str(tmp_path)).scan("predictions")
        rows = sorted((r.tenant_id, r.review_id) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [("t1", "R0")] * 4 + [("t1", "R5")]
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\((_?k|c_custkey)#", plan)
