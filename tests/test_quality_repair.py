from __future__ import annotations

import datetime as dt

import pytest

from conftest import collect
from folio.operators import quality, repair
from folio.schemas import conform
from pyspark.sql import functions as F


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def test_coverage_counts_unknown_and_covered_accounts(spark):
    who = frame(spark, [("t", "C1"), ("t", "C2"), ("t", "C3"), ("t", "C4")], "tenant_id customer_id")
    child = frame(spark, [("t", "C1"), ("t", "C1"), ("t", "C9"), ("t", None), ("u", "C2")], "tenant_id customer_id")
    row = quality.fk_coverage({"orders": child}, who).collect()[0]
    assert (row.named_ids, row.unknown_ids, row.covered, row.coverage) == (3, 2, 1, 0.25)


def test_dates_of_text_columns(spark):
    df = frame(spark, [("t", "2024-01-05"), ("t", "2031-01-01"), ("t", "soon"), ("t", None)], "tenant_id order_date")
    row = quality.audit_dates({"orders": df}, "2026-05-09").collect()[0]
    assert (row.first_day, row.last_day, row.future_rows, row.null_rows) == (dt.date(2024, 1, 5), dt.date(2031, 1, 1), 1, 2)


def test_duplicates_count_rows_beyond_the_first(spark):
    df = frame(spark, [("t", "O1"), ("t", "O1"), ("t", "O1"), ("t", "O2"), ("t", None), ("t", None), ("u", "O1")], "tenant_id order_id")
    assert collect(quality.audit_duplicates({"orders": df}), "table_name", "duplicates") == [("orders", 3)]


def test_references_are_split_and_resolved(spark):
    notes = frame(spark, [("t", "O1; T9;;X"), ("t", " "), ("t", None), ("t", "O1"), ("u", "O1")], "tenant_id source_signal_ids")
    orders = frame(spark, [("t", "O1")], "tenant_id order_id")
    tickets = frame(spark, [("t", "T9"), ("t", None)], "tenant_id ticket_id")
    row = quality.ref_resolution({"notes": notes}, tickets, orders).collect()[0]
    assert (row.rows, row.rows_with_refs, row.refs, row.resolved, row.resolved_share) == (5, 3, 5, 3, 0.6)
    none = quality.ref_resolution({"notes": notes.filter("source_signal_ids is null")}, tickets, orders).collect()[0]
    assert (none.refs, none.resolved, none.resolved_share) == (0, 0, 0.0)


def test_inventory_patterns_and_counts(spark):
    df = frame(spark, [("t", "True", "mail a.b@c.io"), ("t", "false", "call (555) 123-4567"), ("t", None, None)], "tenant_id synthetic_flag body")
    row = quality.audit_inventory({"emails": df}).collect()[0]
    assert (row.rows, row.columns) == (3, 2) and row.synthetic_share == pytest.approx(1 / 3)
    got = {r.column_name: (r.email_cells, r.phone_cells) for r in quality.audit_pii_patterns({"emails": df}).collect()}
    assert got["body"] == (1, 1) and got["synthetic_flag"] == (0, 0)
    assert collect(quality.value_counts(df, "synthetic_flag"), "value", "rows") == [("True", 1), ("false", 1)]


ORDER_COLUMNS = "tenant_id customer_id order_id order_date shipping_date"


def test_rebase_moves_every_tenant_by_its_own_shift(spark):
    tables = {
        "orders": conform(frame(spark, [("t", "C", "O1", "2017-01-01", "2017-01-03"), ("t", "C", "O2", "2017-01-11", None), ("u", "C", "O1", "2020-01-01", None)], ORDER_COLUMNS), "orders"),
        "fulfillment_events": conform(frame(spark, [("t", "C", "F1", "2017-01-05")], "tenant_id customer_id fulfillment_event_id event_date"), "fulfillment_events"),
        "support_tickets": conform(frame(spark, [("t", "C", "T1", "2021-01-01")], "tenant_id customer_id ticket_id date_of_purchase"), "support_tickets"),
    }
    moved = repair.rebase_dates(tables, "2026-05-09")
    assert collect(moved["orders"], "tenant_id", "order_id", "order_date", "shipping_date") == [
        ("t", "O1", dt.date(2026, 3, 30), dt.date(2026, 4, 1)), ("t", "O2", dt.date(2026, 4, 9), None), ("u", "O1", dt.date(2026, 4, 9), None)]
    assert collect(moved["fulfillment_events"], "event_date") == [dt.date(2026, 4, 3)]
    assert collect(moved["support_tickets"], "date_of_purchase") == [dt.date(2026, 5, 2)]


def test_outcomes_are_redrawn_after_their_review(spark):
    n = 2000
    outcomes = spark.range(n).select(F.lit("t").alias("tenant_id"), F.format_string("U%d", "id").alias("outcome_id"), F.format_string("R%d", "id").alias("review_id"),
                                     F.lit("C").alias("customer_id"), F.lit(None).cast("date").alias("outcome_date"), F.lit("Completed").alias("outcome_status"), F.lit(False).alias("follow_up_required"))
    reviews = spark.range(n - 10).select(F.lit("t").alias("tenant_id"), F.format_string("R%d", "id").alias("review_id"),
                                         F.when(F.col("id") % 50 == 0, F.lit("2026-05-08")).otherwise(F.lit("2026-04-01")).cast("timestamp_ntz").alias("reviewed_at"))
    rows = repair.rebase_outcomes(outcomes, reviews, "2026-05-09").collect()
    pending = [r for r in rows if r.outcome_status == "Pending"]
    assert 0.16 < len(pending) / n < 0.24 and all(r.outcome_date is None and r.follow_up_required for r in pending)
    for r in rows:
        i = int(r.review_id[1:])
        if r.outcome_status != "Pending":
            if i >= n - 10:
                assert r.outcome_date is None
            elif i % 50 == 0:
                assert r.outcome_date == dt.date(2026, 5, 9)
            else:
                assert dt.date(2026, 4, 2) <= r.outcome_date <= dt.date(2026, 5, 8)
    again = repair.rebase_outcomes(outcomes.repartition(7), reviews.repartition(3), "2026-05-09")
    assert sorted(again.collect()) == sorted(rows)


EMAIL_COLUMNS = "tenant_id customer_id scenario topic email_id source_signal_ids"
NOTE_COLUMNS = "tenant_id customer_id scenario topic source_signal_ids"


def test_lineage_fills_or_overwrites(spark):
    notes = frame(spark, [("t", "C", "s", "x", "T2;O1;"), ("t", "C", "s", "x", "O1;; A"), ("t", "C", None, "x", "Z"), ("u", "C", "s", "x", "Q")], NOTE_COLUMNS)
    emails = frame(spark, [("t", "C", "s", "x", "E1", None), ("t", "C", "s", "x", "E2", "own"), ("t", "C", None, "x", "E3", None), ("t", "D", "s", "x", "E4", "own")], EMAIL_COLUMNS)
    kept = dict((a, b) for a, b in collect(repair.backfill_lineage(emails, notes), "email_id", "source_signal_ids"))
    assert kept == {"E1": " A;O1;T2", "E2": "own", "E3": "", "E4": "own"}
    over = dict((a, b) for a, b in collect(repair.backfill_lineage(emails, notes, overwrite=True), "email_id", "source_signal_ids"))
    assert over == {"E1": " A;O1;T2", "E2": " A;O1;T2", "E3": "", "E4": ""}


def test_a_group_of_thousands_of_references_keeps_all(spark):
    notes = spark.range(4000).selectExpr("'t' tenant_id", "'C' customer_id", "'s' scenario", "'x' topic", "concat('O', id % 3500) source_signal_ids")
    emails = frame(spark, [("t", "C", "s", "x", "E1", None), ("t", "C", "s", "x", "E2", "O9")], EMAIL_COLUMNS)
    for row in repair.backfill_lineage(emails, notes, overwrite=True).collect():
        refs = row.source_signal_ids.split(";")
        assert row.ref_count == 3500 and refs == sorted(f"O{i}" for i in range(3500))
    assert repair.email_refs(emails, notes).count() == 7000


def test_dates_of_a_tenant_without_orders_stay(spark):
    orders = conform(frame(spark, [("a", "C", "O1", "2020-01-01")], "tenant_id customer_id order_id order_date"), "orders")
    events = conform(frame(spark, [("a", "C", "F1", "2020-01-02"), ("b", "C", "F2", "2020-01-03")], "tenant_id customer_id fulfillment_event_id event_date"), "fulfillment_events")
    tickets = conform(frame(spark, [("b", "C", "T1", None)], "tenant_id customer_id ticket_id date_of_purchase"), "support_tickets")
    moved = repair.rebase_dates({"orders": orders, "fulfillment_events": events, "support_tickets": tickets}, "2026-05-09")
    days = dict(collect(moved["fulfillment_events"], "fulfillment_event_id", "event_date"))
    assert str(days["F2"])[:10] == "2020-01-03" and str(days["F1"])[:10] == "2026-04-10"


def test_tickets_of_a_tenant_without_accounts_stay(spark):
    who = spark.createDataFrame([("a", "C1", "N", 1, 1.0, "High")], "tenant_id string, customer_id string, customer_full_name string, source_customer_id bigint, risk_score double, risk_band string")
    raw = spark.createDataFrame([(t, "X", f"{t}{i}", "Low") for t in "ab" for i in range(3)], "tenant_id string, customer_id string, ticket_id string, ticket_priority string")
    out = dict(collect(repair.spread_tickets(who, conform(raw, "support_tickets")), "ticket_id", "customer_id"))
    assert out == {**{f"a{i}": "C1" for i in range(3)}, **{f"b{i}": "X" for i in range(3)}}


def test_volume_follows_the_band(spark):
    notes = spark.range(4 * 40).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("C"), (F.col("id") % 4).cast("string")).alias("customer_id"), F.format_string("N%03d", "id").alias("note_id"))
    who = frame(spark, [("t", "C0", "Critical"), ("t", "C1", "Moderate"), ("t", "C2", None)], "tenant_id customer_id risk_band")  # C3 is unknown
    sizes = dict(collect(repair.sample_by_band(notes, "note_id", who, 1, 12).groupBy("customer_id").count()))
    assert 8 <= sizes["C0"] <= 12 and 4 <= sizes["C1"] <= 8 and 1 <= sizes["C2"] <= 4 and 1 <= sizes["C3"] <= 4
    few = notes.filter("id < 4")
    assert repair.sample_by_band(few, "note_id", who, 1, 12).count() == 4


@pytest.mark.parametrize("accounts,tickets", [(1, 5), (37, 200), (300, 90), (50, 0)])
def test_every_ticket_is_handed_out_once_and_urgent_ones_to_risky_accounts(spark, accounts, tickets):
    bands = ["Critical", "High", "Moderate", "Low", None]
    who = spark.createDataFrame([("t", f"C{i:03d}", f"N{i}", i, float(100 - i // 3) if i % 11 else None, bands[i * 5 // accounts]) for i in range(accounts)],
                                "tenant_id string, customer_id string, customer_full_name string, source_customer_id bigint, risk_score double, risk_band string")
    words = ["Low", "Critical", "Odd", "High", None]
    raw = spark.createDataFrame([("t", "X", f"T{i}", words[i % 5]) for i in range(tickets)], "tenant_id string, customer_id string, ticket_id string, ticket_priority string")
    given = conform(raw, "support_tickets")
    out = repair.spread_tickets(who, given.repartition(5)).collect()
    assert sorted(r.ticket_id for r in out) == sorted(f"T{i}" for i in range(tickets))
    place = {r.customer_id: i for i, r in enumerate(sorted(who.collect(), key=lambda r: (r.risk_score is None, -(r.risk_score or 0), r.customer_id)))}
    rank = {"Critical": 0, "High": 1, "Low": 3}
    by_place = sorted(out, key=lambda r: place[r.customer_id])
    ranks = [rank.get(r.ticket_priority, 2) for r in by_place]
    last = -1
    for p in sorted({place[r.customer_id] for r in out}):
        mine = [rank.get(r.ticket_priority, 2) for r in out if place[r.customer_id] == p]
        assert min(mine) >= last
        last = max(mine)
    assert len(ranks) == tickets
    again = repair.spread_tickets(who.repartition(3), given).collect()
    assert sorted((r.ticket_id, r.customer_id) for r in again) == sorted((r.ticket_id, r.customer_id) for r in out)


def test_tenants_without_any_target_share_evenly(spark):
    from folio.functions.columns import seeded_int

    ids = spark.range(400).select(F.format_string("C%d", "id").alias("customer_id"))
    idle = [r[0] for r in ids.filter(seeded_int(42, "tickets", F.col("customer_id")) % 10 != 9).limit(6).collect()]
    who = spark.createDataFrame([("t", c, c, 1, 1.0, "Low") for c in idle], "tenant_id string, customer_id string, customer_full_name string, source_customer_id bigint, risk_score double, risk_band string")
    tickets = conform(spark.createDataFrame([("t", "X", f"T{i}", "Low") for i in range(12)], "tenant_id string, customer_id string, ticket_id string, ticket_priority string"), "support_tickets")
    assert {n for _, n in collect(repair.spread_tickets(who, tickets).groupBy("customer_id").count())} == {2}


def test_bridge_keeps_its_column_order_and_blanks(spark):
    tickets = conform(spark.createDataFrame([("t", "C1", "T17", 9)], "tenant_id string, customer_id string, ticket_id string, source_customer_id bigint"), "support_tickets")
    bridge = spark.createDataFrame([], "ticket_id string, extra string, source_ticket_id bigint, mapping_method string")
    out = repair.rebuild_bridge(repair.drop_broken_columns(tickets.withColumn("first_response_time", F.lit("x"))), bridge)
    assert out.columns == bridge.columns and out.collect()[0][:3] == ("T17", "", 17)


def test_one_scan_gives_what_the_single_audits_give(spark, data_dir):
    from folio.sources.binding import book

    b = book(spark, data_dir)
    tables = {t: b[t] for t in ("customers", "customer_notes", "customer_email_logs", "customer_contacts", "support_tickets", "customer_review_logs")}
    tables["orders"] = b["orders"].limit(0)  # no rows, and yet columns
    plain = tables["support_tickets"].withColumn("first_response_time", F.when(F.col("ticket_id") > "T5", "soon").otherwise("2024-01-02 10:00:00"))
    tables["support_tickets"] = plain
    scan = quality.audit_scan(tables, "2024-01-01")
    for got, want in (
        (quality.scanned_inventory(scan), quality.audit_inventory(tables)), (quality.scanned_dates(scan), quality.audit_dates(tables, "2024-01-01")),
        (quality.scanned_columns(scan), quality.audit_columns(tables)), (quality.scanned_patterns(scan), quality.audit_pii_patterns(tables)),
        (quality.scanned_value_counts(scan, "customer_notes", 2), quality.value_counts(tables["customer_notes"], "scenario", 2)),
    ):
        assert collect(got, *sorted(got.columns)) == collect(want, *sorted(got.columns))


def test_the_scan_reads_each_table_once(spark, data_dir, monkeypatch):
    from folio.sources.binding import book

    b = book(spark, data_dir)
    tables = {t: b[t] for t in ("orders", "customer_notes")}
    plans = []
    monkeypatch.setattr(quality, "settle", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    quality.audit_scan(tables, "2024-01-01")
    assert plans[0].split("== Initial Plan")[0].count("FileScan parquet") == 2


ODD_IDS = ["C01", "C1", "c1", "C", "", None, "C-1", "12", "C99999999999999999999", "C999999999999999999", "é7", "C7x", "0", "00", "C0"]


def test_distinct_counts_by_bitmaps_are_those_by_ids(spark):
    book = [(t, f"C{i}") for t in "tu" for i in range(400 if t == "t" else 40_000, 41_000 if t == "u" else 1200)] + [("t", i) for i in ODD_IDS[:9]] + [(None, "C1"), ("t", "C401")]
    child = [("t", f"C{i}") for i in range(0, 3000, 3)] * 2 + [("u", f"C{i}") for i in range(39_000, 42_000, 7)] + [("t", i) for i in ODD_IDS] * 2 + [("w", "C5"), (None, "C1")]
    customers = spark.createDataFrame(book, "tenant_id string, customer_id string")
    children = {"orders": spark.createDataFrame(child, "tenant_id string, customer_id string"), "notes": customers.limit(5), "none": customers.limit(0)}
    got, want = quality.fk_coverage_bitmaps(children, customers), quality.fk_coverage(children, customers)
    assert collect(got, *want.columns) == collect(want)
    tables = {"customers": customers, "orders": children["orders"].withColumnRenamed("customer_id", "order_id")}
    got, want = quality.audit_duplicates_bitmaps(tables), quality.audit_duplicates(tables)
    assert collect(got, *want.columns) == collect(want)


def test_bitmaps_are_shuffled_in_place_of_dense_ids(spark):
    rows = spark.range(100_000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("O"), (F.col("id") % 60_000).cast("string")).alias("order_id"))
    df = quality.audit_duplicates_bitmaps({"orders": rows})
    assert collect(df, "duplicates") == [40_000]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "partial_bitmap_construct_agg" in plan.replace(" ", "")
