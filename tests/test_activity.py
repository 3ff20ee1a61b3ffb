from __future__ import annotations

import datetime as dt

from conftest import collect
from folio.operators import activity
from folio.schemas import conform
from pyspark.sql import functions as F


def feed(spark, table, rows, columns):
    typed = ", ".join(f"{c} string" for c in columns.split())
    return conform(spark.createDataFrame(rows, typed), table)


def test_recent_breaks_ties_by_key_and_puts_undated_rows_last(spark):
    df = feed(spark, "orders", [("t", "C", "O2", "2024-01-01"), ("t", "C", "O1", "2024-01-01"), ("t", "C", "O3", None), ("u", "C", "O9", "2020-01-01")],
              "tenant_id customer_id order_id order_date")
    got = [(r.tenant_id, r.rank, r.order_id) for r in activity.recent(df, "orders", 3).orderBy("tenant_id", "rank").collect()]
    assert got == [("t", 1, "O1"), ("t", 2, "O2"), ("t", 3, "O3"), ("u", 1, "O9")]


def test_emails_of_one_day_come_in_message_order(spark):
    df = feed(spark, "customer_email_logs", [("t", "C", f"E{i}", "TH", "2024-01-01", str(i)) for i in range(12)] + [("t", "C", "E99", "TH", "2024-01-01", None)],
              "tenant_id customer_id email_id thread_id date message_sequence")
    assert [r.email_id for r in activity.recent(df, "customer_email_logs", 2).orderBy("rank").collect()] == ["E11", "E10"]
    assert [r.email_id for r in activity.thread(df, "TH").collect()][-2:] == ["E11", "E99"]


def test_counts_cover_accounts_without_rows(spark):
    who = spark.createDataFrame([("t", "A"), ("t", "B")], "tenant_id string, customer_id string")
    tickets = feed(spark, "support_tickets", [("t", "A", "T1", "Open"), ("t", "A", "T2", None), ("t", "A", "T3", "closed - done"), ("u", "A", "T4", "Open")],
                   "tenant_id customer_id ticket_id ticket_status")
    assert collect(activity.open_ticket_counts(tickets, who)) == [("t", "A", 1), ("t", "B", 0)]
    events = feed(spark, "fulfillment_events", [("t", "A", "F1", "Open"), ("t", "A", "F2", "Unresolved"), ("t", "A", "F3", None)],
                  "tenant_id customer_id fulfillment_event_id resolution_status")
    assert collect(activity.unresolved_counts(events, who)) == [("t", "A", 1), ("t", "B", 0)]
    assert collect(activity.activity_counts(who, {"support_tickets": tickets})) == [("t", "A", 3), ("t", "B", 0)]


def test_timeline_merges_feeds_newest_first(spark):
    feeds = {
        "orders": feed(spark, "orders", [("t", "C", "O1", "2024-01-02", "Late delivery", "0", "1500"), ("t", "C", "O2", None, "x", "1", "1")],
                       "tenant_id customer_id order_id order_date delivery_status late_delivery_risk order_sales"),
        "support_tickets": feed(spark, "support_tickets", [("t", "C", "T1", "2024-01-03", "Critical", "Open", "Billing"), ("t", "C", "T2", "2024-01-01", "Low", "Closed", None)],
                                "tenant_id customer_id ticket_id date_of_purchase ticket_priority ticket_status ticket_type"),
        "customer_notes": feed(spark, "customer_notes", [("t", "C", "N1", "2024-01-02", "a", "b")], "tenant_id customer_id note_id note_date scenario topic"),
        "customer_email_logs": feed(spark, "customer_email_logs", [("t", "C", "E1", "2024-01-05", "Customer", "Frustrated")],
                                    "tenant_id customer_id email_id date direction sentiment_hint"),
        "customer_review_logs": feed(spark, "customer_review_logs", [("t", "C", "R1", "2024-01-04 10:00:00", "Escalate", "s")],
                                     "tenant_id customer_id review_id reviewed_at human_decision scenario"),
    }
    rows = activity.timeline(feeds).collect()
    assert [r.id for r in rows] == ["e:E1", "r:R1", "t:T1", "n:N1", "o:O1", "t:T2"]
    by = {r.id: r for r in rows}
    assert (by["o:O1"].subtitle, by["o:O1"].badge, by["o:O1"].tone) == ("Late delivery · $1.5k", "Late", "warn")
    assert (by["t:T1"].title, by["t:T1"].badge, by["t:T1"].tone) == ("Billing", "Critical · Open", "critical")
    assert (by["t:T2"].title, by["t:T2"].subtitle, by["t:T2"].badge, by["t:T2"].tone) == ("Support ticket", "Low · Closed · ", None, "neutral")
    assert (by["n:N1"].title, by["n:N1"].subtitle) == ("Internal note", "a · b")
    assert (by["e:E1"].title, by["e:E1"].subtitle, by["e:E1"].tone) == ("Email", "customer · Frustrated", "warn")
    assert (by["r:R1"].title, by["r:R1"].tone, by["r:R1"].date) == ("Reviewed by —", "critical", dt.date(2024, 1, 4))
    short = activity.timeline(feeds, {"support_tickets": 1, "orders": 1})
    assert collect(short.filter("kind = 'ticket'"), "id") == ["t:T1"]
    assert collect(activity.timeline(feeds, 1).filter("kind = 'ticket'"), "id") == ["t:T1"]


def test_last_dates_stay_in_their_tenant(spark):
    who = spark.createDataFrame([("t", "C", "n"), ("u", "C", "n")], "tenant_id string, customer_id string, customer_full_name string")
    empty = {f: feed(spark, f, [], "tenant_id") for f in activity.LAST_DATES}
    empty["orders"] = feed(spark, "orders", [("t", "C", "O1", "2024-01-01"), ("t", "C", "O2", "2024-02-01"), ("u", "C", "O3", "2030-01-01")],
                           "tenant_id customer_id order_id order_date")
    got = dict(collect(activity.recent_activity(who, empty), "tenant_id", "last_order_at"))
    assert got == {"t": dt.date(2024, 2, 1), "u": dt.date(2030, 1, 1)}


def test_history_is_the_newest_messages_oldest_first(spark):
    df = spark.range(30).select(F.lit("S").alias("session_id"), F.format_string("M%02d", "id").alias("message_id"),
                                F.expr("timestampadd(minute, cast(id as int), timestamp_ntz '2024-01-01 00:00:00')").alias("created_at"))
    assert [r.message_id for r in activity.recent_history(df, 3).collect()] == ["M27", "M28", "M29"]
