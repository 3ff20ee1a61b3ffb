from __future__ import annotations

import random

import pytest

from conftest import collect
from folio.functions import columns as fx
from folio.operators import portfolio
from pyspark.sql import functions as F

COLUMNS = (
    "tenant_id string, customer_id string, total_sales double, total_profit double, risk_score double, risk_band string, "
    "health_score double, late_delivery_rate double, churn_risk_reason string, open_support_ticket_count int"
)


def accounts_of(spark, sizes: dict[str, int], seed: int = 1, ties: bool = False):
    rng = random.Random(seed)
    rows = []
    for tenant, n in sizes.items():
        for i in range(n):
            sales = rng.choice([None, 0.0, 5.0]) if ties else rng.choice([None, float(rng.randrange(100000)) / 4])
            rows.append((tenant, f"{tenant}-{i}", sales, 1.0, float(i), "High", 10.0, 0.5, " ", 1))
    return rows, spark.createDataFrame(rows, COLUMNS).repartition(7)


def first_tile(values: list) -> float:
    """Revenue of tile 1 of ten, extra rows going to the first tiles."""
    ordered = sorted((v or 0.0 for v in values), reverse=True)
    return sum(ordered[: len(ordered) // 10 + (1 if len(ordered) % 10 else 0)])


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("small_tenant,margin", [(100_000, 5.0), (0, 500.0)])
def test_top_decile_is_exact_for_every_size(spark, ties, small_tenant, margin):
    sizes = {f"t{n}": n for n in (1, 3, 9, 10, 11, 23, 100, 777)}
    if small_tenant == 0:  # the bracket is promised for large tenants
        sizes = {f"t{n}": n for n in (100, 777, 2000)}
    rows, df = accounts_of(spark, sizes, ties=ties)
    got = dict(collect(portfolio.top_decile_revenue(df, small_tenant, margin)))
    want = {t: first_tile([r[2] for r in rows if r[0] == t]) for t in sizes}
    assert got == pytest.approx(want)


def test_top_decile_fails_rather_than_answer_wrong(spark):
    _, df = accounts_of(spark, {"t": 100})
    with pytest.raises(Exception, match="outside its bracket"):
        portfolio.top_decile_revenue(df, small_tenant=0, margin=-500.0).collect()  # a bracket above the cut


def test_summary_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert portfolio.portfolio_summary(empty).collect() == []
    one = spark.createDataFrame([("t", "C1", None, None, None, None, None, None, None, None)], COLUMNS)
    row = portfolio.portfolio_summary(one).collect()[0].asDict()
    assert row.pop("tenant_id") == "t" and row.pop("total_customers") == 1 and row.pop("other_count") == 1
    assert set(row.values()) == {0}
    view = portfolio.v_portfolio_summary(one).collect()[0]
    assert view.avg_risk_score is None and view.total_revenue is None


def test_a_band_of_two_words_counts_in_both(spark):
    rows = [("t", f"C{i}", 10.0, 1.0, 1.0, band, 1.0, 0.0, reason, None) for i, (band, reason) in enumerate(
        [("critical-high", "x"), ("Medium", " "), ("ELEVATED", ""), ("Low", None)])]
    row = portfolio.portfolio_summary(spark.createDataFrame(rows, COLUMNS)).collect()[0]
    assert (row.critical_count, row.high_count, row.moderate_count, row.low_count, row.other_count) == (1, 1, 1, 1, 1)
    assert (row.churn_flag_count, row.revenue_at_risk) == (1, 10.0)


def test_sentiment_tests_positive_words_first_unless_strict(spark):
    words = ["Dissatisfied", "Unresolved", "good", "Good ", "URGENT", "meh", "Unhappy"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    plain = dict(collect(df.select("s", fx.sentiment_bucket(F.col("s")).alias("b"))))
    assert plain == {"Dissatisfied": "positive", "Unresolved": "positive", "good": "positive", "Good ": "neutral", "URGENT": "negative", "meh": "neutral", "Unhappy": "positive"}
    strict = dict(collect(df.select("s", fx.sentiment_bucket(F.col("s"), strict=True).alias("b"))))
    assert strict["Dissatisfied"] == "negative" and strict["Unresolved"] == "positive"


def test_net_sentiment_rounds_ties_to_even_and_handles_silence(spark):
    emails = spark.createDataFrame(
        [("t", "A", "positive")] * 9 + [("t", "A", "negative")] * 8 + [("t", "A", "x")] * 183 + [("t", "B", None)],
        "tenant_id string, customer_id string, sentiment_hint string")
    tickets = spark.createDataFrame([], "tenant_id string, customer_id string, customer_sentiment string")
    who = spark.createDataFrame([("t", "A"), ("t", "B"), ("t", "C")], "tenant_id string, customer_id string")
    got = {r.customer_id: (r.total, r.net) for r in portfolio.customer_sentiment(emails, tickets, who).collect()}
    assert got == {"A": (200, 0), "B": (0, 0), "C": (0, 0)}  # 0.5 percent rounds to 0


def test_lanes_and_labels(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (0, 0.51, 1.0), (None, 0.5, 29.0), (None, None, None)], "o int, l double, h double")
    got = [r[0] for r in df.select(fx.lane(F.col("o"), F.col("l"), F.col("h"))).collect()]
    assert got == ["open_tickets", "late_deliveries", "health_concerns", "watch_list"]
    days = spark.createDataFrame([("2024-01-10", 10)], "as_of string, x int")
    for day, label in (("2024-01-13", "in 3d"), ("2024-01-10", "today"), ("2024-01-09", "yesterday"), ("2023-12-13", "28d ago"),
                       ("2023-11-26", "2mo ago"), ("2022-01-10", "2y ago"), (None, "—")):
        assert days.select(fx.recency_label(F.lit(day).cast("date"), F.col("as_of").cast("date"))).collect()[0][0] == label
    money = spark.createDataFrame([(None,), (999.4,), (1250.0,), (1_250_000.0,), (-4321.0,)], "m double")
    assert [r[0] for r in money.select(fx.money_label(F.col("m"))).collect()] == ["—", "$999", "$1.3k", "$1.3M", "$-4.3k"]


def test_followups_keep_reviews_without_outcome_and_join_within_the_tenant(spark):
    reviews = spark.createDataFrame(
        [("t1", "C1", "R1"), ("t1", "C1", "R2"), ("t1", "C2", "R3"), ("t2", "C1", "R1"), ("t1", "C9", "R4")], "tenant_id string, customer_id string, review_id string"
    ).selectExpr("*", "'n' customer_full_name", "'' scenario", "'' topic", "timestamp_ntz '2024-01-01 00:00:00' reviewed_at", "'Monitor' human_decision")
    outcomes = spark.createDataFrame(
        [("t1", "R1", "U1", "Completed", False), ("t1", "R2", "U2", "Pending", False), ("t1", "R3", "U3", "Completed", True), ("t1", "R3", "U4", "Completed", True)],
        "tenant_id string, review_id string, outcome_id string, outcome_status string, follow_up_required boolean").selectExpr("*", "date '2024-01-02' outcome_date")
    customers = spark.createDataFrame(
        [("t1", "C1", 10.0), ("t1", "C2", 20.0), ("t2", "C1", 99.0)], "tenant_id string, customer_id string, risk_score double").selectExpr("*", "'High' risk_band", "'Call' next_best_action")
    got = [(r.tenant_id, r.rank, r.review_id, r.risk_score) for r in portfolio.pending_followups(reviews, outcomes, customers, 12).orderBy("tenant_id", "rank").collect()]
    assert got == [("t1", 1, "R3", 20.0), ("t1", 2, "R3", 20.0), ("t1", 3, "R2", 10.0), ("t1", 4, "R4", None), ("t2", 1, "R1", 99.0)]


def test_kpis_survive_zero_denominators(spark):
    one = spark.createDataFrame([("t", "C1", None, None, None, None, None, None, None, None)], COLUMNS)
    nothing = spark.createDataFrame([], "tenant_id string, positive bigint, neutral bigint, negative bigint, total bigint, net bigint")
    queue = spark.createDataFrame([], "tenant_id string, followups bigint, approvals bigint")
    row = portfolio.portfolio_kpis(portfolio.portfolio_summary(one), nothing, queue).collect()[0].asDict()
    assert row.pop("tenant_id") == "t" and row.pop("total_customers") == 1
    assert set(row.values()) == {0}
