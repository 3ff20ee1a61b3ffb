from __future__ import annotations

import pytest

from conftest import collect
from folio.operators import accounts

COLUMNS = "tenant_id string, customer_id string, customer_full_name string, customer_email string, customer_country string, risk_score double, risk_band string, total_sales double, late_delivery_rate double"


@pytest.fixture(scope="module")
def book(spark):
    rows = [
        ("t1", "C1", "Ana Smith", "ana@x.com", "NO", 50.0, "Critical", 10.0, 0.1),
        ("t1", "C2", "ana smith", "as@x.com", "SE", 50.0, "critical-high", None, None),
        ("t1", "C3", "Ana Smithson", "smithson@x.com", "SE", 90.0, "High", 5.0, 0.9),
        ("t1", "C4", "Bo 50%_(Ltd).", "bo@x.com", "SE", None, None, 7.0, 0.2),
        ("t1", "C5", "Zoë Lind", None, "SE", 20.0, "Medium", 0.0, 0.3),
        ("t2", "C1", "Ana Smith", "other@y.com", "DK", 1.0, "Low", 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def ask(spark, *names, tenant="t1"):
    return spark.createDataFrame([(tenant, n) for n in names], "tenant_id string, request string")


def answers(df):
    return [tuple(r) for r in df.select("request", "outcome", "rank", "customer_id").orderBy("request", "rank").collect()]


def test_exact_name_prefers_risk_then_id_and_stays_in_the_tenant(book):
    assert collect(accounts.account_by_name(book, "ANA SMITH"), "tenant_id", "customer_id") == [("t1", "C1"), ("t2", "C1")]


def test_exact_name_lists_namesakes(spark, book):
    got = answers(accounts.resolve_names(book, ask(spark, " Ana Smith ")))
    assert got == [(" Ana Smith ", "exact", 1, "C1"), (" Ana Smith ", "exact", 2, "C2")]


def test_one_hit_is_a_match_several_are_ambiguous(spark, book):
    got = answers(accounts.resolve_names(book, ask(spark, "smithso", "smith")))
    assert got == [("smith", "ambiguous", 1, "C3"), ("smith", "ambiguous", 2, "C1"), ("smith", "ambiguous", 3, "C2"), ("smithso", "match", 1, "C3")]
    assert {r[1] for r in answers(accounts.resolve_names(book, ask(spark, "smith"), pick=False))} == {"choose"}


def test_last_word_gives_suggestions_and_strangers_are_not_found(spark, book):
    got = answers(accounts.resolve_names(book, ask(spark, "Nils Lind", "Nobody", "", "  ")))
    assert ("Nils Lind", "suggestion", 1, "C5") in got
    assert {(r[0], r[1]) for r in got if r[0] != "Nils Lind"} == {("Nobody", "not_found"), ("", "not_found"), ("  ", "not_found")}


def test_wildcards_are_literal(spark, book):
    assert collect(accounts.search_accounts(book, "%_("), "customer_id") == ["C4"]
    assert collect(accounts.search_prefix(book, "%"), "customer_id") == []
    assert answers(accounts.resolve_names(book, ask(spark, "50%_(")))[0][1:] == ("match", 1, "C4")


def test_search_agrees_with_a_plain_scan(spark, book):
    rows = [r for r in book.collect()]
    needles = ["a", "an", "smith", "x.com", "ana smithson", "ë", ".", "y.com", "nothing"]
    asked = spark.createDataFrame([(t, n) for t in ("t1", "t2") for n in needles], "tenant_id string, needle string")
    got = set(collect(accounts.find_containing(book, asked), "tenant_id", "needle", "customer_id"))
    want = {
        (r.tenant_id, n, r.customer_id)
        for r in rows for n in needles if n in r.customer_full_name.lower() or n in (r.customer_email or "").lower()
    }
    assert got == want


def test_rankings_put_missing_values_last(book):
    t1 = book.filter("tenant_id = 't1'")
    assert [r.customer_id for r in accounts.top_at_risk(t1, 9).orderBy("rank").collect()] == ["C3", "C1", "C2", "C5", "C4"]
    assert [r.customer_id for r in accounts.top_by_revenue(t1, 9).orderBy("rank").collect()] == ["C1", "C4", "C3", "C5", "C2"]
    assert [r.customer_id for r in accounts.top_by_revenue(t1, 9, True).orderBy("rank").collect()] == ["C5", "C3", "C4", "C1", "C2"]
    # no sales means not healthy, unknown risk comes last
    assert [r.customer_id for r in accounts.top_healthy(t1, 9).orderBy("rank").collect()] == ["C1", "C3", "C4"]


def test_band_is_filtered_before_the_cut(book):
    assert collect(accounts.top_at_risk(book, 1, "CRIT"), "customer_id") == ["C1"]
    assert collect(accounts.by_band(book, "high"), "customer_id") == ["C2", "C3"]


def test_pages_cover_the_book_once_at_any_depth(spark):
    rows = [("t1" if i % 3 else "t2", f"C{i:05d}", f"N{i}", "", "", float(i % 7), "Low", 1.0, 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    seen = []
    for offset in range(0, 2000, 500):
        seen += [(r.tenant_id, r.rank, r.customer_id) for r in accounts.page_accounts(df, 500, offset).collect()]
    want = []
    for t in ("t1", "t2"):
        mine = sorted((-r[5], r[1]) for r in rows if r[0] == t)
        want += [(t, i, c) for i, (_, c) in enumerate(mine, 1)]
    assert sorted(seen) == sorted(want)


def test_ids_keep_their_order_and_unknown_ones_drop(spark, book):
    asked = spark.createDataFrame([("t1", "q", " C3, nobody,,C1 ,C3")], "tenant_id string, request_id string, customer_ids string")
    full = book.selectExpr("*", *[f"cast(null as string) {c}" for c in ("customer_segment", "lifecycle_stage", "churn_risk_reason", "next_best_action", "last_review_decision")],
                           *[f"cast(null as double) {c}" for c in ("total_orders", "total_profit", "support_ticket_count", "open_support_ticket_count", "health_score")])
    assert collect(accounts.resolve_ids(full, asked), "pos", "customer_id") == [(0, "C3"), (3, "C1"), (4, "C3")]


def test_directory_sorts_missing_as_zero(book):
    t1 = book.filter("tenant_id = 't1'")
    got = [r.customer_id for r in accounts.directory(t1, "late_rate", descending=False).orderBy("rank").collect()]
    assert got == ["C2", "C1", "C4", "C5", "C3"]
    names = [r.customer_id for r in accounts.directory(t1, "name", descending=False, limit=3, offset=1).orderBy("rank").collect()]
    assert names == ["C2", "C3", "C4"]
