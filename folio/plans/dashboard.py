"""Bundles of results that are shown together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from folio.operators import activity, evidence, ledger, portfolio, quality, scoring
from folio.operators.accounts import slim_profile

Tables = Mapping[str, DataFrame]

# List sizes of the dashboard.
ACCOUNTS_SHOWN = 60
FOLLOWUPS_SHOWN = 10
ACTIONS_SHOWN = 20


def dashboard(tables: Tables, kpis: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the dashboard shows, per tenant; ``kpis`` may come from kept partial aggregates (kpi_store.py)."""
    customers, emails, tickets = tables["customers"], tables["customer_email_logs"], tables["support_tickets"]
    summary = portfolio.portfolio_summary(customers)
    mood = portfolio.portfolio_sentiment(emails, tickets)
    followups = portfolio.pending_followups(tables["customer_review_logs"], tables["review_outcomes"], customers, FOLLOWUPS_SHOWN)
    actions = ledger.pending_actions(ledger.action_state(tables["ledger"]), ACTIONS_SHOWN)
    kpis = kpis or portfolio.portfolio_kpis(summary, mood, portfolio.queue_counts(followups, actions))
    return {
        "summary": summary,
        "portfolio_sentiment": mood,
        "accounts": portfolio.account_cards(customers, emails, tickets, ACCOUNTS_SHOWN),
        "pending_followups": followups,
        "pending_actions": actions,
        "kpis": kpis,
        "tones": portfolio.kpi_tones(kpis),
    }


def account_panel(tables: Tables, *customer_ids: str) -> dict[str, DataFrame]:
    """Profile, recent feeds and timeline of the given accounts."""
    mine = {t: df.filter(df["customer_id"].isin(*customer_ids)) for t, df in tables.items() if t in activity.FEED_DATE}
    customers = tables["customers"].filter(tables["customers"]["customer_id"].isin(*customer_ids))
    feeds = {t: activity.recent(df, t) for t, df in mine.items()}
    return {"profile": slim_profile(customers), **feeds, "timeline": activity.timeline(mine, activity.PANEL_SIZES)}


def audit(tables: Tables, as_of: str) -> dict[str, DataFrame]:
    """Every audit table of a book."""
    children = {t: df for t, df in tables.items() if t != "customers" and "customer_id" in df.columns}
    notes, emails = tables["customer_notes"], tables["customer_email_logs"]
    scan = quality.audit_scan(tables, as_of)
    return {
        "inventory": quality.scanned_inventory(scan),
        "coverage": quality.fk_coverage(children, tables["customers"]),
        "dates": quality.scanned_dates(scan),
        "duplicates": quality.audit_duplicates(tables),
        "scenarios_notes": quality.scanned_value_counts(scan, "customer_notes"),
        "scenarios_emails": quality.scanned_value_counts(scan, "customer_email_logs"),
        "scenarios_reviews": quality.scanned_value_counts(scan, "customer_review_logs"),
        "references": quality.ref_resolution(
            {"customer_notes": notes, "customer_email_logs": emails}, tables["support_tickets"], tables["orders"]
        ),
        "columns": quality.scanned_columns(scan),
        "patterns": quality.scanned_patterns(scan),
        "sample": quality.audit_sample(tables["customers"], tables),
    }


def evaluation(tables: Tables, predictions: DataFrame) -> dict[str, DataFrame]:
    """Predictions scored against the reviews, with every metric table."""
    truth = evidence.labelled_reviews(tables["customer_review_logs"], tables["review_outcomes"])
    asked = truth.join(predictions.select("tenant_id", "review_id"), ["tenant_id", "review_id"], "left_semi")
    scored = scoring.score_predictions(predictions, truth, evidence.record_ids(tables, asked))
    return {
        "results": scored,
        "headline": scoring.eval_headline(scored),
        "confusion": scoring.confusion_matrix(scored),
        "by_class": scoring.agreement_by_class(scored),
    }
