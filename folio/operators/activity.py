"""Dated activity of accounts: recent rows, threads, counts and the merged timeline."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.columns import money_label, or_else
from folio.operators.ranking import top_per
from folio.schemas import PRIMARY_KEY

ACCOUNT = ["tenant_id", "customer_id"]

# The date that orders each feed, newest first.
FEED_DATE = {
    "orders": "order_date",
    "support_tickets": "date_of_purchase",
    "customer_notes": "note_date",
    "customer_email_logs": "date",
    "customer_review_logs": "reviewed_at",
    "engagement_events": "event_date",
    "fulfillment_events": "event_date",
}

# Rows shown per feed in an account's activity panel.
PANEL_SIZES = {
    "orders": 10,
    "support_tickets": 10,
    "customer_notes": 10,
    "customer_email_logs": 10,
    "engagement_events": 20,
    "fulfillment_events": 20,
    "customer_review_logs": 10,
}


def newest_first(feed: str) -> list[Column]:
    order = [F.col(FEED_DATE[feed]).desc_nulls_last()]
    if feed == "customer_email_logs":
        order.append(F.col("message_sequence").desc_nulls_last())
    return [*order, F.col(PRIMARY_KEY[feed]).asc()]


def recent(df: DataFrame, feed: str, n: int | None = None) -> DataFrame:
    """The newest ``n`` rows of a feed per account (default: the panel size)."""
    return top_per(df, ACCOUNT, newest_first(feed), n or PANEL_SIZES[feed])


def thread(emails: DataFrame, *thread_ids: str) -> DataFrame:
    """Messages in sequence order, unnumbered ones last; all threads when none is named."""
    wanted = emails.filter(F.col("thread_id").isin(*thread_ids)) if thread_ids else emails
    return wanted.orderBy("tenant_id", "thread_id", F.col("message_sequence").asc_nulls_last(), "email_id")


def recent_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` messages of each session, oldest first."""
    newest = [F.col("created_at").desc_nulls_last(), F.col("message_id").desc()]
    return top_per(messages, ["session_id"], newest, n).orderBy("session_id", F.col("rank").desc())


def session_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every message of the tenant's own sessions, in order."""
    owned = messages.drop("tenant_id").join(sessions.select("tenant_id", "session_id"), "session_id")
    return owned.select("tenant_id", "session_id", "message_id", "role", "content", "created_at").orderBy(
        "tenant_id", "session_id", "created_at", "message_id"
    )


def session_activity(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """First seen, last active and message count per session."""
    seen = messages.groupBy("session_id").agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_active"), F.count("*").alias("messages")
    )
    joined = sessions.select("tenant_id", "session_id", "started_at").join(seen, "session_id", "left")
    return joined.select(
        "tenant_id", "session_id",
        F.coalesce(F.least("started_at", "first_seen"), "started_at").alias("first_seen"),
        F.coalesce(F.greatest("started_at", "last_active"), "started_at").alias("last_active"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
    )


def _per_account(customers: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    """One row per account, 0 where nothing was counted."""
    return (
        customers.select(*ACCOUNT)
        .join(counted, ACCOUNT, "left")
        .select(*ACCOUNT, F.coalesce(name, F.lit(0)).alias(name))
    )


def late_counts(orders: DataFrame, customers: DataFrame) -> DataFrame:
    late = orders.filter(F.col("late_delivery_risk") == 1).groupBy(*ACCOUNT).agg(F.count("*").alias("late_orders"))
    return _per_account(customers, late, "late_orders")


def open_ticket_counts(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    """Tickets whose status does not mention closed; a missing status is not counted."""
    still_open = tickets.filter(~F.lower("ticket_status").contains("closed"))
    return _per_account(customers, still_open.groupBy(*ACCOUNT).agg(F.count("*").alias("open_tickets")), "open_tickets")


def unresolved_counts(fulfillment: DataFrame, customers: DataFrame) -> DataFrame:
    """Events whose status mentions neither resolved nor closed (``Unresolved`` mentions resolved)."""
    status = F.lower("resolution_status")
    waiting = fulfillment.filter(~status.contains("resolved") & ~status.contains("closed"))
    return _per_account(customers, waiting.groupBy(*ACCOUNT).agg(F.count("*").alias("unresolved")), "unresolved")


# Feeds whose last date shows in the account view, and the column it shows in.
LAST_DATES = {
    "customer_email_logs": "last_email_at",
    "customer_notes": "last_note_at",
    "orders": "last_order_at",
    "customer_review_logs": "last_review_at",
    "engagement_events": "last_engagement_at",
}


def recent_activity(customers: DataFrame, feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Last date per feed and account: one pass and one shuffle over all feeds."""
    dated = reduce(
        DataFrame.unionByName,
        [feeds[f].select(*ACCOUNT, F.lit(f).alias("feed"), F.col(FEED_DATE[f]).cast("date").alias("day")) for f in LAST_DATES],
    )
    last = dated.groupBy(*ACCOUNT).agg(
        *[F.max(F.when(F.col("feed") == f, F.col("day"))).alias(name) for f, name in LAST_DATES.items()]
    )
    return customers.select(*ACCOUNT, "customer_full_name").join(last, ACCOUNT, "left")


def activity_counts(customers: DataFrame, feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per feed and account; every account is present."""
    names = sorted(feeds)
    marked = reduce(DataFrame.unionByName, [feeds[f].select(*ACCOUNT, F.lit(f).alias("feed")) for f in names])
    counted = marked.groupBy(*ACCOUNT).agg(*[F.count_if(F.col("feed") == f).alias(f) for f in names])
    joined = customers.select(*ACCOUNT).join(counted, ACCOUNT, "left")
    return joined.select(*ACCOUNT, *[F.coalesce(f, F.lit(0)).alias(f) for f in names])


# ---- timeline ------------------------------------------------------------

DOT = " · "


def _join(*parts: Column) -> Column:
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(DOT), part]
    return F.concat(*pieces[1:])


def _items(
    df: DataFrame, kind: str, prefix: str, key: str, day: str, title: Column, subtitle: Column,
    body: Column | None = None, badge: Column | None = None, tone: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.filter(F.col(day).isNotNull()).select(
        *ACCOUNT,
        F.concat(F.lit(prefix), F.col(key)).alias("id"),
        F.col(day).cast("date").alias("date"),
        F.lit(kind).alias("kind"),
        title.alias("title"),
        subtitle.alias("subtitle"),
        (none if body is None else body).alias("body"),
        (none if badge is None else badge).alias("badge"),
        (none if tone is None else tone).alias("tone"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _given(name: str) -> Column:
    """The text, or null where it is empty."""
    return F.when(F.col(name) != "", F.col(name))


def order_items(df: DataFrame) -> DataFrame:
    late = F.coalesce(F.col("late_delivery_risk") == 1, F.lit(False)) | F.lower(_text("delivery_status")).contains("late")
    return _items(
        df, "order", "o:", "order_id", "order_date",
        F.concat(F.lit("Order "), "order_id"),
        _join(or_else(F.col("delivery_status"), "—"), money_label(F.col("order_sales"))),
        badge=F.when(late, "Late"), tone=F.when(late, "warn"),
    )


def ticket_items(df: DataFrame) -> DataFrame:
    critical = F.lower(_text("ticket_priority")) == "critical"
    is_open = ~F.lower(_text("ticket_status")).contains("closed")
    return _items(
        df, "ticket", "t:", "ticket_id", "date_of_purchase",
        F.coalesce(_given("ticket_subject"), _given("ticket_type"), F.lit("Support ticket")),
        _join(or_else(F.col("ticket_priority"), "?"), or_else(F.col("ticket_status"), "?"), _text("ticket_type")),
        body=F.col("ticket_description"),
        badge=F.when(critical & is_open, "Critical" + DOT + "Open").when(critical, "Critical").when(is_open, "Open"),
        tone=F.when(critical & is_open, "critical").when(critical, "warn").otherwise("neutral"),
    )


def note_items(df: DataFrame) -> DataFrame:
    topic = F.when(_given("topic").isNotNull(), F.concat(F.lit(DOT), "topic")).otherwise("")
    return _items(
        df, "note", "n:", "note_id", "note_date",
        or_else(F.col("author"), "Internal note"), F.concat(_text("scenario"), topic), body=F.col("note_text"),
    )


def email_items(df: DataFrame) -> DataFrame:
    hint = F.lower(_text("sentiment_hint"))
    said = F.when(_given("sentiment_hint").isNotNull(), F.concat(F.lit(DOT), "sentiment_hint")).otherwise("")
    return _items(
        df, "email", "e:", "email_id", "date",
        or_else(F.col("subject"), "Email"),
        F.concat(or_else(F.lower("direction"), "—"), said),
        body=F.col("body"), badge=_given("sentiment_hint"),
        tone=F.when(hint.contains("concerned") | hint.contains("frustrated"), "warn").when(hint.contains("positive"), "ok"),
    )


def fulfillment_items(df: DataFrame) -> DataFrame:
    severity = F.lower(_text("severity"))
    return _items(
        df, "fulfillment", "f:", "fulfillment_event_id", "event_date",
        or_else(F.col("event_type"), "Fulfillment event"),
        _join(or_else(F.col("severity"), "—"), _text("root_cause"), _text("resolution_status")),
        badge=_given("severity"),
        tone=F.when(severity == "high", "warn").when(severity == "critical", "critical").otherwise("neutral"),
    )


def engagement_items(df: DataFrame) -> DataFrame:
    return _items(
        df, "engagement", "g:", "engagement_id", "event_date",
        or_else(F.col("event_type"), "Engagement"), _join(or_else(F.col("campaign"), "—"), _text("channel")),
    )


def review_items(df: DataFrame) -> DataFrame:
    decision = F.col("human_decision")
    return _items(
        df, "review", "r:", "review_id", "reviewed_at",
        F.concat(F.lit("Reviewed by "), or_else(F.col("reviewer"), "—")),
        F.concat(F.lit("Decision: "), or_else(decision, "—"), F.lit(DOT), _text("scenario")),
        body=F.col("review_notes"), badge=_given("human_decision"),
        tone=F.when(decision == "Escalate", "critical").when(decision == "Stabilize", "warn").when(decision == "Monitor", "neutral"),
    )


TIMELINE = {
    "orders": order_items,
    "support_tickets": ticket_items,
    "customer_notes": note_items,
    "customer_email_logs": email_items,
    "fulfillment_events": fulfillment_items,
    "engagement_events": engagement_items,
    "customer_review_logs": review_items,
}


def timeline(feeds: Mapping[str, DataFrame], per_feed: Mapping[str, int] | int | None = None) -> DataFrame:
    """All dated activity in one list per account, newest first.

    ``per_feed`` keeps only the newest rows of each feed (a number, or one per feed).
    The sort is a range sort on account, date and id, so a very active account
    spreads over several tasks.
    """
    parts = []
    for feed, as_items in TIMELINE.items():
        if feed not in feeds:
            continue
        df = feeds[feed]
        n = per_feed.get(feed) if isinstance(per_feed, Mapping) else per_feed
        parts.append(as_items(recent(df, feed, n) if n else df))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.orderBy("tenant_id", "customer_id", F.col("date").desc(), "id")
