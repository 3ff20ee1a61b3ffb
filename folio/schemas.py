"""Declared tables: columns, keys and date columns of the customer book.

The spine is fourteen tables keyed by ``customer_id``; the runtime tables hold
what people and models do with it.  Schemas are declared, never inferred, so a
load needs no extra pass over the files.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Table layouts of the data set (column order is the file order).
SPINE_DDL: dict[str, str] = {
    "customers": """
        customer_id string, source_customer_id bigint, customer_first_name string,
        customer_last_name string, customer_full_name string, customer_email string,
        customer_segment string, customer_city string, customer_state string,
        customer_country string, customer_street string, customer_zipcode string,
        latitude double, longitude double, primary_market string, primary_region string,
        total_orders int, total_order_items int, total_sales double, total_profit double,
        late_delivery_count int, late_delivery_rate double, avg_days_scheduled double,
        avg_days_actual double, avg_shipping_delay double, top_category string,
        top_product string, first_order_date date, last_order_date date,
        support_ticket_count int, open_support_ticket_count int,
        critical_support_ticket_count int, avg_ticket_satisfaction double,
        review_count int, last_review_decision string, lifecycle_stage string,
        churn_risk_reason string, next_best_action string,
        last_meaningful_touch_date date, data_quality_flags string, risk_score double,
        risk_band string, health_score double, globe_x double, globe_y double,
        globe_z double""",
    "customer_bridge": """
        customer_id string, source_customer_id bigint, source_dataset string,
        customer_full_name string, customer_email string, mapping_method string,
        mapping_note string""",
    "customer_contacts": """
        contact_id string, customer_id string, source_customer_id bigint,
        customer_full_name string, contact_full_name string, contact_email string,
        role string, influence_level string, preferred_channel string,
        synthetic_flag boolean""",
    "customer_adjustments": """
        adjustment_id string, customer_id string, source_customer_id bigint,
        customer_full_name string, ticket_id string, adjustment_type string,
        amount double, reason string, status string, created_date date""",
    "customer_email_logs": """
        email_id string, thread_id string, customer_id string,
        source_customer_id bigint, customer_full_name string, scenario string,
        topic string, message_sequence int, direction string, date date,
        sender_type string, recipient_type string, subject string, body string,
        sentiment_hint string, synthetic_flag boolean, source_signal_ids string""",
    "customer_notes": """
        note_id string, customer_id string, source_customer_id bigint,
        customer_full_name string, scenario string, topic string, note_date date,
        author string, note_type string, note_text string, synthetic_flag boolean,
        source_signal_ids string""",
    "customer_review_logs": """
        review_id string, customer_id string, source_customer_id bigint,
        customer_full_name string, scenario string, topic string,
        reviewed_at timestamp_ntz, reviewer string, human_decision string,
        review_notes string, decision_boundary string, synthetic_flag boolean""",
    "customer_support_bridge": """
        source_ticket_id bigint, ticket_id string, customer_id string,
        source_customer_id bigint, customer_full_name string,
        support_customer_name string, support_customer_email string,
        mapping_method string, mapping_confidence double, mapping_note string""",
    "engagement_events": """
        engagement_id string, customer_id string, source_customer_id bigint,
        customer_full_name string, event_date date, event_type string,
        campaign string, channel string, engagement_score double""",
    "fulfillment_events": """
        fulfillment_event_id string, order_id string, customer_id string,
        source_customer_id bigint, event_date date, event_type string,
        severity string, root_cause string, resolution_status string""",
    "order_lines": """
        order_line_id string, source_order_item_id bigint, order_id string,
        source_order_id bigint, customer_id string, source_customer_id bigint,
        product_card_id bigint, product_name string, product_category_id bigint,
        category_name string, department_id bigint, department_name string,
        quantity int, product_price double, item_total double, sales double,
        discount double, discount_rate double, profit double, profit_ratio double,
        product_status int, product_image string""",
    "orders": """
        order_id string, source_order_id bigint, customer_id string,
        source_customer_id bigint, order_date date, shipping_date date,
        order_status string, delivery_status string, late_delivery_risk int,
        shipping_mode string, market string, order_region string,
        order_country string, order_state string, order_city string,
        order_zipcode string, order_item_count int, order_quantity int,
        order_sales double, order_total double, order_profit double,
        avg_item_discount_rate double, days_scheduled int, days_actual int,
        issue_flag string""",
    "review_outcomes": """
        outcome_id string, review_id string, customer_id string,
        source_customer_id bigint, customer_full_name string, outcome_date date,
        outcome_status string, outcome_type string, follow_up_required boolean""",
    "support_tickets": """
        ticket_id string, source_ticket_id bigint, customer_id string,
        source_customer_id bigint, customer_full_name string,
        support_customer_name string, support_customer_email string,
        support_customer_age int, support_customer_gender string,
        product_purchased string, date_of_purchase date, ticket_type string,
        ticket_subject string, ticket_description string, ticket_status string,
        resolution string, ticket_priority string, ticket_channel string,
        resolution_time_hours double, customer_satisfaction_rating double,
        customer_sentiment string, mapping_method string,
        mapping_confidence double""",
}

RUNTIME_DDL: dict[str, str] = {
    # one row per thing that happened to a proposed action
    "ledger": """
        action_id string, customer_id string, customer_full_name string, event_ts timestamp_ntz,
        event_seq bigint, event_type string, action_type string,
        payload_json string, status string, actor string, notes string,
        rationale string, confidence double, error string""",
    "sessions": """
        session_id string, user_id string, surface string,
        started_at timestamp_ntz, last_active_at timestamp_ntz""",
    "messages": """
        message_id string, session_id string, role string, content string,
        tool_calls_json string, created_at timestamp_ntz""",
    "predictions": """
        review_id string, predicted_decision string, predicted_band string,
        rationale string, cited_record_ids array<string>, parse_error boolean""",
    "votes": "labeler string, case_id string, decision string",
}

# Columns a load must find, per table.
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id", "customer_full_name", "risk_band", "lifecycle_stage"),
    "orders": ("order_id", "customer_id", "order_date", "delivery_status"),
    "support_tickets": ("ticket_id", "customer_id", "ticket_priority"),
    "customer_notes": ("note_id", "customer_id", "note_text", "scenario"),
    "customer_email_logs": ("email_id", "customer_id", "body", "scenario"),
    "customer_review_logs": ("review_id", "customer_id", "human_decision"),
    "review_outcomes": ("outcome_id", "review_id", "outcome_status"),
    "engagement_events": ("engagement_id", "customer_id", "engagement_score"),
    "fulfillment_events": ("fulfillment_event_id", "customer_id", "severity"),
}

# Primary keys (the two bridges have none).
PRIMARY_KEY: dict[str, str] = {
    "customers": "customer_id",
    "orders": "order_id",
    "order_lines": "order_line_id",
    "support_tickets": "ticket_id",
    "customer_notes": "note_id",
    "customer_email_logs": "email_id",
    "customer_review_logs": "review_id",
    "review_outcomes": "outcome_id",
    "engagement_events": "engagement_id",
    "fulfillment_events": "fulfillment_event_id",
    "customer_contacts": "contact_id",
    "customer_adjustments": "adjustment_id",
}

# The date columns whose range is audited.
DATE_COLUMNS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_since",),
    "orders": ("order_date", "shipping_date"),
    "support_tickets": ("date_of_purchase", "first_response_time", "time_to_resolution"),
    "customer_notes": ("note_date",),
    "customer_email_logs": ("date",),
    "customer_review_logs": ("reviewed_at",),
    "review_outcomes": ("outcome_date",),
    "engagement_events": ("event_date",),
    "fulfillment_events": ("event_date",),
    "customer_adjustments": ("created_date",),
}

# The typed columns a reader of one record sees.
RECORD_COLUMNS: dict[str, tuple[str, ...]] = {
    "customers": (
        "customer_id", "customer_full_name", "customer_email", "customer_segment",
        "customer_country", "customer_state", "customer_city", "primary_market",
        "primary_region", "total_orders", "total_sales", "total_profit",
        "late_delivery_count", "late_delivery_rate", "support_ticket_count",
        "open_support_ticket_count", "risk_score", "risk_band", "health_score",
        "lifecycle_stage", "churn_risk_reason", "next_best_action",
        "last_review_decision", "last_meaningful_touch_date", "tenant_id",
    ),
    "orders": (
        "order_id", "customer_id", "order_date", "shipping_date", "order_status",
        "delivery_status", "late_delivery_risk", "shipping_mode", "order_sales",
        "order_profit", "order_total", "days_scheduled", "days_actual", "issue_flag",
        "tenant_id",
    ),
    "support_tickets": (
        "ticket_id", "customer_id", "customer_full_name", "date_of_purchase",
        "ticket_type", "ticket_subject", "ticket_description", "ticket_status",
        "ticket_priority", "ticket_channel", "resolution", "resolution_time_hours",
        "customer_satisfaction_rating", "customer_sentiment", "tenant_id",
    ),
    "customer_notes": (
        "note_id", "customer_id", "customer_full_name", "scenario", "topic",
        "note_date", "author", "note_type", "note_text", "source_signal_ids",
        "tenant_id",
    ),
    "customer_email_logs": (
        "email_id", "thread_id", "customer_id", "customer_full_name", "scenario",
        "topic", "message_sequence", "direction", "date", "sender_type",
        "recipient_type", "subject", "body", "sentiment_hint", "source_signal_ids",
        "tenant_id",
    ),
    "customer_review_logs": (
        "review_id", "customer_id", "customer_full_name", "scenario", "topic",
        "reviewed_at", "reviewer", "human_decision", "review_notes",
        "decision_boundary", "tenant_id",
    ),
    "engagement_events": (
        "engagement_id", "customer_id", "event_date", "event_type", "campaign",
        "channel", "engagement_score", "tenant_id",
    ),
    "fulfillment_events": (
        "fulfillment_event_id", "order_id", "customer_id", "event_date", "event_type",
        "severity", "root_cause", "resolution_status", "tenant_id",
    ),
}

SPINE_TABLES: tuple[str, ...] = tuple(SPINE_DDL)


@cache
def declared(table: str) -> StructType:
    """The declared columns of a table, without ``tenant_id``."""
    return StructType.fromDDL(SPINE_DDL.get(table) or RUNTIME_DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto ``tenant_id`` plus the declared columns, cast; absent ones are null."""
    have = set(df.columns)
    cols = [F.col("tenant_id")]
    for field in declared(table):
        source = F.col(field.name) if field.name in have else F.lit(None)
        cols.append(source.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def records(df: DataFrame, table: str) -> DataFrame:
    """Only the columns a reader of one record sees."""
    return df.select(*RECORD_COLUMNS[table])
