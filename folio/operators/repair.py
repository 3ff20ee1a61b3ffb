"""Repairs that make a customer book coherent before it is analysed.

Random draws are hashes of the row's own key, so a repair gives the same result on
any cluster, any partitioning and any re-run.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.columns import band_is, blank, priority_rank, seeded_int, seeded_order
from folio.operators.activity import ACCOUNT
from folio.operators.ranking import number_by_text, running_total, top_per
from folio.session import join_small

Tables = Mapping[str, DataFrame]

# Days between the anchor day and the newest row after the rebase.
ORDER_GAP_DAYS = 30
TICKET_GAP_DAYS = 7
PENDING_PERCENT = 20
NOTE_RANGE = (1, 12)
EMAIL_RANGE = (2, 20)
BROKEN_TICKET_COLUMNS = ("first_response_time", "time_to_resolution")

LINEAGE = ["tenant_id", "customer_id", "scenario", "topic"]


# ---- dates -----------------------------------------------------------------------

def day_shift(df: DataFrame, column: str, as_of: str, gap: int) -> DataFrame:
    """Days to add per tenant so that its newest row lies ``gap`` days before ``as_of``."""
    newest = df.groupBy("tenant_id").agg(F.max(column).alias("newest"))
    target = F.date_sub(F.lit(as_of).cast("date"), gap)
    return newest.select("tenant_id", F.datediff(target, "newest").alias("shift"))


def _moved(df: DataFrame, shift: DataFrame, *columns: str) -> DataFrame:
    # a tenant without a newest row has nothing to move by: its dates stay
    joined = join_small(df, shift, ["tenant_id"])
    return joined.withColumns({c: F.date_add(c, F.coalesce("shift", F.lit(0))) for c in columns}).drop("shift").select(*df.columns)


def rebase_dates(tables: Tables, as_of: str) -> dict[str, DataFrame]:
    """Orders, fulfilment events and tickets moved onto a timeline that ends at ``as_of``.

    Orders and fulfilment share one shift, taken from the order dates.
    """
    orders, tickets = tables["orders"], tables["support_tickets"]
    shift = day_shift(orders, "order_date", as_of, ORDER_GAP_DAYS)
    return {
        "orders": _moved(orders, shift, "order_date", "shipping_date"),
        "fulfillment_events": _moved(tables["fulfillment_events"], shift, "event_date"),
        "support_tickets": _moved(tickets, day_shift(tickets, "date_of_purchase", as_of, TICKET_GAP_DAYS), "date_of_purchase"),
    }


def rebase_outcomes(outcomes: DataFrame, reviews: DataFrame, as_of: str, seed: int = 42) -> DataFrame:
    """A seeded fifth of the outcomes becomes pending; the others get a day after their review.

    The day is drawn evenly from the day after the review to the day before
    ``as_of``; where that range is empty it is the day after the review.  An unknown
    review leaves no date.
    """
    r = reviews.select("tenant_id", "review_id", F.col("reviewed_at").cast("date").alias("_reviewed"))
    joined = outcomes.join(r, ["tenant_id", "review_id"], "left")
    key = F.col("outcome_id")
    pending = seeded_int(seed, "pending", key) % 100 < PENDING_PERCENT
    low, high = F.date_add("_reviewed", 1), F.date_sub(F.lit(as_of).cast("date"), 1)
    span = F.greatest(F.datediff(high, low), F.lit(0))
    drawn = F.date_add(low, (seeded_int(seed, "day", key) % (span + 1)).cast("int"))
    return joined.withColumns({
        "outcome_date": F.when(~pending, drawn),
        "outcome_status": F.when(pending, "Pending").otherwise(F.col("outcome_status")),
        "follow_up_required": F.when(pending, True).otherwise(F.col("follow_up_required")),
    }).select(*outcomes.columns)


def drop_broken_columns(tickets: DataFrame) -> DataFrame:
    return tickets.drop(*BROKEN_TICKET_COLUMNS)


# ---- lineage -----------------------------------------------------------------------

def lineage_refs(notes: DataFrame) -> DataFrame:
    """Every distinct reference of the notes of one account, scenario and topic, one row each.

    References are taken as written between the semicolons; only empty ones are dropped.
    """
    parts = notes.filter("source_signal_ids is not null").select(*LINEAGE, F.explode(F.split("source_signal_ids", ";")).alias("ref"))
    keyed = parts.filter("ref <> '' and customer_id is not null and scenario is not null and topic is not null")
    return keyed.distinct()


def email_refs(emails: DataFrame, notes: DataFrame) -> DataFrame:
    """Every reference an email inherits from the matching notes, one row each."""
    return emails.select("email_id", *LINEAGE).join(lineage_refs(notes), LINEAGE).select("tenant_id", "email_id", "ref")


def backfill_lineage(emails: DataFrame, notes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Emails with all references of the matching notes, joined by ``;`` in order.

    By default an email keeps the references it has; ``overwrite`` replaces them,
    with '' where no note matches.  ``ref_count`` is the number of matching
    references; ``email_refs`` has the same in long form.
    """
    packed = lineage_refs(notes).groupBy(*LINEAGE).agg(F.array_sort(F.collect_list("ref")).alias("_refs"))
    # one row per group, written: emails of a busy group are then split by AQE
    joined = join_small(emails, packed, LINEAGE)
    filled = F.coalesce(F.array_join("_refs", ";"), F.lit(""))
    if not overwrite:
        filled = F.when(~blank(F.col("source_signal_ids")), F.col("source_signal_ids")).otherwise(filled)
    count = F.coalesce(F.size("_refs"), F.lit(0)).cast("bigint")
    return joined.withColumn("ref_count", F.when(F.col("_refs").isNull(), 0).otherwise(count)).withColumn("source_signal_ids", filled).select(
        *emails.columns, "ref_count"
    )


# ---- volume -------------------------------------------------------------------------

# The shares of the range that each band keeps.
def volume_target(band: Column, low: int, high: int, draw: Column) -> Column:
    """How many rows an account of a band keeps; riskier bands keep more."""
    third = (high - low) // 3

    def between(first: int, last: int) -> Column:
        return F.lit(first) + draw % (last - first + 1)

    return (
        F.when(band_is(band, "critical", "high"), between(int(0.7 * high), high))
        .when(band_is(band, "elevated", "moderate"), between(low + third, low + 2 * (high - low) // 3))
        .otherwise(between(low, low + max(1, third)))
    )


def sample_by_band(df: DataFrame, key: str, customers: DataFrame, low: int, high: int, seed: int = 42) -> DataFrame:
    """A seeded sample per account whose size follows its risk band.

    Accounts are cut to the largest target first, so the join with the bands sees at
    most ``high`` rows per account.
    """
    drawn = top_per(df, ACCOUNT, [seeded_order(seed, F.col(key)).asc(), F.col(key).asc()], high, "_n")
    bands = customers.select(*ACCOUNT, F.col("risk_band").alias("_band"))
    draw = seeded_int(seed, "volume", F.col("customer_id"))
    joined = drawn.join(bands, ACCOUNT, "left")
    return joined.filter(F.col("_n") <= volume_target(F.col("_band"), low, high, draw)).select(*df.columns)


# ---- tickets --------------------------------------------------------------------------

# Tickets per account of each band.
def ticket_target(band: Column, draw: Column) -> Column:
    """Tickets an account of a band should carry, before scaling to the tickets there are."""
    return (
        F.when(band_is(band, "critical"), 4 + draw % 3)
        .when(band_is(band, "high"), 2 + draw % 3)
        .when(band_is(band, "elevated", "moderate"), 1 + draw % 2)
        .otherwise(F.when(draw % 10 == 9, 1).otherwise(0))
    ).cast("bigint")


def spread_tickets(customers: DataFrame, tickets: DataFrame, seed: int = 42) -> DataFrame:
    """Tickets handed out again: urgent ones first, to the riskiest accounts first.

    Targets per account follow its band and are scaled to the tickets there are.
    Rounding the running total of the targets gives every account the floor or the
    ceiling of its scaled target and hands out every ticket exactly once; tickets of
    a tenant without accounts keep what they have.  Tickets are numbered by the first characters of their
    ids and accounts by range partitions, then both meet on the number.
    """
    draw = seeded_int(seed, "tickets", F.col("customer_id"))
    wanted = customers.select(
        *ACCOUNT, F.col("customer_full_name").alias("new_name"), F.col("source_customer_id").alias("new_source"),
        "risk_score", ticket_target(F.col("risk_band"), draw).alias("target"),
    )
    # a tenant whose targets are all 0 shares its tickets evenly
    totals = wanted.groupBy("tenant_id").agg(F.sum("target").alias("all_targets"), F.count("*").alias("accounts"))
    totals = totals.join(tickets.groupBy("tenant_id").agg(F.count("*").alias("tickets")), "tenant_id")
    sized = join_small(wanted, totals, ["tenant_id"], "inner")
    none = F.col("all_targets") == 0
    sized = sized.withColumn("share", F.when(none, F.lit(1)).otherwise(F.col("target"))).withColumn(
        "shares", F.when(none, F.col("accounts")).otherwise(F.col("all_targets"))
    )
    order = [F.col("risk_score").desc_nulls_last(), F.col("customer_id").asc()]
    summed = running_total(sized, ["tenant_id"], order, "share", "upto")

    # whole-number arithmetic on decimals: the product may exceed 64 bits
    boundary = "cast({} as decimal(19,0)) * cast(tickets as decimal(18,0)) div cast(shares as decimal(19,0))"
    bounds = summed.withColumn("after", F.expr(boundary.format("upto"))).withColumn(
        "first", F.expr(boundary.format("upto - share")) + 1
    )
    slots = bounds.filter("after >= first").select(
        "tenant_id", F.col("customer_id").alias("new_id"), "new_name", "new_source",
        F.explode(F.sequence("first", "after")).alias("slot"),
    )
    numbered = number_by_text(tickets, ["tenant_id"], priority_rank(F.col("ticket_priority")), "ticket_id", "slot")
    # both sides have a row per ticket; the planner would take the unexploded slots for a small side
    handed = numbered.join(slots.hint("merge"), ["tenant_id", "slot"], "left")
    # tickets of a tenant without accounts have no slot and stay as they are
    given = F.col("new_id").isNotNull()
    new = {"customer_id": "new_id", "customer_full_name": "new_name", "source_customer_id": "new_source"}
    return handed.withColumns({c: F.when(given, F.col(n)).otherwise(F.col(c)) for c, n in new.items()}).select(*tickets.columns)


def rebuild_bridge(tickets: DataFrame, bridge: DataFrame) -> DataFrame:
    """The ticket bridge of the new assignment, in the old column order; unknown columns are blank."""
    number = F.regexp_replace("ticket_id", "T", "").try_cast("bigint")
    # fixed values: method and confidence
    made = {
        "tenant_id": F.col("tenant_id"),
        "source_ticket_id": number,
        "ticket_id": F.col("ticket_id"),
        "customer_id": F.col("customer_id"),
        "source_customer_id": F.col("source_customer_id"),
        "customer_full_name": F.col("customer_full_name"),
        "mapping_method": F.lit("risk_redistribution_v2"),
        "mapping_confidence": F.lit(1.0),
        "mapping_note": F.lit("spread_tickets: handed out by account risk"),
    }
    return tickets.select(*[made.get(c, F.lit("")).alias(c) for c in bridge.columns])


# ---- the whole repair --------------------------------------------------------------------

def repair(tables: Tables, as_of: str, seed: int = 42) -> dict[str, DataFrame]:
    """Every repair in order; tables that need none are passed through."""
    out = dict(tables)
    out.update(rebase_dates(tables, as_of))
    out["review_outcomes"] = rebase_outcomes(tables["review_outcomes"], tables["customer_review_logs"], as_of, seed)
    emails = backfill_lineage(tables["customer_email_logs"], tables["customer_notes"], overwrite=True).drop("ref_count")
    customers = tables["customers"]
    out["customer_notes"] = sample_by_band(tables["customer_notes"], "note_id", customers, *NOTE_RANGE, seed)
    out["customer_email_logs"] = sample_by_band(emails, "email_id", customers, *EMAIL_RANGE, seed)
    out["support_tickets"] = spread_tickets(customers, drop_broken_columns(out["support_tickets"]), seed)
    if "customer_support_bridge" in tables:
        out["customer_support_bridge"] = rebuild_bridge(out["support_tickets"], tables["customer_support_bridge"])
    return out


def repair_log(before: Tables, after: Tables, as_of: str) -> DataFrame:
    """What a repair changed, in long form: (tenant_id, step, metric, value)."""

    def lines(df: DataFrame, step: str, **values: Column) -> DataFrame:
        entries = [F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("value")) for m, v in values.items()]
        return df.select("tenant_id", F.lit(step).alias("step"), F.explode(F.array(*entries)).alias("e")).select("tenant_id", "step", "e.*")

    outcomes, tickets = after["review_outcomes"], after["support_tickets"]
    by_status = outcomes.groupBy("tenant_id").agg(
        F.count_if(F.col("outcome_status") == "Pending").alias("p"), F.count_if(F.col("outcome_date").isNotNull()).alias("d")
    )
    # all emails, before the volume sample
    emails = before["customer_email_logs"]
    had_refs = emails.groupBy("tenant_id").agg(F.count_if(~blank(F.col("source_signal_ids"))).alias("r"))
    filled = backfill_lineage(emails, before["customer_notes"], overwrite=True)
    with_refs = filled.groupBy("tenant_id").agg(F.count_if(~blank(F.col("source_signal_ids"))).alias("r"), F.count("*").alias("n"))
    dropped = [c for c in BROKEN_TICKET_COLUMNS if c in before["support_tickets"].columns and c not in tickets.columns]
    loads = tickets.groupBy(*ACCOUNT).agg(F.count("*").alias("load"))
    loads = after["customers"].select(*ACCOUNT).join(loads, ACCOUNT, "left").withColumn("load", F.coalesce("load", F.lit(0)))
    idle = loads.groupBy("tenant_id").agg(F.count_if(F.col("load") == 0).alias("z"))
    spread = loads.filter("load > 0").groupBy("tenant_id", "load").agg(F.count("*").alias("value"))
    parts = [
        lines(day_shift(before["orders"], "order_date", as_of, ORDER_GAP_DAYS), "dates", orders_shift_days=F.col("shift")),
        lines(day_shift(before["support_tickets"], "date_of_purchase", as_of, TICKET_GAP_DAYS), "dates", tickets_shift_days=F.col("shift")),
        lines(by_status, "outcomes", pending=F.col("p"), dated=F.col("d")),
        lines(had_refs, "lineage", emails_with_refs_before=F.col("r")),
        lines(with_refs, "lineage", emails_with_refs=F.col("r"), emails=F.col("n")),
        lines(idle, "tickets", accounts_without_tickets=F.col("z")),
        spread.select("tenant_id", F.lit("tickets").alias("step"), F.format_string("accounts_with_%d_tickets", "load").alias("metric"), "value"),
    ]
    if dropped:
        tenants = before["support_tickets"].select("tenant_id").distinct()
        parts.append(lines(tenants, "columns", **{f"dropped_{c}": F.lit(1) for c in dropped}))
    for name in ("customer_notes", "customer_email_logs", "support_tickets"):
        for label, tables in (("before", before), ("after", after)):
            counted = tables[name].groupBy("tenant_id").agg(F.count("*").alias("n"))
            parts.append(lines(counted, name, **{f"rows_{label}": F.col("n")}))
    return reduce(DataFrame.unionByName, parts)
