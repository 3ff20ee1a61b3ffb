"""The action ledger: proposals, decisions and sends as events, folded to current state.

An event row is (tenant_id, action_id, customer_id, event_ts, event_seq, event_type,
...) with event_type propose, edit, decide or send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.columns import blank, content_key
from folio.operators.activity import ACCOUNT
from folio.operators.ranking import top_per
from folio.session import join_small, settle

ACTION = ["tenant_id", "action_id"]

# The kinds of action a proposal may ask for.
ACTION_TYPES = (
    "send_email",
    "proactive_outreach",
    "reclassify_band",
    "update_lifecycle",
    "escalate",
    "schedule_followup",
    "recommend_credit",
    "recommend_expedite",
    "add_note",
)


# What a decision may be.
DECISIONS = ("approved", "rejected")


def _at() -> Column:
    """When an event happened; the sequence number orders events of one instant."""
    return F.struct("event_ts", "event_seq")


def normal_payload(payload: Column) -> Column:
    """Valid JSON as it is, ``{}`` for nothing, other text wrapped as ``{"text": ...}``."""
    wrapped = F.to_json(F.struct(payload.alias("text")))
    return F.when(blank(payload), "{}").when(F.try_parse_json(payload).isNotNull(), payload).otherwise(wrapped)


def validate_proposals(proposals: DataFrame, customers: DataFrame) -> DataFrame:
    """Proposals with their normal payload and confidence, accepted or with the reason they are not."""
    known = customers.select(*ACCOUNT, "customer_full_name", F.lit(True).alias("_known"))
    joined = proposals.drop("customer_full_name").join(known, ACCOUNT, "left")
    reason = (
        F.when(~F.coalesce(F.col("action_type").isin(*ACTION_TYPES), F.lit(False)), "unknown action type")
        .when(F.col("_known").isNull(), "unknown customer")
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7))))
    return joined.withColumns({
        "payload_json": normal_payload(F.col("payload_json")),
        "confidence": clipped,
        "accepted": reason.isNull(),
        "reject_reason": reason,
    }).drop("_known")


def effective_events(events: DataFrame) -> DataFrame:
    """Only the events that changed something.

    An action exists from its first proposal: earlier events and repeated proposals
    do nothing.  The payload can be edited until the first decision.  Decisions may
    be repeated, anything but an approval or a rejection is none, and sends are recorded
    whatever the status.
    """
    kind = F.col("event_type")
    proposed = events.filter(kind == "propose").groupBy(*ACTION).agg(F.min(_at()).alias("_proposed"))
    # one row per action, written before it meets the events: a busy action is then split by AQE
    proposed = settle(proposed, "proposed")
    valid = F.coalesce(F.col("status").isin(*DECISIONS), F.lit(False))
    choices = events.filter((kind == "decide") & valid).select(*ACTION, _at().alias("_at")).join(proposed, ACTION)
    decided = choices.filter("_at > _proposed").groupBy(*ACTION).agg(F.min("_at").alias("_decided"))
    alive = join_small(events, proposed.join(decided, ACTION, "left"), ACTION, "inner").withColumn("_at", _at())
    after = F.col("_at") > F.col("_proposed")
    open_edit = (kind == "edit") & after & F.coalesce(F.col("_at") < F.col("_decided"), F.lit(True))
    kept = (F.col("_at") == F.col("_proposed")) | open_edit | ((((kind == "decide") & valid) | (kind == "send")) & after)
    return alive.filter(kept).drop("_at", "_proposed", "_decided")


def lasting_events(events: DataFrame) -> DataFrame:
    """The events that can still matter, whatever events come later and of whatever time.

    Of an action's proposals only the first can ever count, of its sends the last.  A proposal of an
    earlier time moves the first decision to an earlier time, never to a later one: edits after the first decision
    and, but for the last, decisions after it are settled.  States of these events, with any others added, are
    those of all events.
    """
    kind, at = F.col("event_type"), _at()
    choice = (kind == "decide") & F.coalesce(F.col("status").isin(*DECISIONS), F.lit(False))
    ends = events.groupBy(*ACTION).agg(
        F.min(F.when(kind == "propose", at)).alias("_proposed"), F.max(F.when(choice, at)).alias("_last"), F.max(F.when(kind == "send", at)).alias("_sent")
    )
    # one row per action, written before it meets the events: a busy action is then split by AQE
    ends = settle(ends, "ends")
    decided = events.filter(choice).select(*ACTION, at.alias("_at")).join(ends, ACTION).filter("_at > _proposed").groupBy(*ACTION).agg(F.min("_at").alias("_decided"))
    marked = join_small(events, ends.join(decided, ACTION, "left"), ACTION, "inner").withColumn("_at", at)
    undecided = F.col("_decided").isNull()
    kept = (
        ((kind == "propose") & (F.col("_at") == F.col("_proposed")))
        | ((kind == "edit") & (undecided | (F.col("_at") < F.col("_decided"))))
        | (choice & (undecided | (F.col("_at") <= F.col("_decided")) | (F.col("_at") == F.col("_last"))))
        | ((kind == "send") & (F.col("_at") == F.col("_sent")))
    )
    return marked.filter(kept).select(*events.columns)


def fold(events: DataFrame) -> DataFrame:
    """Effective events to one row per action: only maxima and minima."""

    def last(kind: str, *fields: str) -> Column:
        row = F.struct(*fields)
        return F.max(F.when(F.col("event_type") == kind, F.struct(_at().alias("at"), row.alias("row"))))

    folded = events.groupBy(*ACTION).agg(
        last("propose", "event_ts", "customer_id", "customer_full_name", "action_type", "payload_json", "rationale", "confidence").alias("p"),
        last("edit", "payload_json").alias("e"),
        last("decide", "event_ts", "status", "actor", "notes").alias("d"),
        last("send", "event_ts", "error").alias("s"),
    )
    p, d, s = F.col("p.row"), F.col("d.row"), F.col("s.row")
    payload = F.when(F.col("e").isNotNull(), F.col("e.row.payload_json")).otherwise(p["payload_json"])
    return folded.filter("p is not null").select(
        *ACTION, p["customer_id"].alias("customer_id"), p["customer_full_name"].alias("customer_full_name"), p["action_type"].alias("action_type"), payload.alias("payload_json"),
        F.coalesce(d["status"], F.lit("pending")).alias("status"), p["event_ts"].alias("created_at"),
        d["event_ts"].alias("decided_at"), d["actor"].alias("decided_by"), p["rationale"].alias("rationale"),
        p["confidence"].alias("confidence"), F.when(s["error"].isNull(), s["event_ts"]).alias("sent_at"),
        s["error"].alias("send_error"),
    )


def action_state(events: DataFrame) -> DataFrame:
    """The current state of every action."""
    return fold(effective_events(events))


def pending_actions(state: DataFrame, n: int = 50) -> DataFrame:
    waiting = state.filter(F.col("status") == "pending")
    return top_per(waiting, ["tenant_id"], [F.col("created_at").desc_nulls_last(), F.col("action_id").asc()], n)


def action_by_id(state: DataFrame, *ids: str) -> DataFrame:
    return state.filter(F.col("action_id").isin(*ids))


def decisions(events: DataFrame) -> DataFrame:
    """The audit trail: one row per decision on an existing action, repeats included."""
    return _trail(effective_events(events))


def state_and_trail(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current state and the audit trail, from events that are cleaned once."""
    effective = settle(effective_events(events), "effective")
    return fold(effective), _trail(effective)


def _trail(effective: DataFrame) -> DataFrame:
    return effective.filter("event_type = 'decide'").select(
        "tenant_id", F.concat(F.lit("DEC-"), F.col("event_seq").cast("string")).alias("decision_id"), "customer_id", "customer_full_name",
        F.col("status").alias("decision"), F.col("actor").alias("decided_by"), F.col("event_ts").alias("decided_at"),
        F.col("notes").alias("decision_notes"), F.col("action_id").alias("related_action_id"),
    )


def decided_actions(state: DataFrame, trail: DataFrame, n: int = 20, latest_only: bool = False) -> DataFrame:
    """Decided actions with their decisions, newest first; one row per decision unless ``latest_only``."""
    d = trail.select("tenant_id", F.col("related_action_id").alias("action_id"), "decision_id", "decision_notes", F.col("decided_at").alias("_when"))
    if not latest_only:
        # the shown list never holds more than ``n`` decisions of one action
        d = top_per(d, ACTION, [F.col("decision_id").asc_nulls_last()], n, "_n").drop("_n")
    if latest_only:
        row = F.struct("_when", "decision_id", "decision_notes")
        d = d.groupBy(*ACTION).agg(F.max(row).alias("r")).select(*ACTION, "r.*")
    done = state.filter(F.col("status").isin(*DECISIONS)).join(d, ACTION, "left").drop("_when")
    order = [F.col("decided_at").desc_nulls_last(), F.col("action_id").asc(), F.col("decision_id").asc_nulls_last()]
    return top_per(done, ["tenant_id"], order, n)


def sendable_emails(state: DataFrame) -> DataFrame:
    """Approved emails with recipient and subject, and why one cannot be sent."""
    emails = state.filter((F.col("action_type") == "send_email") & (F.col("status") == "approved"))
    body = F.coalesce("payload_json", F.lit("{}"))
    to = F.trim(F.coalesce(F.get_json_object(body, "$.to"), F.lit("")))
    subject = F.trim(F.coalesce(F.get_json_object(body, "$.subject"), F.lit("")))
    reason = (
        F.when(F.try_parse_json(body).isNull(), "payload is not JSON")
        .when(to == "", "no recipient")
        .when(~to.contains("@"), "recipient is not an address")
        .when(subject == "", "no subject")
    )
    return emails.select(
        *ACTION, "customer_id", to.alias("send_to"), subject.alias("subject"), reason.isNull().alias("sendable"), reason.alias("reason")
    )


def dedupe_requests(requests: DataFrame, answered: DataFrame, columns: list[str]) -> DataFrame:
    """A tenant's requests not answered yet, one per distinct content.  ``answered`` has (tenant_id, content_key)."""
    key = ["tenant_id", "content_key"]
    keyed = requests.withColumn("content_key", content_key(*columns))
    once = keyed.groupBy(*key).agg(*[F.min(c).alias(c) for c in columns], F.count("*").alias("asked"))
    return once.join(answered.select(*key).distinct(), key, "left_anti")
