"""Classifications and labels as column expressions (no Python UDF anywhere)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Sentiment keywords, tested positive first.
POSITIVE_WORDS = ("posit", "happy", "satisf", "pleas", "stable", "resolved", "delight")
POSITIVE_EXACT = ("good",)
NEGATIVE_WORDS = ("negat", "concern", "frust", "angry", "upset", "critical", "dissat", "urgent")

# The review decisions, mildest first.
DECISIONS = ("Monitor", "Stabilize", "Escalate")

# Tags that give a label away, and fields a blind record must not carry.
GENERATOR_TAGS = (
    "escalation_retention_case",
    "executive_escalation",
    "late_delivery_frustration",
    "late_delivery_recovery",
)
BLIND_DROP_FIELDS = (
    "scenario",
    "topic",
    "tenant_id",
    "customer_email",
    "customer_full_name",
    "source_signal_ids",
    "synthetic_flag",
    "decision_boundary",
)
# Profile fields derived together with the label.
LEAKY_FIELDS = (
    "risk_score",
    "risk_band",
    "health_score",
    "lifecycle_stage",
    "churn_risk_reason",
    "next_best_action",
    "last_review_decision",
    "data_quality_flags",
)

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?:\+?[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(text: Column, words) -> Column:
    return any_of(text.contains(word) for word in words)


def sentiment_bucket(text: Column, strict: bool = False) -> Column:
    """positive / neutral / negative by keyword.

    By default positive words are tested first, so ``Dissatisfied`` and
    ``Unresolved`` count as positive; ``strict`` tests the negative words first.
    """
    lowered = F.lower(text)
    positive = has_any(lowered, POSITIVE_WORDS) | lowered.isin(*POSITIVE_EXACT)
    negative = has_any(lowered, NEGATIVE_WORDS)
    if strict:
        return F.when(negative, "negative").when(positive, "positive").otherwise("neutral")
    return F.when(positive, "positive").when(negative, "negative").otherwise("neutral")


def band_is(band: Column, *words: str) -> Column:
    """Case-insensitive substring test; null stays null."""
    return has_any(F.lower(band), words)


def band_bucket(band: Column) -> Column:
    """First match wins; a missing or unknown band is ``stable``."""
    return (
        F.when(band_is(band, "critical"), "critical")
        .when(band_is(band, "high"), "high")
        .when(band_is(band, "moderate", "elevated"), "moderate")
        .when(band_is(band, "low"), "low")
        .otherwise("stable")
    )


def lane(open_tickets: Column, late_rate: Column, health: Column) -> Column:
    """The primary concern of an account."""
    return (
        F.when(F.coalesce(open_tickets, F.lit(0)) > 0, "open_tickets")
        .when(F.coalesce(late_rate, F.lit(0.0)) > 0.5, "late_deliveries")
        .when(F.coalesce(health, F.lit(100.0)) < 30, "health_concerns")
        .otherwise("watch_list")
    )


def half_up(value: Column) -> Column:
    """Round half up to a whole number, as a browser does."""
    return F.floor(value + F.lit(0.5))


def recency_label(day: Column, as_of: Column) -> Column:
    """``in 3d``, ``today``, ``yesterday``, ``12d ago``, ``4mo ago``, ``2y ago``."""
    days = F.datediff(as_of, day)

    def text(number: Column, suffix: str) -> Column:
        return F.concat(number.cast("string"), F.lit(suffix))

    return (
        F.when(days.isNull(), "—")
        .when(days < 0, F.concat(F.lit("in "), text(-days, "d")))
        .when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 30, text(days, "d ago"))
        .when(days < 365, text(half_up(days / F.lit(30.0)), "mo ago"))
        .otherwise(text(half_up(days / F.lit(365.0)), "y ago"))
    )


def money_label(amount: Column) -> Column:
    """``$640``, ``$12.5k``, ``$1.2M``; a missing amount is a dash."""
    size = F.abs(amount)
    sign = F.when(amount < 0, "-").otherwise("")

    def tenths(unit: float, suffix: str) -> Column:
        t = half_up(size / F.lit(unit / 10))
        whole = F.floor(t / F.lit(10))
        return F.concat(
            F.lit("$"), sign, whole.cast("string"), F.lit("."), (t - whole * 10).cast("string"), F.lit(suffix)
        )

    return (
        F.when(amount.isNull(), "—")
        .when(size >= 1_000_000, tenths(1_000_000.0, "M"))
        .when(size >= 1_000, tenths(1_000.0, "k"))
        .otherwise(F.concat(F.lit("$"), sign, half_up(size).cast("string")))
    )


def or_else(text: Column, default: str) -> Column:
    """The text, or a default where it is null or empty."""
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def blank(text: Column) -> Column:
    """True for null, empty and space-only text."""
    return F.coalesce(F.trim(text), F.lit("")) == ""


def normalise_decision(text: Column) -> Column:
    """One of the three decisions whatever the case and padding, else null."""
    cleaned = F.lower(F.trim(text))
    chosen = F.lit(None).cast("string")
    for decision in DECISIONS:
        chosen = F.when(cleaned == decision.lower(), decision).otherwise(chosen)
    return chosen


def action_level(decision: Column) -> Column:
    """How active a decision is: 1 monitor, 2 stabilize, 3 escalate, 0 anything else."""
    cleaned = F.lower(decision)
    level = F.lit(0)
    for number, name in enumerate(DECISIONS, start=1):
        level = F.when(cleaned == name.lower(), number).otherwise(level)
    return level


def priority_rank(priority: Column) -> Column:
    """Critical 0, High 1, Medium 2, Low 3; anything else counts as Medium."""
    return (
        F.when(priority == "Critical", 0).when(priority == "High", 1).when(priority == "Low", 3).otherwise(2)
    )


def seeded_order(seed: int, *keys: Column) -> Column:
    """A sort key that shuffles rows the same way on every engine and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_int(seed: int, purpose: str, key: Column) -> Column:
    """A non-negative 32-bit number drawn from the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def content_key(*columns: str) -> Column:
    """First 24 hex digits of the SHA-256 of the row as JSON with its keys in order."""
    ordered = [F.col(name) for name in sorted(columns)]
    as_json = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(as_json, 256), 1, 24)


def literal_pattern(text: Column) -> Column:
    """A case-insensitive regular expression matching the text itself."""
    return F.concat(F.lit("(?iu)"), F.regexp_replace(text, r"([^\p{L}\p{N} ])", r"\\$1"))


def redact(text: Column, name: Column | None = None) -> Column:
    """Hide the label tags, then the account name."""
    out = F.regexp_replace(text, "(?iu)" + "|".join(GENERATOR_TAGS), "[redacted]")
    if name is None:
        return out
    hidden = F.regexp_replace(out, literal_pattern(name), F.lit("the customer"))
    return F.when(F.coalesce(name, F.lit("")) == "", out).otherwise(hidden)


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
