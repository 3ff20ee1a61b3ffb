"""Portfolio roll-ups: summary, revenue concentration, sentiment, lanes, follow-ups, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.functions.columns import band_bucket, band_is, blank, half_up, lane, sentiment_bucket, share
from folio.operators.accounts import by_risk
from folio.operators.activity import ACCOUNT
from folio.operators.ranking import top_per
from folio.session import join_small, settle

# percentile_approx is within one part in this many of the exact rank
ACCURACY = 10_000
# the bracket is this many times wider than the sketch's error
MARGIN = 5.0
# tenants up to this size skip the bracket and rank all their distinct values
SMALL_TENANT = 100_000


def _band_counts() -> list[Column]:
    band = F.col("risk_band")
    return [
        F.count_if(band_is(band, "critical")).alias("critical_count"),
        F.count_if(band_is(band, "high")).alias("high_count"),
        F.count_if(band_is(band, "moderate", "elevated")).alias("moderate_count"),
        F.count_if(band_is(band, "low")).alias("low_count"),
    ]


def top_decile_revenue(customers: DataFrame, small_tenant: int = SMALL_TENANT, margin: float = MARGIN) -> DataFrame:
    """Revenue of the first of ten sales tiles per tenant, without ranking a tenant in one task.

    The first tile holds k = ceil(n / 10) accounts.  A quantile sketch brackets the
    k-th sales value; everything above the bracket is only summed and counted, and
    the distinct values inside it (a thousandth of the accounts of a large tenant)
    are walked down to the k-th account.  Equal values are one row, whatever their
    number.  The sketch's error bound keeps the cut inside the bracket; should it not
    be there, the query fails instead of answering wrong.
    """
    value = F.coalesce("total_sales", F.lit(0.0))
    spread = margin / ACCURACY
    sized = customers.groupBy("tenant_id").agg(
        F.count("*").alias("n"),
        F.percentile_approx(value, [0.9 - spread, 0.9 + spread], ACCURACY).alias("cut"),
    )
    everything = F.col("n") <= small_tenant
    bracket = sized.select(
        "tenant_id",
        F.ceil(F.col("n") / 10).alias("k"),
        F.when(everything, F.lit(float("-inf"))).otherwise(F.col("cut")[0]).alias("low"),
        F.when(everything, F.lit(float("inf"))).otherwise(F.col("cut")[1]).alias("high"),
    )
    marked = join_small(customers.select("tenant_id", value.alias("value")), bracket, ["tenant_id"], "inner")
    marked = marked.filter(F.col("value") >= F.col("low"))
    inside = F.when(F.col("value") <= F.col("high"), F.col("value"))
    # one row per tenant and distinct value inside the bracket, one row for all above it
    steps = marked.groupBy("tenant_id", "k", inside.alias("step")).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    downward = Window.partitionBy("tenant_id").orderBy(F.col("step").desc_nulls_first())
    steps = steps.withColumn("seen", F.sum("rows").over(downward.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("seen") - F.col("rows")
    taken = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("k") - before))
    part = F.when(taken == F.col("rows"), F.col("total")).otherwise(taken * F.coalesce("step", F.lit(0.0)))
    above = F.coalesce(F.max(F.when(F.col("step").isNull(), F.col("rows"))), F.lit(0))
    misplaced = (above > F.max("k")) | (F.max("seen") < F.max("k"))
    result = steps.groupBy("tenant_id").agg(F.sum(part).alias("revenue_top10"), misplaced.alias("_misplaced"))
    checked = F.when(F.col("_misplaced"), F.raise_error(F.lit("decile cut outside its bracket"))).otherwise(F.col("revenue_top10"))
    return result.select("tenant_id", checked.cast("double").alias("revenue_top10"))


def portfolio_summary(customers: DataFrame) -> DataFrame:
    """Fourteen measures per tenant, missing ones as 0, plus the accounts in none of the four bands."""
    band, sales = F.col("risk_band"), F.col("total_sales")
    at_risk = band_is(band, "critical", "high")
    counted = customers.groupBy("tenant_id").agg(
        F.count("*").alias("total_customers"),
        *_band_counts(),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("health_score").alias("avg_health_score"),
        F.sum(sales).alias("total_revenue"),
        F.sum("total_profit").alias("total_profit"),
        F.sum(F.when(at_risk, sales).otherwise(F.lit(0.0))).alias("revenue_at_risk"),
        F.avg("late_delivery_rate").alias("avg_late_delivery_rate"),
        F.count_if(~blank(F.col("churn_risk_reason"))).alias("churn_flag_count"),
        F.sum(F.coalesce("open_support_ticket_count", F.lit(0))).cast("bigint").alias("open_ticket_backlog"),
        F.count_if(band_bucket(band) == "stable").alias("other_count"),
    )
    # the sketch has a pass of its own: together with it the plain measures would lose their generated code
    joined = counted.join(top_decile_revenue(customers), "tenant_id", "left")
    return joined.select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "tenant_id"])


def v_portfolio_summary(customers: DataFrame) -> DataFrame:
    """The ten-column summary view; averages and sums of nothing stay null."""
    return customers.groupBy("tenant_id").agg(
        F.count("*").alias("total_customers"),
        *_band_counts(),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("health_score").alias("avg_health_score"),
        F.sum("total_sales").alias("total_revenue"),
        F.sum("total_profit").alias("total_profit"),
    )


# ---- sentiment -------------------------------------------------------------

def sentiment_signals(emails: DataFrame, tickets: DataFrame, strict: bool = False) -> DataFrame:
    """Every email hint and ticket sentiment, lower-cased and put into a bucket."""
    said = emails.select(*ACCOUNT, F.col("sentiment_hint").alias("signal")).unionByName(
        tickets.select(*ACCOUNT, F.col("customer_sentiment").alias("signal"))
    )
    said = said.filter(F.col("signal").isNotNull()).withColumn("signal", F.lower("signal"))
    return said.withColumn("bucket", sentiment_bucket(F.col("signal"), strict))


def _bucket_counts() -> list[Column]:
    return [F.count_if(F.col("bucket") == b).alias(b) for b in ("positive", "neutral", "negative")] + [
        F.count("*").alias("total")
    ]


def net_sentiment() -> Column:
    """Positive minus negative in percent of all signals, ties to even; 0 without signals."""
    percent = (F.col("positive") - F.col("negative")) / F.col("total") * 100
    return F.when(F.col("total") > 0, F.bround(percent, 0)).otherwise(F.lit(0.0)).cast("bigint")


def portfolio_sentiment(emails: DataFrame, tickets: DataFrame, strict: bool = False) -> DataFrame:
    counted = sentiment_signals(emails, tickets, strict).groupBy("tenant_id").agg(*_bucket_counts())
    return counted.withColumn("net", net_sentiment())


def customer_sentiment(emails: DataFrame, tickets: DataFrame, customers: DataFrame, strict: bool = False) -> DataFrame:
    """One row per given account; all zeros where nothing was said."""
    counted = sentiment_signals(emails, tickets, strict).groupBy(*ACCOUNT).agg(*_bucket_counts())
    filled = customers.select(*ACCOUNT).join(counted, ACCOUNT, "left").fillna(
        0, ["positive", "neutral", "negative", "total"]
    )
    return filled.withColumn("net", net_sentiment())


def band_distribution(customers: DataFrame) -> DataFrame:
    return customers.groupBy("tenant_id", band_bucket(F.col("risk_band")).alias("bucket")).agg(F.count("*").alias("accounts"))


# ---- lanes and cards ---------------------------------------------------------

def with_lane(customers: DataFrame) -> DataFrame:
    return customers.withColumn(
        "lane", lane(F.col("open_support_ticket_count"), F.col("late_delivery_rate"), F.col("health_score"))
    )


def lane_counts(customers: DataFrame) -> DataFrame:
    return with_lane(customers).groupBy("tenant_id", "lane").agg(F.count("*").alias("accounts"))


def lanes(customers: DataFrame, featured: int = 3) -> DataFrame:
    """The featured accounts of each lane, riskiest first."""
    return top_per(with_lane(customers), ["tenant_id", "lane"], by_risk(), featured)


def account_cards(customers: DataFrame, emails: DataFrame, tickets: DataFrame, n: int = 60) -> DataFrame:
    """The riskiest accounts with their lane and sentiment; only their signals are counted."""
    cards = settle(with_lane(top_per(customers, ["tenant_id"], by_risk(), n)), "cards")
    chosen = cards.select(*ACCOUNT)
    mood = customer_sentiment(emails.join(chosen, ACCOUNT, "left_semi"), tickets.join(chosen, ACCOUNT, "left_semi"), chosen)
    return cards.join(mood, ACCOUNT)


def waiting_reviews(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Reviews whose outcome is pending, flagged or absent."""
    o = outcomes.select("tenant_id", "review_id", "outcome_id", "outcome_status", "follow_up_required", "outcome_date")
    r = reviews.select(*ACCOUNT, "review_id", "customer_full_name", "scenario", "topic", "reviewed_at", "human_decision")
    open_ = (F.col("outcome_status") == "Pending") | F.col("follow_up_required") | F.col("outcome_id").isNull()
    return r.join(o, ["tenant_id", "review_id"], "left").filter(open_)


def pending_followups(reviews: DataFrame, outcomes: DataFrame, customers: DataFrame, n: int = 12) -> DataFrame:
    """Reviews whose outcome is pending, flagged or absent; riskiest account first, then newest review."""
    c = customers.select(*ACCOUNT, "risk_band", "risk_score", "next_best_action")
    waiting = waiting_reviews(reviews, outcomes).join(c, ACCOUNT, "left")
    order = [
        F.col("risk_score").desc_nulls_last(), F.col("reviewed_at").desc_nulls_last(),
        F.col("review_id").asc(), F.col("outcome_id").asc_nulls_last(),
    ]
    return top_per(waiting, ["tenant_id"], order, n)


# ---- KPIs ----------------------------------------------------------------------

def queue_counts(followups: DataFrame, actions: DataFrame) -> DataFrame:
    """Shown follow-ups and pending approvals per tenant."""
    both = followups.select("tenant_id", F.lit(1).alias("f"), F.lit(0).alias("a")).unionByName(
        actions.select("tenant_id", F.lit(0).alias("f"), F.lit(1).alias("a"))
    )
    return both.groupBy("tenant_id").agg(F.sum("f").alias("followups"), F.sum("a").alias("approvals"))


def portfolio_kpis(summary: DataFrame, sentiment: DataFrame, queue: DataFrame) -> DataFrame:
    """Dashboard figures per tenant; a ratio with an empty denominator is 0."""
    mood = sentiment.select("tenant_id", "positive", "neutral", "negative", F.col("total").alias("signals"), "net")
    joined = summary.join(mood, "tenant_id", "left").join(queue, "tenant_id", "left").fillna(
        0, ["positive", "neutral", "negative", "signals", "net", "followups", "approvals"]
    )
    return kpi_columns(joined)


def kpi_columns(joined: DataFrame) -> DataFrame:
    """The figures from one row per tenant with the measures of the summary, sentiment and queue."""
    n, revenue, profit = F.col("total_customers"), F.col("total_revenue"), F.col("total_profit")
    at_risk = F.col("critical_count") + F.col("high_count")
    percent = F.lit(100.0)
    return joined.select(
        "tenant_id",
        "total_customers",
        "total_revenue",
        at_risk.alias("at_risk"),
        half_up(share(at_risk, n) * percent).alias("at_risk_pct"),
        "revenue_at_risk",
        (F.col("followups") + F.col("approvals")).alias("queue"),
        share(revenue, n).alias("avg_deal"),
        (share(profit, revenue) * percent).alias("margin_pct"),
        F.greatest(F.lit(0.0), revenue - profit).alias("cost"),
        F.col("avg_health_score").alias("avg_health"),
        (F.col("avg_late_delivery_rate") * percent).alias("late_pct"),
        (share(F.col("churn_flag_count"), n) * percent).alias("churn_pct"),
        share(F.col("open_ticket_backlog"), n).alias("backlog_per_customer"),
        (share(F.col("revenue_top10"), revenue) * percent).alias("concentration_pct"),
        *[(share(F.col(f"{b}_count"), n) * percent).alias(f"{b}_pct") for b in ("critical", "high", "moderate", "low")],
        *[(share(F.col(b), F.col("signals")) * percent).alias(f"{b}_pct") for b in ("positive", "neutral", "negative")],
        F.col("net").alias("net_sentiment"),
    )


# Where a figure turns good or okay; ">=" means larger is better.
TONE_LIMITS = (
    ("margin_pct", ">=", 20, 10),
    ("avg_health", ">=", 70, 40),
    ("late_pct", "<=", 10, 25),
    ("concentration_pct", "<", 40, 60),
    ("churn_pct", "<=", 5, 15),
    ("backlog_pct", "<=", 20, 50),
    ("at_risk_pct", "<", 20, 20),
    ("net_sentiment", ">=", 25, -24),
)


def _tone(value: Column, test: str, good: float, okay: float) -> Column:
    def passes(limit: float) -> Column:
        return {">=": value >= limit, "<=": value <= limit, "<": value < limit}[test]

    return F.when(passes(good), "good").when(passes(okay), "okay").otherwise("warn")


def kpi_tones(kpis: DataFrame) -> DataFrame:
    """One row per tenant and figure: its value and whether it is good, okay or a warning."""
    wide = kpis.withColumn("backlog_pct", F.col("backlog_per_customer") * 100)
    rows = [
        F.struct(
            F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
            _tone(F.col(name), test, good, okay).alias("tone"),
        )
        for name, test, good, okay in TONE_LIMITS
    ]
    return wide.select("tenant_id", F.explode(F.array(*rows)).alias("row")).select("tenant_id", "row.*")
