"""Finding, filtering and ranking accounts.

Every function works on all tenants at once; filter with ``for_tenant`` first to
serve one.  Sorts are total: the account id breaks every tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.columns import band_is
from folio.operators.ranking import top_per
from folio.session import settle

# Profile fields and the names they are shown under.
SLIM_PROFILE = {
    "customer_id": "customer_id",
    "name": "customer_full_name",
    "email": "customer_email",
    "segment": "customer_segment",
    "country": "customer_country",
    "total_orders": "total_orders",
    "total_sales": "total_sales",
    "total_profit": "total_profit",
    "late_delivery_rate": "late_delivery_rate",
    "support_ticket_count": "support_ticket_count",
    "open_tickets": "open_support_ticket_count",
    "risk_score": "risk_score",
    "risk_band": "risk_band",
    "health_score": "health_score",
    "lifecycle_stage": "lifecycle_stage",
    "churn_risk_reason": "churn_risk_reason",
    "next_best_action": "next_best_action",
    "last_review_decision": "last_review_decision",
}


def by_risk() -> list[Column]:
    return [F.col("risk_score").desc_nulls_last(), F.col("customer_id").asc()]


def slim_profile(customers: DataFrame) -> DataFrame:
    return customers.select("tenant_id", *[F.col(c).alias(n) for n, c in SLIM_PROFILE.items()])


def accounts_by_id(customers: DataFrame, *ids: str) -> DataFrame:
    return customers.filter(F.col("customer_id").isin(*ids))


def account_by_name(customers: DataFrame, name: str) -> DataFrame:
    """The riskiest account of that exact name, whatever its case, per tenant."""
    hits = customers.filter(F.lower("customer_full_name") == F.lower(F.lit(name)))
    return top_per(hits, ["tenant_id"], by_risk(), 1).drop("rank")


def search_accounts(customers: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Accounts whose name or email contains the text, riskiest first.

    The text is literal: ``%`` and ``_`` are not wildcards.
    """
    needle = text.lower()
    hit = F.lower("customer_full_name").contains(needle) | F.lower("customer_email").contains(needle)
    return top_per(customers.filter(hit), ["tenant_id"], by_risk(), limit)


def search_prefix(customers: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    hits = customers.filter(F.lower("customer_full_name").startswith(prefix.lower()))
    return top_per(hits, ["tenant_id"], by_risk(), limit)


def by_band(customers: DataFrame, band: str, limit: int = 50) -> DataFrame:
    """Accounts whose band contains the text; riskiest first within the limit."""
    return top_per(customers.filter(band_is(F.col("risk_band"), band.lower())), ["tenant_id"], by_risk(), limit)


def top_at_risk(customers: DataFrame, n: int = 10, band: str = "") -> DataFrame:
    """The riskiest accounts, optionally of one band (filtered before the cut)."""
    pool = customers.filter(band_is(F.col("risk_band"), band.lower())) if band else customers
    return top_per(pool, ["tenant_id"], by_risk(), n)


def top_healthy(customers: DataFrame, n: int = 60) -> DataFrame:
    """The least risky accounts that have sales."""
    order = [F.col("risk_score").asc_nulls_last(), F.col("total_sales").desc_nulls_last(), F.col("customer_id").asc()]
    return top_per(customers.filter(F.coalesce("total_sales", F.lit(0.0)) > 0), ["tenant_id"], order, n)


def top_by_revenue(customers: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    sales = F.col("total_sales")
    first = sales.asc_nulls_last() if ascending else sales.desc_nulls_last()
    return top_per(customers, ["tenant_id"], [first, F.col("customer_id").asc()], n)


def _page(customers: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    ranked = top_per(customers, ["tenant_id"], order, offset + limit)
    return ranked.filter(F.col("rank") > offset)


def page_accounts(customers: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the book in risk order; pages never overlap."""
    return _page(customers, by_risk(), limit, offset)


def directory(
    customers: DataFrame,
    sort_key: str = "risk_score",
    descending: bool = True,
    band: str = "",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page sorted by risk, name, revenue or late rate; missing numbers sort as 0."""
    keys = {
        "risk_score": F.coalesce("risk_score", F.lit(0.0)),
        "name": F.lower("customer_full_name"),
        "revenue": F.coalesce("total_sales", F.lit(0.0)),
        "late_rate": F.coalesce("late_delivery_rate", F.lit(0.0)),
    }
    pool = customers.filter(band_is(F.col("risk_band"), band.lower())) if band else customers
    pool = pool.withColumn("sort_value", keys[sort_key])
    first = F.col("sort_value").desc_nulls_last() if descending else F.col("sort_value").asc_nulls_last()
    return _page(pool, [first, F.col("customer_id").asc()], limit, offset).drop("sort_value")


def resolve_ids(customers: DataFrame, requests: DataFrame) -> DataFrame:
    """Comma-separated id lists to slim profiles, list order kept, unknown ids dropped.

    ``requests`` has (tenant_id, request_id, customer_ids).
    """
    items = requests.select("tenant_id", "request_id", F.posexplode(F.split("customer_ids", ",")).alias("pos", "item"))
    items = items.select("tenant_id", "request_id", "pos", F.trim("item").alias("customer_id")).filter("customer_id <> ''")
    return items.join(slim_profile(customers), ["tenant_id", "customer_id"])


# ---- names -------------------------------------------------------------

NAME_END = "\u0001"
GRAM = 3


def find_containing(customers: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs of a needle and an account whose name or email contains it.

    ``needles`` has (tenant_id, needle), lower-case and not empty.  A place in an
    account's text is kept if the first three characters there begin some needle
    (shorter needles count whole); the substrings at the kept places, of the lengths
    that occur among the needles, then meet the needles by equality.  Only true pairs
    come out, and no account is compared with every needle.

    Both steps are semi joins with written needles: these are broadcast while they are
    small, and the growing side never is, whatever size the planner expects of it.
    """
    needles = settle(needles.select("tenant_id", "needle").filter("needle <> ''").distinct(), "needles")
    head = F.substring("needle", 1, GRAM)
    heads = needles.select("tenant_id", head.alias("head")).distinct()
    head_sizes = needles.select(F.collect_set(F.length(head))).scalar()
    sizes = needles.select(F.collect_set(F.length("needle"))).scalar()

    low_name = F.lower("customer_full_name")
    # every account grows into many pieces: spread the accounts over all cores first
    spread = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = customers.repartition(spread, "tenant_id", "customer_id").select(
        "tenant_id", "customer_id", "risk_score", low_name.alias("low_name"),
        F.concat_ws(NAME_END, low_name, F.lower("customer_email")).alias("text"),
    )
    starts = texts.select("*", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("start"), head_sizes.alias("sizes"))
    starts = starts.select("*", F.explode("sizes").alias("size")).drop("sizes")
    starts = starts.withColumn("head", F.substr("text", F.col("start"), F.col("size"))).drop("size")
    places = starts.join(heads, ["tenant_id", "head"], "left_semi").drop("head")
    pieces = places.select("*", sizes.alias("sizes")).select("*", F.explode("sizes").alias("size")).drop("sizes")
    pieces = pieces.filter(F.col("start") + F.col("size") <= F.length("text") + 1)
    pieces = pieces.withColumn("needle", F.substr("text", F.col("start"), F.col("size")))
    found = pieces.join(needles, ["tenant_id", "needle"], "left_semi")
    once = found.select("tenant_id", "needle", "customer_id", "risk_score", "low_name")
    return once.dropDuplicates(["tenant_id", "needle", "customer_id"])


def resolve_names(
    customers: DataFrame,
    requests: DataFrame,
    search_limit: int = 5,
    suggestion_limit: int = 5,
    pick: bool = True,
    containing: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Typed names to accounts, for a batch of (tenant_id, request).

    ``containing`` finds the accounts that contain a needle; a stored index (name_index.py) does so
    without reading every account.

    1. An exact name (any case) gives ``exact``: the riskiest such account at rank 1,
       then same-name accounts among the six riskiest that contain the name.
    2. Otherwise accounts containing the text: one gives ``match``, several give
       ``ambiguous`` with the riskiest at rank 1 (``pick=False`` calls them ``choose``).
    3. Otherwise, for two or more words, accounts containing the last word: ``suggestion``.
    4. Otherwise ``not_found`` with no account.
    """
    asked = requests.select("tenant_id", "request").distinct().withColumn("needle", F.lower(F.trim("request")))
    words = F.filter(F.split("needle", r"\s+"), lambda w: w != "")
    asked = asked.withColumn("last_word", F.when(F.size(words) >= 2, F.element_at(words, -1)))

    per_needle = ["tenant_id", "needle"]
    tails = asked.select("tenant_id", F.col("last_word").alias("needle")).filter("needle is not null")
    needles = settle(asked.select(*per_needle).unionByName(tails).distinct(), "asked")

    same_name = (F.col("low_name") == F.col("needle")).alias("same_name")
    pairs = containing(needles) if containing else find_containing(customers, needles)
    near = top_per(pairs, per_needle, by_risk(), max(6, search_limit, suggestion_limit))
    near = near.groupBy(*per_needle).agg(F.array_sort(F.collect_list(F.struct("rank", "customer_id", same_name))).alias("near"))
    # the riskiest account of a name, unknown risk last, combined before the shuffle
    order = F.struct(F.col("risk_score").isNull(), -F.col("risk_score"), "customer_id")
    named = customers.select("tenant_id", "customer_id", "risk_score", F.lower("customer_full_name").alias("needle"))
    exact = named.join(needles, per_needle, "left_semi").groupBy(*per_needle).agg(F.min_by("customer_id", order).alias("exact_id"))
    # one row per needle, read for the whole request and for its last word
    known = settle(near.join(exact, per_needle, "left"), "known")

    tail = known.select("tenant_id", F.col("needle").alias("last_word"), F.col("near").alias("tail"))
    rows = asked.join(known, per_needle, "left").join(tail, ["tenant_id", "last_word"], "left")
    is_exact, some = F.col("exact_id").isNotNull(), F.coalesce(F.size("near"), F.lit(0))
    namesakes = F.filter("near", lambda n: n["same_name"] & (n["rank"] <= 6) & (n["customer_id"] != F.col("exact_id")))
    outcome = (
        F.when(is_exact, "exact").when(some == 1, "match").when(some > 1, "ambiguous" if pick else "choose")
        .when(F.size("tail") > 0, "suggestion").otherwise("not_found")
    )
    ids = (
        F.when(is_exact, F.concat(F.array("exact_id"), namesakes["customer_id"]))
        .when(some > 0, F.slice(F.col("near")["customer_id"], 1, search_limit))
        .otherwise(F.slice(F.col("tail")["customer_id"], 1, suggestion_limit))
    )
    answers = rows.select("tenant_id", "request", outcome.alias("outcome"), F.posexplode_outer(ids).alias("pos", "customer_id"))
    shown = customers.select("tenant_id", "customer_id", "customer_full_name", "risk_band", "customer_country")
    return answers.join(shown, ["tenant_id", "customer_id"], "left").select(
        "tenant_id", "request", "outcome", (F.col("pos") + 1).alias("rank"), "customer_id", "customer_full_name", "risk_band", "customer_country"
    )


# ---- small facets --------------------------------------------------------

def pending_outcomes(outcomes: DataFrame, limit: int = 50) -> DataFrame:
    waiting = outcomes.filter(F.col("outcome_status") == "Pending")
    return top_per(waiting, ["tenant_id"], [F.col("outcome_id").asc()], limit)


def outcome_for_review(outcomes: DataFrame, *review_ids: str) -> DataFrame:
    return outcomes.filter(F.col("review_id").isin(*review_ids))


def action_types(actions: DataFrame) -> DataFrame:
    return actions.select("tenant_id", "action_type").distinct().orderBy("tenant_id", "action_type")


def actions_of_type(actions: DataFrame, action_type: str) -> DataFrame:
    return actions.filter(F.col("action_type") == action_type)
