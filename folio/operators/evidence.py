"""Evidence bundles, redaction and the labelling set."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from folio.functions.columns import BLIND_DROP_FIELDS, GENERATOR_TAGS, LEAKY_FIELDS, redact, seeded_order
from folio.operators.activity import ACCOUNT, FEED_DATE, recent
from folio.operators.ranking import top_per
from folio.schemas import PRIMARY_KEY, RECORD_COLUMNS
from folio.session import join_small, settle
from folio.sources.binding import Scans

Tables = Mapping[str, DataFrame]

# The feeds of a bundle and the field each fills.
BUNDLE_FEEDS = {
    "orders": "recent_orders",
    "support_tickets": "recent_tickets",
    "customer_notes": "recent_notes",
    "customer_email_logs": "recent_emails",
    "fulfillment_events": "fulfillment_events",
}
PER_FEED = 5
REVIEW_FIELDS = ("reviewed_at", "scenario", "topic", "human_decision", "review_notes")


def _newest(df: DataFrame, feed: str, columns: tuple[str, ...], field: str, n: int, as_of: str | None) -> DataFrame:
    """The newest rows per account as one array.  Cut to ``n`` before they are gathered."""
    if as_of is not None:
        df = df.filter(F.col(FEED_DATE[feed]) <= F.lit(as_of).cast("date"))
    top = recent(df.select(*{*ACCOUNT, *columns, FEED_DATE[feed], PRIMARY_KEY[feed]}), feed, n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("r"))))
    return top.groupBy(*ACCOUNT).agg(F.transform(ordered, lambda x: x["r"]).alias(field))


def evidence_bundle(
    tables: Tables, cases: DataFrame | None = None, per_feed: int = PER_FEED, as_of: str | None = None
) -> DataFrame:
    """One row per account: its profile without leaky fields and its newest records of each feed.

    ``cases`` (tenant_id, customer_id, review_id) gives one bundle per held-out
    review, whose own review is left out of the prior ones after the cut to five.
    """
    customers = tables["customers"]
    shown = [c for c in RECORD_COLUMNS["customers"] if c not in LEAKY_FIELDS]
    who = customers.select(*ACCOUNT, F.struct(*shown).alias("customer"))
    feeds = dict(BUNDLE_FEEDS)
    sources = {f: tables[f] for f in (*feeds, "customer_review_logs")}
    if cases is not None:
        cases = settle(cases.select(*ACCOUNT, "review_id"), "cases")
        wanted = settle(cases.select(*ACCOUNT).distinct(), "wanted")
        who = who.join(wanted, ACCOUNT, "left_semi")
        sources = {f: df.join(wanted, ACCOUNT, "left_semi") for f, df in sources.items()}

    bundle = who
    for feed, field in feeds.items():
        got = _newest(sources[feed], feed, RECORD_COLUMNS[feed], field, per_feed, as_of)
        bundle = bundle.join(got, ACCOUNT, "left").withColumn(field, F.coalesce(field, F.array().cast(got.schema[field].dataType)))
    prior = _newest(
        sources["customer_review_logs"], "customer_review_logs", ("review_id", *REVIEW_FIELDS), "_reviews", per_feed, as_of
    )
    bundle = bundle.join(prior, ACCOUNT, "left")
    reviews = F.coalesce("_reviews", F.array().cast(prior.schema["_reviews"].dataType))
    if cases is not None:
        # written: cases of a busy account are then split by AQE
        bundle = join_small(cases, bundle.withColumn("_reviews", reviews), ACCOUNT, "inner")
        reviews = F.col("_reviews")
        reviews = F.filter(reviews, lambda r: ~r["review_id"].eqNullSafe(F.col("review_id")))
    prior_reviews = F.transform(reviews, lambda r: F.struct(*[r[f].alias(f) for f in REVIEW_FIELDS]))
    extra = ["review_id"] if cases is not None else []
    return bundle.select(*ACCOUNT, *extra, "customer", prior_reviews.alias("prior_reviews"), *feeds.values())


def valid_record_ids(bundle: DataFrame) -> Column:
    """The ids a prediction may cite: every record in the bundle."""
    ids = [F.col(field)[PRIMARY_KEY[feed]] for feed, field in BUNDLE_FEEDS.items()]
    return F.filter(F.array_distinct(F.concat(*ids)), lambda x: x.isNotNull() & (x != ""))


def record_ids(tables: Tables, accounts: DataFrame, per_feed: int = PER_FEED) -> DataFrame:
    """Only the citable ids per account, without building the bundles."""
    out = wanted = settle(accounts.select(*ACCOUNT).distinct(), "wanted")
    # tables read straight from the source leave out the rows of other ids before they join them
    some = settle(wanted.select("customer_id").distinct(), "ids") if isinstance(tables, Scans) else None
    for feed, field in BUNDLE_FEEDS.items():
        df = tables[feed] if some is None else tables.rows_of(feed, some)
        df = df.join(wanted, ACCOUNT, "left_semi")
        columns = {*ACCOUNT, PRIMARY_KEY[feed], FEED_DATE[feed], *(["message_sequence"] if feed == "customer_email_logs" else [])}
        ids = recent(df.select(*columns), feed, per_feed).groupBy(*ACCOUNT).agg(F.collect_set(PRIMARY_KEY[feed]).alias(field))
        out = out.join(ids, ACCOUNT, "left")
    empty = F.array().cast("array<string>")
    valid = F.concat(*[F.coalesce(f, empty) for f in BUNDLE_FEEDS.values()])
    return out.select(*ACCOUNT, F.array_distinct(valid).alias("valid_ids"))


# ---- redaction ---------------------------------------------------------------

def redact_columns(df: DataFrame, columns: list[str], name: str | None = "customer_full_name") -> DataFrame:
    """Hide label tags and the account name in the given text columns."""
    who = F.col(name) if name else None
    return df.withColumns({c: redact(F.col(c), who) for c in columns})


def redact_feeds(tables: Tables) -> DataFrame:
    """Every text column of the records of a bundle's feeds, redacted, in long form."""
    names = tables["customers"].select(*ACCOUNT, F.col("customer_full_name").alias("_name"))
    parts = []
    for feed in BUNDLE_FEEDS:
        df = tables[feed].join(names, ACCOUNT, "left")
        name = F.coalesce("customer_full_name", "_name") if "customer_full_name" in df.columns else F.col("_name")
        texts = [f.name for f in tables[feed].select(*RECORD_COLUMNS[feed]).schema if isinstance(f.dataType, StringType) and f.name not in BLIND_DROP_FIELDS]
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), redact(F.col(c), name).alias("text")) for c in texts])
        record = F.col(PRIMARY_KEY[feed]).cast("string").alias("record_id")
        parts.append(df.select(F.lit(feed).alias("table_name"), "tenant_id", record, F.explode(cells).alias("e")).select("table_name", "tenant_id", "record_id", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def _blind_record(record: Column, schema: StructType, name: Column) -> Column:
    fields = []
    for f in schema:
        if f.name in BLIND_DROP_FIELDS:
            continue
        value = record[f.name]
        fields.append((redact(value, name) if isinstance(f.dataType, StringType) else value).alias(f.name))
    return F.struct(*fields)


def _blinder(schema: StructType, name: Column) -> Callable[[Column], Column]:
    return lambda record: _blind_record(record, schema, name)


def blind_bundle(bundle: DataFrame) -> DataFrame:
    """Bundles without anything that tells the label: tags, names, prior decisions."""
    bundle = bundle.withColumn("_name", F.coalesce(F.col("customer")["customer_full_name"], F.lit("")))
    name = F.col("_name")
    keys = [c for c in (*ACCOUNT, "review_id") if c in bundle.columns]
    out = [_blind_record(F.col("customer"), bundle.schema["customer"].dataType, name).alias("customer")]
    dates = F.transform("prior_reviews", lambda r: r["reviewed_at"])
    out.append(F.filter(dates, lambda d: d.isNotNull()).alias("prior_review_dates"))
    for field in BUNDLE_FEEDS.values():
        array = bundle.schema[field].dataType
        assert isinstance(array, ArrayType)
        out.append(F.transform(field, _blinder(array.elementType, name)).alias(field))
    return bundle.select(*keys, *out)


BLIND_FIELDS = ("customer", "prior_review_dates", *BUNDLE_FEEDS.values())


def leaks(df: DataFrame, columns: tuple[str, ...] | list[str]) -> Column:
    """The label tags and decision fields that still show anywhere in the given columns."""
    text = F.to_json(F.struct(*columns))
    found = [F.when(F.lower(text).contains(t), F.lit(t)) for t in GENERATOR_TAGS]
    field = text.contains('"human_decision"') | text.contains('"review_notes"')
    found.append(F.when(field, F.lit("prior review decision or notes")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def leak_check(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows that still leak and what they leak; none after redaction."""
    return df.withColumn("leak", F.explode(leaks(df, columns)))


# ---- samples -------------------------------------------------------------------

def labelled_reviews(reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decided reviews with the outcome that followed, if any."""
    o = outcomes.select("tenant_id", "review_id", "outcome_status", "follow_up_required", "outcome_type")
    decided = reviews.filter(F.col("human_decision").isNotNull())
    columns = [*ACCOUNT, "review_id", "customer_full_name", "human_decision", "scenario", "topic", "reviewed_at"]
    return decided.select(*columns).join(o, ["tenant_id", "review_id"], "left")


def one_case_per_customer(reviews: DataFrame) -> DataFrame:
    """The decided review with the lowest id of each account (combined before the shuffle)."""
    decided = reviews.filter(F.col("human_decision").isNotNull())
    fields = F.struct("review_id", "human_decision", "reviewed_at")
    return decided.groupBy(*ACCOUNT).agg(F.min_by(fields, "review_id").alias("r")).select(*ACCOUNT, "r.*")


def _balanced(rows: DataFrame, n: int, seed: int, per_class: Column) -> DataFrame:
    """``per_class`` seeded rows of every class per tenant, shuffled, at most ``n``; ``position`` is the order."""
    key = F.col("review_id")
    # no class can give more than this many rows: lets every task cut early
    most = max(2, n)
    draw = [seeded_order(seed, key).asc(), key.asc()]
    ranked = top_per(rows, ["tenant_id", "human_decision"], draw, most, "_draw")
    classes = rows.groupBy("tenant_id", "human_decision").agg(F.lit(1).alias("one"))
    classes = classes.groupBy("tenant_id").agg(F.count("*").alias("classes"))
    picked = ranked.join(classes, "tenant_id").filter(F.col("_draw") <= per_class)
    order = [seeded_order(seed + 1, key).asc(), key.asc()]
    return top_per(picked.drop("classes", "_draw"), ["tenant_id"], order, n, "position")


def stratified_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n // classes`` seeded rows of every class, whatever the order of the input."""
    return _balanced(rows, n, seed, F.floor(F.lit(n) / F.greatest("classes", F.lit(1))))


def holdout(reviews: DataFrame, outcomes: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded evaluation set: at least two rows per decision, cut to ``n``."""
    rows = labelled_reviews(reviews, outcomes)
    return _balanced(rows, n, seed, F.greatest(F.lit(2), F.floor(F.lit(n) / F.col("classes"))))


def label_cases(tables: Tables, n: int = 80, seed: int = 7) -> DataFrame:
    """Blind cases for people to label: one review per account, balanced by decision.

    Case ids follow the shuffled position; a case without an account is skipped and
    leaves a gap.  A case that still leaks fails the query.
    """
    sample = stratified_sample(one_case_per_customer(tables["customer_review_logs"]), n, seed)
    chosen = settle(sample.select(*ACCOUNT, "review_id", "position", F.col("reviewed_at").alias("review_date")), "chosen")
    blind = settle(blind_bundle(evidence_bundle(tables, chosen)), "blind")
    found = leaks(blind, BLIND_FIELDS)
    message = F.concat(F.lit("case for review "), "review_id", F.lit(" still reveals: "), F.array_join(found, ", "))
    # a filter, so that the check runs whatever columns are read later
    clean = F.when(F.size(found) > 0, F.raise_error(message)).otherwise(F.lit(True))
    bundles = blind.filter(clean).select(*ACCOUNT, "review_id", F.struct(*BLIND_FIELDS).alias("bundle"))
    case_id = F.format_string("H%03d", F.col("position"))
    return chosen.join(bundles, [*ACCOUNT, "review_id"]).select(
        "tenant_id", case_id.alias("case_id"), "review_id", "customer_id", "review_date", "bundle"
    )
