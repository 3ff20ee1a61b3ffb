"""Dashboard figures from partial aggregates that are kept per tenant and stored file.

Counts, sums and sentiment of a file are one row per tenant; they are computed once, when the file is new or
changed, and added up when the figures are read.  The top-decile revenue of all files follows
from a histogram of sales per file, whose buckets are in order of the values, and from the values of the one bucket
that holds the cut: each file's distinct values are kept sorted by bucket, so that only these are read.
What joins tables (follow-ups, pending approvals) is computed anew when one of its tables changes.

Everything is kept in keyed tables (streaming/store.py): a file is a key, its newest rows are its
current ones, and a file that is gone has a row without tenant.  Reading takes the newest published version; one
writer refreshes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folio.functions.columns import band_bucket, band_is, blank, sentiment_bucket
from folio.operators import ledger, portfolio
from folio.session import settle
from folio.streaming.store import KeyedTable

#: The stored tables the figures come from.
TABLES = ("customers", "customer_email_logs", "support_tickets", "customer_review_logs", "review_outcomes", "ledger")
#: Histogram buckets for each doubling of the sales value.
STEPS = 32
_NOBODY = "tenant_id is not null"


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0)).cast("double")


def _measures() -> dict[str, Column]:
    band, sales = F.col("risk_band"), F.col("total_sales")
    bands = {f"{b}_count": F.count_if(band_is(band, *names)) for b, names in (("critical", ("critical",)), ("high", ("high",)), ("moderate", ("moderate", "elevated")), ("low", ("low",)))}
    means = ("risk_score", "health_score", "late_delivery_rate")
    return {
        "total_customers": F.count("*"), **bands, "other_count": F.count_if(band_bucket(band) == "stable"),
        **{f"{c}_sum": _sum(F.col(c)) for c in means}, **{f"{c}_rows": F.count(c) for c in means},
        "total_revenue": _sum(sales), "total_profit": _sum(F.col("total_profit")),
        "revenue_at_risk": _sum(F.when(band_is(band, "critical", "high"), sales)),
        "churn_flag_count": F.count_if(~blank(F.col("churn_risk_reason"))),
        "open_ticket_backlog": F.coalesce(F.sum("open_support_ticket_count"), F.lit(0)).cast("bigint"),
    }


def _mood(signal: str) -> dict[str, Column]:
    said = F.col(signal).isNotNull()
    bucket = sentiment_bucket(F.lower(signal))
    return {**{b: F.count_if(said & (bucket == b)) for b in ("positive", "neutral", "negative")}, "total": F.count(signal)}


#: Per table the measures of a file.
PARTS = {"customers": _measures, "customer_email_logs": lambda: _mood("sentiment_hint"), "support_tickets": lambda: _mood("customer_sentiment")}
#: What is computed from whole tables: the value's name and the tables.
WHOLES = {"followups": ("customer_review_logs", "review_outcomes"), "approvals": ("ledger",), "revenue_top10": ("customers",)}
_DOUBLES = ("risk_score_sum", "health_score_sum", "late_delivery_rate_sum", "total_revenue", "total_profit", "revenue_at_risk", "revenue_top10")


def _names() -> list[str]:
    """All measures, in order."""
    return list(dict.fromkeys([n for part in PARTS.values() for n in part()] + list(WHOLES)))


def sales_bucket(value: Column) -> Column:
    """A number that grows with the value, by steps of a 32nd of a doubling; 0 for nothing."""
    size = F.floor(F.log2(F.abs(value) + 1) * STEPS).cast("int") + 1
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0)


class KpiStore:
    """Partial aggregates below ``folder`` for the stored tables at ``paths``."""

    def __init__(self, spark: SparkSession, paths: Mapping[str, str], folder: str, followups: int = 10, approvals: int = 20):
        self.spark, self.paths, self.shown = spark, dict(paths), {"followups": followups, "approvals": approvals}
        # what is read for every figure is small: compacted by every refresh
        self.parts = KeyedTable(spark, f"{folder}/parts", ["file"], buckets=1, compact_every=1)
        self.histogram = KeyedTable(spark, f"{folder}/histogram", ["file"], buckets=1, compact_every=1)
        self.values = KeyedTable(spark, f"{folder}/values", ["file"], buckets=64, compact_every=16, sort_by=("bucket", "tenant_id", "value"))
        self._seen: dict[str, str] | None = None

    # ---- what there is ------------------------------------------------------------------

    def files(self, table: str) -> dict[str, str]:
        """Every file of a table and its stamp: length and time."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[table])
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f for f in fs.listStatus(path) if f.getPath().getName().endswith(".parquet")]
        return {f"{table}/{f.getPath().getName()}": f"{f.getLen()}:{f.getModificationTime()}" for f in found}

    def stamps(self) -> dict[str, str]:
        """What is wanted: the files of the parts, and one stamp over all files of each whole."""
        files = {t: self.files(t) for t in TABLES}
        out = {name: stamp for t in PARTS for name, stamp in files[t].items()}
        for whole, tables in WHOLES.items():
            seen = sorted(x for t in tables for x in files[t].items())
            out[whole] = hashlib.sha256(repr((seen, self.shown.get(whole))).encode()).hexdigest()[:16]
        return out

    def kept(self) -> dict[str, str]:
        """The stamp of every key that is kept; one for each stored file, as a listing of the tables has."""
        if self.parts.manifest().schema is None:
            return {}
        return dict(tuple(r) for r in self.parts.current().filter("stamp <> ''").select("file", "stamp").distinct().collect())

    # ---- refresh ---------------------------------------------------------------------------

    def _row(self, df: DataFrame) -> DataFrame:
        """All measures; those ``df`` lacks are nothing."""
        own = set(df.columns)
        return df.select("file", "stamp", "tenant_id", *[
            (F.coalesce(F.col(n), F.lit(0)) if n in own else F.lit(0)).cast("double" if n in _DOUBLES else "bigint").alias(n) for n in _names()
        ])

    def _read_files(self, table: str, files: list[str], stamps: Mapping[str, str]) -> DataFrame:
        paths = [f"{self.paths[table]}/{f.split('/', 1)[1]}" for f in files]
        stamped = self.spark.createDataFrame([(f, stamps[f]) for f in files], "file string, stamp string")
        df = self.spark.read.parquet(*paths).withColumn("file", F.concat(F.lit(f"{table}/"), F.col("_metadata.file_name")))
        return df.join(stamped, "file")

    def _whole(self, name: str) -> DataFrame:
        read = {t: self.spark.read.parquet(self.paths[t]) for t in WHOLES[name]}
        if name == "revenue_top10":
            return self._top_decile()
        if name == "approvals":
            state = ledger.action_state(read["ledger"]).filter("status = 'pending'")
        else:
            state = portfolio.waiting_reviews(read["customer_review_logs"], read["review_outcomes"])
        return state.groupBy("tenant_id").agg(F.least(F.count("*"), F.lit(self.shown[name])).alias(name))

    def _top_decile(self) -> DataFrame:
        """Sales of the first of ten tiles per tenant: whole buckets above the cut, and the values of the bucket that holds it."""
        buckets = self.histogram.current().filter(_NOBODY).groupBy("tenant_id", "bucket").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
        size = buckets.groupBy("tenant_id").agg(F.ceil(F.sum("rows") / 10).alias("k"))
        above = Window.partitionBy("tenant_id").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        marked = buckets.withColumns({"before": F.coalesce(F.sum("rows").over(above), F.lit(0)), "sum_before": F.coalesce(F.sum("total").over(above), F.lit(0.0))})
        cut = settle(marked.join(size, "tenant_id").filter((F.col("before") < F.col("k")) & (F.col("before") + F.col("rows") >= F.col("k"))).drop("rows", "total"), "cuts")
        # one bucket per tenant: their numbers skip the rest of the sorted values
        wanted = [r[0] for r in cut.select("bucket").distinct().collect()]
        inside = self.values.current().filter(F.col("bucket").isin(wanted)).join(cut, ["tenant_id", "bucket"])
        steps = inside.groupBy("tenant_id", "k", "before", "sum_before", "value").agg(F.sum("rows").alias("rows"))
        higher = Window.partitionBy("tenant_id").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("seen", F.col("before") + F.coalesce(F.sum("rows").over(higher), F.lit(0)))
        taken = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("k") - F.col("seen")))
        return steps.groupBy("tenant_id").agg((F.max("sum_before") + F.sum(taken * F.col("value"))).alias("revenue_top10"))

    def refresh(self) -> list[str]:
        """Bring the partial aggregates up to date; returns the files and wholes that were computed."""
        wanted = self.stamps()
        if wanted == self._seen:
            return []
        kept = self.kept()
        changed = sorted(n for n, stamp in wanted.items() if kept.get(n) != stamp)
        gone = sorted(set(kept) - set(wanted))
        if not changed and not gone:
            self._seen = wanted
            return []
        number = max(t.through() for t in (self.parts, self.histogram, self.values)) + 1
        rows = []
        for table, measures in PARTS.items():
            files = [n for n in changed if n.startswith(f"{table}/")]
            if files:
                df = self._read_files(table, files, wanted)
                made = df.groupBy("file", "stamp", "tenant_id").agg(*[v.alias(n) for n, v in measures().items()])
                empty = self.spark.createDataFrame([(f, wanted[f], None) for f in files], "file string, stamp string, tenant_id string")
                rows += [self._row(made), self._row(empty)]
        sales = [n for n in changed if n.startswith("customers/")]
        missing = [n for n in gone if n.startswith("customers/")]
        if sales or missing:
            self._refresh_sales(sales, missing, wanted, number)
        for whole in WHOLES:
            if whole in changed:
                made = self._whole(whole).withColumns({"file": F.lit(whole), "stamp": F.lit(wanted[whole])})
                empty = self.spark.createDataFrame([(whole, wanted[whole], None)], "file string, stamp string, tenant_id string")
                rows += [self._row(made), self._row(empty)]
        if gone:
            rows.append(self._row(self.spark.createDataFrame([(f, "", None) for f in gone], "file string, stamp string, tenant_id string")))
        # last: only now do the new stamps count
        self.parts.commit(reduce(DataFrame.unionByName, rows), number)
        self._seen = wanted
        return changed

    def _refresh_sales(self, files: list[str], gone: list[str], stamps: Mapping[str, str], number: int) -> None:
        value = F.coalesce("total_sales", F.lit(0.0)).cast("double")
        none = self.spark.createDataFrame([(f,) for f in (*files, *gone)], "file string")
        rows = none.select("file", F.lit(None).cast("string").alias("tenant_id"), F.lit(0).alias("bucket"), F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("rows"))
        if files:
            read = self._read_files("customers", files, stamps).select("file", "tenant_id", sales_bucket(value).alias("bucket"), value.alias("value"))
            rows = rows.unionByName(read.groupBy("file", "tenant_id", "bucket", "value").agg(F.count("*").alias("rows")))
        rows = settle(rows, "sales")
        counted = rows.groupBy("file", "tenant_id", "bucket").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("value")).alias("total"))
        self.histogram.commit(counted, number)
        self.values.commit(rows, number)

    # ---- read --------------------------------------------------------------------------------

    def kpis(self) -> DataFrame:
        """The dashboard figures of every tenant that has accounts, as of the last refresh."""
        kept = self.parts.current().filter(_NOBODY).groupBy("tenant_id").agg(*[F.sum(n).alias(n) for n in _names()]).filter("total_customers > 0")

        def mean(c: str) -> Column:
            return F.when(F.col(f"{c}_rows") > 0, F.col(f"{c}_sum") / F.col(f"{c}_rows")).otherwise(0.0)

        summary = kept.withColumns({f"avg_{c}": mean(c) for c in ("risk_score", "health_score", "late_delivery_rate")})
        return portfolio.kpi_columns(summary.withColumns({"signals": F.col("total"), "net": portfolio.net_sentiment()}))
