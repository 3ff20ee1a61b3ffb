"""A stored index of the character grams of account names and emails.

A posting says that a gram (of one to three, six or twelve characters) occurs in an account's lower-case name or email.
A needle is looked up by grams of the largest size that it has: three characters of an id occur in ever more accounts
as the book grows, twelve in few. Postings lie in partitions by hash of the gram, sorted by tenant and gram, so a batch of needles reads the partitions and row
groups of its own grams only.  A needle's candidates are the accounts that its ``rarest`` rarest grams have in common;
the text decides.  With one gram the candidates need no shuffle of their own; more are worth it
where texts are long and each gram is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio.operators.accounts import NAME_END, by_risk
from folio.operators.ranking import top_per
from folio.session import settle

GRAM = 3
SIZES = (1, 2, GRAM, 6, 12)
PARTS = 64
#: Postings, about, that a task sorts, and grams that it counts: its memory does not grow with the book.
TASK_ROWS = 1_000_000
PART = "part"
POSTINGS = "tenant_id string, customer_id string, gram string, part int"
TEXTS = "tenant_id string, customer_id string, risk_score double, low_name string, text string"
COUNTS = "tenant_id string, gram string, rows bigint"


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _grams(text: Column, size: int) -> Column:
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(size)))


def write_name_index(customers: DataFrame, folder: str) -> None:
    """Index the names and emails of all accounts below ``folder``."""
    low_name = F.lower("customer_full_name")
    # an account id may be repeated: one row with all its texts
    texts = customers.groupBy("tenant_id", "customer_id").agg(
        F.max("risk_score").alias("risk_score"), F.min(low_name).alias("low_name"),
        F.array_join(F.collect_set(F.concat_ws(NAME_END, low_name, F.lower("customer_email"))), NAME_END).alias("text"),
    )
    # every account grows into many grams: spread the accounts over all cores first
    spread = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.repartitionByRange(spread, "tenant_id", "customer_id").sortWithinPartitions("tenant_id", "customer_id").write.mode("overwrite").parquet(f"{folder}/texts")
    texts = customers.sparkSession.read.schema(TEXTS).parquet(f"{folder}/texts")
    grams = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in SIZES]))
    # grams across the end of the name are in neither
    postings = texts.select("tenant_id", "customer_id", F.explode(F.filter(grams, lambda g: ~g.contains(NAME_END))).alias("gram"))
    postings = postings.withColumn(PART, _part(F.col("gram")))
    # a frequent gram is spread over several files by its accounts
    length = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    tasks = max(spread, -(-len(SIZES) * length // TASK_ROWS))
    ranged = postings.repartitionByRange(tasks, PART, "tenant_id", "gram", "customer_id").sortWithinPartitions(PART, "tenant_id", "gram", "customer_id")
    ranged.write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/postings")
    stored = customers.sparkSession.read.schema(POSTINGS).parquet(f"{folder}/postings")
    # dealt out uncounted: files are packed into few reads, each with more grams than a task should hold
    counts = stored.select("tenant_id", "gram").repartition(tasks, "tenant_id", "gram").groupBy("tenant_id", "gram").agg(F.count("*").alias("rows"))
    counts.repartitionByRange(tasks, "tenant_id", "gram").sortWithinPartitions("tenant_id", "gram").write.mode("overwrite").parquet(f"{folder}/counts")


class NameIndex:
    """The index that ``write_name_index`` stored below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, rarest: int = 1):
        self.rarest = rarest
        self.postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        self.texts = spark.read.schema(TEXTS).parquet(f"{folder}/texts")
        self.counts = spark.read.schema(COUNTS).parquet(f"{folder}/counts")

    def rarest_grams(self, needles: DataFrame) -> DataFrame:
        """The grams to look up for each (tenant_id, needle); none for a needle with a gram that no account has."""
        size = F.greatest(*[F.when(F.length("needle") >= n, F.lit(n)) for n in SIZES], F.lit(1))
        places = F.sequence(F.lit(1), F.length("needle") - size + 1)
        asked = needles.select("tenant_id", "needle", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col("needle"), i, size)))).alias("gram"))
        known = asked.join(self.counts, ["tenant_id", "gram"], "left")
        per = known.groupBy("tenant_id", "needle").agg(
            F.count("*").alias("grams"), F.slice(F.array_sort(F.collect_list(F.when(F.col("rows").isNotNull(), F.struct("rows", "gram")))), 1, self.rarest).alias("rarest"), F.count("rows").alias("found")
        )
        per = per.filter("found = grams")
        return per.select("tenant_id", "needle", F.size("rarest").alias("wanted"), F.explode("rarest").alias("g")).select("tenant_id", "needle", "wanted", F.col("g.gram").alias("gram"))

    def postings_of(self, grams: DataFrame) -> DataFrame:
        """Only the partitions that hold the given grams are read."""
        parts = sorted(r[0] for r in grams.select(_part(F.col("gram"))).distinct().collect())
        return self.postings.filter(F.col(PART).isin(parts))

    def find_containing(self, needles: DataFrame) -> DataFrame:
        """Pairs of a needle and an account whose name or email contains it; ``needles`` has (tenant_id, needle), lower-case."""
        needles = needles.select("tenant_id", "needle").filter("needle <> ''").distinct()
        grams = settle(self.rarest_grams(needles), "grams")
        met = self.postings_of(grams).drop(PART).join(grams, ["tenant_id", "gram"])
        if self.rarest > 1:
            met = met.groupBy("tenant_id", "needle", "customer_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).filter("n = wanted")
        found = met.select("tenant_id", "needle", "customer_id").join(self.texts, ["tenant_id", "customer_id"])
        return found.filter(F.col("text").contains(F.col("needle"))).select("tenant_id", "needle", "customer_id", "risk_score", "low_name")

    def search(self, text: str, limit: int = 10) -> DataFrame:
        """Ids of the accounts of each tenant whose name or email contains the text, riskiest first."""
        needle = text.lower()
        first = needle[:GRAM]
        tenants = self.counts.filter(F.col("gram") == first).select("tenant_id", F.lit(needle).alias("needle"))
        return top_per(self.find_containing(tenants), ["tenant_id"], by_risk(), limit).select("tenant_id", "customer_id", "rank")
