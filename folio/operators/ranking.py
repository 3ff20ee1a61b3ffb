"""Top rows per group and exact positions in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.session import join_small, settle


# spark.sql.optimizer.windowGroupLimitThreshold in session.RUNTIME_SETTINGS
GROUP_LIMIT = 10_000


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key.

    Planned as a window group limit: every task keeps at most ``n`` rows per key
    before the shuffle, so a key holding a third of the rows costs no more than others.
    Lists longer than the planner limits that way are cut from distributed row numbers.
    """
    if n > GROUP_LIMIT:
        return number_rows(df, keys, order, rank).filter(F.col(rank) <= n)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Sorted by key and order over range partitions, written, with each row's partition and place."""
    by = [F.col(k) for k in keys] + order
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    # written before it is counted: a second evaluation could cut the ranges elsewhere
    return settle(ranged, "ranged").withColumn("_slice", F.shiftright("_at", 33))


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_no") -> DataFrame:
    """Exact 1-based row numbers per key without putting a key into one task.

    Rows are range-partitioned and sorted; a row's number is its place in its slice
    plus the rows of the same key in earlier slices.  Only one row per key and
    slice is windowed.
    """
    rows = _ranged(df, keys, order)
    slices = rows.groupBy(*keys, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    joined = join_small(rows, offsets, [*keys, "_slice"], "inner")
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop(
        "_at", "_slice", "_first", "_before"
    )


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` per key, this row included, without putting a key into one task."""
    rows = _ranged(df, keys, order)
    slices = rows.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_within", F.sum(amount).over(within))
    joined = join_small(local, offsets, [*keys, "_slice"], "inner")
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_at", "_slice", "_within", "_before")


#: Characters of a text that tell its group, and rows that a group should not have more of.
PREFIX, GROUP_ROWS = 3, 1 << 20


def number_by_text(df: DataFrame, keys: list[str], rank: Column, text: str, name: str = "row_no") -> DataFrame:
    """Exact 1-based row numbers per key in order of a small number and then of a text, mostly an id.

    Rows with the first characters in common (beyond those that all texts share) stand together in that
    order, so a row's number is its place in its group plus the rows of earlier groups: one shuffle by
    group, and a table of counts.  No range is sampled and no copy of the rows is written.  As few characters are
    taken as make the largest group small.
    """
    ends = df.agg(F.min(text).alias("low"), F.max(text).alias("high")).first()
    pairs = zip(ends.low or "", ends.high or "")
    shared = next((i for i, (a, b) in enumerate(pairs) if a != b), min(len(ends.low or ""), len(ends.high or "")))

    def prefix(length: int | Column) -> Column:
        return F.coalesce(F.substr(F.col(text), F.lit(shared + 1), F.lit(length) if isinstance(length, int) else length), F.lit(""))

    ranked = df.withColumn("_rank", rank)
    counts = settle(ranked.groupBy(*keys, "_rank", prefix(PREFIX).alias("_prefix")).agg(F.count("*").alias("_rows")), "prefixes")
    by_length = counts.withColumn("_length", F.explode(F.sequence(F.lit(0), F.lit(PREFIX))))
    cut = F.substr(F.col("_prefix"), F.lit(1), F.col("_length"))
    largest = by_length.groupBy(*keys, "_rank", "_length", cut.alias("_cut")).agg(F.sum("_rows").alias("n")).groupBy("_length").agg(F.max("n").alias("n")).collect()
    length = min((r["_length"] for r in largest if r.n <= GROUP_ROWS), default=PREFIX)

    groups = counts.groupBy(*keys, "_rank", F.substr(F.col("_prefix"), F.lit(1), F.lit(length)).alias("_prefix")).agg(F.sum("_rows").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_rank", "_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    own = Window.partitionBy(*keys, "_rank", "_prefix").orderBy(F.col(text).asc())
    placed = ranked.withColumn("_prefix", prefix(length)).withColumn("_place", F.row_number().over(own))
    joined = join_small(placed, offsets, [*keys, "_rank", "_prefix"], "inner")
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_rank", "_prefix", "_place", "_before")
