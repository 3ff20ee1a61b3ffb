"""Data audit: inventory, key coverage, dates, duplicates, references, patterns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from folio.functions.columns import EMAIL_PATTERN, PHONE_PATTERN, blank, seeded_order
from folio.operators.activity import ACCOUNT, activity_counts
from folio.operators.ranking import top_per
from folio.schemas import DATE_COLUMNS, PRIMARY_KEY
from folio.session import join_small, settle

Tables = Mapping[str, DataFrame]


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_inventory(tables: Tables) -> DataFrame:
    """Rows, columns and the share of synthetic rows of each table (null where it has no such flag)."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "tenant_id"]
        flag = F.coalesce(F.lower(F.col("synthetic_flag").cast("string")) == "true", F.lit(False)) if "synthetic_flag" in columns else None
        synthetic = F.lit(None).cast("double") if flag is None else F.avg(flag.cast("double"))
        counted = df.agg(F.count("*").alias("rows"), synthetic.alias("synthetic_share"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "rows", F.lit(len(columns)).alias("columns"), "synthetic_share"))
    return _stack(parts)


def fk_coverage(children: Tables, customers: DataFrame) -> DataFrame:
    """Per child table: accounts named, unknown accounts, and how much of the book is covered."""
    named = _stack([df.filter("customer_id is not null").select(F.lit(no).alias("table_no"), *ACCOUNT) for no, df in enumerate(children.values())])
    known = customers.select(*ACCOUNT).distinct().withColumn("known", F.lit(True))
    per_table = (
        named.distinct().join(known, ACCOUNT, "left").groupBy("table_no").agg(
            F.count("*").alias("named_ids"), F.count_if(F.col("known").isNull()).alias("unknown_ids"),
            F.count_if(F.col("known")).alias("covered"),
        ).select(_name_of(list(children)).alias("table_name"), "named_ids", "unknown_ids", "covered")
    )
    # the size of the book is one number: an uncorrelated scalar subquery
    size = known.agg(F.count("*").alias("n")).scalar()
    return per_table.withColumn("coverage", F.col("covered") / size)


def _as_time(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text that is none becomes null."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.col(column).try_cast("timestamp_ntz")
    return F.col(column).cast("timestamp_ntz")


def audit_dates(tables: Tables, as_of: str) -> DataFrame:
    """Range, future rows and missing or unreadable values per date column; one pass per table."""
    today = F.lit(as_of).cast("timestamp_ntz")
    parts = []
    for name, columns in DATE_COLUMNS.items():
        present = [c for c in columns if name in tables and c in tables[name].columns]
        if not present:
            continue
        df = tables[name]
        seen = df.agg(*[
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                F.min(_as_time(df, c)).cast("date").alias("first_day"), F.max(_as_time(df, c)).cast("date").alias("last_day"),
                F.count_if(_as_time(df, c) > today).alias("future_rows"), F.count_if(_as_time(df, c).isNull()).alias("null_rows"),
            ).alias(c) for c in present
        ])
        parts.append(seen.select(F.explode(F.array(*present)).alias("r")).select("r.*"))
    return _stack(parts)


def audit_duplicates(tables: Tables) -> DataFrame:
    """Rows beyond the first of each primary key; missing keys count as equal."""
    keyed, named = _keyed(tables)
    per_key = keyed.groupBy("table_no", "tenant_id", "key").agg(F.count("*").alias("rows"))
    return per_key.groupBy("table_no").agg(F.sum(F.col("rows") - 1).alias("duplicates")).select(*named, "duplicates")


def _keyed(tables: Tables) -> tuple[DataFrame, list[Column]]:
    """The keys of all tables with their table's number, which is shuffled in place of names, and the names of a number."""
    keys = {name: key for name, key in PRIMARY_KEY.items() if name in tables and key in tables[name].columns}
    keyed = _stack([
        tables[name].select(F.lit(no).alias("table_no"), "tenant_id", F.col(key).cast("string").alias("key")) for no, (name, key) in enumerate(keys.items())
    ])
    return keyed, [_name_of(list(keys)).alias("table_name"), _name_of(list(keys.values())).alias("key_column")]


def _name_of(names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.col("table_no"))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values, missing ones left out."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return counted.orderBy(F.col("rows").desc(), "value").limit(n)


def references(df: DataFrame, column: str = "source_signal_ids") -> Column:
    """The ids of a ``;`` list, spaces removed and blanks dropped."""
    return F.filter(F.split(F.regexp_replace(F.col(column), " ", ""), ";"), lambda x: x != "")


def ref_resolution(evidence: Tables, tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Per table: rows that carry references, references, and how many name a real ticket or order.

    References are counted per id before they meet the known ids, so an id cited by
    very many rows is one row in the join.
    """
    marked = [
        df.select(F.lit(n).alias("table_name"), "tenant_id", "source_signal_ids", references(df).alias("refs")) for n, df in evidence.items()
    ]
    rows = _stack([
        m.groupBy("table_name").agg(F.count("*").alias("rows"), F.count_if(~blank(F.col("source_signal_ids"))).alias("rows_with_refs"))
        for m in marked
    ])
    cited = _stack([m.select("table_name", "tenant_id", F.explode("refs").alias("ref")) for m in marked])
    cited = cited.groupBy("table_name", "tenant_id", "ref").agg(F.count("*").alias("times"))
    known = tickets.select("tenant_id", F.col("ticket_id").alias("ref")).unionByName(
        orders.select("tenant_id", F.col("order_id").alias("ref"))
    ).filter("ref is not null").distinct().withColumn("known", F.lit(True))
    resolved = cited.join(known, ["tenant_id", "ref"], "left").groupBy("table_name").agg(
        F.sum("times").alias("refs"), F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("resolved")
    )
    joined = rows.join(resolved, "table_name", "left").fillna(0, ["refs", "resolved"])
    return joined.withColumn("resolved_share", F.col("resolved") / F.greatest(F.col("refs"), F.lit(1)))


def audit_columns(tables: Tables) -> DataFrame:
    """Every column of every table in file order, with the rows that have a value in it."""
    parts = []
    for name, df in tables.items():
        filled = df.selectExpr(*[f"count(`{c}`) as `{c}`" for c in df.columns])
        entries = ", ".join(f"{i}, '{c}', `{c}`" for i, c in enumerate(df.columns, start=1))
        stacked = f"stack({len(df.columns)}, {entries}) as (position, column_name, filled_rows)"
        parts.append(filled.selectExpr(f"'{name}' as table_name", stacked))
    return _stack(parts)


def _has_email(text: Column) -> Column:
    """Most cells are decided without the pattern."""
    return text.contains("@") & text.rlike(EMAIL_PATTERN)


def _has_phone(text: Column) -> Column:
    # no match is shorter than ten digits and two separators
    return (F.length(text) >= 12) & text.rlike(PHONE_PATTERN)


def audit_pii_patterns(tables: Tables) -> DataFrame:
    """Cells that look like an email address or a phone number, per text column; whole texts are searched."""
    parts = []
    for name, df in tables.items():
        texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        seen = df.agg(*[
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                F.count_if(_has_email(F.col(c))).alias("email_cells"),
                F.count_if(_has_phone(F.col(c))).alias("phone_cells"),
            ).alias(c) for c in texts
        ])
        parts.append(seen.select(F.explode(F.array(*texts)).alias("r")).select("r.*"))
    return _stack(parts)


SAMPLE_FEEDS = ("orders", "support_tickets", "customer_notes", "customer_email_logs")


def audit_sample(customers: DataFrame, feeds: Tables, seed: int = 42, n: int = 3) -> DataFrame:
    """A seeded sample of accounts per tenant with the size of their feeds."""
    drawn = top_per(customers, ["tenant_id"], [seeded_order(seed, F.col("customer_id")).asc(), F.col("customer_id").asc()], n)
    drawn = settle(drawn.select(*ACCOUNT, "customer_full_name", "customer_segment", "total_sales", "late_delivery_rate"), "drawn")
    chosen = drawn.select(*ACCOUNT)
    sizes = activity_counts(chosen, {f: feeds[f].join(chosen, ACCOUNT, "left_semi") for f in SAMPLE_FEEDS})
    return drawn.join(sizes, ACCOUNT)


# ---- one scan ----------------------------------------------------------------------

#: The column whose values are counted with the rest.
COUNTED = "scenario"
_CELLS = (
    "table_name string, value string, position int, column_name string, text boolean, dated boolean, rows bigint, synthetic_rows bigint, filled bigint, "
    "emails bigint, phones bigint, first_day date, last_day date, future bigint, missing bigint"
)


def audit_scan(tables: Tables, as_of: str) -> DataFrame:
    """What all of the audit needs, from one scan of each table: a row per table, value of ``scenario`` and column.

    Counts, minima and maxima only, so rows of a table's values add up to those of the table.
    """
    today = F.lit(as_of).cast("timestamp_ntz")
    spark = next(iter(tables.values())).sparkSession
    parts, none = [], []
    for name, df in tables.items():
        flag = F.count_if(F.lower(F.col("synthetic_flag").cast("string")) == "true") if "synthetic_flag" in df.columns else F.lit(None).cast("bigint")
        cells = []
        for position, field in enumerate(df.schema, start=1):
            c, text, dated = F.col(field.name), isinstance(field.dataType, StringType), field.name in DATE_COLUMNS.get(name, ())
            time = _as_time(df, field.name) if dated else None
            cells.append(F.struct(
                F.lit(position).alias("position"), F.lit(field.name).alias("column_name"), F.lit(text).alias("text"), F.lit(dated).alias("dated"),
                F.count("*").alias("rows"), flag.alias("synthetic_rows"), F.count(c).alias("filled"),
                (F.count_if(_has_email(c)) if text else F.lit(0)).cast("bigint").alias("emails"),
                (F.count_if(_has_phone(c)) if text else F.lit(0)).cast("bigint").alias("phones"),
                (F.min(time) if dated else F.lit(None)).cast("date").alias("first_day"), (F.max(time) if dated else F.lit(None)).cast("date").alias("last_day"),
                (F.count_if(time > today) if dated else F.lit(0)).cast("bigint").alias("future"), (F.count_if(time.isNull()) if dated else F.lit(0)).cast("bigint").alias("missing"),
            ))
            synthetic = 0 if "synthetic_flag" in df.columns else None
            none.append((name, None, position, field.name, text, dated, 0, synthetic, 0, 0, 0, None, None, 0, 0))
        value = (F.col(COUNTED) if COUNTED in df.columns else F.lit(None)).cast("string").alias("value")
        seen = df.groupBy(value).agg(F.array(*cells).alias("cells"))
        parts.append(seen.select(F.lit(name).alias("table_name"), "value", F.explode("cells").alias("c")).select("table_name", "value", "c.*"))
    # a table without rows has its columns nevertheless
    return settle(_stack([*parts, spark.createDataFrame(none, _CELLS)]), "audit")


def scanned_inventory(scan: DataFrame) -> DataFrame:
    per = scan.groupBy("table_name").agg(
        F.sum(F.when(F.col("position") == 1, F.col("rows"))).alias("rows"), F.count_if((F.col("column_name") != "tenant_id") & F.col("value").isNull() & (F.col("rows") == 0)).cast("int").alias("columns"),
        F.sum(F.when(F.col("position") == 1, F.col("synthetic_rows"))).alias("synthetic"),
    )
    return per.select("table_name", "rows", "columns", F.try_divide("synthetic", "rows").alias("synthetic_share"))


def scanned_columns(scan: DataFrame) -> DataFrame:
    return scan.groupBy("table_name", "position", "column_name").agg(F.sum("filled").alias("filled_rows"))


def scanned_patterns(scan: DataFrame) -> DataFrame:
    return scan.filter("text").groupBy("table_name", "column_name").agg(F.sum("emails").alias("email_cells"), F.sum("phones").alias("phone_cells"))


def scanned_dates(scan: DataFrame) -> DataFrame:
    return scan.filter("dated").groupBy("table_name", "column_name").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("future").alias("future_rows"), F.sum("missing").alias("null_rows")
    )


def scanned_value_counts(scan: DataFrame, table: str, n: int = 10) -> DataFrame:
    counted = scan.filter((F.col("table_name") == table) & (F.col("position") == 1) & F.col("value").isNotNull())
    return counted.select("value", "rows").orderBy(F.col("rows").desc(), "value").limit(n)


# ---- exact distinct counts by bitmaps ----------------------------------------------

#: An id that is text and a number without leading zeros stands for that number, and no other id does.
_NUMBERED = r"^(\D*)(0|[1-9][0-9]{0,17})$"
#: Bits in a bitmap, and ids that a bitmap must stand for to cost less than they do.
BITMAP_BITS, DENSE = 32_768, 128


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """The text, bitmap and bit of each id; null for ids of another form."""
    number = F.regexp_extract(key, _NUMBERED, 2).try_cast("bigint")
    return df.withColumns({
        "_text": F.when(number.isNotNull(), F.regexp_extract(key, _NUMBERED, 1)), "_map": F.bitmap_bucket_number(number), "_bit": F.bitmap_bit_position(number),
    })


def _dense_maps(rows: DataFrame, by: list[str]) -> DataFrame:
    """The bitmaps that stand for enough rows."""
    return rows.filter("_map is not null").groupBy(*by, "_text", "_map").agg(F.count("*").alias("_n")).filter(F.col("_n") >= DENSE).drop("_n")


def _routed(rows: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """``_dense`` says whether a row's id is counted by bitmap."""
    return join_small(rows, maps.withColumn("_dense", F.lit(True)), [*by, "_text", "_map"])


def fk_coverage_bitmaps(children: Tables, customers: DataFrame) -> DataFrame:
    """``fk_coverage`` with bitmaps shuffled in place of ids, where the ids of the book are dense numbers.

    Ids of another form, and numbers far from any account's, are counted one by one.
    """
    place = ["tenant_id", "_text", "_map"]
    book = _numbered(customers.select(*ACCOUNT), "customer_id")
    maps = settle(_dense_maps(book, ["tenant_id"]), "maps")
    known = _routed(book, maps, ["tenant_id"])
    bits = settle(known.filter("_dense").groupBy(*place).agg(F.bitmap_construct_agg("_bit").alias("bits")), "known")
    named = _stack([df.filter("customer_id is not null").select(F.lit(n).alias("table_name"), *ACCOUNT) for n, df in children.items()])
    named = _routed(_numbered(named, "customer_id"), maps, ["tenant_id"])

    own = named.filter("_dense").groupBy("table_name", *place).agg(F.bitmap_construct_agg("_bit").alias("bits"))
    names = F.explode(F.array(*[F.lit(n) for n in children]))
    both = own.withColumn("own", F.bitmap_count("bits")).withColumn("book", F.lit(0).cast("bigint")).unionByName(
        bits.select(names.alias("table_name"), *place, "bits", F.lit(0).cast("bigint").alias("own"), F.bitmap_count("bits").alias("book"))
    )
    # what two bitmaps have in common: their bits less those of their union
    met = both.groupBy("table_name", *place).agg(F.sum("own").alias("own"), F.sum("book").alias("book"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("any"))
    by_map = met.select("table_name", F.col("own").alias("named"), (F.col("own") + F.col("book") - F.col("any")).alias("covered"))

    single = known.filter("_dense is null").select(*ACCOUNT).distinct().withColumn("known", F.lit(True))
    others = named.filter("_dense is null").select("table_name", *ACCOUNT).distinct().join(single, ACCOUNT, "left")
    by_id = others.select("table_name", F.lit(1).cast("bigint").alias("named"), F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("covered"))
    size = bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).scalar() + single.agg(F.count("*").alias("n")).scalar()
    counted = by_map.unionByName(by_id).groupBy("table_name").agg(F.sum("named").alias("named_ids"), F.sum("covered").alias("covered")).filter("named_ids > 0")
    return counted.select("table_name", "named_ids", (F.col("named_ids") - F.col("covered")).alias("unknown_ids"), "covered", (F.col("covered") / size).alias("coverage"))


def audit_duplicates_bitmaps(tables: Tables) -> DataFrame:
    """``audit_duplicates`` with bitmaps shuffled in place of ids, where a table's keys are dense numbers."""
    by = ["table_no", "tenant_id"]
    keyed, named = _keyed(tables)
    # written: the keys are read for the maps and again for their bits
    keyed = settle(_numbered(keyed, "key"), "keys")
    rows = _routed(keyed, _dense_maps(keyed, by), by)
    by_map = rows.filter("_dense").groupBy(*by, "_text", "_map").agg(F.count("*").alias("rows"), F.bitmap_count(F.bitmap_construct_agg("_bit")).alias("keys"))
    by_key = rows.filter("_dense is null").groupBy(*by, "key").agg(F.count("*").alias("rows")).withColumn("keys", F.lit(1).cast("bigint"))
    both = by_map.select("table_no", "rows", "keys").unionByName(by_key.select("table_no", "rows", "keys"))
    return both.groupBy("table_no").agg((F.sum("rows") - F.sum("keys")).alias("duplicates")).select(*named, "duplicates")
