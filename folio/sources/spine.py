"""Loading, checking and storing the spine tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folio.schemas import PRIMARY_KEY, REQUIRED_COLUMNS, SPINE_TABLES, declared

CORRUPT = "_corrupt_record"


class SchemaDrift(RuntimeError):
    """A table lacks columns that queries rely on."""


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, or an error that lists the missing columns in order."""
    missing = sorted(set(REQUIRED_COLUMNS.get(table, ())) - set(df.columns))
    if missing:
        raise SchemaDrift(f"{table} lacks required columns: {missing}")
    return df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line (every file of a table has the same header)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One CSV table with the declared types, by column name.

    Quoted cells may hold commas, doubled quotes and line breaks.  A record with a
    cell that does not fit its type keeps the other cells and shows the raw line in
    ``_corrupt_record``.
    """
    names = csv_header(spark, path)
    types = {f.name: f.dataType for f in declared(table)}
    fields = [StructField(n, types.get(n, StringType())) for n in names]
    schema = StructType([*fields, StructField(CORRUPT, StringType())])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    return require_columns(df, table)


def load_spine(
    spark: SparkSession, folder: str, tenant: str, tables: tuple[str, ...] = SPINE_TABLES
) -> dict[str, DataFrame]:
    """Every ``<table>.csv`` of the folder, stamped with its tenant."""
    return {t: read_csv(spark, f"{folder}/{t}.csv", t).withColumn("tenant_id", F.lit(tenant)) for t in tables}


#: Columns by which single records are looked up, whatever account they are of.
LOOKUP_KEYS = ("order_id", "ticket_id", "note_id", "email_id", "review_id", "outcome_id", "fulfillment_event_id", "engagement_id", "contact_id", "adjustment_id")


def bloom_options(table: str, columns: list[str], values: int = 1_000_000) -> dict[str, str]:
    """Writer options for a Bloom filter of each row group on the ids that the row order does not narrow."""
    out = {}
    for c in columns:
        if c in LOOKUP_KEYS or c == PRIMARY_KEY.get(table) != "customer_id":
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(values), f"parquet.enable.dictionary#{c}": "false"}
    return out | ({"parquet.bloom.filter.adaptive.enabled": "true"} if out else {})


def write_table(df: DataFrame, path: str, table: str, mode: str = "overwrite", finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store one table as Parquet, clustered for account lookups.

    Range clustering on tenant and account gives each file a narrow key range, so
    point lookups skip files by their statistics.  The table's own key comes last:
    an account with very many rows is spread over several files.  Lookups of single
    records, by ids that lie in every file's range, skip row groups by Bloom filters.
    ``finish`` adds the columns that need not be exchanged and sorted.
    """
    keys = [k for k in ("tenant_id", "customer_id", PRIMARY_KEY.get(table)) if k in df.columns]
    keys = list(dict.fromkeys(keys))
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    laid_out = finish(laid_out) if finish else laid_out
    laid_out.write.mode(mode).options(**bloom_options(table, laid_out.columns)).parquet(path)


def write_spine(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        write_table(df.drop(CORRUPT), f"{folder}/{name}", name, mode)


def read_spine(spark: SparkSession, folder: str, tables: tuple[str, ...] = SPINE_TABLES) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table in one job (answered from file footers for Parquet)."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def snapshot_once(spark: SparkSession, source: str, backup: str, tables: tuple[str, ...] = SPINE_TABLES) -> None:
    """Copy the stored tables the first time only; repairs always start from the copy."""
    for table in tables:
        spark.read.parquet(f"{source}/{table}").write.mode("ignore").parquet(f"{backup}/{table}")


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)
