"""Spine tables stored in buckets by account, for work that joins the feeds of every account.

Rows of one account lie in one file of each table, sorted by account and key, and every table has the same
number of buckets: windows, aggregates and joins by account then need no exchange.  One busy
account is one task here; where an account may hold a large share of the rows, the range layout of
``spine.write_spine`` is the better one, which spreads it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from folio.schemas import PRIMARY_KEY
from folio.sources.spine import CORRUPT, bloom_options

BY = ("tenant_id", "customer_id")
LAYOUT = "layout"


def _table(folder: str, name: str) -> str:
    """The name under which a folder's table is known to a session."""
    return f"folio_{hashlib.sha256(folder.encode()).hexdigest()[:12]}_{name}"


def write_bucketed(tables: Mapping[str, DataFrame], folder: str, buckets: int = 64) -> None:
    """Store the tables below ``folder``, each in so many files; those without an account are stored as they are."""
    kept = []
    for name, df in tables.items():
        df = df.drop(CORRUPT)
        path, by = f"{folder}/{name}", [c for c in BY if c in df.columns]
        if len(by) < len(BY):
            df.write.mode("overwrite").parquet(path)
            continue
        order = [*by, *([PRIMARY_KEY[name]] if PRIMARY_KEY.get(name) in df.columns and PRIMARY_KEY.get(name) not in by else [])]
        # dealt as the buckets are: each task writes one file
        dealt = df.repartition(buckets, *by)
        writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *by).sortBy(*order)
        writer.options(**bloom_options(name, df.columns)).option("path", path).saveAsTable(_table(folder, name))
        kept.append((name, buckets, df.schema.json(), ",".join(order)))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(kept, "name string, buckets int, schema string, sorted_by string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LAYOUT}")


def read_bucketed(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """The stored tables, in this session or any other, with their buckets."""
    layout = {r.name: r for r in spark.read.parquet(f"{folder}/{LAYOUT}").collect()}
    out = {}
    for name in tables:
        if name not in layout:
            out[name] = spark.read.parquet(f"{folder}/{name}")
            continue
        known = _table(folder, name)
        if not spark.catalog.tableExists(known):
            row = layout[name]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(row.schema)))
            spark.sql(
                f"create table {known} ({columns}) using parquet clustered by ({', '.join(BY)}) sorted by ({row.sorted_by}) "
                f"into {row.buckets} buckets location '{folder}/{name}'"
            )
        out[name] = spark.table(known)
    return out
