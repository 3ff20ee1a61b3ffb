"""What every operator here needs of the session."""

from __future__ import annotations

import folio.llm
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.session import tune

#: Bytes of a batch of rows sent to Python, about: Spark and the worker of every core hold one each, Spark's grown by doubling.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Tune the session and have this package's functions sent with their tasks, installed on the executors or not."""
    cloudpickle.register_pickle_by_value(folio.llm)
    # very long texts: a batch that goes to Python is bounded by bytes, not only by rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tune(spark)


def text_total(docs: DataFrame, column: str = "text") -> int:
    """The bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")).cast("long")), F.lit(0))).first()[0]


def shard_of(n: int, *columns: str):
    """A shard number below ``n`` by hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
