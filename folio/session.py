"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  forceOptimizeSkewedJoin lets AQE split a hot join
# key even when that costs one more exchange before the following aggregate.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # lists up to this long are cut in every task before the shuffle (ranking.GROUP_LIMIT)
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
}

def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "folio", partitions: int = 8, **extra: str) -> SparkSession:
    """A tuned single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # recording the call site of every column expression doubles the time to build a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or else the warehouse, which all executors share as well.

    On a cluster a warehouse on a local disk is no shared folder: the job fails instead of losing rows.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.split("://")[0].startswith(("file", "/")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share: the warehouse {warehouse} is on a local disk")
    return warehouse


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/folio/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a side expected to be small, without a hint.

    The side is written first, so the planner knows its real size: up to
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and ``df`` is not shuffled;
    beyond that both sides are shuffled, and since both shuffles feed the join
    directly, AQE can split a hot key.  (It cannot where one side is an aggregate.)
    """
    return df.join(settle(small, "small"), on, how)
