"""Ledger state and sentiment counts kept up to date from streams.

Both sinks are keyed tables (store.py): a batch writes new versions of the keys it touched,
counts once however often it is started, and is compacted after some time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folio.functions.columns import sentiment_bucket
from folio.operators.ledger import ACTION, action_state, lasting_events
from folio.session import settle, tune
from folio.streaming.store import KeyedTable

DAY = ["tenant_id", "customer_id", "day"]


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(df: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


# ---- the ledger -------------------------------------------------------------------------------

def kept_events(spark: SparkSession, folder: str) -> KeyedTable:
    """The events of each action that can still matter."""
    return KeyedTable(spark, f"{folder}/events", ACTION)


def action_table(spark: SparkSession, folder: str) -> KeyedTable:
    """The state of each action, one row."""
    return KeyedTable(spark, f"{folder}/state", ACTION)


def ledger_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Takes batches of raw events, in any order of time, into the state of the actions they touch.

    A batch meets the kept events of its actions only; what can no longer matter is
    not kept again, and the states of these actions are written anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = tune(batch.sparkSession)
        events, states = kept_events(spark, folder), action_table(spark, folder)
        fresh = settle(batch, "batch")
        touched = settle(fresh.select(*ACTION).distinct(), "touched")
        if events.through() < number:
            held = events.current_of(touched)
            events.commit(lasting_events(fresh if held is None else held.unionByName(fresh)), number)
        # a batch that ended between the two tables goes on here
        if states.through() < number:
            states.commit(action_state(events.current_of(touched)), number)

    return write


def stream_action_state(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Raw ledger events to the current state of every action."""
    return _start(events, checkpoint, "append", ledger_writer(folder))


def current_actions(spark: SparkSession, folder: str) -> DataFrame:
    return action_table(spark, folder).current()


# ---- sentiment ----------------------------------------------------------------------------------

def sentiment_table(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, folder, DAY)


def stream_sentiment(signals: DataFrame, folder: str, checkpoint: str, lateness: str = "2 days") -> StreamingQuery:
    """Signals per account, day and bucket; a signal id counts once, rows past the watermark are dropped.

    ``signals`` has (tenant_id, customer_id, signal_id, signal, event_time).
    """
    fresh = signals.filter("signal is not null").withWatermark("event_time", lateness)
    once = fresh.dropDuplicatesWithinWatermark(["tenant_id", "signal_id"])
    bucket = sentiment_bucket(F.col("signal"))
    counted = once.groupBy(F.window("event_time", "1 day").alias("w"), "tenant_id", "customer_id").agg(
        *[F.count_if(bucket == b).alias(b) for b in ("positive", "neutral", "negative")], F.count("*").alias("total")
    )
    flat = counted.select("tenant_id", "customer_id", F.col("w.start").cast("date").alias("day"), "positive", "neutral", "negative", "total")

    def write(batch: DataFrame, number: int) -> None:
        # a batch's rows are the new totals of the days it changed
        sentiment_table(batch.sparkSession, folder).commit(batch, number)

    return _start(flat, checkpoint, "update", write)


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return sentiment_table(spark, folder).current()


def batch_sentiment(signals: DataFrame) -> DataFrame:
    """The same counts over a table that is complete."""
    once = signals.filter("signal is not null").dropDuplicates(["tenant_id", "signal_id"])
    bucket = sentiment_bucket(F.col("signal"))
    return once.groupBy("tenant_id", "customer_id", F.col("event_time").cast("date").alias("day")).agg(
        *[F.count_if(bucket == b).alias(b) for b in ("positive", "neutral", "negative")], F.count("*").alias("total")
    )
