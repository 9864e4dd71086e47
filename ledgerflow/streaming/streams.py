"""Stream operators: event time, dedupe, running counts.

State is bounded by a watermark. Rows older than the watermark are dropped by the
counts, and copies that arrive after it pass the dedupe; the keyed append of the
store stops those as well.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.functions.times import event_time
from ledgerflow.schemas import EVENT_KEY

DELAY = "10 minutes"


def with_event_time(events: DataFrame, *, as_of: datetime | int | None = None, delay: str = DELAY) -> DataFrame:
    """Add `event_time` and its watermark.

    Events without a time get the run's. When replaying old data, pass an `as_of`
    from that time, or those events push the watermark past all others.
    """
    return events.withColumn("event_time", event_time("timestamp_ms", as_of)).withWatermark("event_time", delay)


def dedupe_stream(events: DataFrame, *, as_of: datetime | int | None = None, delay: str = DELAY) -> DataFrame:
    """Drop re-delivered events; keys are remembered until the watermark passes them."""
    timed = events if "event_time" in events.columns else with_event_time(events, as_of=as_of, delay=delay)
    return timed.dropDuplicatesWithinWatermark(EVENT_KEY)


def joined_transactions(
    transactions: DataFrame,
    events: DataFrame,
    *,
    within: str = "10 minutes",
    how: str = "inner",
    as_of: datetime | int | None = None,
    delay: str = DELAY,
) -> DataFrame:
    """Two streams joined: each transaction with those of its events that lie up to `within` of its time.

    Both sides carry a watermark and the slower one counts, so state is bounded by delay
    and interval on both. With `how="leftOuter"` a transaction without events comes out once the
    watermark has passed the interval. The transaction's columns are prefixed by `tx_`.
    """
    own = transactions.select([F.col(c).alias(f"tx_{c}") for c in transactions.columns])
    own = own.withColumn("tx_time", event_time("tx_timestamp_ms", as_of)).withWatermark("tx_time", delay)
    timed = with_event_time(events, as_of=as_of, delay=delay)
    near = F.col("event_time").between(F.expr(f"tx_time - interval {within}"), F.expr(f"tx_time + interval {within}"))
    return own.join(timed, (F.col("tx_digest") == F.col("transaction_digest")) & near, how)


def running_type_counts(
    events: DataFrame, *, width: str = "1 day", as_of: datetime | int | None = None, delay: str = DELAY
) -> DataFrame:
    """Events per type in tumbling windows.

    In append mode a window comes out once the watermark has passed its end; in
    update mode its count so far comes with every trigger.
    """
    timed = events if "event_time" in events.columns else with_event_time(events, as_of=as_of, delay=delay)
    counts = timed.groupBy(F.window("event_time", width).alias("w"), F.col("type_name").alias("event_type")).agg(
        F.count("*").alias("event_count")
    )
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "event_count"
    )


def close_counts(counts: DataFrame, folder: str, state: str, *, interval: str | None = None) -> StreamingQuery:
    """Write the counts of each window once, when the watermark has closed it; read all with `kept_counts`.

    Windows that are open stay in the stream's own state and nowhere else, so the files
    below `folder` grow with closed windows and not with micro-batches.
    """
    dated = counts.withColumn("window_date", F.to_date("window_start"))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    # Partitioned, as a batch that closes no window then writes no file.
    writer = dated.writeStream.outputMode("append").format("parquet").partitionBy("window_date").trigger(**trigger)
    return writer.option("checkpointLocation", state).start(folder)


def kept_counts(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """Counts of all windows: closed ones from what `close_counts` wrote, open ones from the state of its last batch."""
    columns = ("window_start", "window_end", "event_type", "event_count")
    schema = "window_start timestamp, window_end timestamp, event_type string, event_count long, window_date date"
    closed = spark.read.schema(schema).parquet(folder).select(*columns)
    held = spark.read.format("statestore").load(state)
    window, kind, count = (f"{part}.`{name}`" for part, name in zip(("key", "key", "value"), _state_names(held), strict=True))
    still_open = held.select(
        F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end"), F.col(kind).alias("event_type"), F.col(count).alias("event_count")
    )
    # A window that was closed in the last batch may be in both.
    both = closed.withColumn("closed", F.lit(1)).unionByName(still_open.withColumn("closed", F.lit(0)))
    keys = ("window_start", "window_end", "event_type")
    return both.groupBy(*keys).agg(F.max_by("event_count", "closed").alias("event_count")).select(*columns)


def _state_names(held: DataFrame) -> tuple[str, str, str]:
    """The names that the state gives to window, type and count, in the order of the grouping."""
    window, kind = held.schema["key"].dataType.fieldNames()
    (count,) = held.schema["value"].dataType.fieldNames()[-1:]
    return window, kind, count


def keep_counts(counts: DataFrame, folder: str, state: str, *, interval: str | None = None) -> StreamingQuery:
    """Keep a stream's counts below `folder`, open windows included.

    Every micro-batch writes the counts that it changed, under its own number, so that a
    batch which is repeated after a failure replaces what it had written. Read them with
    `latest_counts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = counts.writeStream.outputMode("update").option("checkpointLocation", state).trigger(**trigger)
    return writer.foreachBatch(write).start()


def latest_counts(kept: DataFrame) -> DataFrame:
    """One row per window and type from what `keep_counts` wrote: its newest count."""
    newest = F.max_by("event_count", "batch").alias("event_count")
    return kept.groupBy("window_start", "window_end", "event_type").agg(newest)
