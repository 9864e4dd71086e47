"""Transactions: projection, stored shape, nested events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.ids import row_id
from ledgerflow.functions.times import as_of_column, event_time, run_time
from ledgerflow.schemas import EVENT_KEY

# Most events of one transaction that are gathered into one row.
EVENTS_PER_PART = 1024


def succeeded_flag() -> Column:
    """True for a successful status, false for any other or for missing effects."""
    return F.coalesce(F.col("effects.status") == "success", F.lit(False))


def gas_used() -> Column:
    """Computation plus storage cost; the rebate is not taken off. Null without effects."""
    return F.col("effects.gas.computation_cost") + F.col("effects.gas.storage_cost")


def event_count() -> Column:
    return F.when(F.col("events").isNull(), F.lit(0)).otherwise(F.size("events")).cast("bigint")


def project_transactions(
    transactions: DataFrame, *, as_of: datetime | int | None = None, include_source: bool = True
) -> DataFrame:
    """Processed transactions: checkpoint, time, success, gas and event count."""
    as_of = run_time(as_of)
    now = as_of_column(as_of)
    source = F.to_json(F.struct(*[F.col(c) for c in _source_columns(transactions)]))
    metadata = F.struct(
        now.alias("processed_at"),
        F.lit(None).cast("bigint").alias("processing_duration_ms"),
        event_count().alias("event_count"),
        gas_used().alias("gas_used"),
        succeeded_flag().alias("success"),
    )
    return transactions.select(
        row_id("digest").alias("id"),
        (source if include_source else F.lit(None).cast("string")).alias("transaction_data"),
        F.col("digest"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        event_time("timestamp_ms", as_of).alias("timestamp"),
        F.col("sender"),
        F.to_json("effects").alias("effects"),
        metadata.alias("metadata"),
        now.alias("processed_at"),
        now.alias("created_at"),
    )


def stored_transactions(processed: DataFrame) -> DataFrame:
    """Processed transactions in the shape of their table: no null gas, status as text."""
    return processed.select(
        "id",
        "transaction_data",
        "digest",
        "checkpoint_sequence",
        "timestamp",
        "sender",
        F.coalesce("metadata.gas_used", F.lit(0).cast("bigint")).alias("gas_used"),
        F.col("metadata.success").cast("string").alias("status"),
        "effects",
        "metadata",
        "processed_at",
        "created_at",
    )


def transaction_rows(processed: DataFrame) -> DataFrame:
    """Flat transaction rows; gas price and error message have no source and stay null."""
    return processed.select(
        "id",
        "digest",
        "checkpoint_sequence",
        F.unix_millis("timestamp").alias("timestamp_ms"),
        "sender",
        F.col("metadata.gas_used").alias("gas_used"),
        F.lit(None).cast("bigint").alias("gas_price"),
        F.col("metadata.success").alias("success"),
        F.lit(None).cast("string").alias("error_message"),
        "created_at",
    )


def events_per_transaction(events: DataFrame) -> DataFrame:
    return events.groupBy("transaction_digest").agg(F.count("*").alias("event_count"))


def transactions_with_events(
    transactions: DataFrame, events: DataFrame, *, per_part: int = EVENTS_PER_PART, unique: bool = False
) -> DataFrame:
    """Transactions with their processed events as a list in order of event number.

    Rows are keyed by (digest, `part`). Part 0 always exists, has the transaction's
    columns and its events with numbers below `per_part`; further events follow in
    rows of their own, where every other column of the transaction is null, so that
    sums over all rows stay right. No row, and no group behind it, therefore holds
    more than `per_part` events, however many one transaction has. Events must be
    unique by key for that: copies are removed first, map-side, unless `unique`
    says that there are none.
    """
    if per_part < 1:
        raise ValueError("per_part must be at least 1")
    single = events if unique else events.dropDuplicates(EVENT_KEY)
    part = F.floor(F.col("event_seq") / F.lit(per_part)).cast("bigint")
    item = F.struct(*[F.col(c) for c in _item_columns(events)])
    lists = (
        single.withColumn("part", part)
        .groupBy("transaction_digest", "part")
        .agg(F.sort_array(F.collect_list(item)).alias("processed_events"))
        .withColumnRenamed("transaction_digest", "digest")
    )
    empty = F.array().cast(lists.schema["processed_events"].dataType)
    first = transactions.join(lists.where("part = 0").drop("part"), "digest", "left").withColumns(
        {"part": F.lit(0).cast("bigint"), "processed_events": F.coalesce("processed_events", empty)}
    )
    known = transactions.select("digest").distinct()
    return first.unionByName(lists.where("part <> 0").join(known, "digest", "left_semi"), allowMissingColumns=True)


def _item_columns(events: DataFrame) -> list[str]:
    """The event's number first, since it orders the list; values that cannot be ordered are left out."""
    keep = [f.name for f in events.schema if f.dataType.typeName() not in ("map", "variant")]
    return ["event_seq", *[c for c in keep if c not in EVENT_KEY]]


def _source_columns(transactions: DataFrame) -> list[str]:
    return [c for c in transactions.columns if c not in ("outcome", "reason")]
