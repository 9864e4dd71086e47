"""Aggregations and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.times import as_of_column, event_time, run_time
from ledgerflow.operators.transactions import gas_used

AsOf = datetime | int | None

STATS_KEY = ["date", "package_id", "module_name", "event_type"]
SENDER, TRANSACTION = "sender", "transaction"


def stats_by_type(events: DataFrame, type_column: str = "type_name") -> DataFrame:
    """Number of events per type."""
    return events.groupBy(F.col(type_column).alias("event_type")).agg(F.count("*").alias("event_count"))


def daily_event_stats(
    events: DataFrame, transactions: DataFrame | None = None, *, as_of: AsOf = None, approximate: bool = False
) -> DataFrame:
    """Daily rollup per package, module and type: events, distinct senders, gas.

    Gas is that of the distinct transactions in a group, 0 where unknown. Events are read
    once and become counts per (group, sender) and per (group, transaction) before
    anything is shuffled, which spreads a group that holds much of the data and needs
    no distinct count. `approximate` replaces the exact sender count by a sketch.
    """
    return stats_of_pairs(daily_pairs(events, as_of=as_of), transactions, approximate=approximate)


def daily_pairs(events: DataFrame, *, as_of: AsOf = None) -> DataFrame:
    """Numbers of events per group and sender, and per group and transaction; `kind` tells which `member` is."""
    members = F.array(
        F.struct(F.lit(SENDER).alias("kind"), F.col("sender").alias("member")),
        F.struct(F.lit(TRANSACTION).alias("kind"), F.col("transaction_digest").alias("member")),
    )
    return (
        events.select(
            F.to_date(event_time("timestamp_ms", as_of)).alias("date"),
            "package_id",
            F.col("type_module").alias("module_name"),
            F.col("type_name").alias("event_type"),
            F.explode(members).alias("m"),
        )
        .groupBy(*STATS_KEY, "m.kind", "m.member")
        .agg(F.count("*").alias("n"))
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each key of several sets of `daily_pairs`."""
    return pairs.groupBy(*STATS_KEY, "kind", "member").agg(F.sum("n").alias("n"))


def stats_of_pairs(pairs: DataFrame, transactions: DataFrame | None = None, *, approximate: bool = False) -> DataFrame:
    """`daily_event_stats` from merged pairs."""
    by_sender, zero = F.col("kind") == SENDER, F.lit(0).cast("bigint")
    if transactions is None:
        pairs, gas = pairs.where(by_sender), zero
    else:
        # The kind is part of the key, so that senders are spread and match nothing.
        known = _gas_by_digest(transactions).select(F.lit(TRANSACTION).alias("kind"), F.col("transaction_digest").alias("member"), "gas")
        pairs, gas = pairs.join(known, ["kind", "member"], "left"), F.coalesce(F.sum("gas"), zero)
    sender = F.when(by_sender, F.col("member"))
    # A sender is one row of its group, so rows are counted, not distinct values.
    senders = F.hll_sketch_estimate(F.hll_sketch_agg(sender)) if approximate else F.count(sender)
    return pairs.groupBy(*STATS_KEY).agg(
        F.sum(F.when(by_sender, F.col("n"))).alias("event_count"), senders.alias("unique_senders"), gas.alias("total_gas_used")
    )


def daily_sketches(pairs: DataFrame) -> DataFrame:
    """Events of each group, and a sketch of its senders, from its pairs."""
    by_sender = pairs.where(F.col("kind") == SENDER)
    return by_sender.groupBy(*STATS_KEY).agg(F.sum("n").alias("n"), F.hll_sketch_agg("member").alias("senders"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy(*STATS_KEY).agg(F.sum("n").alias("n"), F.hll_union_agg("senders").alias("senders"))


def _gas_by_digest(transactions: DataFrame) -> DataFrame:
    """Gas per digest; a re-delivered transaction must not count twice."""
    known = transactions.where(gas_used().isNotNull())
    return known.groupBy(F.col("digest").alias("transaction_digest")).agg(F.max(gas_used()).alias("gas"))


def processing_stats(batch_log: DataFrame, *, as_of: AsOf = None) -> DataFrame:
    """One row over all batches: totals, rates, mean times, errors, uptime.

    Rates divide by whole seconds between the first start and the last finish and
    are 0 while that is 0. Mean times are batch time over records. A batch that was
    logged again after a retry counts once, with its last entry.
    """
    log = latest_batches(batch_log)
    totals = log.agg(
        _long_sum("events").alias("total_events"),
        _long_sum("transactions").alias("total_transactions"),
        _long_sum("errors").alias("error_count"),
        _long_sum("event_ms").alias("event_ms"),
        _long_sum("transaction_ms").alias("transaction_ms"),
        F.min("started_at").alias("start_time"),
        F.max("finished_at").alias("last_update"),
        F.max_by("checkpoint_sequence", F.struct("finished_at", "run_id", "batch_id")).alias("current_checkpoint"),
    )
    now = as_of_column(as_of)
    seconds = _whole_seconds("start_time", F.col("last_update"))
    return totals.select(
        "total_events",
        "total_transactions",
        _ratio(F.col("total_events"), seconds).alias("events_per_second"),
        _ratio(F.col("total_transactions"), seconds).alias("transactions_per_second"),
        _ratio(F.col("event_ms"), F.col("total_events")).alias("avg_event_processing_ms"),
        _ratio(F.col("transaction_ms"), F.col("total_transactions")).alias("avg_transaction_processing_ms"),
        "start_time",
        "last_update",
        "current_checkpoint",
        "error_count",
        _whole_seconds("start_time", now).alias("uptime_seconds"),
        _whole_seconds("last_update", now).alias("seconds_since_update"),
    )


def latest_batches(batch_log: DataFrame) -> DataFrame:
    """The last entry of each batch."""
    measures = [c for c in batch_log.columns if c not in ("run_id", "batch_id")]
    last = F.max_by(F.struct(*measures), F.struct("finished_at", "started_at"))
    return batch_log.groupBy("run_id", "batch_id").agg(last.alias("b")).select("run_id", "batch_id", "b.*")


def latest_progress(progress: DataFrame) -> DataFrame:
    """One row: the newest processed checkpoint (null if none), and the same with 0 for none.

    Progress only grows, except that a reset starts a new generation.
    """
    newest = F.max(F.struct("generation", "checkpoint_sequence"))["checkpoint_sequence"]
    return progress.agg(newest.alias("latest_checkpoint")).withColumn(
        "last_processed_checkpoint", F.coalesce("latest_checkpoint", F.lit(0).cast("bigint"))
    )


def progress_by_source(source_progress: DataFrame) -> DataFrame:
    """Per source: records of its batches, each counted once however often it was noted, and its newest checkpoint."""
    once = source_progress.groupBy("source", "run_id", "batch_id").agg(
        F.max_by("records", "updated_at").alias("records"), F.max("checkpoint_sequence").alias("checkpoint_sequence")
    )
    return once.groupBy("source").agg(
        _long_sum("records").alias("records"), F.max("checkpoint_sequence").alias("latest_checkpoint")
    )


def checkpoint_stats(progress: DataFrame, *, target: int | Column | None) -> DataFrame:
    """One row: checkpoints done, rate per whole second, and time left in whole seconds.

    Time left is null while the rate is 0 or the target is unknown.
    """
    current = latest_progress(progress).select(F.col("latest_checkpoint").alias("current_checkpoint"))
    done = progress.agg(
        F.countDistinct("checkpoint_sequence").alias("total_processed"),
        F.min("updated_at").alias("first_update"),
        F.max("updated_at").alias("last_update"),
    )
    seconds = _whole_seconds("first_update", F.col("last_update"))
    goal = _goal(target)
    return (
        done.select(
            "total_processed",
            current.scalar().alias("current_checkpoint"),
            goal.alias("target_checkpoint"),
            _ratio(F.col("total_processed"), seconds).alias("processing_rate"),
        )
        .withColumn("checkpoints_remaining", remaining(F.col("current_checkpoint"), F.col("target_checkpoint")))
        .withColumn(
            "seconds_remaining",
            F.when(
                F.col("processing_rate") > 0,
                F.floor(F.col("checkpoints_remaining") / F.col("processing_rate")).cast("bigint"),
            ),
        )
    )


def remaining(current: Column, target: Column) -> Column:
    """Checkpoints left to the target, never below 0; null if either is unknown."""
    known = current.isNotNull() & target.isNotNull()
    return F.when(known, F.greatest(target - current, F.lit(0).cast("bigint")))


def caught_up(current: Column, target: Column) -> Column:
    return F.coalesce(current >= target, F.lit(False))


def status_report(batch_log: DataFrame, progress: DataFrame, *, as_of: AsOf = None) -> DataFrame:
    """One row: events, transactions, last checkpoint, events per minute."""
    stats = processing_stats(batch_log, as_of=as_of)
    last = latest_progress(progress).select("last_processed_checkpoint")
    return stats.select(
        "total_events",
        "total_transactions",
        last.scalar().alias("last_checkpoint"),
        (F.col("events_per_second") * 60).alias("events_per_minute"),
        "error_count",
    )


def freshness(checkpoints: DataFrame, progress: DataFrame, *, max_lag: int = 0) -> DataFrame:
    """One row: chain head against processed checkpoint; healthy while the lag is small."""
    processed = latest_progress(progress).select("latest_checkpoint")
    both = checkpoints.agg(F.max("sequence_number").alias("latest_checkpoint")).select(
        "latest_checkpoint", processed.scalar().alias("processed_checkpoint")
    )
    head, done = F.col("latest_checkpoint"), F.col("processed_checkpoint")
    return both.withColumns(
        {
            "lag": remaining(done, head),
            "caught_up": caught_up(done, head),
            "healthy": F.coalesce(remaining(done, head) <= max_lag, F.lit(False)),
            "error": F.when(head.isNull(), "chain head is unknown").when(done.isNull(), "nothing is processed"),
        }
    )


def _goal(target: int | Column | None) -> Column:
    return target if isinstance(target, Column) else F.lit(target).cast("bigint")


def _long_sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def _ratio(total: Column, parts: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), parts.cast("double")), F.lit(0.0))


def _whole_seconds(start: str, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("bigint")
