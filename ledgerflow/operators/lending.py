"""Lending analytics.

Everything is a sum of signed amounts, so a user, asset or pool with a large part
of all events is added up on the map side before it is shuffled.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.payload import amount, field_text, payload_map, unique_keys
from ledgerflow.functions.times import event_time
from ledgerflow.operators.enrich import action_label, event_class

_PAYLOAD = "_payload"
_TEXTS = ("coin_type", "pool_id", "user", "liquidator")
_AMOUNTS = ("amount", "liquidated_amount")


def lending_actions(events: DataFrame, *, as_of: datetime | int | None = None) -> DataFrame:
    """Events with action, class and the payload fields that lending uses.

    Filter to the protocol first; the payload is parsed for every event given.
    """
    parsed = events.withColumn(_PAYLOAD, payload_map("parsed_json")).withColumn(_PAYLOAD, unique_keys(F.col(_PAYLOAD)))
    texts = [field_text(_PAYLOAD, name).alias(name) for name in _TEXTS]
    amounts = [amount(field_text(_PAYLOAD, name)).alias(name) for name in _AMOUNTS]
    return parsed.select(
        "transaction_digest",
        "event_seq",
        "checkpoint_sequence",
        event_time("timestamp_ms", as_of).alias("timestamp"),
        "package_id",
        "type_name",
        F.col("sender").alias("account"),
        action_label().alias("action"),
        event_class().alias("event_class"),
        *texts,
        *amounts,
    )


def portfolio(actions: DataFrame) -> DataFrame:
    """Deposits less withdrawals per account and asset."""
    flow = signed(plus="deposit", minus="withdraw")
    return _moves(actions, "deposit", "withdraw").groupBy("account", "coin_type").agg(
        F.sum(flow).alias("net_deposit"),
        F.count_if(F.col("event_class") == "deposit").alias("deposits"),
        F.count_if(F.col("event_class") == "withdraw").alias("withdrawals"),
    )


def debt(actions: DataFrame) -> DataFrame:
    """Borrowed less repaid per account and asset."""
    flow = signed(plus="borrow", minus="repay")
    return _moves(actions, "borrow", "repay").groupBy("account", "coin_type").agg(
        F.sum(flow).alias("debt"),
        F.count_if(F.col("event_class") == "borrow").alias("borrows"),
        F.count_if(F.col("event_class") == "repay").alias("repayments"),
    )


def locked_value(actions: DataFrame) -> DataFrame:
    """Net flow per pool and day, and the running total of value locked.

    The window runs over days, after the flows were added up per day, so a pool
    never brings more rows to it than there are days.
    """
    daily = (
        _moves(actions, "deposit", "withdraw")
        .groupBy("pool_id", F.to_date("timestamp").alias("day"))
        .agg(F.sum(signed(plus="deposit", minus="withdraw")).alias("net_flow"))
    )
    so_far = Window.partitionBy("pool_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("locked", F.sum("net_flow").over(so_far))


def utilization(actions: DataFrame) -> DataFrame:
    """Outstanding borrows over outstanding deposits per pool; null without deposits."""
    totals = _moves(actions, "deposit", "withdraw", "borrow", "repay").groupBy("pool_id").agg(
        F.sum(signed(plus="deposit", minus="withdraw")).alias("deposits"),
        F.sum(signed(plus="borrow", minus="repay")).alias("borrows"),
    )
    rate = F.col("borrows").cast("double") / F.col("deposits").cast("double")
    return totals.withColumn("utilization", F.when(F.col("deposits") > 0, rate))


def liquidations(actions: DataFrame) -> DataFrame:
    """Liquidation alerts: who was liquidated, by whom and how much, where the payload says so."""
    return actions.where(F.col("event_class") == "liquidation").select(
        "transaction_digest",
        "event_seq",
        "checkpoint_sequence",
        "timestamp",
        F.col("account").alias("liquidated_account"),
        "liquidator",
        "liquidated_amount",
    )


def action_amounts(actions: DataFrame) -> DataFrame:
    """Number and sum of amounts per class, asset and pool."""
    return actions.groupBy("event_class", "coin_type", "pool_id").agg(
        F.count("*").alias("events"), F.sum("amount").alias("total_amount")
    )


def signed(*, plus: str, minus: str) -> Column:
    """The amount, negative for the `minus` class and 0 for classes that are neither."""
    value = F.coalesce("amount", F.lit(0).cast("decimal(38,0)"))
    kind = F.col("event_class")
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(kind == plus, value).when(kind == minus, -value).otherwise(zero)


def _moves(actions: DataFrame, *classes: str) -> DataFrame:
    return actions.where(F.col("event_class").isin(*classes))
