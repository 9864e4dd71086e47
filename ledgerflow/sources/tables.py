"""Ledger tables derived from the star-schema test tables (see FIXTURES.md).

One SQL text serves Spark and DuckDB; only the epoch-millisecond expression
differs, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import configure

_SPARK_MS = "unix_millis(cast({} as timestamp))"
_DUCKDB_MS = "(epoch_us({})//1000)"

_EVENTS = """
select event_id,
  concat('tx', lpad(cast(cast((event_id - event_id % 3) / 3 as bigint) as varchar(20)), 12, '0')) as transaction_digest,
  event_id % 3 as event_seq,
  cast((event_id - event_id % 30) / 30 as bigint) as checkpoint_sequence,
  case when event_id % 89 = 0 then null else {event_ms} end as timestamp_ms,
  case event_id % 4
    when 0 then '0x81c408448d0d57b3e371ea94de1d40bf852784d3e225de1e74acab3e8395c18f'
    when 1 then '0xa99b8952d4f7d947ea77fe0ecdcc9e5fc0bcab2841d6e2a5aa00c3044e5544b5'
    when 2 then concat('0x', lpad('2', 64, '0')) else concat('0x', lpad('3', 64, '0')) end as package_id,
  case event_id % 4 when 2 then 'coin' when 3 then 'sui_system' else 'lending' end as transaction_module,
  case event_id % 4
    when 0 then '0xd899cf7d2b5db716bd2cf55599fb0d5ee38a3061e7b6bb6eebf73fa5bc4c81ca'
    when 1 then '0xa99b8952d4f7d947ea77fe0ecdcc9e5fc0bcab2841d6e2a5aa00c3044e5544b5'
    when 2 then concat('0x', lpad('2', 64, '0')) else concat('0x', lpad('3', 64, '0')) end as type_address,
  case when event_id % 4 = 2 and event_id % 5 = 0 then 'balance'
       when event_id % 4 = 2 then 'coin' when event_id % 4 = 3 then 'sui_system' else 'lending' end as type_module,
  case event_type when 'click' then 'DepositEvent' when 'view' then 'WithdrawEvent'
    when 'purchase' then 'BorrowEvent' when 'signup' then 'RepayEvent' else 'LiquidationEvent' end as type_name,
  concat('0x', lpad(lower(hex(user_id)), 64, '0')) as sender,
  case when event_id % 97 = 0 then '[1]'
       when event_id % 101 = 0 then 'not json'
       when event_id % 4 >= 2 then props
       else concat('{{"amount":"', cast(cast(round(value * 100) as bigint) as varchar(20)),
         '","coin_type":"0x2::sui::SUI","asset_id":', cast(user_id % 5 as varchar(5)),
         ',"pool_id":"pool', cast(event_id % 7 as varchar(5)),
         '","user":"0x', lpad(lower(hex(user_id)), 64, '0'), '"}}') end as parsed_json
from {events}
"""

_TRANSACTIONS = """
select concat('tx', lpad(cast(o_orderkey as varchar(20)), 12, '0')) as digest,
  cast((o_orderkey - o_orderkey % 10) / 10 as bigint) as checkpoint_sequence,
  {order_ms} as timestamp_ms,
  concat('0x', lpad(lower(hex(o_custkey)), 64, '0')) as sender,
  case o_orderstatus when 'F' then 'failure' when 'O' then 'success' end as status,
  case when o_orderstatus <> 'P' then cast(round(o_totalprice * 100) as bigint) end as computation_cost,
  case when o_orderstatus <> 'P' then o_custkey * 10 end as storage_cost,
  case when o_orderstatus <> 'P' then o_custkey * 9 end as storage_rebate,
  coalesce(n, 0) as event_count
from {orders} left join (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey) l
  on l_orderkey = o_orderkey
"""

_CHECKPOINTS = """
select checkpoint_sequence as sequence_number, max(timestamp_ms) as timestamp_ms,
  min(digest) as first_digest, count(*) as n_transactions
from {chain_transactions} group by checkpoint_sequence
"""


def chain_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the canonical columns (and `event_id`, the source's own key)."""
    return map_events(spark, raw_events(spark, folder))


def chain_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions in the nested canonical shape.

    Their event list is built from a count, which has the list's length without
    gathering rows.
    """
    flat = _flat_transactions(spark, folder)
    gas = F.struct("computation_cost", "storage_cost", "storage_rebate")
    effects = F.when(F.col("status").isNotNull(), F.struct(F.col("status"), gas.alias("gas")))
    one = F.struct(F.lit(0).cast("bigint").alias("event_seq"), F.lit("LineEvent").alias("type_name"))
    events = F.array_repeat(one, F.col("event_count").cast("int"))
    return flat.select(
        "digest", "checkpoint_sequence", "timestamp_ms", "sender", effects.alias("effects"), events.alias("events")
    )


def chain_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    flat = _flat_transactions(spark, folder)
    return spark.sql(_CHECKPOINTS, chain_transactions=flat)


def oracle_tables() -> str:
    """The same tables as DuckDB common table expressions."""
    events = _EVENTS.format(event_ms=_DUCKDB_MS.format("ts"), events="events")
    transactions = _TRANSACTIONS.format(
        order_ms=_DUCKDB_MS.format("o_orderdate"), orders="orders", lineitem="lineitem"
    )
    checkpoints = _CHECKPOINTS.format(chain_transactions="chain_transactions")
    return f"chain_events as ({events}), chain_transactions as ({transactions}), chain_checkpoints as ({checkpoints})"


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events")


def map_events(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """`chain_events` of a given raw frame, which may be a stream."""
    text = _EVENTS.replace("{event_ms}", _SPARK_MS.format("ts"))
    return configure(spark).sql(text, events=raw).withColumn("bcs", F.lit(None).cast("binary"))


def _flat_transactions(spark: SparkSession, folder: str) -> DataFrame:
    text = _TRANSACTIONS.replace("{order_ms}", _SPARK_MS.format("o_orderdate"))
    return configure(spark).sql(
        text, orders=_table(spark, folder, "orders"), lineitem=_table(spark, folder, "lineitem")
    )


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
