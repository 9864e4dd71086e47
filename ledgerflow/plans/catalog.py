"""Named queries over the test tables, each with the SQL that must give the same rows.

Results are flat: lists come as joined text, times as epoch milliseconds, days as
text and wide amounts as BIGINT, so that two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow import fixed_values as fixed
from ledgerflow import schemas
from ledgerflow.functions.ids import canonical_id, full_type, is_module_name, row_id
from ledgerflow.functions.payload import field_text, json_field, payload_map
from ledgerflow.operators import enrich, filters, lending, outcomes, ranges, reports, routing, transactions
from ledgerflow.operators.rules import (
    Rule,
    event_type_rule,
    filter_stats,
    lending_rules,
    module_rule,
    sender_rule,
)
from ledgerflow.plans.pipeline import Pipeline
from ledgerflow.session import scratch_folder
from ledgerflow.sinks.store import Store, event_ledger, new_rows, read_range
from ledgerflow.sources import paging, readers
from ledgerflow.sources.tables import (
    chain_checkpoints,
    chain_events,
    chain_transactions,
    map_events,
    oracle_tables,
    raw_events,
)
from ledgerflow.streaming.streams import dedupe_stream, keep_counts, latest_counts, running_type_counts

Query = Callable[[SparkSession, str], DataFrame]

# The run's time: 2024-01-15 12:00 UTC, inside the events' month.
AS_OF = 1705320000000
PAGE = 50

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the derived tables and the helpers of `_WITH`."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = f"{_WITH}\n{sql.strip()}"
        return function

    return register


# `ok` adds the payload as JSON where it is valid, and the time with its fallback.
_WITH = f"""with {oracle_tables()},
ok as (
  select *, case when json_valid(parsed_json) then parsed_json end as j,
    case when json_valid(parsed_json) and json_type(parsed_json) = 'OBJECT' then parsed_json end as obj,
    coalesce(timestamp_ms, {AS_OF}) as time_ms,
    strftime(make_timestamp(coalesce(timestamp_ms, {AS_OF}) * 1000), '%Y-%m-%d') as day,
    case type_name when 'DepositEvent' then 'deposit' when 'WithdrawEvent' then 'withdraw'
      when 'BorrowEvent' then 'borrow' when 'RepayEvent' then 'repay' end as action,
    starts_with(package_id, '{fixed.PREFIX_PROTOCOL_IDS[0]}') as member,
    contains(package_id, '{fixed.CONTAINED_PROTOCOL_ID}') as mentioned
  from chain_events),
effects as (
  select *, computation_cost + storage_cost as gas, coalesce(status = 'success', false) as success
  from chain_transactions),
batch_log as (
  select checkpoint_sequence as batch_id, count(*) as events, count(distinct transaction_digest) as transactions,
    count(*) filter (where not json_valid(parsed_json)) as errors,
    max(timestamp_ms) - min(timestamp_ms) as event_ms, 3 * count(distinct transaction_digest) as transaction_ms,
    checkpoint_sequence, min(timestamp_ms) as started_ms, max(timestamp_ms) as finished_ms
  from chain_events group by checkpoint_sequence),
batch_totals as (
  select cast(sum(events) as bigint) as total_events, cast(sum(transactions) as bigint) as total_transactions,
    cast(sum(errors) as bigint) as error_count, cast(sum(event_ms) as bigint) as event_ms,
    cast(sum(transaction_ms) as bigint) as transaction_ms, min(started_ms) as start_ms, max(finished_ms) as last_ms,
    arg_max(checkpoint_sequence, finished_ms * 1000000 + batch_id) as current_checkpoint,
    (max(finished_ms) - min(started_ms)) // 1000 as seconds
  from batch_log),
ends as (select (select max(sequence_number) from chain_checkpoints) as head,
                (select max(checkpoint_sequence) from chain_events) as done),
actions as (
  select *, case when contains(type_name, 'DepositEvent') then 'deposit' when contains(type_name, 'BorrowEvent') then 'borrow'
      when contains(type_name, 'WithdrawEvent') then 'withdraw' when contains(type_name, 'RepayEvent') then 'repay'
      when contains(type_name, 'LiquidationEvent') then 'liquidation' else 'other' end as event_class,
    json_extract_string(obj, '$.coin_type') as coin_type, json_extract_string(obj, '$.pool_id') as pool_id,
    coalesce(cast(json_extract_string(obj, '$.amount') as bigint), 0) as amount
  from ok where transaction_module = 'lending')"""

_COIN_ID = "concat('0x', lpad('2', 64, '0'))"
_SYSTEM_ID = "concat('0x', lpad('3', 64, '0'))"
_TYPE = "concat_ws('::', type_address, type_module, type_name)"


def _millis(column: str):
    return F.unix_millis(column)


def _joined(column: str, separator: str = ","):
    return F.array_join(column, separator)


def _long(column):
    return column.cast("bigint")


# --- rules ------------------------------------------------------------------

_SHOWN = ("event_id", "transaction_digest", "event_seq", "package_id", "type_name")
_SHOWN_SQL = "select event_id, transaction_digest, event_seq, package_id, type_name from ok"


def _some_rules() -> list[Rule]:
    return [
        module_rule("0x2", "coin"),
        event_type_rule(fixed.LENDING_PACKAGE_ID, "lending", "DepositEvent"),
        Rule(
            package=fixed.LENDING_PACKAGE_ID,
            module="lending",
            event_type=f"{fixed.LENDING_TYPE_ADDRESS}::lending::BorrowEvent",
        ),
        Rule(package="0x3", event_type="LiquidationEvent"),
        Rule(sender="0x7", event_type="RepayEvent"),
        Rule(package="not an id"),
    ]


_RULE_SQL = [
    f"package_id = {_COIN_ID} and transaction_module = 'coin'",
    f"package_id = '{fixed.LENDING_PACKAGE_ID}' and transaction_module = 'lending' "
    f"and {_TYPE} = '{fixed.LENDING_PACKAGE_ID}::lending::DepositEvent'",
    f"package_id = '{fixed.LENDING_PACKAGE_ID}' and transaction_module = 'lending' "
    f"and {_TYPE} = '{fixed.LENDING_TYPE_ADDRESS}::lending::BorrowEvent'",
    f"package_id = {_SYSTEM_ID} and type_name = 'LiquidationEvent'",
    "sender = concat('0x', lpad('7', 64, '0')) and type_name = 'RepayEvent'",
]


@query(f"{_SHOWN_SQL} where {' or '.join(f'({r})' for r in _RULE_SQL)}")
def filter_events(spark: SparkSession, folder: str) -> DataFrame:
    return filters.filter_events(chain_events(spark, folder), _some_rules()).select(*_SHOWN)


@query(f"{_SHOWN_SQL} where sender in (concat('0x', lpad('7', 64, '0')), concat('0x', lpad('2a', 64, '0')))")
def filter_by_sender(spark: SparkSession, folder: str) -> DataFrame:
    rules = [sender_rule("0x7"), sender_rule("0x2A"), Rule(sender="0xno_address")]
    return filters.filter_events(chain_events(spark, folder), rules).select(*_SHOWN)


@query(
    f"{_SHOWN_SQL} where transaction_module = 'lending' and {_TYPE} in "
    f"('{fixed.PREFIX_PROTOCOL_IDS[0]}::lending::DepositEvent', '{fixed.PREFIX_PROTOCOL_IDS[0]}::lending::WithdrawEvent',"
    f" '{fixed.PREFIX_PROTOCOL_IDS[0]}::lending::BorrowEvent', '{fixed.PREFIX_PROTOCOL_IDS[0]}::lending::RepayEvent')"
)
def filter_full_type(spark: SparkSession, folder: str) -> DataFrame:
    rules = lending_rules(fixed.PREFIX_PROTOCOL_IDS[0])
    return filters.filter_events(chain_events(spark, folder), rules).select(*_SHOWN)


@query(
    "select event_id, concat_ws('|', "
    + ", ".join(f"case when {sql} then '{rule.label()}' end" for sql, rule in zip(_RULE_SQL, _some_rules()))
    + ") as matched_filters from ok"
)
def matched_filters(spark: SparkSession, folder: str) -> DataFrame:
    labelled = filters.match_rules(chain_events(spark, folder), _some_rules())
    return labelled.select("event_id", _joined("matched_filters", "|").alias("matched_filters"))


def _rules_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for each customer as sender, for each full type, and for each module of a package."""
    none = F.lit(None).cast("string")
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    senders = customers.select(
        F.concat(F.lit("sender-"), "c_custkey").alias("name"),
        none.alias("package"),
        none.alias("module"),
        none.alias("event_type"),
        F.concat(F.lit("0x"), F.lower(F.hex("c_custkey"))).alias("sender"),
    )
    events = chain_events(spark, folder)
    whole = full_type("type_address", "type_module", "type_name")
    types = events.select(
        F.concat(F.lit("type-"), whole).alias("name"),
        none.alias("package"),
        none.alias("module"),
        whole.alias("event_type"),
        none.alias("sender"),
    ).distinct()
    modules = events.select(
        F.concat(F.lit("module-"), "package_id", F.lit("-"), "transaction_module").alias("name"),
        F.col("package_id").alias("package"),
        F.col("transaction_module").alias("module"),
        none.alias("event_type"),
        none.alias("sender"),
    ).distinct()
    return senders.unionByName(types).unionByName(modules)


@query(
    f"""
select e.event_id, concat_ws('|', concat('module-', package_id, '-', transaction_module),
  case when c_custkey is not null then concat('sender-', c_custkey) end, concat('type-', {_TYPE})) as matched_filters
from ok e left join customer on sender = concat('0x', lpad(lower(hex(c_custkey)), 64, '0'))
"""
)
def matched_filters_many(spark: SparkSession, folder: str) -> DataFrame:
    labelled = filters.match_rules(chain_events(spark, folder), _rules_from_tables(spark, folder))
    return labelled.select("event_id", _joined("matched_filters", "|").alias("matched_filters"))


@query(
    f"""
select e.event_id, transaction_digest, event_seq, package_id, type_name
from ok e where exists (select 1 from customer where sender = concat('0x', lpad(lower(hex(c_custkey)), 64, '0')))
"""
)
def filter_by_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    rules = _rules_from_tables(spark, folder).where(F.col("sender").isNotNull())
    return filters.filter_events(chain_events(spark, folder), rules).select(*_SHOWN)


@query(
    f"""
select (select count(*) from customer) + count(distinct {_TYPE}) + count(distinct (package_id, transaction_module)) as total_filters,
  count(distinct package_id) as package_filters, count(distinct (package_id, transaction_module)) as module_filters,
  count(distinct {_TYPE}) as event_type_filters, (select count(distinct c_custkey) from customer) as sender_filters
from ok
""",
    name="filter_stats",
)
def _filter_stats(spark: SparkSession, folder: str) -> DataFrame:
    return filter_stats(_rules_from_tables(spark, folder))


# --- enrichment -------------------------------------------------------------

_TAGS = (
    "concat_ws(',', case when member then 'navi' end, case when member then 'lending' end, action, type_module{})"
)


def _envelope(processed: DataFrame) -> DataFrame:
    return processed.select(
        "id",
        "transaction_digest",
        "event_seq",
        "checkpoint_sequence",
        _millis("timestamp").alias("timestamp_ms"),
        "package_id",
        "module_name",
        "event_type",
        "sender",
        F.col("metadata.event_index").alias("event_index"),
        _joined("metadata.matched_filters").alias("matched_filters"),
        _joined("metadata.tags").alias("tags"),
    )


def _envelope_sql(time: str, index: str, matched: str, tags: str) -> str:
    return f"""
select sha256(concat(transaction_digest, ':', event_seq)) as id, transaction_digest, event_seq, checkpoint_sequence,
  {time} as timestamp_ms, package_id, type_module as module_name, type_name as event_type, sender,
  {index} as event_index, {matched} as matched_filters, {tags} as tags
from ok
"""


@query(_envelope_sql("time_ms", "event_seq", "''", _TAGS.format("")))
def enrich_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return _envelope(enrich.enrich_events(chain_events(spark, folder), as_of=AS_OF))


@query(_envelope_sql("time_ms", "event_seq", "''", _TAGS.format(", 'defi', 'navi-protocol'")))
def profile_lending(spark: SparkSession, folder: str) -> DataFrame:
    return _envelope(enrich.enrich_lending_events(chain_events(spark, folder), as_of=AS_OF))


_MATCHED = "case when mentioned then 'navi_protocol' else '' end"


def _profile_fields(processed: DataFrame, *paths: str) -> DataFrame:
    shown = [F.get_json_object("fields", f"$.{p}").alias(f"field_{p.rsplit('.', 1)[-1]}") for p in paths]
    return processed.select(
        "id",
        _millis("timestamp").alias("timestamp_ms"),
        F.col("metadata.event_index").alias("event_index"),
        _joined("metadata.matched_filters").alias("matched_filters"),
        _joined("metadata.tags").alias("tags"),
        *shown,
    )


def _profile_sql(matched: str, tags: str, fields: str) -> str:
    return f"""
select sha256(concat(transaction_digest, ':', event_seq)) as id, cast({AS_OF} as bigint) as timestamp_ms,
  cast(0 as bigint) as event_index, {matched} as matched_filters, {tags} as tags, {fields}
from ok
"""


@query(
    _profile_sql(
        _MATCHED,
        "case when mentioned then 'navi,defi' else '' end",
        "type_name as field_type, json_extract_string(j, '$.amount') as field_amount, "
        "json_extract_string(j, '$.k') as field_k",
    )
)
def profile_default(spark: SparkSession, folder: str) -> DataFrame:
    processed = enrich.enrich_default(chain_events(spark, folder), as_of=AS_OF)
    return _profile_fields(processed, "type", "parsed_json.amount", "parsed_json.k")


@query(
    _profile_sql(
        "''",
        "'simple'",
        "json_extract_string(j, '$.pool_id') as field_pool_id, json_extract_string(j, '$.k') as field_k",
    )
)
def profile_simple(spark: SparkSession, folder: str) -> DataFrame:
    return _profile_fields(enrich.enrich_simple(chain_events(spark, folder), as_of=AS_OF), "pool_id", "k")


@query(
    _profile_sql(
        _MATCHED,
        "case when mentioned then 'navi,defi,lending' else 'blockchain' end",
        "json_extract_string(j, '$.coin_type') as field_coin_type, json_extract_string(j, '$.k') as field_k",
    )
)
def profile_defi(spark: SparkSession, folder: str) -> DataFrame:
    return _profile_fields(enrich.enrich_defi(chain_events(spark, folder), as_of=AS_OF), "coin_type", "k")


def _fields(df: DataFrame, *names: str) -> DataFrame:
    """Single keys of the fields text, parsed once per row."""
    parsed = df.select("transaction_digest", "event_seq", payload_map("fields").alias("f"))
    picked = [F.try_variant_get(F.element_at("f", n), "$", "string").alias(n) for n in names]
    return parsed.select("transaction_digest", "event_seq", *picked)


_FIELD_NAMES = (
    "package_id",
    "module",
    "event_type",
    "sender",
    "transaction_digest",
    "event_sequence",
    "timestamp_ms",
    "amount",
    "coin_type",
    "user",
    "k",
)


@query(
    """
select transaction_digest, event_seq, package_id, type_module as module, type_name as event_type, sender,
  transaction_digest as digest_field, cast(event_seq as varchar) as event_sequence,
  cast(timestamp_ms as varchar) as timestamp_ms, json_extract_string(obj, '$.amount') as amount,
  json_extract_string(obj, '$.coin_type') as coin_type, json_extract_string(obj, '$.user') as user,
  json_extract_string(obj, '$.k') as k
from ok
"""
)
def enrich_fields(spark: SparkSession, folder: str) -> DataFrame:
    processed = enrich.enrich_events(chain_events(spark, folder), as_of=AS_OF)
    parsed = processed.select("transaction_digest", "event_seq", payload_map("fields").alias("f"))

    def text(name: str):
        return F.try_variant_get(F.element_at("f", name), "$", "string")

    shown = [text(n).alias("digest_field" if n == "transaction_digest" else n) for n in _FIELD_NAMES]
    return parsed.select("transaction_digest", "event_seq", *shown)


_LENDING_FIELDS = (
    "protocol",
    "action",
    "deposit_amount",
    "withdraw_amount",
    "borrow_amount",
    "repay_amount",
    "user_address",
    "success",
    "asset_id",
    "pool_id",
)


@query(
    """
select transaction_digest, event_seq, case when member then 'navi' end as protocol,
  case when member then coalesce(action, 'unknown') end as action,
  case when member and action = 'deposit' then json_extract_string(obj, '$.amount') end as deposit_amount,
  case when member and action = 'withdraw' then json_extract_string(obj, '$.amount') end as withdraw_amount,
  case when member and action = 'borrow' then json_extract_string(obj, '$.amount') end as borrow_amount,
  case when member and action = 'repay' then json_extract_string(obj, '$.amount') end as repay_amount,
  case when member and action is not null then json_extract_string(obj, '$.user') end as user_address,
  case when member and action is not null and obj is not null then 'true' end as success,
  json_extract_string(obj, '$.asset_id') as asset_id, json_extract_string(obj, '$.pool_id') as pool_id
from ok
"""
)
def lending_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(enrich.enrich_events(chain_events(spark, folder), as_of=AS_OF), *_LENDING_FIELDS)


@query(
    """
select event_id, case when json_type(obj, '$.amount') in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')
    then json_extract_string(obj, '$.amount') end as amount,
  case when json_type(obj, '$.asset_id') in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')
    then json_extract_string(obj, '$.asset_id') end as asset_id,
  json_extract_string(obj, '$.k') as k, cast(null as varchar) as nonexistent
from ok
""",
    name="json_field",
)
def _json_field(spark: SparkSession, folder: str) -> DataFrame:
    parsed = chain_events(spark, folder).select("event_id", "parsed_json", payload_map("parsed_json").alias("p"))
    return parsed.select(
        "event_id",
        json_field("parsed_json", "amount").alias("amount"),
        *[field_text("p", name).alias(name) for name in ("asset_id", "k", "nonexistent")],
    )


@query(
    """
select sha256(concat(transaction_digest, ':', event_seq)) as id, checkpoint_sequence, transaction_digest,
  event_seq as event_sequence, type_name as event_type, package_id, type_module as module_name, sender, timestamp_ms,
  cast(null as varchar) as bcs, json_extract_string(obj, '$.amount') as amount
from ok
"""
)
def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.event_rows(chain_events(spark, folder), as_of=AS_OF)
    amount = F.get_json_object("fields", "$.amount").alias("amount")
    kept = [c for c in rows.columns if c not in ("fields", "created_at", "bcs")]
    return rows.select(*kept, F.base64("bcs").alias("bcs"), amount)


@query("select event_class, package_id, count(*) as events from actions group by event_class, package_id")
def event_classes(spark: SparkSession, folder: str) -> DataFrame:
    events = chain_events(spark, folder).where(F.col("transaction_module") == "lending")
    classed = events.withColumn("event_class", enrich.event_class())
    return classed.groupBy("event_class", "package_id").agg(F.count("*").alias("events"))


# --- outcomes ---------------------------------------------------------------

_OUTCOME_SQL = f"""
decided as (select *, ({' or '.join(f'({r})' for r in _RULE_SQL)}) as wanted from ok),
outcomes as (select *, case when not wanted then 'filtered' when j is null then 'error' else 'success' end as outcome,
  case when not wanted then 'no rule matched' when j is null then 'payload is not JSON' end as reason from decided)"""


def _with_outcomes(sql: str) -> str:
    return f", {_OUTCOME_SQL.strip()}\n{sql}"


@query(_with_outcomes("select event_id, outcome, reason from outcomes"), name="outcomes")
def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.event_outcomes(chain_events(spark, folder), _some_rules()).select("event_id", "outcome", "reason")


@query(
    _with_outcomes(
        "select count(*) as records_in, count(*) filter (where outcome <> 'filtered') as after_filter, "
        "count(*) filter (where outcome = 'success') as records_out, "
        "count(*) filter (where outcome = 'error') as errors from outcomes"
    )
)
def batch_counts(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.batch_counts(outcomes.event_outcomes(chain_events(spark, folder), _some_rules()))


@query(
    "select 'payload is not JSON' as reason, parsed_json as payload, transaction_digest as digest, checkpoint_sequence "
    "from ok where j is null"
)
def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    rows = outcomes.quarantine(outcomes.event_outcomes(chain_events(spark, folder)), AS_OF)
    return rows.select(
        "reason",
        F.get_json_object("record", "$.parsed_json").alias("payload"),
        F.get_json_object("record", "$.transaction_digest").alias("digest"),
        "checkpoint_sequence",
    )


@query(
    """
select case when status is null then 'skipped' else 'success' end as outcome,
  case when status is null then 'effects are missing' end as reason, count(*) as n
from chain_transactions group by 1, 2
"""
)
def transaction_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.outcome_counts(outcomes.transaction_outcomes(chain_transactions(spark, folder)))


@query(
    _with_outcomes(
        "select sha256(concat(transaction_digest, ':', event_seq, ':', outcome)) as id, transaction_digest, "
        "event_seq as event_sequence, checkpoint_sequence, outcome as status, "
        "case when outcome = 'error' then reason end as error_message from outcomes"
    ),
    name="event_ledger",
)
def _event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_ledger(outcomes.event_outcomes(chain_events(spark, folder), _some_rules()), AS_OF)
    return rows.drop("processed_at", "processing_duration_ms")


# --- transactions -----------------------------------------------------------


@query(
    """
select digest, checkpoint_sequence, timestamp_ms, sender, success, gas as gas_used, event_count from effects
""",
    name="transactions",
)
def _transactions(spark: SparkSession, folder: str) -> DataFrame:
    done = transactions.project_transactions(chain_transactions(spark, folder), as_of=AS_OF)
    return done.select(
        "digest",
        "checkpoint_sequence",
        _millis("timestamp").alias("timestamp_ms"),
        "sender",
        "metadata.success",
        "metadata.gas_used",
        "metadata.event_count",
    )


@query(
    """
select sha256(digest) as id, digest, checkpoint_sequence, timestamp_ms, sender, coalesce(gas, 0) as gas_used,
  case when success then 'true' else 'false' end as status
from effects
"""
)
def tx_store_shape(spark: SparkSession, folder: str) -> DataFrame:
    done = transactions.project_transactions(chain_transactions(spark, folder), as_of=AS_OF)
    return transactions.stored_transactions(done).select(
        "id", "digest", "checkpoint_sequence", _millis("timestamp").alias("timestamp_ms"), "sender", "gas_used", "status"
    )


@query(
    """
select sha256(digest) as id, digest, checkpoint_sequence, timestamp_ms, sender, gas as gas_used,
  cast(null as bigint) as gas_price, success, cast(null as varchar) as error_message
from effects
"""
)
def transaction_rows(spark: SparkSession, folder: str) -> DataFrame:
    done = transactions.project_transactions(chain_transactions(spark, folder), as_of=AS_OF)
    return transactions.transaction_rows(done).drop("created_at")


@query("select transaction_digest, count(*) as event_count from chain_events group by transaction_digest")
def events_per_transaction(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.events_per_transaction(chain_events(spark, folder))


def _tx_with_events(spark: SparkSession, folder: str, per_part: int) -> DataFrame:
    events = chain_events(spark, folder).select("transaction_digest", "event_seq", "type_name")
    both = transactions.transactions_with_events(
        chain_transactions(spark, folder).select("digest", "checkpoint_sequence"), events, per_part=per_part
    )
    texts = F.transform("processed_events", lambda e: F.concat_ws(":", e["event_seq"].cast("string"), e["type_name"]))
    return both.select(
        "digest",
        "checkpoint_sequence",
        "part",
        _long(F.size("processed_events")).alias("n_events"),
        F.array_join(texts, ",").alias("events"),
    )


def _tx_with_events_sql(per_part: int) -> str:
    return f"""
, lists as (
  select transaction_digest, event_seq // {per_part} as part, count(*) as n,
    string_agg(concat(event_seq, ':', type_name), ',' order by event_seq) as events
  from chain_events group by 1, 2)
select digest, checkpoint_sequence, 0 as part, coalesce(n, 0) as n_events, coalesce(events, '') as events
from chain_transactions left join (select * from lists where part = 0) l on transaction_digest = digest
union all
select digest, null, part, n, events from chain_transactions join lists on transaction_digest = digest where part > 0
"""


@query(_tx_with_events_sql(transactions.EVENTS_PER_PART))
def tx_with_events(spark: SparkSession, folder: str) -> DataFrame:
    return _tx_with_events(spark, folder, transactions.EVENTS_PER_PART)


@query(_tx_with_events_sql(2))
def tx_with_events_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _tx_with_events(spark, folder, 2)


# --- reports ----------------------------------------------------------------

_DAILY_SQL = """
, counts as (
  select day as date, package_id, type_module as module_name, type_name as event_type, count(*) as event_count,
    count(distinct sender) as unique_senders
  from {source} group by all),
gas as (
  select date, package_id, module_name, event_type, cast(sum(gas) as bigint) as total_gas_used from (
    select distinct day as date, package_id, type_module as module_name, type_name as event_type, transaction_digest
    from {source}) join effects on digest = transaction_digest group by all)
select date, package_id, module_name, event_type, event_count, unique_senders,
  coalesce(total_gas_used, 0) as total_gas_used
from counts left join gas using (date, package_id, module_name, event_type)
"""


def _stats(df: DataFrame) -> DataFrame:
    measures = [F.col(c).cast("bigint").alias(c) for c in ("event_count", "unique_senders", "total_gas_used")]
    return df.select(
        F.col("date").cast("string").alias("date"), "package_id", "module_name", "event_type", *measures
    )


@query(_DAILY_SQL.format(source="ok"))
def event_stats_daily(spark: SparkSession, folder: str) -> DataFrame:
    stats = reports.daily_event_stats(chain_events(spark, folder), chain_transactions(spark, folder), as_of=AS_OF)
    return _stats(stats)


@query(_DAILY_SQL.format(source="(select * from ok where transaction_module = 'lending')"))
def lending_stats_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: events of the two lending packages by day, module and type, with their gas."""
    ids = (fixed.LENDING_PACKAGE_ID, *fixed.PREFIX_PROTOCOL_IDS)
    kept = filters.filter_events(chain_events(spark, folder), [module_rule(i, fixed.LENDING_MODULE) for i in ids])
    return _stats(reports.daily_event_stats(kept, chain_transactions(spark, folder), as_of=AS_OF))


@query("select type_name as event_type, count(*) as event_count from chain_events group by type_name")
def stats_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return reports.stats_by_type(chain_events(spark, folder))


def _batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """One batch per checkpoint, timed by its events."""
    per_batch = (
        chain_events(spark, folder)
        .groupBy("checkpoint_sequence")
        .agg(
            F.count("*").alias("events"),
            F.countDistinct("transaction_digest").alias("transactions"),
            F.count_if(F.get_json_object("parsed_json", "$").isNull()).alias("errors"),
            (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("event_ms"),
            F.timestamp_millis(F.min("timestamp_ms")).alias("started_at"),
            F.timestamp_millis(F.max("timestamp_ms")).alias("finished_at"),
        )
    )
    return per_batch.select(
        F.lit("run").alias("run_id"),
        F.col("checkpoint_sequence").alias("batch_id"),
        "events",
        "transactions",
        "errors",
        "event_ms",
        (F.col("transactions") * 3).alias("transaction_ms"),
        "checkpoint_sequence",
        "started_at",
        "finished_at",
    )


@query(
    f"""
select total_events, total_transactions, coalesce(total_events::double / nullif(seconds, 0), 0) as events_per_second,
  coalesce(total_transactions::double / nullif(seconds, 0), 0) as transactions_per_second,
  event_ms::double / total_events as avg_event_processing_ms,
  transaction_ms::double / total_transactions as avg_transaction_processing_ms,
  start_ms as start_time, last_ms as last_update, current_checkpoint, error_count,
  ({AS_OF} + 2678400000 - start_ms) // 1000 as uptime_seconds, ({AS_OF} + 2678400000 - last_ms) // 1000 as seconds_since_update
from batch_totals
"""
)
def processing_stats(spark: SparkSession, folder: str) -> DataFrame:
    # Seen 31 days after the usual time, when all batches are done.
    stats = reports.processing_stats(_batch_log(spark, folder), as_of=AS_OF + 31 * 86400 * 1000)
    return stats.withColumns({c: _millis(c) for c in ("start_time", "last_update")})


def _progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress as if each checkpoint of the events were a batch."""
    done = chain_events(spark, folder).groupBy("checkpoint_sequence").agg(F.max("timestamp_ms").alias("ms"))
    return done.select(
        "checkpoint_sequence",
        F.lit("running").alias("status"),
        F.timestamp_millis("ms").alias("updated_at"),
        F.col("checkpoint_sequence").alias("batch_id"),
        F.lit(False).alias("reset"),
        F.lit(0).cast("bigint").alias("generation"),
    )


@query(
    """
, base as (select count(*) as n, min(ms) as first_ms, max(ms) as last_ms from (
    select checkpoint_sequence, max(timestamp_ms) as ms from chain_events group by 1)),
rated as (select n, head, done, n::double / ((last_ms - first_ms) // 1000) as rate from base cross join ends)
select n as total_processed, done as current_checkpoint, head as target_checkpoint, rate as processing_rate,
  greatest(head - done, 0) as checkpoints_remaining, cast(floor(greatest(head - done, 0) / rate) as bigint) as seconds_remaining
from rated
"""
)
def checkpoint_stats(spark: SparkSession, folder: str) -> DataFrame:
    target = readers.chain_head(chain_checkpoints(spark, folder)).scalar()
    return reports.checkpoint_stats(_progress(spark, folder), target=target)


@query(
    """
select total_events, total_transactions, done as last_checkpoint,
  coalesce(total_events::double / nullif(seconds, 0), 0) * 60 as events_per_minute, error_count
from batch_totals cross join ends
"""
)
def status_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.status_report(_batch_log(spark, folder), _progress(spark, folder), as_of=AS_OF)


@query(
    """
select head as latest_checkpoint, done as processed_checkpoint, greatest(head - done, 0) as lag,
  done >= head as caught_up, greatest(head - done, 0) <= 10 as healthy, cast(null as varchar) as error
from ends
"""
)
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    return reports.freshness(chain_checkpoints(spark, folder), _progress(spark, folder), max_lag=10)


@query(
    """
select checkpoint_sequence as latest_checkpoint, checkpoint_sequence as last_processed_checkpoint
from (select checkpoint_sequence, year(make_timestamp(timestamp_ms * 1000)) as generation from chain_transactions)
order by generation desc, checkpoint_sequence desc limit 1
"""
)
def progress_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each transaction's checkpoint as a progress row, every year having begun with a reset."""
    rows = chain_transactions(spark, folder).select(
        "checkpoint_sequence", F.year(F.timestamp_millis("timestamp_ms")).cast("bigint").alias("generation")
    )
    return reports.latest_progress(rows)


# --- reads ------------------------------------------------------------------


@query("select max(sequence_number) as head from chain_checkpoints")
def chain_head(spark: SparkSession, folder: str) -> DataFrame:
    return readers.chain_head(chain_checkpoints(spark, folder))


@query("select * from chain_checkpoints where sequence_number = (select done // 2 from ends)")
def checkpoint_lookup(spark: SparkSession, folder: str) -> DataFrame:
    middle = _done(spark, folder) // 2
    return readers.checkpoint_at(chain_checkpoints(spark, folder), middle)


def _done(spark: SparkSession, folder: str) -> int:
    """The last checkpoint that has events."""
    return chain_events(spark, folder).agg(F.max("checkpoint_sequence")).first()[0]


@query(f"{_SHOWN_SQL} where checkpoint_sequence >= (select done // 3 from ends) or checkpoint_sequence = 0")
def backfill_from(spark: SparkSession, folder: str) -> DataFrame:
    start = ranges.start_checkpoint(0, _done(spark, folder) // 3)
    return readers.from_checkpoint(chain_events(spark, folder), start).select(*_SHOWN)


@query(
    """
select sha256(concat(transaction_digest, ':', event_seq)) as id, transaction_digest, event_seq, checkpoint_sequence,
  type_name as event_type
from ok, ends where checkpoint_sequence between done // 4 and 3 * done // 4
"""
)
def range_read(spark: SparkSession, folder: str) -> DataFrame:
    done = _done(spark, folder)
    processed = enrich.enrich_events(chain_events(spark, folder), as_of=AS_OF)
    rows = read_range(processed, done // 4, 3 * done // 4)
    return rows.select("id", *schemas.EVENT_KEY, "checkpoint_sequence", "event_type")


def _positions(page: DataFrame, descending: bool = False) -> DataFrame:
    """Number the rows of a page, which never has more than its limit."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in paging.PAGE_KEY]
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return page.select(*paging.PAGE_KEY, "type_name", rank.alias("position"))


def _page_sql(direction: str, skip: int, where: str = "true") -> str:
    order = f"checkpoint_sequence {direction}, transaction_digest {direction}, event_seq {direction}"
    return f"""
select checkpoint_sequence, transaction_digest, event_seq, type_name, position - {skip} as position from (
  select *, row_number() over (order by {order}) as position from chain_events where {where})
where position > {skip} and position <= {skip + PAGE}
"""


@query(_page_sql("asc", PAGE))
def page_after_cursor(spark: SparkSession, folder: str) -> DataFrame:
    events = chain_events(spark, folder)
    first = paging.query_events(events, limit=PAGE)
    return _positions(paging.query_events(events, limit=PAGE, cursor=first.next_cursor).data)


@query(_page_sql("desc", 0))
def page_desc(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(paging.query_events(chain_events(spark, folder), limit=PAGE, descending=True).data, True)


@query(_page_sql("asc", 0, f"package_id = {_COIN_ID} and sender = concat('0x', lpad('7', 64, '0'))"))
def page_of_package(spark: SparkSession, folder: str) -> DataFrame:
    page = paging.query_events(chain_events(spark, folder), package_id="0x2", sender="0x7", limit=PAGE, window=4)
    return _positions(page.data)


@query(
    """
select transaction_digest, event_seq, checkpoint_sequence, timestamp_ms, package_id, transaction_module, type_address,
  type_module, type_name, sender, coalesce(json_extract_string(obj, '$.amount'), json_extract_string(obj, '$.k')) as value
from ok
"""
)
def wire_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as wire text and decoded again; a payload that isn't JSON is null on the wire."""
    events = chain_events(spark, folder)
    checkpoint = F.concat(F.lit(',"checkpoint":'), "checkpoint_sequence", F.lit("}"))
    text = F.concat(F.regexp_replace(enrich.source_event(), "}$", ""), checkpoint)
    decoded = readers.decode_wire_events(events.select(text.alias("value")))
    amount = F.get_json_object("parsed_json", "$.amount")
    return decoded.select(
        *[c for c in schemas.EVENTS.fieldNames() if c not in ("parsed_json", "bcs")],
        F.coalesce(amount, F.get_json_object("parsed_json", "$.k")).alias("value"),
    )


# --- ranges -----------------------------------------------------------------


@query(
    """
, starts as (select unnest(generate_series(0, head, 7)) as start from ends)
select start, least(start + 6, head) as end, count(digest) as present
from starts cross join ends left join chain_transactions
  on checkpoint_sequence between start and least(start + 6, head)
group by start, head
"""
)
def split_range(spark: SparkSession, folder: str) -> DataFrame:
    found = chain_transactions(spark, folder)
    head = found.agg(F.max("checkpoint_sequence")).first()[0]
    return ranges.chunk_counts(found, ranges.CheckpointRange(0, head), 7, "checkpoint_sequence")


@query(
    """
select c.sequence_number, e.cp as current, case when e.cp is not null then greatest(done - 5 - e.cp, 0) end as remaining,
  coalesce(e.cp >= done - 5, false) as caught_up, coalesce(e.cp + 1, 0) as next_checkpoint
from chain_checkpoints c cross join ends
left join (select distinct checkpoint_sequence as cp from chain_events) e on e.cp = c.sequence_number
"""
)
def remaining(spark: SparkSession, folder: str) -> DataFrame:
    """Each checkpoint seen as a state of the walk: how far is it to five before the last done one?"""
    done = chain_events(spark, folder).select(F.col("checkpoint_sequence").alias("current")).distinct()
    states = chain_checkpoints(spark, folder).join(done, F.col("sequence_number") == F.col("current"), "left")
    target = chain_events(spark, folder).agg((F.max("checkpoint_sequence") - 5).alias("t")).scalar()
    current = F.col("current")
    return states.select(
        "sequence_number",
        "current",
        reports.remaining(current, target).alias("remaining"),
        reports.caught_up(current, target).alias("caught_up"),
        F.coalesce(current + 1, F.lit(0).cast("bigint")).alias("next_checkpoint"),
    )


@query(
    """
select sequence_number as checkpoint_sequence from chain_checkpoints
where sequence_number not in (select checkpoint_sequence from chain_transactions where status = 'success')
"""
)
def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints up to the head without any successful transaction."""
    found = chain_transactions(spark, folder)
    head = found.agg(F.max("checkpoint_sequence")).first()[0]
    return ranges.missing_checkpoints(
        found.where(transactions.succeeded_flag()), ranges.CheckpointRange(0, head)
    )


# --- storage ----------------------------------------------------------------


@query("select transaction_digest, event_seq, sender, type_name from ok where member is false")
def dedupe_replay(spark: SparkSession, folder: str) -> DataFrame:
    """All events delivered twice, the protocol's having been stored before."""
    columns = [*schemas.EVENT_KEY, "sender", "type_name"]
    events = chain_events(spark, folder)
    stored = events.where(enrich.in_protocol()).select(*columns)
    twice = events.select(*columns).unionByName(events.select(*columns))
    return new_rows(twice, stored, schemas.EVENT_KEY)


@query(
    """
select sha256(concat(transaction_digest, ':', event_seq)) as id, transaction_digest, event_seq, checkpoint_sequence,
  time_ms as timestamp_ms, type_name as event_type, done as latest_checkpoint
from ok, ends where j is not null and checkpoint_sequence between done // 4 and 3 * done // 4
"""
)
def store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Run the job twice from the start, then read a range of what it stored."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    events = chain_events(spark, folder)
    for _ in range(2):
        Pipeline().run_batch(events, store, start=0, reset=True, as_of=AS_OF)
    latest = store.latest_checkpoint()
    rows = store.events_in_range(latest // 4, 3 * latest // 4)
    return rows.select(
        "id",
        *schemas.EVENT_KEY,
        "checkpoint_sequence",
        _millis("timestamp").alias("timestamp_ms"),
        "event_type",
        F.lit(latest).cast("bigint").alias("latest_checkpoint"),
    )


# --- lending ----------------------------------------------------------------


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    events = chain_events(spark, folder).where(F.col("transaction_module") == fixed.LENDING_MODULE)
    return lending.lending_actions(events, as_of=AS_OF)


@query(
    """
select sender as account, coin_type, cast(sum(case event_class when 'deposit' then amount else -amount end) as bigint) as net_deposit,
  count(*) filter (where event_class = 'deposit') as deposits, count(*) filter (where event_class = 'withdraw') as withdrawals
from actions where event_class in ('deposit', 'withdraw') group by sender, coin_type
"""
)
def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    held = lending.portfolio(_actions(spark, folder))
    return held.withColumn("net_deposit", _long(F.col("net_deposit")))


@query(
    """
select sender as account, coin_type, cast(sum(case event_class when 'borrow' then amount else -amount end) as bigint) as debt,
  count(*) filter (where event_class = 'borrow') as borrows, count(*) filter (where event_class = 'repay') as repayments
from actions where event_class in ('borrow', 'repay') group by sender, coin_type
"""
)
def debt(spark: SparkSession, folder: str) -> DataFrame:
    return lending.debt(_actions(spark, folder)).withColumn("debt", _long(F.col("debt")))


@query(
    """
, daily as (
  select pool_id, day, cast(sum(case event_class when 'deposit' then amount else -amount end) as bigint) as net_flow
  from actions where event_class in ('deposit', 'withdraw') group by pool_id, day)
select pool_id, day, net_flow, cast(sum(net_flow) over (partition by pool_id order by day) as bigint) as locked from daily
"""
)
def tvl_running(spark: SparkSession, folder: str) -> DataFrame:
    locked = lending.locked_value(_actions(spark, folder))
    return locked.select(
        "pool_id", F.col("day").cast("string").alias("day"), *[_long(F.col(c)).alias(c) for c in ("net_flow", "locked")]
    )


@query(
    """
, pools as (
  select pool_id, cast(sum(case event_class when 'deposit' then amount when 'withdraw' then -amount else 0 end) as bigint) as deposits,
    cast(sum(case event_class when 'borrow' then amount when 'repay' then -amount else 0 end) as bigint) as borrows
  from actions where event_class in ('deposit', 'withdraw', 'borrow', 'repay') group by pool_id)
select pool_id, deposits, borrows, case when deposits > 0 then round(borrows::double / deposits::double, 6) end as utilization
from pools
"""
)
def utilization(spark: SparkSession, folder: str) -> DataFrame:
    pools = lending.utilization(_actions(spark, folder))
    return pools.select(
        "pool_id",
        *[_long(F.col(c)).alias(c) for c in ("deposits", "borrows")],
        F.round("utilization", 6).alias("utilization"),
    )


@query(
    """
select transaction_digest, event_seq, checkpoint_sequence, time_ms as timestamp_ms, sender as liquidated_account,
  json_extract_string(obj, '$.liquidator') as liquidator,
  cast(json_extract_string(obj, '$.liquidated_amount') as bigint) as liquidated_amount
from actions where event_class = 'liquidation'
"""
)
def liquidations(spark: SparkSession, folder: str) -> DataFrame:
    alerts = lending.liquidations(_actions(spark, folder))
    return alerts.select(
        *schemas.EVENT_KEY,
        "checkpoint_sequence",
        _millis("timestamp").alias("timestamp_ms"),
        "liquidated_account",
        "liquidator",
        _long(F.col("liquidated_amount")).alias("liquidated_amount"),
    )


@query(
    """
select event_class, coin_type, pool_id, count(*) as events,
  cast(sum(cast(json_extract_string(obj, '$.amount') as bigint)) as bigint) as total_amount
from actions group by event_class, coin_type, pool_id
"""
)
def action_amounts(spark: SparkSession, folder: str) -> DataFrame:
    totals = lending.action_amounts(_actions(spark, folder))
    return totals.withColumn("total_amount", _long(F.col("total_amount")))


# --- streams ----------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = raw_events(spark, folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return map_events(spark, raw)


def _drain(stream: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    """Run a stream over all present data into a Parquet folder and read that."""
    folder = scratch_folder(spark, purpose)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/data")
    running = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


@query("select transaction_digest, event_seq, type_name, sender from chain_events")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """All events delivered twice in a stream."""
    columns = [*schemas.EVENT_KEY, "type_name", "sender"]
    events = _event_stream(spark, folder).select(*columns, "timestamp_ms")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _drain(dedupe_stream(twice, as_of=AS_OF).select(*columns), spark, "dedupe")


@query(
    """
select cast(epoch_ms(cast(day as timestamp)) as bigint) as window_start, type_name as event_type, count(*) as event_count
from ok group by 1, 2
"""
)
def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts as a stream keeps them, the day that is still open too."""
    counts = running_type_counts(_event_stream(spark, folder), as_of=AS_OF)
    kept = scratch_folder(spark, "counts")
    keep_counts(counts, f"{kept}/data", f"{kept}/state").awaitTermination()
    newest = latest_counts(spark.read.parquet(f"{kept}/data"))
    return newest.select(_millis("window_start").alias("window_start"), "event_type", "event_count")


@query(
    f"""
select transaction_digest, event_seq, type_name as event_type, concat_ws(',', case when member then 'navi' end,
  case when member then 'lending' end, action, type_module) as tags
from ok where j is not null and ({' or '.join(f'({r})' for r in _RULE_SQL)})
"""
)
def stream_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job as a stream into a store, run again with lost stream state."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    pipeline = Pipeline(rules=_some_rules())
    for _ in range(2):
        state = scratch_folder(spark, "state")
        running = pipeline.run_stream(_event_stream(spark, folder), store, state, interval=None, as_of=AS_OF)
        running.awaitTermination()
    rows = store.processed_events()
    return rows.select(*schemas.EVENT_KEY, "event_type", _joined("metadata.tags").alias("tags"))


# --- extensions -------------------------------------------------------------


@query(
    """
select event_id, concat(upper(substr(type_name, 1, 1)), lower(substr(type_name, 2))) as label,
  length(parsed_json) as payload_chars
from chain_events
"""
)
def udf_processor(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own logic on pandas batches."""

    def label(batch):
        return batch.assign(
            label=batch["type_name"].str.capitalize(), payload_chars=batch["parsed_json"].str.len().astype("int64")
        )[["event_id", "label", "payload_chars"]]

    process = routing.pandas_processor(
        label, "event_id bigint, label string, payload_chars bigint", ["event_id", "type_name", "parsed_json"]
    )
    return chain_events(spark, folder).transform(process)


@query(
    f"""
select event_id, case when package_id = {_COIN_ID} then concat('coin:', type_module)
  when package_id = {_SYSTEM_ID} then concat('system:', sender) else concat('other:', type_name) end as route
from chain_events
"""
)
def protocol_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Protocol handlers as columns, in one pass."""
    route = routing.route_columns(
        {
            "0x2": F.concat(F.lit("coin:"), "type_module"),
            "0x3": F.concat(F.lit("system:"), "sender"),
        },
        F.concat(F.lit("other:"), "type_name"),
    )
    return chain_events(spark, folder).select("event_id", route.alias("route"))


@query(
    f"""
select package_id, case when package_id = {_COIN_ID} then type_module else type_name end as kind, count(*) as events
from chain_events group by 1, 2
"""
)
def protocol_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Protocol handlers as whole processors."""

    def by_module(events: DataFrame) -> DataFrame:
        return events.groupBy("package_id", F.col("type_module").alias("kind")).agg(F.count("*").alias("events"))

    def by_type(events: DataFrame) -> DataFrame:
        return events.groupBy("package_id", F.col("type_name").alias("kind")).agg(F.count("*").alias("events"))

    return routing.route_frames(chain_events(spark, folder), {"0x2": by_module}, by_type)


@query(
    """
select event_id, concat('0x', lpad(lower(hex(user_id)), 64, '0')) as sender,
  sha256(concat(cast(event_id as varchar), ':', event_type)) as row_id,
  true as broken_id, regexp_full_match(event_type, '[A-Za-z][A-Za-z0-9_]*') as is_name, false as broken_name
from events
"""
)
def canonical_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and names; with a line break at the end they are none."""
    short = F.concat(F.lit("0x"), F.hex("user_id"))
    broken = [F.concat(part, F.lit("\n")) for part in (short, F.col("event_type"))]
    return raw_events(spark, folder).select(
        "event_id",
        canonical_id(short).alias("sender"),
        row_id("event_id", "event_type").alias("row_id"),
        canonical_id(broken[0]).isNull().alias("broken_id"),
        is_module_name("event_type").alias("is_name"),
        is_module_name(broken[1]).alias("broken_name"),
    )
