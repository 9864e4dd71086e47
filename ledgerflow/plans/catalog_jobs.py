"""Named queries over jobs: readers, resumed and repeated runs, ledgers, sinks, switches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow import fixed_values as fixed
from ledgerflow import schemas
from ledgerflow.functions.times import event_time
from ledgerflow.operators import enrich, filters, outcomes, ranges, reports, rules, transactions
from ledgerflow.plans.catalog import (
    _RULE_SQL,
    _SHOWN,
    _SHOWN_SQL,
    _DAILY_SQL,
    AS_OF,
    _drain,
    _event_stream,
    _joined,
    _millis,
    _some_rules,
    _stats,
    _with_outcomes,
    query,
)
from ledgerflow.plans.pipeline import Pipeline, fan_out, keep_running
from ledgerflow.session import scratch_folder
from ledgerflow.sinks.rollup import DailyRollup
from ledgerflow.sinks.store import Store
from ledgerflow.sinks.zones import Zones
from ledgerflow.sources import checkpoints, readers
from ledgerflow.sources.paging import PAGE_KEY
from ledgerflow.sources.tables import chain_checkpoints, chain_events, chain_transactions
from ledgerflow.streaming.streams import close_counts, joined_transactions, kept_counts, running_type_counts

_KEY = ("transaction_digest", "event_seq")


def _written(frame: DataFrame, purpose: str) -> str:
    folder = scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return folder


def _source_events(spark: SparkSession, folder: str) -> DataFrame:
    return chain_events(spark, folder).select(*schemas.EVENTS.fieldNames())


# --- readers ----------------------------------------------------------------


@query(
    """
select case when event_id % 50 > 0 then transaction_digest end as transaction_digest,
  case when event_id % 50 > 0 then event_seq end as event_seq,
  case when event_id % 50 > 0 then package_id end as package_id,
  case when event_id % 50 > 0 then parsed_json end as parsed_json,
  case when event_id % 50 > 0 then checkpoint_sequence else 0 end as checkpoint_sequence,
  case when event_id % 50 = 0 then concat('{"transaction_digest": "', transaction_digest) end as corrupt
from chain_events
"""
)
def read_json_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of which every fiftieth is cut off."""
    events = chain_events(spark, folder)
    broken = F.concat(F.lit('{"transaction_digest": "'), "transaction_digest")
    line = F.when(F.col("event_id") % 50 == 0, broken).otherwise(F.to_json(F.struct(*schemas.EVENTS.fieldNames())))
    path = scratch_folder(spark, "json-events")
    events.select(line.alias("value")).write.text(path)
    read = readers.read_events(spark, path, format="json")
    return read.select(*_KEY, "package_id", "parsed_json", "checkpoint_sequence", F.col(readers.CORRUPT).alias("corrupt"))


@query(
    """
select digest, checkpoint_sequence, timestamp_ms, sender, gas, success, event_count from effects
"""
)
def read_transactions(spark: SparkSession, folder: str) -> DataFrame:
    read = readers.read_transactions(spark, _written(chain_transactions(spark, folder), "transactions"))
    return read.select(
        "digest",
        "checkpoint_sequence",
        "timestamp_ms",
        "sender",
        transactions.gas_used().alias("gas"),
        transactions.succeeded_flag().alias("success"),
        transactions.event_count().alias("event_count"),
    )


@query("select sequence_number, first_digest as digest, timestamp_ms, n_transactions from chain_checkpoints")
def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    known = chain_checkpoints(spark, folder).select(
        "sequence_number",
        F.col("first_digest").alias("digest"),
        "timestamp_ms",
        F.col("n_transactions").alias("network_total_transactions"),
    )
    read = readers.read_checkpoints(spark, _written(schemas.conform(_filled(known, schemas.CHECKPOINTS), schemas.CHECKPOINTS), "checkpoints"))
    return read.select("sequence_number", "digest", "timestamp_ms", F.col("network_total_transactions").alias("n_transactions"))


def _filled(frame: DataFrame, schema) -> DataFrame:
    return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in frame.columns})


@query("select transaction_digest, event_seq, checkpoint_sequence from chain_events where checkpoint_sequence >= 5 or checkpoint_sequence = 0")
def stream_from(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over files from checkpoint 5 on; the unknown checkpoint 0 always comes along."""
    stream = readers.stream_events(spark, _written(_source_events(spark, folder), "event-files"), start=5)
    return _drain(stream.select(*_KEY, "checkpoint_sequence"), spark, "stream-from")


# --- runs -------------------------------------------------------------------

_STORED = """
select transaction_digest, event_seq, checkpoint_sequence, type_name as event_type,
  (select count(*) from ok where j is not null) as total_events
from ok where j is not null
"""


def _stored(store: Store) -> DataFrame:
    total = reports.processing_stats(store.batch_log(), as_of=AS_OF).select("total_events").scalar()
    rows = store.processed_events().select(*_KEY, "checkpoint_sequence", "event_type")
    return rows.withColumn("total_events", total)


@query(_STORED)
def pipeline_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The input in two parts, the second with late events of done checkpoints; then all of it again."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    events = chain_events(spark, folder)
    early = (F.col("event_id") % 7 != 0) & (F.col("checkpoint_sequence") % 10 < 8)
    for part in (events.where(early), events.where(~early), events):
        Pipeline().run_batch(part, store, as_of=AS_OF)
    return _stored(store)


@query(
    """
select case when event_id % 5 > 0 then checkpoint_sequence else 0 end as checkpoint_sequence, count(*) as stored
from ok where j is not null group by 1
"""
)
def pipeline_unknown_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth event has no checkpoint; replayed with the stream's narrower search for copies."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=7)
    number = F.when(F.col("event_id") % 5 > 0, F.col("checkpoint_sequence"))
    events = chain_events(spark, folder).withColumn("checkpoint_sequence", number)
    for _ in range(2):
        state = scratch_folder(spark, "state")
        stream = _event_stream(spark, folder).withColumn("checkpoint_sequence", number)
        Pipeline().run_stream(stream.select(*events.columns), store, state, interval=None, as_of=AS_OF).awaitTermination()
    return store.processed_events().groupBy("checkpoint_sequence").agg(F.count("*").alias("stored"))


@query("select digest, checkpoint_sequence, coalesce(gas, 0) as gas_used, cast(success as varchar) as status from effects")
def pipeline_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions that come after their events have been done, and once more."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    events, found = chain_events(spark, folder), chain_transactions(spark, folder)
    Pipeline().run_batch(events, store, transactions=found.where("checkpoint_sequence % 3 = 0"), as_of=AS_OF)
    for _ in range(2):
        Pipeline().run_batch(events.where("event_id % 11 = 0"), store, transactions=found, as_of=AS_OF)
    return store.processed_transactions().select("digest", "checkpoint_sequence", "gas_used", "status")


@query("select digest, checkpoint_sequence, sender from chain_transactions")
def append_transactions(spark: SparkSession, folder: str) -> DataFrame:
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    done = transactions.project_transactions(chain_transactions(spark, folder), as_of=AS_OF)
    for part in (done.where("checkpoint_sequence % 2 = 0"), done):
        store.append_transactions(part)
    return store.processed_transactions().select("digest", "checkpoint_sequence", "sender")


@query(_with_outcomes("select transaction_digest, event_seq from outcomes where outcome <> 'success' or event_id % 3 <> 0"))
def ledger_skip(spark: SparkSession, folder: str) -> DataFrame:
    """What is left to do when the ledger lists every third event."""
    store = Store(spark, scratch_folder(spark, "store"))
    marked = _outcomes_of(spark, folder)
    store.append_event_ledger(marked.where("event_id % 3 = 0"), AS_OF)
    return store.not_yet_processed(marked).select(*_KEY)


@query(
    """
, parts as (select unnest([1, 2, 3, 4]) as part)
select part, count(*) filter (where case part when 1 then event_id % 4 = 0 when 2 then event_id % 2 = 0 else true end) as received,
  count(*) filter (where case part when 1 then event_id % 4 = 0 when 2 then event_id % 4 = 2 when 3 then event_id % 2 = 1 else false end) as written
from chain_events, parts group by part
"""
)
def append_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Appends that overlap with what is stored, and what the index lets through of each."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    rows = chain_events(spark, folder)
    done = enrich.enrich_events(rows, as_of=AS_OF, extract_fields=False, include_source=False)
    keyed = done.join(rows.select(*_KEY, "event_id"), list(_KEY)).withColumn("bucket", F.col("event_id") % 4)
    results = []
    for part, where in enumerate(("bucket = 0", "bucket in (0, 2)", "true", "true"), 1):
        found = store.append_events(keyed.where(where).drop("event_id", "bucket"))
        results.append((part, found.received, found.written))
    return spark.createDataFrame(results, "part int, received long, written long")


#: Bytes of a row group of the files that streams take, so that several tasks share a large file.
_ROW_GROUP = 8 << 20


def _split(frame: DataFrame, purpose: str, parts: int) -> str:
    """The frame as so many files, which a stream takes one by one."""
    folder = scratch_folder(frame.sparkSession, purpose)
    frame.repartition(parts).write.option("parquet.block.size", _ROW_GROUP).parquet(folder)
    return folder


def _files(spark: SparkSession, path: str, schema, per_batch: int | None = 1) -> DataFrame:
    """A stream of so many files in a micro-batch, or of all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def _two_sources(spark: SparkSession, folder: str) -> Store:
    """Events and transactions in one stream that fails at its second batch and is started again."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    event_files = _split(_source_events(spark, folder), "event-files", 3)
    transaction_files = _split(chain_transactions(spark, folder), "transaction-files", 2)
    state, failures = scratch_folder(spark, "state"), [RuntimeError("sink is down")]

    def sink(processed: DataFrame, batch_id: int) -> None:
        if batch_id and failures:
            raise failures.pop()

    def start():
        return Pipeline().run_stream(
            readers.stream_events(spark, event_files, max_files_per_trigger=1),
            store,
            state,
            transactions=_files(spark, transaction_files, schemas.TRANSACTIONS),
            sinks=[sink],
            interval=None,
            as_of=AS_OF,
        )

    keep_running(start, restarts=1, pause_seconds=0.0)
    return store


@query(
    """
select 'event' as kind, concat(transaction_digest, ':', event_seq) as name, checkpoint_sequence from ok where j is not null
union all select 'transaction', digest, checkpoint_sequence from chain_transactions
"""
)
def stream_two_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored of both sources after the restart."""
    store = _two_sources(spark, folder)
    name = F.concat_ws(":", "transaction_digest", "event_seq")
    events = store.processed_events().select(F.lit("event").alias("kind"), name.alias("name"), "checkpoint_sequence")
    found = store.processed_transactions().select(F.lit("transaction"), "digest", "checkpoint_sequence")
    return events.union(found)


@query(
    """
select 'events' as source, count(*) as records, max(checkpoint_sequence) as latest_checkpoint from chain_events
union all select 'transactions', count(*), max(checkpoint_sequence) from chain_transactions
"""
)
def source_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress per source of that stream; the batch that ran twice counts once."""
    return reports.progress_by_source(_two_sources(spark, folder).source_progress())


@query("select checkpoint_sequence, count(*) as events from chain_events where checkpoint_sequence >= 3 group by 1")
def stream_by_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """A stream whose offsets are checkpoints: from the third on, a third of them in each run, until the head is reached."""
    checkpoints.register(spark)
    events = _source_events(spark, folder)
    files = _split(events, "event-files", 4)
    head = events.agg(F.max("checkpoint_sequence")).first()[0]
    root = scratch_folder(spark, "by-checkpoint")
    options = {"path": files, "start": 3, "step": head // 3 + 1}
    for _ in range(3):
        stream = spark.readStream.format("checkpoints").options(**options).load().select("checkpoint_sequence")
        writer = stream.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{root}/data")
    return rows.groupBy("checkpoint_sequence").agg(F.count("*").alias("events"))


@query(
    """
select sink, transaction_digest, event_seq, 1 as times from ok, (select unnest(['steady', 'failing']) as sink) where j is not null
"""
)
def sinks_take_once(spark: SparkSession, folder: str) -> DataFrame:
    """One of two named sinks fails at its first batch; the other gets no event twice when the batch is repeated."""
    root = scratch_folder(spark, "sinks")
    failures = [RuntimeError("sink is down")]

    def steady(processed: DataFrame, batch_id: int) -> None:
        processed.select(*_KEY).write.mode("append").parquet(f"{root}/steady")

    def failing(processed: DataFrame, batch_id: int) -> None:
        if failures:
            raise failures.pop()
        processed.select(*_KEY).write.mode("append").parquet(f"{root}/failing")

    files = _split(_source_events(spark, folder), "event-files", 2)
    store = Store(spark, f"{root}/store", bucket_size=1000)

    def start():
        stream = readers.stream_events(spark, files, max_files_per_trigger=1)
        sinks = {"steady": steady, "failing": failing}
        return Pipeline().run_stream(stream, store, f"{root}/state", sinks=sinks, interval=None, as_of=AS_OF)

    keep_running(start, restarts=1, pause_seconds=0.0)
    taken = [spark.read.parquet(f"{root}/{name}").withColumn("sink", F.lit(name)) for name in ("steady", "failing")]
    return taken[0].unionByName(taken[1]).groupBy("sink", *_KEY).agg(F.count("*").alias("times"))


@query(
    """
select cast(epoch_ms(cast(day as timestamp)) as bigint) as window_start, type_name as event_type, count(*) as event_count
from ok group by 1, 2
"""
)
def stream_counts_state(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts over a restart: closed days from files, open ones from the state of the stream."""
    root = scratch_folder(spark, "counts")
    events = _source_events(spark, folder)
    # Days come in order, so that those of the first half close in the second.
    middle = events.agg(F.percentile_approx(_event_ms(), 0.5)).first()[0]
    for part in (events.where(_event_ms() < middle), events.where(_event_ms() >= middle)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/events")
        stream = _files(spark, f"{root}/events", schemas.EVENTS)
        counts = running_type_counts(stream, as_of=AS_OF)
        close_counts(counts, f"{root}/closed", f"{root}/state").awaitTermination()
    found = kept_counts(spark, f"{root}/closed", f"{root}/state")
    return found.select(_millis("window_start").alias("window_start"), "event_type", "event_count")


def _event_ms():
    return F.unix_millis(event_time("timestamp_ms", AS_OF))


@query(_DAILY_SQL.format(source="ok"))
def event_stats_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The daily statistics kept by batches, one of which comes twice and some of which bring late events."""
    rollup = DailyRollup(spark, scratch_folder(spark, "rollup"))
    events = chain_events(spark, folder)
    for batch, part in enumerate((0, 2, 1, 1)):
        rollup.add(min(batch, 2), events.where(F.col("event_id") % 3 == part), as_of=AS_OF)
    return _stats(rollup.stats(chain_transactions(spark, folder)))


_PLACES_SQL = """
select checkpoint_sequence, transaction_digest, event_seq, type_name as event_type, direction, position
from (
  select *, row_number() over (order by checkpoint_sequence, transaction_digest, event_seq) as position, 'up' as direction from ok where j is not null
  union all
  select *, row_number() over (order by checkpoint_sequence desc, transaction_digest desc, event_seq desc), 'down' from ok where j is not null)
where position <= 150
"""


@query(_PLACES_SQL)
def pages_by_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Three pages of 50 stored events up from the first and down from the last, from the files they lie in."""
    zones = Zones(_stored_chain(spark, folder))
    found = []
    for direction in ("up", "down"):
        cursor = None
        for number in range(3):
            page = zones.page(cursor=cursor, limit=50, descending=direction == "down")
            path, cursor = scratch_folder(spark, "page"), page.next_cursor
            order = [F.col(c).desc() if direction == "down" else F.col(c).asc() for c in PAGE_KEY]
            place = F.row_number().over(Window.orderBy(*order)) + 50 * number
            rows = page.data.select(*PAGE_KEY, "event_type", F.lit(direction).alias("direction"), place.cast("bigint").alias("position"))
            rows.write.parquet(path)
            found.append(path)
    return spark.read.parquet(*found)


@query(
    """
select checkpoint_sequence, transaction_digest, event_seq, type_name as event_type from ok
where j is not null and transaction_digest = (select max(transaction_digest) from ok where j is not null)
"""
)
def page_of_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The stored events of one transaction, by a digest that names its files."""
    store = _stored_chain(spark, folder)
    digest = store.processed_events().agg(F.max("transaction_digest")).first()[0]
    return Zones(store).page(transaction_digest=digest).data.select(*PAGE_KEY, "event_type")


def _stored_chain(spark: SparkSession, folder: str) -> Store:
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=20)
    Pipeline().run_batch(chain_events(spark, folder), store, as_of=AS_OF)
    return store


@query(
    """
, first_times as (select transaction_digest as digest, min(time_ms) as tx_ms from ok group by 1)
select digest, event_seq, tx_ms, time_ms as event_ms
from first_times join chain_transactions using (digest) join ok on transaction_digest = digest
where time_ms <= tx_ms + 21600000
"""
)
def stream_transactions_with_events(spark: SparkSession, folder: str) -> DataFrame:
    """Streams of transactions and events, joined as they arrive; stopped half-way and started again.

    A transaction has the time of its first event here. Nothing is late, as the watermark waits.
    """
    events = _source_events(spark, folder)
    time = F.unix_millis(event_time("timestamp_ms", AS_OF))
    first = events.groupBy(F.col("transaction_digest").alias("digest")).agg(F.min(time).alias("timestamp_ms"))
    found = chain_transactions(spark, folder).drop("timestamp_ms").join(first, "digest").select(*schemas.TRANSACTIONS.fieldNames())
    root = scratch_folder(spark, "joined")
    for half in range(2):
        events.where(F.col("event_seq") % 2 == half).write.mode("append").parquet(f"{root}/events")
        found.where(F.col("checkpoint_sequence") % 2 == half).write.mode("append").parquet(f"{root}/transactions")
        joined = joined_transactions(
            # Larger tables are written as more files, each of which would be a micro-batch over all of the state.
            _files(spark, f"{root}/transactions", schemas.TRANSACTIONS, None),
            _files(spark, f"{root}/events", schemas.EVENTS, None),
            within="6 hours",
            as_of=AS_OF,
            delay="3650 days",
        )
        rows = joined.select(
            F.col("tx_digest").alias("digest"), "event_seq", _millis("tx_time").alias("tx_ms"), _millis("event_time").alias("event_ms")
        )
        writer = rows.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/data")


@query(
    """
select 'stored' as kind, transaction_digest, event_seq from ok where j is not null and event_id % 5 > 0
union all select case when j is null then 'error' else 'success' end, transaction_digest, event_seq from ok
"""
)
def stream_ledger_skip(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that gets everything twice; the stored ledger lists every fifth event as done before it starts."""
    store = Store(spark, scratch_folder(spark, "store"), bucket_size=1000)
    decided = outcomes.event_outcomes(chain_events(spark, folder)).where("event_id % 5 = 0 and outcome = 'success'")
    store.append_event_ledger(decided, AS_OF)
    files = scratch_folder(spark, "event-files")
    for _ in range(2):
        _source_events(spark, folder).coalesce(1).write.mode("append").parquet(files)
    stream = readers.stream_events(spark, files, max_files_per_trigger=1)
    Pipeline(ledger=True).run_stream(stream, store, scratch_folder(spark, "state"), interval=None, as_of=AS_OF).awaitTermination()
    listed = store.event_ledger().select(F.col("status").alias("kind"), "transaction_digest", F.col("event_sequence").alias("event_seq"))
    return store.processed_events().select(F.lit("stored").alias("kind"), *_KEY).union(listed)


def _outcomes_of(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerflow.plans.catalog import QUERIES  # the same rules as the query "outcomes"

    decided = QUERIES["outcomes"](spark, folder).select("event_id", "outcome", "reason")
    return chain_events(spark, folder).join(decided, "event_id")


@query(
    f"""
select sink, transaction_digest, event_seq from ok, (select unnest(['first', 'second', 'store']) as sink)
where j is not null and ({' or '.join(f'({r})' for r in _RULE_SQL)})
"""
)
def sink_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Two sinks of the caller beside the store."""
    root = scratch_folder(spark, "sinks")

    def sink(name: str):
        def write(processed: DataFrame, batch_id: int) -> None:
            processed.select(*_KEY).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

        return write

    store = Store(spark, f"{root}/store")
    both = fan_out(sink("first"), sink("second"))
    running = Pipeline(rules=_some_rules()).run_stream(
        _event_stream(spark, folder), store, f"{root}/state", sinks=[both], interval=None, as_of=AS_OF
    )
    running.awaitTermination()
    found = store.processed_events().select(F.lit("store").alias("sink"), *_KEY)
    for name in ("first", "second"):
        found = found.unionByName(spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("sink"), *_KEY))
    return found


@query("select transaction_digest, event_seq, upper(type_name) as event_type from ok where j is not null")
def custom_processor(spark: SparkSession, folder: str) -> DataFrame:
    """A processor of the caller that changes what the default one gives."""

    def louder(events: DataFrame, *, as_of=None) -> DataFrame:
        return enrich.enrich_events(events, as_of=as_of).withColumn("event_type", F.upper("event_type"))

    store = Store(spark, scratch_folder(spark, "store"))
    Pipeline(processor=louder).run_batch(chain_events(spark, folder), store, as_of=AS_OF)
    return store.processed_events().select(*_KEY, "event_type")


@query(
    f"""
select transaction_digest, event_seq,
  concat_ws(',', case when {_RULE_SQL[0]} then 'a' end, case when {_RULE_SQL[3]} then 'b' end) as matched
from ok where j is not null and ({_RULE_SQL[0]} or {_RULE_SQL[3]})
"""
)
def pipeline_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table of rules drives the job."""
    chosen = [_some_rules()[0], _some_rules()[3]]
    named = [rules.Rule(r.package, r.module, r.event_type, r.sender, name) for r, name in zip(chosen, "ab", strict=True)]
    store = Store(spark, scratch_folder(spark, "store"))
    Pipeline(rules=rules.rules_frame(spark, named)).run_batch(chain_events(spark, folder), store, as_of=AS_OF)
    return store.processed_events().select(*_KEY, _joined("metadata.matched_filters").alias("matched"))


@query(_with_outcomes("select event_id, outcome from outcomes where outcome <> 'error'"))
def strict_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Without its bad records the input passes the strict mode, which would fail at the first."""
    good = _outcomes_of(spark, folder).where("outcome <> 'error'").drop("outcome", "reason")
    decided = outcomes.event_outcomes(good, _strict_rules(), on_error="raise")
    return decided.select("event_id", "outcome")


@query("select 'all' as part, exists(select 1 from ok where j is null) as failed union all select 'good', false")
def strict_mode_fails(spark: SparkSession, folder: str) -> DataFrame:
    """The strict mode fails at a bad record and names its reason."""
    events = chain_events(spark, folder)
    good = outcomes.succeeded(outcomes.event_outcomes(events))
    found = []
    for part, frame in (("all", events), ("good", good)):
        decided = outcomes.event_outcomes(frame, on_error="raise")
        try:
            decided.select("event_id", "outcome").write.parquet(scratch_folder(spark, "strict"))
            found.append((part, False))
        except Exception as problem:  # Spark wraps what a task raises in errors of several kinds
            if "bad record: payload is not JSON" not in str(problem):
                raise
            found.append((part, True))
    return spark.createDataFrame(found, "part string, failed boolean")


@query(
    """
, shapes as (
  select event_id, event_id % 6 as shape, case event_id % 6 when 0 then concat('{"n":1', event_id, 'e400}') when 1 then concat('{"n":-', event_id, 'E+308}')
      when 2 then concat('{"n":', repeat('9', 39), '}') when 3 then concat('{"n":"', repeat('9', 39), 'e400"}')
      when 4 then concat('{"n":', repeat('9', 38), '}') else concat('{"n":0.', repeat('9', 45), '}') end as payload
  from events)
select event_id, case when shape in (0, 2) or shape = 1 and event_id > 1 then 'error' else 'success' end as outcome from shapes
"""
)
def payload_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that no value can hold are errors; the same digits inside a string are not."""
    kind, number = F.col("event_id") % 6, F.lit('{"n":')
    nines = F.repeat(F.lit("9"), F.lit(39))
    text = (
        F.when(kind == 0, F.concat(number, F.lit("1"), "event_id", F.lit("e400}")))
        .when(kind == 1, F.concat(number, F.lit("-"), "event_id", F.lit("E+308}")))
        .when(kind == 2, F.concat(number, nines, F.lit("}")))
        .when(kind == 3, F.concat(number, F.lit('"'), nines, F.lit('e400"}')))
        .when(kind == 4, F.concat(number, F.substring(nines, 1, 38), F.lit("}")))
        .otherwise(F.concat(number, F.lit("0."), F.repeat(F.lit("9"), F.lit(45)), F.lit("}")))
    )
    events = chain_events(spark, folder).withColumn("parsed_json", text)
    return outcomes.event_outcomes(events).select("event_id", "outcome")


def _strict_rules() -> list[rules.Rule]:
    return _some_rules()


# --- rules ------------------------------------------------------------------


@query(_SHOWN_SQL)
def filter_empty_rules(spark: SparkSession, folder: str) -> DataFrame:
    """An empty table of rules keeps everything, as an empty list does."""
    none = rules.rules_frame(spark, _some_rules()).where(F.lit(False))
    return filters.filter_events(chain_events(spark, folder), none).select(*_SHOWN)


@query(
    """
select sender, type_name, regexp_matches(sender, '^0x[0-9a-fA-F]{1,64}$') as valid_sender,
  regexp_matches(type_module, '^[A-Za-z][A-Za-z0-9_]*$') as valid_module
from (select distinct sender, type_name, type_module from chain_events)
"""
)
def rule_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of the rule builders on the ids and names of the events."""
    from ledgerflow.functions.ids import canonical_id, is_module_name

    parts = chain_events(spark, folder).select("sender", "type_name", "type_module").distinct()
    return parts.select(
        "sender", "type_name", canonical_id("sender").isNotNull().alias("valid_sender"), is_module_name("type_module").alias("valid_module")
    )


@query("select distinct package_id, transaction_module, true as valid, false as bad_package, false as bad_module from chain_events")
def rule_builders(spark: SparkSession, folder: str) -> DataFrame:
    """What the rule builders accept of the modules that occur, and of spoilt forms of them."""

    def accepts(build, *parts: str) -> bool:
        try:
            build(*parts)
            return True
        except ValueError:
            return False

    # Modules are few whatever the number of events.
    known = chain_events(spark, folder).select("package_id", "transaction_module").distinct().collect()
    found = [
        (
            package,
            module,
            all((accepts(rules.module_rule, package, module), accepts(rules.package_rule, package), accepts(rules.sender_rule, package))),
            any(accepts(build, *parts) for build, *parts in ((rules.module_rule, f"{package}g", module), (rules.package_rule, f"{package}\n"), (rules.sender_rule, ""))),
            any(accepts(rules.module_rule, package, name) for name in (f"{module}-", f"1{module}", f"{module}\n", "")),
        )
        for package, module in known
    ]
    return spark.createDataFrame(found, "package_id string, transaction_module string, valid boolean, bad_package boolean, bad_module boolean")


# --- enrichment -------------------------------------------------------------


@query("select transaction_digest, event_seq, base64(encode(type_name)) as raw, true as same from chain_events")
def raw_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bytes in the fields and in the copy of the source event."""
    events = chain_events(spark, folder).withColumn("bcs", F.encode("type_name", "utf-8"))
    done = enrich.enrich_events(events, as_of=AS_OF)
    raw = F.get_json_object("fields", "$.bcs_data")
    return done.select(*_KEY, raw.alias("raw"), (raw == F.get_json_object("event_data", "$.bcs")).alias("same"))


@query(
    """
select transaction_digest, event_seq, true as no_source, true as no_metadata, true as no_fields,
  false as with_action, member and action is not null as action_kept
from ok
"""
)
def enrich_switches(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that are off are null; protocol fields come only if they are on."""
    events = chain_events(spark, folder)
    off = enrich.enrich_events(events, as_of=AS_OF, extract_fields=False, add_metadata=False, include_source=False)
    plain = enrich.enrich_events(events, as_of=AS_OF, custom_fields=False, include_source=False)
    full = enrich.enrich_events(events, as_of=AS_OF, include_source=False)
    action = F.get_json_object("fields", "$.action")
    none = off.select(
        *_KEY,
        F.col("event_data").isNull().alias("no_source"),
        F.col("metadata").isNull().alias("no_metadata"),
        F.col("fields").isNull().alias("no_fields"),
    )
    known = action.isNotNull() & (action != fixed.UNKNOWN_ACTION)
    return (
        none.join(plain.select(*_KEY, action.isNotNull().alias("with_action")), list(_KEY))
        .join(full.select(*_KEY, F.coalesce(known, F.lit(False)).alias("action_kept")), list(_KEY))
    )


@query(
    """
, shapes as (
  select transaction_digest, event_seq, event_id % 6 as shape,
    case event_id % 6 when 0 then concat('"', type_name, '"') when 1 then 'null' when 2 then '[1, "a"]' when 3 then '7.5'
      when 4 then '{"a":{"b":[true,null]}}' else concat('{"t":"', type_name, '"}') end as payload
  from chain_events)
select transaction_digest, event_seq, true as readable, json_type(payload) as kind,
  case when shape = 0 then json_extract_string(payload, '$') when shape = 5 then json_extract_string(payload, '$.t') end as value
from shapes
"""
)
def source_copy(spark: SparkSession, folder: str) -> DataFrame:
    """The copy of the source event stays JSON whatever the payload is."""
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('"'), "type_name", F.lit('"')))
        .when(kind == 1, "null")
        .when(kind == 2, '[1, "a"]')
        .when(kind == 3, "7.5")
        .when(kind == 4, '{"a":{"b":[true,null]}}')
        .otherwise(F.concat(F.lit('{"t":"'), "type_name", F.lit('"}')))
    )
    events = chain_events(spark, folder).withColumn("parsed_json", text)
    done = enrich.enrich_events(events, as_of=AS_OF, extract_fields=False)
    parsed = F.try_parse_json("event_data")
    payload = F.try_variant_get(parsed, "$.parsedJson", "variant")
    names = {"STRING": "VARCHAR", "ARRAY": "ARRAY", "OBJECT": "OBJECT", "DECIMAL": "DOUBLE", "VOID": "NULL"}
    found = F.schema_of_variant(payload)
    named = F.coalesce(*[F.when(found.startswith(ours), F.lit(theirs)) for ours, theirs in names.items()], F.lit("NULL"))
    value = F.coalesce(
        F.when(found == "STRING", F.try_variant_get(payload, "$", "string")), F.try_variant_get(payload, "$.t", "string")
    )
    return done.select(*_KEY, parsed.isNotNull().alias("readable"), named.alias("kind"), value.alias("value"))


@query(
    """
, shapes as (
  select event_id, case event_id % 8 when 0 then concat(props, ' trailing') when 1 then concat(props, props)
      when 2 then concat('{''k'':', event_id, '}') when 3 then '"text"' when 4 then 'null' when 5 then '[1,2]'
      when 6 then '1],[2' else props end as payload
  from events)
select event_id, case when json_valid(payload) then 'success' else 'error' end as outcome from shapes
"""
)
def strict_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Text behind a value, two values and single quotes are no JSON."""
    kind = F.col("event_id") % 8
    raw = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "props")
    text = (
        F.when(kind == 0, F.concat("props", F.lit(" trailing")))
        .when(kind == 1, F.concat("props", "props"))
        .when(kind == 2, F.concat(F.lit("{'k':"), "event_id", F.lit("}")))
        .when(kind == 3, '"text"')
        .when(kind == 4, "null")
        .when(kind == 5, "[1,2]")
        .when(kind == 6, "1],[2")
        .otherwise(F.col("props"))
    )
    events = chain_events(spark, folder).drop("parsed_json").join(raw, "event_id").withColumn("parsed_json", text)
    return outcomes.event_outcomes(events).select("event_id", "outcome")


@query(
    """
, clash as (
  select transaction_digest, event_seq, sender, package_id, type_name,
    concat('{"sender":"payload","extra":', event_id % 2 = 0, ',"list":[', event_id, '],"package_id":{"a":1}}') as payload from ok)
select transaction_digest, event_seq, sender, package_id, json_extract_string(payload, '$.extra') as extra,
  json_extract_string(payload, '$.list[0]') as first_item
from clash
"""
)
def fields_overwritten(spark: SparkSession, folder: str) -> DataFrame:
    """Payload keys that the envelope has too are overwritten; the others stay, of whatever type."""
    payload = F.concat(
        F.lit('{"sender":"payload","extra":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"list":['), "event_id", F.lit('],"package_id":{"a":1}}')
    )
    done = enrich.enrich_events(chain_events(spark, folder).withColumn("parsed_json", payload), as_of=AS_OF)
    field = {"sender": "$.sender", "package_id": "$.package_id", "extra": "$.extra", "first_item": "$.list[0]"}
    return done.select(*_KEY, *[F.get_json_object("fields", path).alias(name) for name, path in field.items()])


# --- planning ---------------------------------------------------------------


@query(
    """
, points as (
  select distinct checkpoint_sequence * 1000 as place from effects where success
  union select -1 union select 1000000001),
following as (select place, lead(place) over (order by place) as further from points)
select place + 1 as "start", further - 1 as "end", further - place - 1 as length from following where further - place > 1
"""
)
def gap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of a range of a billion checkpoints, of which every thousandth may be there."""
    found = chain_transactions(spark, folder).where(transactions.succeeded_flag())
    spread = found.select((F.col("checkpoint_sequence") * 1000).alias("checkpoint_sequence"))
    return ranges.missing_intervals(spread, ranges.CheckpointRange(0, 1_000_000_000))


@query("select done + 1 as next_checkpoint from ends")
def next_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """The checkpoint behind the one that a run has noted as done."""
    store = Store(spark, scratch_folder(spark, "store"))
    Pipeline().run_batch(chain_events(spark, folder), store, as_of=AS_OF)
    return ranges.next_checkpoint(reports.latest_progress(store.progress()))


@query(
    """
select transaction_digest, event_seq, sender as liquidated_account, concat('0x', lpad('9', 64, '0')) as liquidator,
  event_id as liquidated_amount, time_ms as timestamp_ms
from ok where transaction_module = 'lending' and contains(type_name, 'LiquidationEvent')
"""
)
def liquidations_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Liquidation payloads that name the liquidator and the amount."""
    from ledgerflow.operators import lending

    payload = F.concat(F.lit('{"liquidator":"0x'), F.lpad(F.lit("9"), 64, "0"), F.lit('","liquidated_amount":"'), "event_id", F.lit('"}'))
    events = chain_events(spark, folder).where(F.col("transaction_module") == fixed.LENDING_MODULE).withColumn("parsed_json", payload)
    alerts = lending.liquidations(lending.lending_actions(events, as_of=AS_OF))
    return alerts.select(
        *_KEY, "liquidated_account", "liquidator", F.col("liquidated_amount").cast("bigint").alias("liquidated_amount"), _millis("timestamp").alias("timestamp_ms")
    )
