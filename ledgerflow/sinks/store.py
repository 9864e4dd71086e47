"""Stored tables: idempotent appends, progress, range reads.

Tables are plain Parquet folders below one root. There are no transactions, so
safety comes from order and keys: data is written first, progress last, and an
append skips keys that are stored already, which an index beside each table knows
(`key_index`). A run that died half-way is repaired by running it again. One writer
per table at a time is assumed.

Large tables are laid out by `checkpoint_bucket`, a range of checkpoints, and
sorted by checkpoint and type inside each file. A table whose appends reach over
very many buckets has folders of several buckets, named by the first of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas
from ledgerflow.functions.ids import row_id
from ledgerflow.functions.times import as_of_column, run_time
from ledgerflow.operators.reports import latest_progress
from ledgerflow.operators.transactions import stored_transactions
from ledgerflow.sinks.files import CODEC, drop_folder
from ledgerflow.sinks.key_index import BUCKET, KeyIndex, hashed
from ledgerflow.sinks.small_log import SmallLog

DEFAULT_BUCKET_SIZE = 100_000
# Keys to be left out are broadcast up to this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows that one task sorts to merge copies, about, and copies of a key beyond which they are merged in two steps.
TASK_ROWS, HOT_COPIES = 1 << 19, 1 << 12
# Folders that one append writes, about; if its rows lie in more buckets, folders hold several.
APPEND_FOLDERS = 256

_SPANS = T.StructType([T.StructField("span", T.LongType()), T.StructField("at", T.TimestampType())])


@dataclass(frozen=True)
class AppendResult:
    """Rows of the input, and what became of them."""

    received: int
    written: int

    @property
    def skipped(self) -> int:
        return self.received - self.written


@dataclass(frozen=True)
class Claim:
    """Rows of a batch that are not stored yet, one per key, and how many came in and are left."""

    received: int
    new: int
    rows: DataFrame


@dataclass(frozen=True)
class Store:
    """The tables below `root`, with `bucket_size` checkpoints per partition folder.

    An append that lies in more than `APPEND_FOLDERS` buckets makes the table's folders
    wider from then on: `span` buckets each, a power of four.

    `scope` says where copies of a row can be. "table": anywhere, so an append
    looks through all stored keys. "checkpoint": only in the row's own checkpoint,
    as is the case for a ledger, where a transaction belongs to one checkpoint;
    an append then looks only into the buckets it writes to.

    With `rebalance` rows are shuffled so that a bucket's rows come together, which
    keeps small batches from leaving a file per task and bucket, and a bucket that
    is too large for one task is split. Data that arrives in checkpoint order, such
    as a backfill, is laid out well already and needs no such shuffle.
    """

    spark: SparkSession
    root: str
    bucket_size: int = DEFAULT_BUCKET_SIZE
    rebalance: bool = True

    def __post_init__(self) -> None:
        if self.bucket_size < 1:
            raise ValueError("bucket_size must be at least 1")

    # --- appends -----------------------------------------------------------

    def new_events(self, events: DataFrame, *, scope: str = "table") -> Claim:
        """Source events, one per key, that are not stored yet.

        Ask before enriching: rows are smaller then, and stored ones cost no work. The
        claim is good until the next one of the same table.
        """
        return self._claim(events, "processed_events", schemas.PROCESSED_EVENTS, schemas.EVENT_KEY, scope)

    def append_new_events(self, processed: DataFrame) -> int:
        """Add processed events that came through `new_events`; gives their number."""
        rows = schemas.conform(processed, schemas.PROCESSED_EVENTS)
        return self._write(rows, "processed_events", schemas.EVENT_KEY, ["checkpoint_sequence", "event_type"])

    def append_events(self, processed: DataFrame, *, scope: str = "table") -> AppendResult:
        """Add processed events whose key is new."""
        rows = schemas.conform(processed, schemas.PROCESSED_EVENTS)
        order = ["checkpoint_sequence", "event_type"]
        return self._append_new(rows, "processed_events", schemas.EVENT_KEY, order, scope)

    def append_transactions(self, processed: DataFrame, *, scope: str = "table") -> AppendResult:
        """Add processed transactions whose digest is new; copies are skipped, not an error."""
        rows = processed if "status" in processed.columns else stored_transactions(processed)
        rows = schemas.conform(rows, schemas.PROCESSED_TRANSACTIONS)
        return self._append_new(rows, "processed_transactions", ["digest"], ["checkpoint_sequence", "sender"], scope)

    def append_event_rows(self, rows: DataFrame, *, scope: str = "table") -> AppendResult:
        rows = schemas.conform(rows, schemas.EVENT_ROWS)
        return self._append_new(rows, "events", ["id"], ["checkpoint_sequence", "event_type"], scope)

    def append_transaction_rows(self, rows: DataFrame, *, scope: str = "table") -> AppendResult:
        rows = schemas.conform(rows, schemas.TRANSACTION_ROWS)
        return self._append_new(rows, "transactions", ["digest"], ["checkpoint_sequence", "sender"], scope)

    def append_quarantine(self, rows: DataFrame, *, scope: str = "table") -> AppendResult:
        rows = schemas.conform(rows, schemas.QUARANTINE)
        return self._append_new(rows, "quarantine", ["record_id"], ["checkpoint_sequence", "reason"], scope)

    def append_event_ledger(self, outcomes: DataFrame, as_of: datetime | int | None = None) -> AppendResult:
        """Record which events were processed, and how."""
        rows = event_ledger(outcomes, as_of)
        return self._append_new(rows, "event_ledger", ["id"], ["checkpoint_sequence"], "table")

    def append_transaction_ledger(self, outcomes: DataFrame, as_of: datetime | int | None = None) -> AppendResult:
        rows = transaction_ledger(outcomes, as_of)
        return self._append_new(rows, "transaction_ledger", ["id"], ["checkpoint_sequence"], "table")

    def not_yet_processed(self, events: DataFrame) -> DataFrame:
        """Events that the ledger does not list."""
        done = self.event_ledger().where(F.col("status") == "success")
        keys = done.select("transaction_digest", F.col("event_sequence").alias("event_seq"))
        return events.join(keys, schemas.EVENT_KEY, "left_anti")

    def log_batch(
        self,
        *,
        run_id: str,
        batch_id: int,
        events: int,
        transactions: int,
        errors: int,
        event_ms: int,
        transaction_ms: int,
        checkpoint_sequence: int | None,
        started_at: datetime,
        finished_at: datetime,
    ) -> None:
        row = dict(
            run_id=run_id,
            batch_id=batch_id,
            events=events,
            transactions=transactions,
            errors=errors,
            event_ms=event_ms,
            transaction_ms=transaction_ms,
            checkpoint_sequence=checkpoint_sequence,
            started_at=started_at,
            finished_at=finished_at,
        )
        self._log("batch_log", schemas.BATCH_LOG).append(row)

    def write_event_stats(self, stats: DataFrame) -> None:
        """Replace the days that `stats` holds; other days stay."""
        rows = schemas.conform(
            stats.select(*[F.col(f.name).cast(f.dataType) for f in schemas.EVENT_STATS]), schemas.EVENT_STATS
        )
        writer = rows.write.partitionBy("date").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.table_path("event_stats"))

    # --- progress ----------------------------------------------------------

    def save_progress(
        self,
        checkpoint: int,
        *,
        status: str = "running",
        as_of: datetime | int | None = None,
        batch_id: int | None = None,
        reset: bool = False,
    ) -> None:
        """Note that everything up to `checkpoint` is stored; write the data first.

        With `reset` the checkpoint counts even if it lies before an earlier one.
        """
        newest = self.progress().agg(F.max("generation")).first()[0]
        generation = (newest or 0) + (1 if reset and newest is not None else 0)
        row = dict(
            checkpoint_sequence=checkpoint,
            status=status,
            updated_at=run_time(as_of),
            batch_id=batch_id,
            reset=reset,
            generation=generation,
        )
        self._log("progress", schemas.PROGRESS).append(row)

    def save_source_progress(
        self, source: str, *, run_id: str, batch_id: int, records: int, checkpoint: int | None, as_of: datetime | int | None = None
    ) -> None:
        """Note what one source of a run has brought in a batch; write the data first."""
        row = dict(
            source=source, run_id=run_id, batch_id=batch_id, records=records, checkpoint_sequence=checkpoint, updated_at=run_time(as_of)
        )
        self._log("source_progress", schemas.SOURCE_PROGRESS).append(row)

    def source_progress(self) -> DataFrame:
        return self._log("source_progress", schemas.SOURCE_PROGRESS).read(self.spark)

    def save_delivery(self, sink: str, *, run_id: str, batch_id: int, as_of: datetime | int | None = None) -> None:
        """Note that a sink has taken a batch."""
        row = dict(run_id=run_id, batch_id=batch_id, sink=sink, delivered_at=run_time(as_of))
        self._log("deliveries", schemas.DELIVERIES).append(row)

    def deliveries(self) -> DataFrame:
        return self._log("deliveries", schemas.DELIVERIES).read(self.spark)

    def has_delivery(self, sink: str, *, run_id: str, batch_id: int, sinks: int) -> bool:
        """Whether a sink has taken the newest batch of a run; of a batch there are at most `sinks` rows."""
        newest = self._log("deliveries", schemas.DELIVERIES).tail(sinks)
        return any((row["run_id"], row["batch_id"], row["sink"]) == (run_id, batch_id, sink) for row in newest)

    def latest_checkpoint(self) -> int | None:
        return latest_progress(self.progress()).first()["latest_checkpoint"]

    def last_transaction_checkpoint(self) -> int | None:
        """The newest checkpoint with a stored transaction: their progress, apart from that of events."""
        return self.processed_transactions().agg(F.max("checkpoint_sequence")).first()[0]

    def last_processed_checkpoint(self) -> int:
        return self.latest_checkpoint() or 0

    # --- reads -------------------------------------------------------------

    def progress(self) -> DataFrame:
        return self._log("progress", schemas.PROGRESS).read(self.spark)

    def batch_log(self) -> DataFrame:
        return self._log("batch_log", schemas.BATCH_LOG).read(self.spark)

    def processed_events(self) -> DataFrame:
        return self.read("processed_events", schemas.PROCESSED_EVENTS, bucketed=True)

    def processed_transactions(self) -> DataFrame:
        return self.read("processed_transactions", schemas.PROCESSED_TRANSACTIONS, bucketed=True)

    def event_ledger(self) -> DataFrame:
        return self.read("event_ledger", schemas.EVENT_LEDGER)

    def quarantined(self) -> DataFrame:
        return self.read("quarantine", schemas.QUARANTINE, bucketed=True)

    def event_stats(self) -> DataFrame:
        return self.read("event_stats", schemas.EVENT_STATS)

    def events_in_range(self, start: int, end: int) -> DataFrame:
        """Stored events of checkpoints `start` to `end`, in order; prunes to their buckets."""
        span = self.span("processed_events")
        return read_range(self.processed_events(), start, end, bucket_size=self.bucket_size, span=span).drop(BUCKET)

    def span(self, table: str) -> int:
        """Buckets that the widest folders of a table hold."""
        newest = self._spans(table).last()
        return newest["span"] if newest else 1

    def read(self, table: str, schema: T.StructType, *, bucketed: bool = False) -> DataFrame:
        """A stored table; before its first append, an empty frame of its schema."""
        full = T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())]) if bucketed else schema
        found = self._stored(table, full)
        return self.spark.createDataFrame([], full) if found is None else found

    # --- internals ---------------------------------------------------------

    def work_folder(self, purpose: str) -> str:
        """A fresh folder for an intermediate table; drop it when it is done with."""
        return f"{self.table_path('_work')}/{purpose}/{uuid.uuid4().hex}"

    def _append_new(self, rows: DataFrame, table: str, keys: list[str], order: list[str], scope: str) -> AppendResult:
        claim = self._claim(rows, table, rows.schema, keys, scope)
        return AppendResult(claim.received, self._write(claim.rows, table, keys, order) if claim.new else 0)

    def _claim(self, rows: DataFrame, table: str, schema: T.StructType, keys: list[str], scope: str) -> Claim:
        """The rows whose key is not stored, one per key; a null key part is a value like any other.

        The batch is read once for this, on its keys alone: they are counted into one row
        each, which finds copies within the batch, and looked up in the index. The rows are
        not moved unless there are stored keys or copies beyond `BROADCAST_BYTES`.
        """
        if scope not in ("table", "checkpoint"):
            raise ValueError(f"unknown scope: {scope}")
        drop_folder(f"{self.table_path('_work')}/{table}")
        stored = self._stored(table, T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())]))
        index = self._index(table, schema, keys)
        # The index has each row's own bucket, whatever its folder holds.
        index.settle(None if stored is None else stored.withColumn(BUCKET, bucket_of("checkpoint_sequence", self.bucket_size)))
        checkpoint = F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint"))
        measures = (F.count("*").alias("_copies"), F.min(checkpoint).alias("_first"), F.max(checkpoint).alias("_last"))
        keyed = hashed(rows.groupBy(*keys).agg(*measures), keys).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = keyed.agg(
                F.sum("_copies").alias("rows"),
                F.count("*").alias("keys"),
                F.count_if(F.col("_copies") > 1).alias("copied"),
                F.min("_first").alias("first"),
                F.max("_last").alias("last"),
                F.approx_count_distinct(bucket_of("_first", self.bucket_size)).alias("buckets"),
            ).first()
            self._widen(table, size)
            found, n_found = None, 0
            if stored is not None and size["keys"]:
                buckets = (size["first"] // self.bucket_size, size["last"] // self.bucket_size)
                among = index.stored_among(keyed, size["keys"], buckets if scope == "checkpoint" else None)
                found, n_found = self._held(among, table, keys)
            copied, n_copied = self._held(keyed.where("_copies > 1").select(*keys) if size["copied"] else None, table, keys)
        finally:
            keyed.unpersist()
        fresh = _join(rows, found, keys, "left_anti") if n_found else rows
        if n_copied:
            # Copies are merged before their shuffle, so it does not matter if most rows are copies of one.
            once = _join(fresh, copied, keys, "left_semi").dropDuplicates(keys)
            fresh = _join(fresh, copied, keys, "left_anti").unionByName(once)
        return Claim(size["rows"] or 0, size["keys"] - n_found, fresh)

    def _held(self, found: DataFrame | None, table: str, keys: list[str]) -> tuple[DataFrame | None, int]:
        """Keys written to a table of their own, marked for broadcast if they are small, and their number."""
        if found is None:
            return None, 0
        seen, folder = Observation(), self.work_folder(table)
        found.observe(seen, F.count("*").alias("n"), F.sum(_key_bytes(keys)).alias("bytes")).write.option("compression", CODEC).parquet(folder)
        held = self.spark.read.schema(found.schema).parquet(folder)
        small = (seen.get["bytes"] or 0) <= BROADCAST_BYTES
        return (F.broadcast(held) if small else held), seen.get["n"]

    def _widen(self, table: str, size: Row) -> None:
        """Make the table's folders wide enough for a batch; they never get narrower."""
        if (size["buckets"] or 0) <= APPEND_FOLDERS:
            return
        reach, span = size["last"] // self.bucket_size - size["first"] // self.bucket_size + 1, 1
        while reach > span * APPEND_FOLDERS:
            span *= 4
        if span > self.span(table):
            self._spans(table).append({"span": span, "at": run_time(None)})

    def _write(self, rows: DataFrame, table: str, keys: list[str], order: list[str]) -> int:
        seen = Observation()
        bucketed = rows.withColumn(BUCKET, bucket_of("checkpoint_sequence", self.bucket_size))
        index = self._index(table, rows.schema, keys)
        segment = index.begin(bucketed)
        laid_out = bucketed.withColumn(BUCKET, folder_of(BUCKET, self.span(table))).observe(seen, F.count("*").alias("n"))
        if self.rebalance:
            laid_out = laid_out.hint("rebalance", BUCKET)
        laid_out.sortWithinPartitions(BUCKET, *order).write.option("compression", CODEC).partitionBy(BUCKET).mode("append").parquet(
            self.table_path(table)
        )
        index.finish(segment)
        return seen.get["n"]

    def _index(self, table: str, schema: T.StructType, keys: list[str]) -> KeyIndex:
        return KeyIndex(self.spark, self.root, table, T.StructType([schema[key] for key in keys]))

    def _log(self, table: str, schema: T.StructType) -> SmallLog:
        return SmallLog(self.table_path(table), schema)

    def _spans(self, table: str) -> SmallLog:
        return self._log(f"{table}_spans", _SPANS)

    def _stored(self, table: str, schema: T.StructType) -> DataFrame | None:
        # The reader lists the folder and names its absence; no private handle of the session is needed.
        try:
            return self.spark.read.schema(schema).parquet(self.table_path(table))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def table_path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def bucket_of(checkpoint: Column | str, bucket_size: int) -> Column:
    value = F.col(checkpoint) if isinstance(checkpoint, str) else checkpoint
    return F.floor(F.coalesce(value, F.lit(0)) / bucket_size).cast("bigint")


def folder_of(bucket: Column | str, span: int) -> Column:
    """The first of the `span` buckets that lie in a bucket's folder."""
    value = F.col(bucket) if isinstance(bucket, str) else bucket
    return value - F.pmod(value, F.lit(span)) if span > 1 else value


def new_rows(batch: DataFrame, stored: DataFrame | None, keys: list[str], *, small: bool = False) -> DataFrame:
    """Rows of the batch, one per key, whose key is not stored.

    A null key part is a value like any other: rows that agree in it are copies.
    For a small batch its keys are broadcast: the stored table is then only
    scanned, on its key columns, instead of shuffled for every append. For a large
    one, keys alone are shuffled to find those that are stored or repeat; the rows
    themselves move only if too many are.
    """
    if small:
        fresh = batch
        if stored is not None:
            found = _join(stored.select(*keys), F.broadcast(batch.select(*keys)), keys, "left_semi")
            fresh = _join(batch, found, keys, "left_anti")
        return fresh.dropDuplicates(keys)
    rows = unique_rows(batch, keys)
    if stored is None:
        return rows
    # Distinct first: copies in the batch must not meet in one task.
    found = _join(stored.select(*keys), batch.select(*keys).distinct(), keys, "left_semi")
    side = _measured(found, keys)
    return rows if side is None else _join(rows, side, keys, "left_anti")


def unique_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, for data that is large and has few copies.

    Only the keys are shuffled, to find those that repeat. The other rows stay
    where they are; copies are merged before their shuffle, so it does not matter
    if most rows are copies of one. If too many keys repeat to be broadcast, all
    rows are dealt by key to tasks of about `TASK_ROWS`, and only those of keys with
    more than `HOT_COPIES` are merged before.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_copies"))
    repeated = counted.where(F.col("_copies") > 1)
    size = F.when(F.col("_copies") > 1, _key_bytes(keys))
    n_bytes, n_rows, most = counted.agg(F.sum(size), F.sum("_copies"), F.max("_copies")).first()
    if n_bytes is None:
        return rows
    if n_bytes <= BROADCAST_BYTES:
        side = F.broadcast(repeated.select(*keys))
        copies = _join(rows, side, keys, "left_semi").dropDuplicates(keys)
        return _join(rows, side, keys, "left_anti").unionByName(copies)
    parts = -(-n_rows // TASK_ROWS)
    if most <= HOT_COPIES:
        return rows.repartition(parts, *keys).dropDuplicates(keys)
    hot = repeated.where(F.col("_copies") > HOT_COPIES).select(*keys)
    # Hot copies are dealt to all tasks, which keep one of a key each before these meet.
    spread = _join(rows, hot, keys, "left_semi").repartition(parts, *keys, F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    return _join(rows, hot, keys, "left_anti").repartition(parts, *keys).dropDuplicates(keys).unionByName(spread.dropDuplicates(keys))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join in which null equals null, as it does in a grouping."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def _key_bytes(keys: list[str]) -> Column:
    """Of a row's key; 16 bytes stand for the row itself."""
    return F.octet_length(F.concat_ws(":", *[F.col(k).cast("string") for k in keys])) + 16


def _measured(found: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys for a join: none at all, marked for broadcast if few, or as they are."""
    n, n_bytes = found.agg(F.count("*"), F.sum(_key_bytes(keys))).first()
    if not n:
        return None
    return F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found


def read_range(
    processed: DataFrame, start: int, end: int, *, bucket_size: int | None = None, span: int | None = None
) -> DataFrame:
    """Events of checkpoints `start` to `end`, both included, in a total order.

    Spark cannot know how buckets follow from checkpoints; given the `bucket_size`
    of a stored table and the `span` of its folders, the condition on its folders is
    added here. Without the span it is that on the last folder alone.
    """
    chosen = processed.where(F.col("checkpoint_sequence").between(start, end))
    if bucket_size:
        chosen = chosen.where(F.col(BUCKET) <= end // bucket_size)
        if span:
            chosen = chosen.where(F.col(BUCKET) >= start // bucket_size // span * span)
    return chosen.orderBy("checkpoint_sequence", "processed_at", *schemas.EVENT_KEY)


def event_ledger(outcomes: DataFrame, as_of: datetime | int | None = None) -> DataFrame:
    return outcomes.where(F.col("transaction_digest").isNotNull() & F.col("event_seq").isNotNull()).select(
        row_id(*schemas.EVENT_KEY, "outcome").alias("id"),
        "transaction_digest",
        F.col("event_seq").alias("event_sequence"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        as_of_column(as_of).alias("processed_at"),
        F.lit(None).cast("bigint").alias("processing_duration_ms"),
        F.col("outcome").alias("status"),
        F.when(F.col("outcome") == "error", F.col("reason")).alias("error_message"),
    )


def transaction_ledger(outcomes: DataFrame, as_of: datetime | int | None = None) -> DataFrame:
    return outcomes.where(F.col("digest").isNotNull()).select(
        row_id("digest", "outcome").alias("id"),
        F.col("digest").alias("transaction_digest"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        as_of_column(as_of).alias("processed_at"),
        F.lit(None).cast("bigint").alias("processing_duration_ms"),
        F.col("outcome").alias("status"),
        F.when(F.col("outcome") == "error", F.col("reason")).alias("error_message"),
    )
