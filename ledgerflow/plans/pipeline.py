"""The event job, in batches and as a stream.

The source is read once: filter and outcomes are one narrow stage that writes the decided
records to an intermediate table and counts them on the way. Keys, quarantine and enrichment
read that table. A batch run shuffles nothing before the keyed append; a micro-batch, which may
be a single file and so a single task, is dealt to all cores before it is judged.
"""

from __future__ import annotations

import inspect
import logging
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.fixed_values import POLL_INTERVAL
from ledgerflow.functions.times import run_time
from ledgerflow.operators import outcomes as oc
from ledgerflow.operators.enrich import enrich_events
from ledgerflow.operators.filters import filter_events, joins
from ledgerflow.operators.ranges import start_checkpoint
from ledgerflow.operators.rules import Rule
from ledgerflow.operators.transactions import project_transactions
from ledgerflow.sinks.files import CODEC, drop_folder
from ledgerflow.sinks.store import Store
from ledgerflow.sources.readers import from_checkpoint
from ledgerflow.streaming.ledger import REMEMBER, by_slice, skip_done, state_store

log = logging.getLogger(__name__)

# A sink gets the processed events of a batch and the batch's number.
Sink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Report:
    """What one batch did."""

    received: int
    after_filter: int
    succeeded: int
    errors: int
    stored_events: int
    stored_transactions: int
    checkpoint_sequence: int | None


@dataclass(frozen=True)
class Pipeline:
    """Rules, then a processor, then sinks.

    The processor turns events into processed events; the default enriches them in
    full. It gets the run's time by keyword if it takes `as_of`. With `ledger` events that
    the store's ledger lists as done are skipped, and what becomes of the others is noted there.
    """

    rules: Sequence[Rule] | DataFrame = ()
    processor: Callable[..., DataFrame] = enrich_events
    on_error: str = "quarantine"
    type_match: str = "auto"
    label_rules: bool = True
    index_transactions: bool = True
    ledger: bool = False

    def process(self, events: DataFrame, as_of: datetime | int | None = None) -> DataFrame:
        """Filter, then transform: the job without outcomes and storage."""
        return self._transform(filter_events(events, self.rules, type_match=self.type_match), as_of)

    def run_batch(
        self,
        events: DataFrame,
        store: Store,
        *,
        transactions: DataFrame | None = None,
        start: int | None = None,
        reset: bool = False,
        late: str = "append",
        as_of: datetime | int | None = None,
    ) -> Report:
        """Process everything that isn't stored yet, from checkpoint `start` on.

        Late records, those of checkpoints that were done before, go to the keyed
        append like all others ("append"); a source that never delivers late may
        resume behind the saved progress instead ("skip"), events behind that of
        events and transactions behind the last stored transaction. Records without
        a known checkpoint are never left out. `reset` sets the progress back. What
        is stored already is skipped, so a run that failed half-way is simply repeated.
        """
        if late not in ("append", "skip"):
            raise ValueError(f"unknown late: {late}")
        begin = begin_transactions = start
        if late == "skip":
            begin = start_checkpoint(start, _following(store.latest_checkpoint()), reset=reset)
            begin_transactions = start_checkpoint(start, _following(store.last_transaction_checkpoint()), reset=reset)
        if transactions is not None:
            transactions = from_checkpoint(transactions, begin_transactions)
        events = from_checkpoint(events, begin)
        return self._run(
            self.outcomes(store.not_yet_processed(events) if self.ledger else events, keep_payload=True),
            store,
            transactions,
            as_of=as_of,
            run_id=uuid.uuid4().hex,
            batch_id=0,
            scope="table",
            reset=reset,
        )

    def run_stream(
        self,
        events: DataFrame,
        store: Store,
        checkpoint_folder: str,
        *,
        transactions: DataFrame | None = None,
        sinks: Sequence[Sink] | Mapping[str, Sink] = (),
        interval: str | None = POLL_INTERVAL,
        as_of: datetime | int | None = None,
        scope: str = "checkpoint",
        remember: timedelta = REMEMBER,
    ) -> StreamingQuery:
        """Start the stream; with `interval` None it stops when all present data is done.

        The new events of a micro-batch are processed once, cached, and go to every
        sink and then to the store. A batch that is repeated after a failure changes
        nothing in the store. Sinks get its number to recognise it by; of sinks given by name the
        store keeps which batches they took, and a repeated batch goes only to those that lack
        it. One stream at a time may use the names of a store.

        `transactions` is a second streaming source. One query reads both, so that one
        checkpoint has the place reached in each, and a restart goes on from both. With a
        ledger, keys of done events are state that starts from the stored ledger and is
        kept for `remember`; rules must then be few enough to need no join.
        """
        stream, decided = events, False
        if self.ledger:
            if joins(self.rules):
                raise ValueError("a stream with a ledger takes a short list of rules")
            listed = store.event_ledger()
            stream, decided = skip_done(self.outcomes(by_slice(events)), listed, remember=remember), True
        if transactions is not None and self.index_transactions:
            stream = _tagged(stream, transactions)
        else:
            transactions = None

        def handle(batch: DataFrame, batch_id: int) -> None:
            folder = store.work_folder("batch")
            try:
                found = None
                if not decided:
                    # A file may be one task's, and with it all that is read from what that task writes.
                    batch = batch.hint("rebalance")
                if decided or transactions is not None:
                    # State and sources are gone through once; all that follows reads this table.
                    batch = _written(batch, folder)
                if transactions is not None:
                    batch, found = (batch.where(f"{part} is not null").select(f"{part}.*") for part in (_EVENT, _TRANSACTION))
                self._run(
                    batch if decided else self.outcomes(batch, keep_payload=True),
                    store,
                    found,
                    as_of=as_of,
                    run_id=checkpoint_folder,
                    batch_id=batch_id,
                    scope=scope,
                    sinks=sinks,
                    staged=decided,
                )
            finally:
                drop_folder(folder)

        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        writer = stream.writeStream.option("checkpointLocation", checkpoint_folder).trigger(**trigger)
        with state_store(store.spark) if decided else nullcontext():
            return writer.foreachBatch(handle).start()

    def outcomes(self, events: DataFrame, *, keep_payload: bool = False) -> DataFrame:
        """Events with their outcome, and the labels of the matching rules if wanted."""
        # A frame of rules may be empty; only an empty list is known to label nothing.
        labels = self.label_rules and (isinstance(self.rules, DataFrame) or bool(self.rules))
        return oc.event_outcomes(
            events,
            self.rules,
            on_error=self.on_error,
            type_match=self.type_match,
            label_rules=labels,
            keep_payload=keep_payload and getattr(self.processor, "takes_payload", False),
        )

    def _run(
        self,
        decided: DataFrame,
        store: Store,
        transactions: DataFrame | None,
        *,
        as_of: datetime | int | None,
        run_id: str,
        batch_id: int,
        scope: str,
        sinks: Sequence[Sink] | Mapping[str, Sink] = (),
        reset: bool = False,
        staged: bool = False,
    ) -> Report:
        """One batch of events with their outcomes, `staged` if they are a table already."""
        as_of = run_time(as_of)
        started = datetime.now(timezone.utc)
        folder, held = store.work_folder("decided"), []
        try:
            if staged:
                counts = decided.agg(*_measures()).first().asDict()
            else:
                decided, counts = _counted(decided, folder)
            if counts["errors"]:
                store.append_quarantine(oc.quarantine(decided, as_of), scope=scope)
            clock = time.monotonic()
            n_events = 0
            if counts["succeeded"]:
                claim = store.new_events(oc.succeeded(decided), scope=scope)
                processed = self._transform(claim.rows, as_of)
                if sinks:
                    held.append(processed.persist(StorageLevel.MEMORY_AND_DISK))
                # The store comes last: once it has the events they are not new any more,
                # and a repeated batch would not bring them to a sink that failed.
                for name, sink in _named(sinks):
                    # Sinks that have a name and took this batch before it failed don't get it again.
                    if name and store.has_delivery(name, run_id=run_id, batch_id=batch_id, sinks=len(sinks)):
                        continue
                    sink(processed, batch_id)
                    if name:
                        store.save_delivery(name, run_id=run_id, batch_id=batch_id, as_of=as_of)
                n_events = store.append_new_events(processed) if claim.new else 0
            if self.ledger and counts["after_filter"]:
                store.append_event_ledger(decided.where(F.col("outcome") != oc.FILTERED), as_of)
            event_ms = _ms_since(clock)
        finally:
            for frame in held:
                frame.unpersist()
            drop_folder(folder)
        clock = time.monotonic()
        n_transactions, tx = 0, None
        if transactions is not None and self.index_transactions:
            tx, n_transactions = self._run_transactions(transactions, store, as_of, scope)
        transaction_ms = _ms_since(clock)
        store.log_batch(
            run_id=run_id,
            batch_id=batch_id,
            # Both as stored, so that a repeated run adds nothing to the totals.
            events=n_events,
            transactions=n_transactions,
            errors=counts["errors"],
            event_ms=event_ms,
            transaction_ms=transaction_ms,
            checkpoint_sequence=counts["last"],
            started_at=started,
            finished_at=datetime.now(timezone.utc),
        )
        # Progress comes last: it says that all of the above is stored.
        for source, found in (("events", counts), ("transactions", tx)):
            if found and found["received"]:
                store.save_source_progress(source, run_id=run_id, batch_id=batch_id, records=found["received"], checkpoint=found["last"], as_of=as_of)
        if counts["received"]:
            store.save_progress(max(counts["last"], 0 if reset else store.last_processed_checkpoint()), as_of=as_of, batch_id=batch_id, reset=reset)
        return Report(
            counts["received"],
            counts["after_filter"],
            counts["succeeded"],
            counts["errors"],
            n_events,
            n_transactions,
            counts["last"],
        )

    def _run_transactions(self, transactions: DataFrame, store: Store, as_of: datetime, scope: str) -> tuple[dict, int]:
        """The numbers of a batch of transactions, and how many were stored."""
        folder = store.work_folder("decided")
        try:
            marked, counts = _counted(oc.transaction_outcomes(transactions, on_error=self.on_error), folder)
            if counts["errors"]:
                store.append_quarantine(oc.quarantine(marked, as_of), scope=scope)
            if counts["received"] == counts["errors"]:
                return counts, 0
            usable = marked.where(F.col("outcome") != oc.ERROR).drop("outcome", "reason")
            return counts, store.append_transactions(project_transactions(usable, as_of=as_of), scope=scope).written
        finally:
            drop_folder(folder)

    def _transform(self, events: DataFrame, as_of: datetime | int | None) -> DataFrame:
        takes_time = "as_of" in inspect.signature(self.processor).parameters
        return self.processor(events, as_of=as_of) if takes_time else self.processor(events)


def fan_out(*sinks: Sink) -> Sink:
    """Several sinks as one."""

    def write(processed: DataFrame, batch_id: int) -> None:
        for sink in sinks:
            sink(processed, batch_id)

    return write


def _named(sinks: Sequence[Sink] | Mapping[str, Sink]) -> list[tuple[str | None, Sink]]:
    return list(sinks.items()) if isinstance(sinks, Mapping) else [(None, sink) for sink in sinks]


def keep_running(start: Callable[[], StreamingQuery], *, restarts: int, pause_seconds: float = 10.0) -> None:
    """Run a stream and start it again from its checkpoint when it fails, up to `restarts` times."""
    for attempt in range(restarts + 1):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException as problem:
            log.warning("stream failed (attempt %d): %s", attempt + 1, problem)
            if attempt == restarts:
                raise
            time.sleep(pause_seconds)


_EVENT, _TRANSACTION = "_event", "_transaction"


def _tagged(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Two sources as one, each record in the column of its kind."""
    event, transaction = F.struct(*events.columns), F.struct(*transactions.columns)
    kinds = (events.select(event.alias("x")).schema["x"].dataType, transactions.select(transaction.alias("x")).schema["x"].dataType)
    left = events.select(event.alias(_EVENT), F.lit(None).cast(kinds[1]).alias(_TRANSACTION))
    return left.unionByName(transactions.select(F.lit(None).cast(kinds[0]).alias(_EVENT), transaction.alias(_TRANSACTION)))


def _written(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.option("compression", CODEC).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _measures() -> list[Column]:
    return [
        F.count("*").alias("received"),
        F.count_if(F.col("outcome") != oc.FILTERED).alias("after_filter"),
        F.count_if(F.col("outcome") == oc.SUCCESS).alias("succeeded"),
        F.count_if(F.col("outcome") == oc.ERROR).alias("errors"),
        # As the store does it: an unknown checkpoint is 0 and lies in the first bucket.
        F.max(F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint"))).alias("last"),
    ]


def _counted(outcomes: DataFrame, folder: str) -> tuple[DataFrame, dict]:
    """The decided records as a table below `folder`, and their numbers, counted as they are written."""
    seen = Observation()
    return _written(outcomes.observe(seen, *_measures()), folder), seen.get


def _following(checkpoint: int | None) -> int:
    return 0 if checkpoint is None else checkpoint + 1


def _ms_since(clock: float) -> int:
    return int((time.monotonic() - clock) * 1000)
