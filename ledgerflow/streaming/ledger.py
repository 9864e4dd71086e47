"""The ledger of processed events inside a stream.

State holds the keys of events that were processed; it starts from the stored ledger
and is written with the micro-batches, so a repeated event is found by its key alone and no
micro-batch is joined with the ledger. Keys are forgotten `remember` after they were done;
what comes again later than that is stopped by the keyed append of the store.

State needs the RocksDB store: start the stream inside `state_store`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerflow.operators.outcomes import SUCCESS
from ledgerflow.schemas import EVENT_KEY

REMEMBER = timedelta(days=7)

#: Keys are dealt to so many slices by their hash. A stream that has started keeps this number.
SLICES = 1 << 14

_SLICE = "_slice"

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State that is forgotten by the clock would otherwise ask for batches without data for ever.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; other streams of the session are left alone."""
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    try:
        for name, value in _SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class OncePerKey(StatefulProcessor):
    """Lets an event through unless its key was done before, and notes it as done if it succeeded.

    Of several events of one key in a micro-batch all come through up to the first that
    succeeded, with that one; so errors are seen each and a success once.

    Keys come in slices, each a group with a map of its done keys: Spark calls Python, and Python
    writes an Arrow batch, once for a slice and not once for a key.
    """

    def __init__(self, remember: timedelta):
        self._milliseconds = int(remember.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "transaction_digest string, event_seq long"
        self._done = handle.getMapState("done", key, "done boolean", self._milliseconds)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            own = tuple(row[name] for name in EVENT_KEY)
            usable = None not in own
            if usable and self._done.containsKey(own):
                continue
            # The output's schema leaves the slice out.
            yield row
            if usable and row["outcome"] == SUCCESS:
                self._done.updateValue(own, (True,))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        for own in initialState["keys"]:
            self._done.updateValue(tuple(own[name] for name in EVENT_KEY), (True,))


def skip_done(decided: DataFrame, ledger: DataFrame | None = None, *, remember: timedelta = REMEMBER) -> DataFrame:
    """A stream of `event_outcomes` less the events that were done.

    `ledger` has rows of the stored event ledger; it is read once, when the stream first
    starts. Events without a usable key are never done and always come through, each as the
    error that it is. Deal the events by `by_slice` before they are decided, and that work is
    spread as the state is, by the same shuffle.
    """
    first = None
    if ledger is not None:
        done = ledger.where(F.col("status") == SUCCESS)
        # The ledger may have the same event from several runs.
        keys = done.select("transaction_digest", F.col("event_sequence").alias("event_seq")).distinct()
        first = keys.groupBy(_slice().alias(_SLICE)).agg(F.collect_list(F.struct(*EVENT_KEY)).alias("keys")).groupBy(_SLICE)
    if _SLICE not in decided.columns:
        decided = decided.withColumn(_SLICE, _slice())
    return decided.groupBy(_SLICE).transformWithState(
        OncePerKey(remember),
        _nullable(decided.drop(_SLICE).schema),
        outputMode="Append",
        timeMode="ProcessingTime",
        initialState=first,
    )


def by_slice(events: DataFrame) -> DataFrame:
    """The events of a stream, shuffled as the state of `skip_done` is; a column tells the slice."""
    return events.withColumn(_SLICE, _slice()).repartition(_SLICE)


def _slice() -> Column:
    return F.pmod(F.xxhash64(*EVENT_KEY), F.lit(SLICES)).cast("int")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(field.name, field.dataType, True) for field in schema])
