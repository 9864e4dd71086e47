"""Daily statistics kept up to date by batches of events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import reports
from ledgerflow.operators.reports import AsOf
from ledgerflow.sinks.segments import SegmentTable

_KEY = [
    T.StructField("date", T.DateType()),
    *[T.StructField(name, T.StringType()) for name in ("package_id", "module_name", "event_type")],
]
_N = T.StructField("n", T.LongType())
PAIRS = T.StructType([*_KEY, T.StructField("kind", T.StringType()), T.StructField("member", T.StringType()), _N])
SKETCHES = T.StructType([*_KEY, _N, T.StructField("senders", T.BinaryType())])


@dataclass(frozen=True)
class DailyRollup:
    """The state of `daily_event_stats` below `root`, to which new and late events are added alike.

    Exact: counts per (group, sender) and (group, transaction), so that distinct senders and gas
    stay right whatever comes later. Beside them a sketch of the senders of each group, which
    answers without the members. Give each batch of events once, with growing numbers: events
    that were stored already, and copies, must have been dropped.
    """

    spark: SparkSession
    root: str

    def add(self, batch: int, events: DataFrame, *, as_of: AsOf = None) -> bool:
        """Whether the batch is new; one that counts already changes nothing."""
        pairs = reports.daily_pairs(events, as_of=as_of).sortWithinPartitions("date")
        written = self._pairs.add(batch, pairs)
        done = self._sketches.last_batch()
        if written is None and batch == self._pairs.last_batch() and (done is None or done < batch):
            # It died between the two.
            written = self._pairs.batch(batch)
        if written is None:
            return False
        self._sketches.add(batch, reports.daily_sketches(written))
        return True

    def stats(self, transactions: DataFrame | None = None, *, first: date | None = None, last: date | None = None) -> DataFrame:
        """Exact statistics, of some days if wanted."""
        return reports.stats_of_pairs(reports.merge_pairs(_days(self._pairs.read(), first, last)), transactions)

    def estimates(self, *, first: date | None = None, last: date | None = None) -> DataFrame:
        """Events, and senders as the sketches tell them."""
        merged = reports.merge_sketches(_days(self._sketches.read(), first, last))
        senders = F.hll_sketch_estimate("senders").alias("unique_senders")
        return merged.select(*reports.STATS_KEY, F.col("n").alias("event_count"), senders)

    @property
    def _pairs(self) -> SegmentTable:
        return SegmentTable(self.spark, f"{self.root.rstrip('/')}/pairs", PAIRS, reports.merge_pairs)

    @property
    def _sketches(self) -> SegmentTable:
        return SegmentTable(self.spark, f"{self.root.rstrip('/')}/sketches", SKETCHES, reports.merge_sketches)


def _days(rows: DataFrame, first: date | None, last: date | None) -> DataFrame:
    if first is not None:
        rows = rows.where(F.col("date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("date") <= F.lit(last))
