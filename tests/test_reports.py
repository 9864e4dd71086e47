from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plans_of import plan_of
from ledgerflow import schemas
from ledgerflow.operators import ranges, reports
from ledgerflow.operators.transactions import transactions_with_events
from ledgerflow.sources import paging
from ledgerflow.streaming.streams import dedupe_stream, running_type_counts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log_row(batch, events, transactions, event_ms, tx_ms, checkpoint, seconds, errors=0):
    end = START + timedelta(seconds=seconds)
    return ("run", batch, events, transactions, errors, event_ms, tx_ms, checkpoint, START, end)


def test_processing_stats(spark):
    one = spark.createDataFrame([log_row(0, 5, 1, 100, 500, 123, 0, 3)], schemas.BATCH_LOG)
    row = reports.processing_stats(one, as_of=START + timedelta(seconds=9)).first()
    assert (row["total_events"], row["total_transactions"], row["current_checkpoint"], row["error_count"]) == (5, 1, 123, 3)
    assert (row["events_per_second"], row["avg_event_processing_ms"], row["uptime_seconds"]) == (0.0, 20.0, 9)
    again = log_row(1, 15, 3, 300, 100, 124, 10)
    many = spark.createDataFrame([log_row(0, 5, 1, 100, 500, 123, 2), again, again], schemas.BATCH_LOG)
    row = reports.processing_stats(many, as_of=START).first()
    assert (row["total_events"], row["events_per_second"], row["avg_transaction_processing_ms"]) == (20, 2.0, 150.0)
    empty = reports.processing_stats(spark.createDataFrame([], schemas.BATCH_LOG), as_of=START).first()
    assert (empty["total_events"], empty["events_per_second"]) == (0, 0.0)


def test_checkpoint_stats(spark):
    rows = [(c, "running", START + timedelta(seconds=10 * (c - 51) / 49), c, False, 0) for c in range(51, 101)]
    row = reports.checkpoint_stats(spark.createDataFrame(rows, schemas.PROGRESS), target=200).first()
    assert (row["processing_rate"], row["checkpoints_remaining"], row["seconds_remaining"]) == (5.0, 100, 20)
    unknown = reports.checkpoint_stats(spark.createDataFrame(rows, schemas.PROGRESS), target=None).first()
    assert unknown["checkpoints_remaining"] is None and unknown["seconds_remaining"] is None


def test_remaining_and_caught_up(spark):
    rows = [(101, 105), (105, 105), (106, 105), (None, 105), (101, None)]
    df = spark.createDataFrame(rows, "c bigint, t bigint")
    got = df.select(reports.remaining(F.col("c"), F.col("t")), reports.caught_up(F.col("c"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(4, False), (0, True), (0, True), (None, False), (None, False)]


def test_ranges(spark):
    whole = ranges.CheckpointRange(10, 20)
    assert len(whole) == 11
    chunks = ranges.split_range(spark, whole, 5).orderBy("start").collect()
    assert [tuple(r) for r in chunks] == [(10, 14), (15, 19), (20, 20)]
    assert [r[0] for r in ranges.members(spark, ranges.CheckpointRange(5, 8)).orderBy(F.col("checkpoint_sequence")).collect()] == [5, 6, 7, 8]
    with pytest.raises(ValueError):
        ranges.CheckpointRange(20, 10)
    with pytest.raises(ValueError):
        ranges.split_range(spark, whole, 0)


def test_next_and_start(spark):
    latest = spark.createDataFrame([(None,), (100,)], "latest_checkpoint bigint")
    assert [r[0] for r in ranges.next_checkpoint(latest).collect()] == [0, 101]
    assert ranges.start_checkpoint(None, 7) == 7
    assert ranges.start_checkpoint(3, 7) == 7 and ranges.start_checkpoint(3, 7, reset=True) == 3


def test_gaps(spark):
    present = spark.createDataFrame([(1,), (3,), (3,), (9,)], "checkpoint_sequence bigint")
    found = ranges.missing_checkpoints(present, ranges.CheckpointRange(0, 4))
    assert sorted(r[0] for r in found.collect()) == [0, 2, 4]


def test_freshness_of_nothing(spark):
    none = spark.createDataFrame([], "sequence_number bigint")
    row = reports.freshness(none, spark.createDataFrame([], schemas.PROGRESS)).first()
    assert (row["healthy"], row["caught_up"], row["error"]) == (False, False, "chain head is unknown")


def test_hot_transaction_is_split(spark):
    """One transaction has most events, with copies; nothing is lost and no list is too long."""
    events = [("hot", n, "E") for n in range(1000)] * 2 + [("b", 0, "E")]
    df = spark.createDataFrame(events, "transaction_digest string, event_seq bigint, type_name string")
    tx = spark.createDataFrame([("hot",), ("b",), ("none",)], "digest string")
    rows = transactions_with_events(tx, df, per_part=64).collect()
    assert max(len(r["processed_events"]) for r in rows) == 64
    hot = sorted((r["part"], [e["event_seq"] for e in r["processed_events"]]) for r in rows if r["digest"] == "hot")
    assert [n for _, part in hot for n in part] == list(range(1000))
    assert [(r["part"], r["processed_events"]) for r in rows if r["digest"] == "none"] == [(0, [])]


def test_daily_stats_count_gas_once(spark, make_events):
    events = make_events({"event_seq": 0}, {"event_seq": 1, "sender": "0x9"}, {"event_seq": 0, "transaction_digest": "tx2"})
    tx = spark.createDataFrame([("tx1", 7, 1, "0x1", ("success", (5, 2, 1)), [])] * 2, schemas.TRANSACTIONS)
    row = reports.daily_event_stats(events, tx, as_of=0).first()
    assert (str(row["date"]), row["event_count"], row["unique_senders"], row["total_gas_used"]) == ("1970-01-01", 3, 2, 7)
    plan = plan_of(reports.daily_event_stats(events, tx, as_of=0))
    assert "Expand" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("window", [None, 1])
def test_pages_cover_everything_once(make_events, descending, window):
    events = make_events(*[{"event_seq": n % 3, "transaction_digest": f"t{n // 3}", "checkpoint_sequence": n // 4 * 5} for n in range(20)])
    seen, cursor = [], None
    while True:
        page = paging.query_events(events, cursor=cursor, limit=7, descending=descending, window=window)
        seen += [tuple(r[c] for c in paging.PAGE_KEY) for r in page.data.collect()]
        cursor = page.next_cursor
        if not page.has_next_page:
            break
    everything = sorted((tuple(r[c] for c in paging.PAGE_KEY) for r in events.collect()), reverse=descending)
    assert seen == everything


def test_page_filters(make_events):
    events = make_events({"event_seq": 0}, {"event_seq": 1, "sender": "0x9"}, {"event_seq": 2, "package_id": "0x9"})
    count = lambda **parts: paging.query_events(events, **parts).data.count()
    assert count(sender="0x9") == 1 and count(package_id="0x2", sender="0x123") == 1
    assert count(transaction_digest="tx1") == 3 and count(sender="bad") == 0
    plan = plan_of(paging.page(events, limit=5))
    assert "TakeOrderedAndProject" in plan


def test_late_rows_and_copies_in_streams(spark, make_events, tmp_path):
    """Files arrive one by one: copies are dropped, rows behind the watermark are not counted."""
    hour = 3_600_000
    batches = [
        [{"event_seq": 0, "timestamp_ms": 30 * hour}, {"event_seq": 0, "timestamp_ms": 30 * hour}],
        [{"event_seq": 1, "timestamp_ms": 60 * hour}, {"event_seq": 0, "timestamp_ms": 30 * hour}],
        [{"event_seq": 2, "timestamp_ms": 31 * hour}, {"event_seq": 3, "timestamp_ms": 100 * hour}],
        [{"event_seq": 4, "timestamp_ms": 31 * hour}],
    ]
    for number, rows in enumerate(batches):
        make_events(*rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(df, name):
        query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c"))
        query.option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    unique = drain(dedupe_stream(source(), delay="40 hours").select("event_seq"), "unique")
    assert sorted(r[0] for r in unique.collect()) == [0, 1, 2, 3, 4]
    counts = drain(running_type_counts(source(), delay="1 hour"), "counts")
    got = {(r["window_start"].day, r["event_count"]) for r in counts.collect()}
    # The watermark that a batch tests rows against is that of the batch before, so
    # the third batch's old row still counts and the fourth's does not.
    assert (2, 4) in got
