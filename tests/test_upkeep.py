"""What is kept up to date beside the stored tables: rollups, zones, counts, checkpoint offsets, gaps, deliveries."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from plans_of import plan_of
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators import enrich, ranges, reports
from ledgerflow.plans.pipeline import Pipeline, keep_running
from ledgerflow.sinks.manifest import FAN
from ledgerflow.sinks.rollup import DailyRollup
from ledgerflow.sinks.segments import SegmentTable
from ledgerflow.sinks.store import Store
from ledgerflow.sinks.zones import Zones
from ledgerflow.sources import checkpoints
from ledgerflow.sources.paging import PAGE_KEY, query_events
from ledgerflow.sources.readers import stream_events
from ledgerflow.streaming.streams import close_counts, kept_counts, running_type_counts

AS_OF = 5_000
DAY = 86_400_000


# --- rollups -------------------------------------------------------------------


def some_events(rng, n):
    return [
        {
            "transaction_digest": f"t{rng.randrange(40)}", "event_seq": i, "sender": rng.choice([None, "0x1", "0x2", f"0x{i:x}"]),
            "timestamp_ms": rng.choice([None, rng.randrange(4 * DAY)]), "type_name": rng.choice("AB"),
        }
        for i in range(n)
    ]


def test_rollup_by_batches_equals_the_whole(spark, make_events, tmp_path):
    rng = random.Random(1)
    rows = some_events(rng, 120)
    gas = spark.createDataFrame(
        [(f"t{i}", 1, 0, "0x1", ("success", (i, 1, 0)), []) for i in range(30)] * 2, schemas.TRANSACTIONS
    )
    rollup = DailyRollup(spark, str(tmp_path))
    for batch in range(3):
        part = make_events(*rows[batch::3])
        assert rollup.add(batch, part, as_of=AS_OF)
        assert not rollup.add(batch, part, as_of=AS_OF)
    whole = make_events(*rows)
    for own, wanted in (
        (rollup.stats(gas), reports.daily_event_stats(whole, gas, as_of=AS_OF)),
        (rollup.stats(), reports.daily_event_stats(whole, as_of=AS_OF)),
        (rollup.estimates(), reports.daily_event_stats(whole, as_of=AS_OF, approximate=True).drop("total_gas_used")),
        (rollup.stats(gas, first=date(1970, 1, 2), last=date(1970, 1, 3)), reports.daily_event_stats(whole, gas, as_of=AS_OF).where("date between '1970-01-02' and '1970-01-03'")),
    ):
        columns = sorted(wanted.columns)
        assert sorted(own.select(columns).collect()) == sorted(wanted.select(columns).collect())
    brute = Counter((r["timestamp_ms"] or AS_OF) // DAY for r in rows)
    counted = rollup.stats().groupBy("date").agg(F.sum("event_count").alias("n")).collect()
    assert {(r["date"] - date(1970, 1, 1)).days: r["n"] for r in counted} == brute


def test_rollup_that_died_between_its_tables(spark, make_events, tmp_path, monkeypatch):
    rollup = DailyRollup(spark, str(tmp_path))
    events = make_events({"event_seq": 0}, {"event_seq": 1})
    add = SegmentTable.add
    with monkeypatch.context() as patch:
        patch.setattr(SegmentTable, "add", lambda self, batch, rows: 1 / 0 if "sketches" in self.folder else add(self, batch, rows))
        with pytest.raises(ZeroDivisionError):
            rollup.add(0, events, as_of=AS_OF)
    assert rollup.add(0, events, as_of=AS_OF)
    assert rollup.stats().first()["event_count"] == rollup.estimates().first()["event_count"] == 2


def test_statistics_read_events_once(spark, make_events):
    events, gas = make_events({"sender": "0x1"}), spark.createDataFrame([("tx1", 1, 0, "0x1", ("success", (1, 1, 0)), [])], schemas.TRANSACTIONS)
    plan = plan_of(reports.daily_event_stats(events, gas, as_of=AS_OF))
    assert plan.count("Generate explode") == 1
    assert plan.count("Exchange hashpartitioning") <= 4


def test_segments_stay_few(spark, tmp_path):
    schema = spark.range(1).schema
    table = SegmentTable(spark, str(tmp_path), schema, lambda rows: rows.groupBy().agg(F.sum("id").alias("id")))
    for batch in range(FAN + 3):
        assert table.add(batch, spark.range(batch, batch + 1)) is not None
    assert len(table._parts().names()) == 4
    assert table.read().agg(F.sum("id")).first()[0] == sum(range(FAN + 3))
    assert table.add(3, spark.range(1)) is None


# --- zones ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, make_events, tmp_path_factory):
    """A store of several files."""
    rng = random.Random(2)
    rows = [
        {"transaction_digest": f"t{i // 3:03d}", "event_seq": i % 3, "checkpoint_sequence": i // 6 if i % 5 else 0, "sender": f"0x{i % 4}"}
        for i in range(90)
    ]
    rng.shuffle(rows)
    store = Store(spark, str(tmp_path_factory.mktemp("stored")), bucket_size=4)
    for part in (rows[:50], rows[50:]):
        store.append_events(enrich.enrich_events(make_events(*part), as_of=AS_OF))
    return store


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("wanted", [{}, {"sender": "0x2"}, {"transaction_digest": "t007"}, {"transaction_digest": "no"}])
def test_pages_equal_a_full_scan(stored, descending, wanted):
    zones, cursor, other = Zones(stored), None, None
    for _ in range(3):
        page = zones.page(cursor=cursor, limit=8, descending=descending, **wanted)
        full = query_events(stored.processed_events().drop("checkpoint_bucket"), cursor=other, limit=8, descending=descending, **wanted)
        rows, wanted_rows = ([tuple(r[c] for c in PAGE_KEY) for r in p.data.collect()] for p in (page, full))
        assert rows == wanted_rows
        assert (page.has_next_page, page.next_cursor) == (full.has_next_page, full.next_cursor)
        if not page.has_next_page:
            break
        cursor, other = page.next_cursor, full.next_cursor


def test_page_reads_only_near_files(stored):
    zones = Zones(stored)
    first = zones.page(limit=2)
    assert first.data.count() == 2
    looked = []
    rows = Zones._rows
    try:
        Zones._rows = lambda self, files: looked.extend(files) or rows(self, files)
        zones.page(limit=2, cursor=first.next_cursor)
        assert 0 < len(set(looked)) < len(zones._files())
        looked.clear()
        zones.page(transaction_digest="t020")
        assert 0 < len(set(looked)) <= 3
    finally:
        Zones._rows = rows


def test_page_of_an_empty_store(spark, tmp_path):
    page = Zones(Store(spark, str(tmp_path))).page()
    assert (page.data.count(), page.next_cursor, page.has_next_page) == (0, None, False)
    with pytest.raises(ValueError, match="limit"):
        Zones(Store(spark, str(tmp_path))).page(limit=0)


# --- checkpoint offsets --------------------------------------------------------


def checkpoint_run(spark, tmp_path, **options):
    stream = spark.readStream.format("checkpoints").options(path=str(tmp_path / "in"), **options).load()
    rows = stream.select("event_seq", "checkpoint_sequence")
    writer = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(r["event_seq"] for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())


def test_offsets_are_checkpoints(spark, make_events, tmp_path):
    checkpoints.register(spark)
    numbers = [0, 1, 2, 3, 5, 8, 9, 4, None]
    make_events(*[{"event_seq": i, "checkpoint_sequence": n} for i, n in enumerate(numbers)]).repartition(3).write.parquet(str(tmp_path / "in"))
    by_start = lambda low, high: sorted(i for i, n in enumerate(numbers) if low <= (n or 0) < high)
    options = {"start": 1, "step": 4}
    assert checkpoint_run(spark, tmp_path, **options) == by_start(1, 5)
    assert checkpoint_run(spark, tmp_path, **options) == by_start(1, 9)
    assert checkpoint_run(spark, tmp_path, **options) == by_start(1, 10)
    assert checkpoint_run(spark, tmp_path, **options) == by_start(1, 10)
    make_events({"event_seq": 20, "checkpoint_sequence": 12}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert checkpoint_run(spark, tmp_path, **options) == by_start(1, 10) + [20]


def test_checkpoints_behind_the_head_are_waited_for(spark, make_events, tmp_path):
    checkpoints.register(spark)
    make_events(*[{"event_seq": i, "checkpoint_sequence": i} for i in range(10)]).write.parquet(str(tmp_path / "in"))
    assert checkpoint_run(spark, tmp_path, delay=3) == list(range(7))


# --- counts, gaps, deliveries --------------------------------------------------


def test_counts_of_open_and_closed_windows(spark, make_events, tmp_path):
    hour = 3_600_000
    files = 0
    for part in ([0, 1, 2], [30, 31, 1], [60], [61]):
        make_events(*[{"event_seq": h, "timestamp_ms": h * hour} for h in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = running_type_counts(stream_events(spark, str(tmp_path / "in"), max_files_per_trigger=1), as_of=AS_OF)
        close_counts(counts, str(tmp_path / "closed"), str(tmp_path / "state")).awaitTermination()
        files = len(list(Path(tmp_path, "closed").rglob("*.parquet")))
    found = kept_counts(spark, str(tmp_path / "closed"), str(tmp_path / "state")).orderBy("window_start").collect()
    # The late event of the first day comes before the watermark has closed it.
    assert [(r["window_start"].day, r["event_count"]) for r in found] == [(1, 4), (2, 2), (3, 2)]
    assert files <= 2


@pytest.mark.parametrize("size", [2, 10_000])
def test_gaps_as_intervals(spark, monkeypatch, size):
    monkeypatch.setattr(ranges, "STRETCHES", size)
    rng = random.Random(5)
    for start, end, members in ((0, 50, rng.sample(range(-5, 60), 20)), (3, 3, []), (3, 3, [3, 3]), (10, 40, []), (0, 5, [0, 5]), (-4, 4, [0, None])):
        present = spark.createDataFrame([(m,) for m in members], "checkpoint_sequence int")
        wanted = ranges.CheckpointRange(start, end)
        missing = sorted(set(range(start, end + 1)) - set(members))
        found = sorted(tuple(r) for r in ranges.missing_intervals(present, wanted).collect())
        assert [m for a, b, n in found for m in range(a, b + 1) if n == b - a + 1] == missing
        assert all(b + 1 < c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))


def test_named_sinks_get_a_repeated_batch_once(spark, make_events, tmp_path):
    make_events(*[{"event_seq": n} for n in range(6)]).repartition(2).write.parquet(str(tmp_path / "in"))
    store, seen, left = Store(spark, str(tmp_path / "store")), {"a": Counter(), "b": Counter()}, [2]

    def sink(name):
        def write(frame, batch_id):
            if name == "b" and left[0]:
                left[0] -= 1
                raise RuntimeError("sink is down")
            seen[name].update(r["event_seq"] for r in frame.select("event_seq").collect())

        return write

    def start():
        source = stream_events(spark, str(tmp_path / "in"), max_files_per_trigger=1)
        return Pipeline().run_stream(source, store, str(tmp_path / "state"), sinks={"a": sink("a"), "b": sink("b")}, interval=None, as_of=AS_OF)

    keep_running(start, restarts=2, pause_seconds=0)
    assert seen["a"] == seen["b"] == Counter(range(6))
    assert store.deliveries().count() == 4
