"""What keeps the jobs' figures in proportion to their input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators import enrich
from ledgerflow.plans import catalog_jobs
from ledgerflow.plans.pipeline import Pipeline
from ledgerflow.sinks import store as sinks
from ledgerflow.sinks.store import Store
from ledgerflow.sinks.zones import Zones
from ledgerflow.sources.paging import query_events
from ledgerflow.sources.readers import stream_events
from ledgerflow.streaming import ledger

AS_OF = 5_000


def one_file(make_events, folder, n):
    make_events(*[{"event_seq": i} for i in range(n)]).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_single_file_is_dealt_to_several_tasks(spark, make_events, tmp_path):
    one_file(make_events, tmp_path / "in", 4000)
    name, parts = "spark.sql.adaptive.coalescePartitions.minPartitionSize", []
    before = spark.conf.get(name)
    spark.conf.set(name, "1k")
    try:
        source, store = stream_events(spark, str(tmp_path / "in")), Store(spark, str(tmp_path / "store"))

        def sink(frame, batch_id):
            parts.append(frame.select(F.spark_partition_id()).distinct().count())

        Pipeline().run_stream(source, store, str(tmp_path / "state"), sinks=[sink], interval=None, as_of=AS_OF).awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert parts[0] > 1
    assert store.processed_events().count() == 4000


def test_ledger_state_is_kept_by_slices(spark, make_events, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SLICES", 3)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        one_file(make_events, tmp_path / "in", 100)
    source = stream_events(spark, str(tmp_path / "in"), max_files_per_trigger=1)
    Pipeline(ledger=True).run_stream(source, store, str(tmp_path / "state"), interval=None, as_of=AS_OF).awaitTermination()
    assert sorted(r["event_seq"] for r in store.processed_events().collect()) == list(range(100))
    assert store.event_ledger().count() == 100
    with ledger.state_store(spark):
        held = spark.read.format("statestore").option("stateVarName", "done").load(str(tmp_path / "state"))
        keys = held.select("key.*").collect()
    assert len(keys) == 100
    assert len({tuple(key) for key in keys}) == 3


def test_all_files_are_one_batch_if_wanted(spark, make_events, tmp_path):
    for _ in range(3):
        one_file(make_events, tmp_path / "in", 2)
    batches = []
    for per_batch in (1, None):
        stream = catalog_jobs._files(spark, str(tmp_path / "in"), schemas.EVENTS, per_batch)
        seen = []
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / f"state-{per_batch}")).trigger(availableNow=True)
        writer.foreachBatch(lambda frame, number: seen.append(frame.count())).start().awaitTermination()
        batches.append(seen)
    assert batches == [[2, 2, 2], [6]]


def test_stored_tables_are_compressed_by_zstd(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    Pipeline().run_batch(make_events({}, {"event_seq": 1}), store, as_of=AS_OF)
    for table in ("processed_events", "processed_events_keys"):
        files = list((tmp_path / table).rglob("part-*.parquet"))
        assert files and all(file.name.endswith(".zstd.parquet") for file in files)


@pytest.mark.parametrize("scope", ["table", "checkpoint"])
def test_appends_over_many_buckets_write_few_folders(spark, make_events, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(sinks, "APPEND_FOLDERS", 4)
    store = Store(spark, str(tmp_path), bucket_size=2)
    numbers = [0, 1, None, *range(6, 200, 3)]
    make = lambda own: enrich.enrich_events(make_events(*[{"event_seq": i, "checkpoint_sequence": n} for i, n in own]), as_of=AS_OF)
    rows = list(enumerate(numbers))
    # A narrow append comes first: its folders stay beside the wider ones.
    assert store.append_events(make(rows[20:22]), scope=scope).written == 2
    assert store.append_events(make(rows), scope=scope).written == len(rows) - 2
    for part in (rows, rows[3:9], rows[-2:]):
        assert store.append_events(make(part), scope=scope).written == 0
    assert len(list((tmp_path / "processed_events").glob("checkpoint_bucket=*"))) <= 4 + 2
    assert store.span("processed_events") == 64
    for start, end in ((0, 5), (60, 72), (130, 199)):
        found = [r["checkpoint_sequence"] for r in store.events_in_range(start, end).collect()]
        assert found == sorted(n or 0 for n in numbers if start <= (n or 0) <= end)
    for descending in (False, True):
        full = sorted(((n or 0, i) for i, n in rows), reverse=descending)
        own = store.processed_events()
        for page in (Zones(store).page(limit=10, descending=descending), query_events(own, limit=10, descending=descending, bucket_size=2, window=5)):
            assert [(r["checkpoint_sequence"], r["event_seq"]) for r in page.data.collect()] == full[:10]


@pytest.mark.parametrize("hot", [10**6, 5])
def test_many_copies_are_merged_in_bounded_tasks(spark, monkeypatch, hot):
    monkeypatch.setattr(sinks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sinks, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(sinks, "HOT_COPIES", hot, raising=False)
    keys = [(f"tx{n}", n % 3) for n in range(300)] * 2 + [("hot", 0), (None, 1), ("x", None)] * 40 + [("one", 1)]
    rows = spark.createDataFrame([(*key, f"v{key}") for key in keys], "transaction_digest string, event_seq int, value string")
    found = sinks.unique_rows(rows, schemas.EVENT_KEY)
    sizes = [len(part) for part in found.rdd.glom().collect()]
    assert sum(sizes) == len(set(keys)) and max(sizes) < 75
    assert {tuple(row) for row in found.collect()} == {(*key, f"v{key}") for key in keys}
