from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from plans_of import plan_of
from ledgerflow import schemas
from ledgerflow.operators import enrich, outcomes, routing
from ledgerflow.operators.rules import Rule
from ledgerflow.operators.transactions import project_transactions
from ledgerflow.plans.pipeline import Pipeline, fan_out
from ledgerflow.sinks.store import Store, new_rows, unique_rows
from ledgerflow.sources.readers import stream_events

AS_OF = 5_000


def processed(make_events, *rows):
    return enrich.enrich_events(make_events(*rows), as_of=AS_OF)


@pytest.mark.parametrize("scope", ["table", "checkpoint"])
def test_replayed_append_changes_nothing(spark, make_events, tmp_path, scope):
    store = Store(spark, str(tmp_path), bucket_size=10)
    rows = processed(make_events, {"event_seq": 0}, {"event_seq": 1}, {"event_seq": 1}, {"event_seq": 2, "checkpoint_sequence": 99})
    first = store.append_events(rows, scope=scope)
    again = store.append_events(rows, scope=scope)
    assert (first.written, first.skipped, again.written, again.skipped) == (3, 1, 0, 4)
    assert store.processed_events().count() == 3
    assert store.append_events(rows.limit(0)).received == 0
    assert sorted(p.name for p in (tmp_path / "processed_events").glob("checkpoint_bucket=*")) == ["checkpoint_bucket=0", "checkpoint_bucket=9"]


def test_range_read_is_ordered_and_prunes(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path), bucket_size=10)
    store.append_events(processed(make_events, *[{"event_seq": n, "checkpoint_sequence": n * 7} for n in range(9)]))
    rows = store.events_in_range(14, 42)
    assert [r["checkpoint_sequence"] for r in rows.collect()] == [14, 21, 28, 35, 42]
    pushed = plan_of(rows).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "checkpoint_bucket" in pushed and ">= 1" in pushed and "<= 4" in pushed


def test_digest_is_unique(spark, tmp_path):
    tx = spark.createDataFrame(
        [("a", 1, 1000, "0x1", ("success", (5, 2, 1)), []), ("a", 1, 1000, "0x1", None, None), ("b", None, None, None, None, None)],
        schemas.TRANSACTIONS,
    )
    store = Store(spark, str(tmp_path))
    done = project_transactions(tx, as_of=AS_OF)
    assert store.append_transactions(done).written == 2
    assert store.append_transactions(done).written == 0
    row = {r["digest"]: r for r in store.processed_transactions().collect()}["b"]
    assert (row["gas_used"], row["status"], row["checkpoint_sequence"]) == (0, "false", 0)


def test_gas_does_not_subtract_the_rebate(spark):
    tx = spark.createDataFrame([("a", 1, 1000, "0x1", ("success", (5, 2, 1)), [(0, "E"), (1, "E")])], schemas.TRANSACTIONS)
    meta = project_transactions(tx, as_of=AS_OF).first()["metadata"]
    assert (meta["gas_used"], meta["success"], meta["event_count"]) == (7, True, 2)


def test_progress_and_reset(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.latest_checkpoint() is None and store.last_processed_checkpoint() == 0
    for checkpoint in (5, 9, 7):
        store.save_progress(checkpoint, as_of=AS_OF)
    assert store.latest_checkpoint() == 9
    store.save_progress(3, as_of=AS_OF, reset=True)
    store.save_progress(4, as_of=AS_OF)
    assert store.latest_checkpoint() == 4


@pytest.mark.parametrize("small", [True, False])
def test_new_rows_with_hot_copies(spark, small):
    """A third of all rows are copies of one key; compared with brute force."""
    keys = [(f"tx{n % 50}", n % 3) for n in range(400)] + [("hot", 0)] * 200
    stored = [(f"tx{n}", 1) for n in range(25)]
    batch = spark.createDataFrame(keys, "transaction_digest string, event_seq int").repartition(8)
    old = spark.createDataFrame(stored, "transaction_digest string, event_seq int")
    got = Counter(tuple(r) for r in new_rows(batch, old, schemas.EVENT_KEY, small=small).collect())
    assert got == Counter(set(keys) - set(stored))


def test_unique_rows_keeps_rows_in_place(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert "Exchange" not in plan_of(unique_rows(rows, ["k"]))


def test_statistics_replace_whole_days(spark, tmp_path):
    from datetime import date

    store = Store(spark, str(tmp_path))
    row = lambda day, n: (date(2024, 1, day), "p", "m", "t", n, 1, 0)
    store.write_event_stats(spark.createDataFrame([row(1, 1), row(2, 1)], schemas.EVENT_STATS))
    store.write_event_stats(spark.createDataFrame([row(2, 5)], schemas.EVENT_STATS))
    assert {(r["date"].day, r["event_count"]) for r in store.event_stats().collect()} == {(1, 1), (2, 5)}


def test_ledger_skips_what_was_done(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    events = make_events({"event_seq": 0}, {"event_seq": 1, "parsed_json": "bad"}, {"event_seq": 2})
    assert store.not_yet_processed(events).count() == 3
    store.append_event_ledger(outcomes.event_outcomes(events.where("event_seq < 2")), AS_OF)
    assert sorted(r["event_seq"] for r in store.not_yet_processed(events).collect()) == [1, 2]


def test_flat_rows_and_schema_check(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.append_event_rows(enrich.event_rows(make_events({}, {"event_seq": 1}), as_of=AS_OF)).written == 2
    with pytest.raises(ValueError, match="columns missing"):
        store.append_events(make_events({}))


def test_batch_run_quarantines_and_resumes(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    pipeline = Pipeline(rules=[Rule(package="0x2")])
    events = make_events(
        {"event_seq": 0}, {"event_seq": 1, "parsed_json": "bad"}, {"event_seq": 2, "package_id": "0x5"},
        {"event_seq": 3, "checkpoint_sequence": 20},
    )
    early = events.where("checkpoint_sequence < 10")
    report = pipeline.run_batch(early, store, as_of=AS_OF)
    assert (report.received, report.after_filter, report.succeeded, report.errors, report.stored_events) == (3, 2, 1, 1, 1)
    assert store.quarantined().first()["reason"] == "payload is not JSON"
    assert store.processed_events().first()["metadata"]["matched_filters"] == ["package=0x2"]
    report = pipeline.run_batch(events, store, as_of=AS_OF, late="skip")
    assert (report.received, report.stored_events, store.latest_checkpoint()) == (1, 1, 20)
    report = pipeline.run_batch(events, store, start=0, reset=True, as_of=AS_OF)
    assert (report.received, report.stored_events) == (4, 0)
    assert store.quarantined().count() == 1


def test_stream_equals_batch_and_survives_a_failing_sink(spark, make_events, tmp_path):
    rows = [{"event_seq": n, "checkpoint_sequence": n % 4, "parsed_json": "bad" if n == 3 else '{"a":1}'} for n in range(12)]
    make_events(*rows, rows[0]).repartition(3).write.parquet(str(tmp_path / "in"))
    batch_store, store = Store(spark, str(tmp_path / "b")), Store(spark, str(tmp_path / "s"))
    pipeline = Pipeline()
    pipeline.run_batch(make_events(*rows), batch_store, as_of=AS_OF)
    seen = Counter()
    fail = [True]

    def counting(frame, batch_id):
        seen.update(r["event_seq"] for r in frame.select("event_seq").collect())

    def failing(frame, batch_id):
        if fail[0]:
            fail[0] = False
            raise RuntimeError("sink is down")

    def start():
        source = stream_events(spark, str(tmp_path / "in"), max_files_per_trigger=1)
        return pipeline.run_stream(
            source, store, str(tmp_path / "state"), sinks=[fan_out(failing, counting)], interval=None, as_of=AS_OF
        )

    with pytest.raises(Exception, match="sink is down"):
        start().awaitTermination()
    assert store.processed_events().count() == 0
    start().awaitTermination()
    key = ["transaction_digest", "event_seq", "fields", "event_type", "timestamp"]
    assert sorted(store.processed_events().select(key).collect()) == sorted(batch_store.processed_events().select(key).collect())
    assert seen == Counter(set(range(12)) - {3})
    assert store.latest_checkpoint() == 3


def test_stream_starts_at_a_checkpoint(spark, make_events, tmp_path):
    make_events({"event_seq": 0, "checkpoint_sequence": 1}, {"event_seq": 1, "checkpoint_sequence": 5}).write.parquet(str(tmp_path / "in"))
    source = stream_events(spark, str(tmp_path / "in"), start=5)
    store = Store(spark, str(tmp_path / "s"))
    Pipeline(processor=enrich.enrich_simple).run_stream(source, store, str(tmp_path / "c"), interval=None, as_of=AS_OF).awaitTermination()
    assert [r["event_seq"] for r in store.processed_events().collect()] == [1]


def test_process_filters_then_transforms(make_events):
    done = Pipeline(rules=[Rule(package="0x2")], processor=lambda df: df.select("event_seq")).process(
        make_events({"event_seq": 4}, {"package_id": "0x9"})
    )
    assert [tuple(r) for r in done.collect()] == [(4,)]


def test_routes_need_valid_ids(make_events):
    with pytest.raises(ValueError):
        routing.route_columns({"zz": F.lit(1)}, F.lit(0))
    parts = routing.route_frames(make_events({}, {"package_id": None}), {"0x2": lambda d: d.select("event_seq")}, lambda d: d.select("event_seq"))
    assert parts.count() == 2
