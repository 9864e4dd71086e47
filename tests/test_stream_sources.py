"""Streams with two sources, with the ledger as state, and across restarts."""

from __future__ import annotations

import time
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.operators import reports
from ledgerflow.operators.outcomes import event_outcomes
from ledgerflow.operators.rules import Rule
from ledgerflow.plans.pipeline import Pipeline, keep_running
from ledgerflow.sinks.store import Store
from ledgerflow.sources.readers import stream_events
from ledgerflow.streaming.streams import joined_transactions

AS_OF = 5_000


def transactions_of(spark, *rows):
    full = [(d, cp, ms, "0x1", ("success", (5, 2, 1)), []) for d, cp, ms in rows]
    return spark.createDataFrame(full, schemas.TRANSACTIONS)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_two_sources_survive_a_restart(spark, make_events, tmp_path):
    events = make_events(*[{"event_seq": n, "checkpoint_sequence": n, "parsed_json": "bad" if n == 3 else "{}"} for n in range(8)])
    found = transactions_of(spark, *[(f"t{n % 5}", n % 5 + 10, 1000) for n in range(9)], (None, 1, 1000))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    found.repartition(2).write.parquet(str(tmp_path / "transactions"))
    store = Store(spark, str(tmp_path / "store"))
    left = [2]

    def failing(frame, batch_id):
        if left[0]:
            left[0] -= 1
            raise RuntimeError("sink is down")

    def start():
        return Pipeline().run_stream(
            stream_events(spark, str(tmp_path / "events"), max_files_per_trigger=1),
            store,
            str(tmp_path / "state"),
            transactions=stream_of(spark, tmp_path / "transactions", schemas.TRANSACTIONS),
            sinks=[failing],
            interval=None,
            as_of=AS_OF,
        )

    with pytest.raises(Exception, match="sink is down"):
        keep_running(start, restarts=0)
    keep_running(start, restarts=1, pause_seconds=0)
    assert left == [0]
    assert sorted(r["event_seq"] for r in store.processed_events().collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert sorted(r["digest"] for r in store.processed_transactions().collect()) == [f"t{n}" for n in range(5)]
    assert sorted(r["reason"] for r in store.quarantined().collect()) == ["digest is missing", "payload is not JSON"]
    sources = {r["source"]: (r["records"], r["latest_checkpoint"]) for r in reports.progress_by_source(store.source_progress()).collect()}
    assert sources == {"events": (8, 7), "transactions": (10, 14)}
    found.where("digest = 't1'").withColumn("digest", F.lit("t9")).limit(1).write.mode("append").parquet(str(tmp_path / "transactions"))
    keep_running(start, restarts=0)
    assert store.processed_transactions().count() == 6
    assert store.processed_events().count() == 7


def test_join_of_streams_goes_on_after_a_restart(spark, make_events, tmp_path):
    minute = 60_000
    start = 1_700_000_000_000
    parts = (
        (transactions_of(spark, ("a", 1, start), ("b", 1, start + minute)), make_events({"transaction_digest": "a", "timestamp_ms": start + 10 * minute})),
        (
            transactions_of(spark, ("c", 2, start + 20 * minute), ("late", 3, start + 900 * minute)),
            make_events(
                {"transaction_digest": "b", "event_seq": 3, "timestamp_ms": start + 8 * minute},
                {"transaction_digest": "c", "timestamp_ms": start + 40 * minute},
                {"transaction_digest": "x", "timestamp_ms": start + 900 * minute},
            ),
        ),
    )
    pairs = []
    for own, events in parts:
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        source = stream_of(spark, tmp_path / "t", schemas.TRANSACTIONS), stream_of(spark, tmp_path / "e", schemas.EVENTS)
        joined = joined_transactions(*source, within="10 minutes", how="leftOuter", delay="30 minutes", as_of=AS_OF)
        rows = joined.select("tx_digest", "event_seq")
        writer = rows.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        running = writer.option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
        running.awaitTermination()
        pairs.append(sorted((r["tx_digest"], r["event_seq"]) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()))
    assert pairs[0] == [("a", 0)]
    # What waited for its events past the watermark comes out without; "late" still waits.
    assert pairs[1] == [("a", 0), ("b", 3), ("c", None)]


def ledger_run(spark, store, folder, state, **options):
    source = stream_events(spark, str(folder), max_files_per_trigger=1)
    seen = Counter()

    def sink(frame, batch_id):
        seen.update(r["event_seq"] for r in frame.select("event_seq").collect())

    rules = options.pop("rules", ())
    running = Pipeline(rules=rules, ledger=True).run_stream(source, store, str(state), sinks=[sink], interval=None, as_of=AS_OF, **options)
    running.awaitTermination()
    return seen, running


def test_ledger_in_the_stream_skips_what_is_done(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [{"event_seq": n, "parsed_json": "bad" if n == 3 else "{}"} for n in range(6)]
    # Two events were done before, one failed then.
    before = event_outcomes(make_events(rows[0], rows[1], {"event_seq": 2, "parsed_json": "bad"}))
    store.append_event_ledger(before, AS_OF)
    events = make_events(*rows)
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, running = ledger_run(spark, store, tmp_path / "in", tmp_path / "state")
    assert seen == Counter([2, 4, 5])
    assert sorted(r["event_seq"] for r in store.processed_events().collect()) == [2, 4, 5]
    statuses = {(r["event_sequence"], r["status"]) for r in store.event_ledger().collect()}
    assert statuses == {(0, "success"), (1, "success"), (2, "error"), (2, "success"), (3, "error"), (4, "success"), (5, "success")}
    # The state goes on after a restart, and the stored ledger alone is enough for a new stream.
    make_events({"event_seq": 5}, {"event_seq": 6}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert ledger_run(spark, store, tmp_path / "in", tmp_path / "state")[0] == Counter([6])
    assert ledger_run(spark, store, tmp_path / "in", tmp_path / "other")[0] == Counter()


def test_ledger_state_is_forgotten_in_time(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    make_events({"event_seq": 1}).write.parquet(str(tmp_path / "in"))
    options = {"remember": timedelta(milliseconds=1)}
    ledger_run(spark, store, tmp_path / "in", tmp_path / "state", **options)
    time.sleep(0.1)
    make_events({"event_seq": 1}, {"event_seq": 2}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger_run(spark, store, tmp_path / "in", tmp_path / "state", **options)
    # What is forgotten comes again and is stopped by the keyed append.
    assert store.processed_events().count() == 2


def test_batches_use_the_ledger_too(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    pipeline = Pipeline(ledger=True, rules=[Rule(package="0x2")])
    events = make_events({"event_seq": 0}, {"event_seq": 1, "parsed_json": "bad"}, {"event_seq": 2, "package_id": "0x5"})
    first = pipeline.run_batch(events, store, as_of=AS_OF)
    again = pipeline.run_batch(events, store, as_of=AS_OF)
    assert (first.received, first.stored_events, again.received, again.errors, again.stored_events) == (3, 1, 2, 1, 0)
    assert sorted((r["event_sequence"], r["status"]) for r in store.event_ledger().collect()) == [(0, "success"), (1, "error")]


def test_stream_with_a_ledger_refuses_rule_tables(spark, make_events, tmp_path):
    from ledgerflow.operators.rules import rules_frame

    make_events({}).write.parquet(str(tmp_path / "in"))
    pipeline = Pipeline(rules=rules_frame(spark, [Rule(package="0x2")]), ledger=True)
    with pytest.raises(ValueError, match="short list"):
        pipeline.run_stream(stream_events(spark, str(tmp_path / "in")), Store(spark, str(tmp_path / "s")), str(tmp_path / "c"))
