"""The key index of stored tables and the small logs beside them."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators import enrich
from ledgerflow.plans.pipeline import Pipeline
from ledgerflow.sinks import key_index
from ledgerflow.sinks.key_index import KeyIndex, bloom, hashed, may_hold
from ledgerflow.sinks.manifest import FAN, KEPT_CHANGES, Manifest
from ledgerflow.sinks.small_log import SmallLog
from ledgerflow.sinks.store import Store

AS_OF = 5_000
KEY = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def test_filters_deny_nothing_they_hold():
    rng = np.random.default_rng(4)
    for size in (1, 7, 5000):
        held = np.sort(rng.integers(-(2**63), 2**63 - 1, size))
        bits = bloom(held)
        assert may_hold(bits, held).all()
        strangers = rng.integers(-(2**63), 2**63 - 1, 50_000)
        assert may_hold(bits, strangers).mean() < 0.002
    # Hashes side by side, as they are in a sorted file.
    near = np.arange(10_000, dtype=np.int64) * 3
    assert may_hold(bloom(near), near).all() and may_hold(bloom(near), near + 1).mean() < 0.002
    assert not may_hold(bloom(np.empty(0, np.int64)), near).all()


def keyed(spark, *names):
    return spark.createDataFrame([(n, i) for n, i in names], KEY)


def stored_keys(index, frame, buckets=None):
    found = index.stored_among(hashed(frame, index.keys), frame.count(), buckets)
    return set() if found is None else {tuple(r) for r in found.collect()}


@pytest.mark.parametrize("task_keys", [4, 1 << 20])
def test_index_knows_what_was_added(spark, tmp_path, monkeypatch, task_keys):
    monkeypatch.setattr(key_index, "TASK_KEYS", task_keys)
    index = KeyIndex(spark, str(tmp_path), "t", KEY)
    some = [(f"k{i % 30}", i) for i in range(100)] + [(None, 1), ("a", None), (None, None)]
    assert stored_keys(index, keyed(spark, *some)) == set()
    for part, bucket in ((some[:50], 0), (some[50:], 7)):
        index.finish(index.begin(keyed(spark, *part).withColumn("checkpoint_bucket", F.lit(bucket).cast("bigint"))))
    asked = keyed(spark, *some, ("k1", 999), (None, 5), ("zz", None))
    assert stored_keys(index, asked) == set(some)
    assert stored_keys(index, asked, (7, 9)) == set(some[50:])
    assert stored_keys(index, asked, (1, 6)) == set()


def test_filters_of_runs(monkeypatch):
    monkeypatch.setattr(key_index, "FILTER_KEYS", 16)
    files = ["a"] * 20 + ["b"] * 3 + ["c"] * 40
    columns = {"segment": ["s"] * 63, "file": files, "_hash": list(range(63)), "checkpoint_bucket": [i // 10 for i in range(63)]}
    whole = pa.RecordBatch.from_pydict(columns)
    found = [row for batch in key_index._build([whole.slice(0, 7), whole.slice(7, 30), whole.slice(37)]) for row in batch.to_pylist()]
    assert [(r["file"], r["low"], r["high"], r["n_keys"]) for r in found] == [
        ("a", 0, 15, 16), ("a", 16, 19, 4), ("b", 20, 22, 3), ("c", 23, 38, 16), ("c", 39, 54, 16), ("c", 55, 62, 8)
    ]
    assert all(may_hold(r["bits"], np.arange(r["low"], r["high"] + 1)).all() for r in found)
    assert [(r["first_bucket"], r["last_bucket"]) for r in found][:2] == [(0, 1), (1, 1)]
    assert list(key_index._build([whole.slice(0, 0)])) == []


def processed(make_events, *rows):
    return enrich.enrich_events(make_events(*rows), as_of=AS_OF)


def test_new_keys_read_nothing_that_is_stored(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append_events(processed(make_events, *[{"event_seq": n} for n in range(50)]))
    for folder in ("processed_events", "processed_events_keys"):
        for file in Path(tmp_path, folder).rglob("*.parquet"):
            file.write_bytes(b"unreadable")
    fresh = processed(make_events, *[{"event_seq": n} for n in range(100, 150)])
    assert store.append_events(fresh).written == 50
    with pytest.raises(Exception, match="parquet|Parquet"):
        store.append_events(processed(make_events, {"event_seq": 7}))


def test_input_is_read_once(spark, make_events, tmp_path):
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    rows = [{"event_seq": i, "parsed_json": "bad" if i % 5 == 0 else "{}"} for i in range(40)]
    events = make_events(*rows, rows[1], rows[2])
    store = Store(spark, str(tmp_path))
    for wanted in (32, 0):
        report = Pipeline().run_batch(events.mapInArrow(counted, events.schema), store, as_of=AS_OF)
        assert (report.received, report.stored_events) == (42, wanted)
    assert n.value == 2 * 42
    assert not list(Path(tmp_path, "_work").rglob("*.parquet")) or not list(Path(tmp_path, "_work", "decided").rglob("*"))


@pytest.mark.parametrize("dies_at", ["keys", "rows", "filters"])
def test_append_that_died_is_repaired(spark, make_events, tmp_path, monkeypatch, dies_at):
    store = Store(spark, str(tmp_path))
    store.append_events(processed(make_events, {"event_seq": 0}))
    rows = processed(make_events, *[{"event_seq": n} for n in range(5)])

    def down(*_):
        raise RuntimeError("it died")

    with monkeypatch.context() as patch:
        if dies_at == "keys":
            patch.setattr(KeyIndex, "_write_keys", down)
        elif dies_at == "rows":
            begin = KeyIndex.begin
            patch.setattr(KeyIndex, "begin", lambda self, frame: begin(self, frame) and down())
        else:
            patch.setattr(KeyIndex, "finish", down)
        with pytest.raises(RuntimeError, match="it died"):
            store.append_events(rows)
    again = store.append_events(rows)
    assert again.written == (0 if dies_at == "filters" else 4)
    assert store.append_events(rows).written == 0
    assert sorted(r["event_seq"] for r in store.processed_events().collect()) == [0, 1, 2, 3, 4]


def test_table_without_an_index_gets_one(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    old = processed(make_events, {"event_seq": 0}, {"event_seq": 1}).withColumn("checkpoint_bucket", F.lit(0).cast("bigint"))
    old.write.partitionBy("checkpoint_bucket").parquet(f"{tmp_path}/processed_events")
    assert store.append_events(processed(make_events, {"event_seq": 1}, {"event_seq": 2})).written == 1
    assert store.processed_events().count() == 3


LOG = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("t", T.StringType())])


def row(n):
    return {"n": n, "at": datetime(2024, 1, 1, 0, 0, n % 60, tzinfo=timezone.utc), "t": None if n % 2 else f"é{n}"}


def test_log_keeps_few_files(spark, tmp_path):
    log = SmallLog(f"{tmp_path}/log", LOG)
    assert log.last() is None and log.read(spark).count() == 0
    most = 0
    for n in range(1000):
        log.append(row(n))
        assert n % 50 or log.last() == row(n)
        most = max(most, len(list(Path(tmp_path, "log").iterdir())))
    assert most < 3 * FAN + KEPT_CHANGES * FAN
    assert len(log.paths()) <= 3 * FAN
    found = log.read(spark)
    assert found.schema == LOG
    assert sorted(r["n"] for r in found.collect()) == list(range(1000))
    assert found.where("n = 58").first()["at"] == datetime(2024, 1, 1, 0, 0, 58)


def test_log_reads_what_was_there_before(spark, tmp_path):
    folder = f"{tmp_path}/log"
    spark.createDataFrame([(1, datetime(2024, 1, 1), "a"), (2, datetime(2024, 1, 1), None)], LOG).coalesce(1).write.parquet(folder)
    log = SmallLog(folder, LOG)
    assert log.read(spark).count() == 2
    log.append(row(3))
    assert sorted(r["n"] for r in log.read(spark).collect()) == [1, 2, 3]


def test_half_an_append_is_not_seen(spark, tmp_path, monkeypatch):
    log = SmallLog(f"{tmp_path}/log", LOG)
    log.append(row(0))
    with monkeypatch.context() as patch:
        patch.setattr(Manifest, "_put", lambda *_: (_ for _ in ()).throw(OSError("it died")))
        with pytest.raises(OSError):
            log.append(row(1))
    assert [r["n"] for r in log.read(spark).collect()] == [0]
    held = log.read(spark)
    for n in range(2, 2 + FAN):
        log.append(row(n))
    # A frame from before a merge can still be read.
    assert [r["n"] for r in held.collect()] == [0]
    (manifest,) = Path(tmp_path, "log").glob("_manifest-*.json")
    assert len(json.loads(manifest.read_text())["live"]) <= FAN
