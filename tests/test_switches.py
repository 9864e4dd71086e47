"""Both sides of each switch on size give the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import filters
from ledgerflow.operators.outcomes import event_outcomes
from ledgerflow.operators.rules import Rule, rules_frame
from ledgerflow.operators.transactions import transactions_with_events
from ledgerflow.plans.pipeline import Pipeline
from ledgerflow.sinks.store import Store, new_rows
from ledgerflow.streaming.streams import latest_counts

RULES = [Rule(package="0x2", name="a"), Rule(sender="0x9", name="b")]


@pytest.fixture
def events(make_events):
    return make_events({"event_seq": 0}, {"event_seq": 1, "package_id": "0x5"}, {"event_seq": 2, "sender": "0x9", "package_id": "0x6"})


def many() -> list[Rule]:
    return RULES + [Rule(package=f"0xf{n:03d}", name=f"r{n}") for n in range(filters.COMPILED_RULES)]


@pytest.mark.parametrize("rules", [RULES, many()], ids=["few", "many"])
def test_unknown_type_match_is_refused(events, rules):
    for call in (filters.filter_events, filters.match_rules, event_outcomes):
        with pytest.raises(ValueError, match="type_match"):
            call(events, rules, type_match="guess")


@pytest.mark.parametrize("rules", [RULES, many()], ids=["few", "many"])
def test_labels_come_only_when_asked_for(spark, events, rules, tmp_path):
    assert "matched_filters" not in event_outcomes(events, rules).columns
    assert [r["outcome"] for r in event_outcomes(events, rules).orderBy("event_seq").collect()] == ["success", "filtered", "success"]
    for label, wanted in ((True, [["a"], ["b"]]), (False, [[], []])):
        store = Store(spark, str(tmp_path / f"store-{label}"))
        Pipeline(rules=rules, label_rules=label).run_batch(events, store)
        stored = store.processed_events().orderBy("event_seq").select("metadata.matched_filters").collect()
        assert [list(r["matched_filters"]) for r in stored] == wanted


@pytest.mark.parametrize("small", [True, False])
def test_null_keys_are_copies_of_each_other(spark, small):
    schema = "k string, n int, v int"
    batch = spark.createDataFrame([(None, 1, 1), (None, 1, 2), ("a", None, 3), ("b", 1, 4), ("b", 1, 5)], schema)
    stored = spark.createDataFrame([("a", None, 9), ("c", 1, 9)], schema)
    found = new_rows(batch, stored, ["k", "n"], small=small)
    assert sorted((str(r["k"]), r["n"]) for r in found.collect()) == [("None", 1), ("b", 1)]


def test_every_transaction_has_a_first_part(spark):
    tx = spark.createDataFrame([("t", 7), ("u", 8)], "digest string, gas int")
    events = spark.createDataFrame([("t", 5), ("t", 2000), ("u", 3000), ("x", 1)], "transaction_digest string, event_seq long")
    rows = transactions_with_events(tx, events).collect()
    assert sorted((r["digest"], r["part"], r["gas"], len(r["processed_events"])) for r in rows if r["part"] == 0) == [("t", 0, 7, 1), ("u", 0, 8, 0)]
    assert sorted((r["digest"], r["part"], r["gas"]) for r in rows if r["part"] > 0) == [("t", 1, None), ("u", 2, None)]


def test_empty_rule_table_keeps_all(spark, events):
    none = rules_frame(spark, RULES).where(F.lit(False))
    assert filters.filter_events(events, none).count() == 3
    assert event_outcomes(events, none).where("outcome = 'success'").count() == 3


def test_newest_counts_win(spark):
    rows = [(0, 1, "E", 2, 0), (0, 1, "E", 5, 1), (1, 2, "E", 1, 1)]
    kept = spark.createDataFrame(rows, "window_start int, window_end int, event_type string, event_count long, batch int")
    assert sorted((r["window_start"], r["event_count"]) for r in latest_counts(kept).collect()) == [(0, 5), (1, 1)]


def test_late_and_unknown_records_are_kept(spark, make_events, tmp_path):
    store = Store(spark, str(tmp_path))
    Pipeline().run_batch(make_events({"event_seq": 0, "checkpoint_sequence": 9}), store)
    later = make_events(
        {"event_seq": 1, "checkpoint_sequence": 9}, {"event_seq": 2, "checkpoint_sequence": None},
        {"event_seq": 3, "checkpoint_sequence": 3, "parsed_json": '{"a":1} trailing'}, {"event_seq": 4, "checkpoint_sequence": 10},
    )
    report = Pipeline().run_batch(later, store)
    assert (report.received, report.stored_events, report.errors) == (4, 3, 1)
    again = Pipeline().run_batch(later, store)
    assert (again.stored_events, store.processed_events().count(), store.quarantined().count()) == (0, 4, 1)
    assert store.batch_log().agg(F.sum("events")).first()[0] == 4
    with pytest.raises(ValueError, match="late"):
        Pipeline().run_batch(later, store, late="drop")
