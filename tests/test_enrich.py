from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plans_of import plan_of
from ledgerflow.fixed_values import LENDING_PACKAGE_ID, PREFIX_PROTOCOL_IDS
from ledgerflow.operators import enrich, outcomes
from ledgerflow.operators.rules import Rule
from ledgerflow.sources.readers import decode_wire_events, from_thin, read_events
from ledgerflow import schemas

MEMBER = PREFIX_PROTOCOL_IDS[0]
AS_OF = 5_000


def fields(make_events, event: dict, **options) -> dict:
    return json.loads(enrich.enrich_events(make_events(event), as_of=AS_OF, **options).first()["fields"])


def test_envelope_overwrites_payload(make_events):
    got = fields(make_events, {"parsed_json": '{"sender":"me","x":1.5,"n":null,"o":{"a":[1,"2"]}}'})
    assert got["sender"] == "0x" + "123".rjust(64, "0")
    assert (got["x"], got["n"], got["o"]) == (1.5, None, {"a": [1, "2"]})
    assert (got["module"], got["event_type"], got["event_sequence"], got["timestamp_ms"]) == ("coin", "Transfer", 0, 1000)


def test_key_without_envelope_value_stays(make_events):
    got = fields(make_events, {"timestamp_ms": None, "parsed_json": '{"timestamp_ms":"mine","bcs_data":1}'})
    assert (got["timestamp_ms"], got["bcs_data"]) == ("mine", 1)


@pytest.mark.parametrize("text", ["[1]", '"text"', "3", None, "{}", "broken"])
def test_payload_without_members_adds_nothing(make_events, text):
    assert set(fields(make_events, {"parsed_json": text})) == {
        "package_id", "module", "event_type", "sender", "transaction_digest", "event_sequence", "timestamp_ms"
    }


def test_last_of_repeated_keys_wins(make_events):
    text = enrich.enrich_events(make_events({"parsed_json": '{"a":1,"b":2,"a":3}'}), as_of=AS_OF).first()["fields"]
    assert json.loads(text)["a"] == 3 and text.count('"a"') == 1


def test_raw_bytes_only_when_there_are_any(make_events):
    assert fields(make_events, {"bcs": b"hi"})["bcs_data"] == "aGk="
    assert "bcs_data" not in fields(make_events, {"bcs": b""})
    assert "bcs_data" not in fields(make_events, {"bcs": b"hi"}, include_raw=False)


def test_deposit_fields_keep_types_and_overwrite(make_events):
    event = {
        "package_id": MEMBER,
        "type_name": "DepositEvent",
        "parsed_json": '{"amount":"10","asset_id":3,"user":"u","pool_id":"p","action":"mine","success":false}',
    }
    got = fields(make_events, event)
    wanted = {"deposit_amount": "10", "asset_id": 3, "user_address": "u", "pool_id": "p", "action": "deposit"}
    assert wanted.items() <= got.items()
    assert got["success"] is True and got["protocol"] == "navi"


def test_unknown_action_and_no_object(make_events):
    got = fields(make_events, {"package_id": MEMBER, "type_name": "Other", "parsed_json": '{"amount":1}'})
    assert got["action"] == "unknown" and "success" not in got
    got = fields(make_events, {"package_id": MEMBER, "type_name": "DepositEvent", "parsed_json": "[1]"})
    assert got["action"] == "deposit" and "success" not in got
    assert "protocol" not in fields(make_events, {"package_id": MEMBER}, custom_fields=False)


def tags(make_events, event: dict, transform=enrich.enrich_events) -> list:
    return transform(make_events(event), as_of=AS_OF).first()["metadata"]["tags"]


def test_tags(make_events):
    assert tags(make_events, {"package_id": MEMBER, "type_name": "DepositEvent"}) == ["navi", "lending", "deposit", "coin"]
    assert tags(make_events, {"type_name": "BorrowEvent"}) == ["borrow", "coin"]
    assert tags(make_events, {}, enrich.enrich_lending_events) == ["coin", "defi", "navi-protocol"]
    assert tags(make_events, {}, enrich.enrich_simple) == ["simple"]
    assert tags(make_events, {}, enrich.enrich_defi) == ["blockchain"]
    assert tags(make_events, {"package_id": LENDING_PACKAGE_ID}, enrich.enrich_defi) == ["navi", "defi", "lending"]


def test_default_profile(make_events):
    row = enrich.enrich_default(
        make_events({"package_id": LENDING_PACKAGE_ID, "event_seq": 4, "parsed_json": '{"a":1}'}), as_of=AS_OF
    ).first()
    assert json.loads(row["fields"]) == {"type": "Transfer", "parsed_json": {"a": 1}}
    assert row["metadata"]["matched_filters"] == ["navi_protocol"] and row["metadata"]["event_index"] == 0


def test_class_order_and_parts(spark):
    names = {
        "MyDepositEventV2": "deposit",
        "DepositEventBorrowEvent": "deposit",
        "BorrowEvent": "borrow",
        "LiquidationEvent": "liquidation",
        "Deposit": "other",
    }
    df = spark.createDataFrame([(n,) for n in names], "type_name string")
    assert {r[0]: r[1] for r in df.select("type_name", enrich.event_class()).collect()} == names


def test_switches_keep_the_schema(make_events):
    off = enrich.enrich_events(
        make_events({}), as_of=AS_OF, extract_fields=False, add_metadata=False, include_source=False
    )
    row = schemas.conform(off, schemas.PROCESSED_EVENTS).first()
    assert (row["fields"], row["metadata"], row["event_data"]) == (None, None, None)


def test_source_copy_decodes_again(make_events):
    events = make_events({"parsed_json": '{"a":"b"}', "bcs": b"hi"})
    text = events.select(enrich.source_event().alias("value"))
    back = decode_wire_events(text).drop("_corrupt_record", "checkpoint_sequence")
    assert back.collect() == events.select(*back.columns).collect()


def test_enrichment_does_not_shuffle(make_events):
    assert "Exchange" not in plan_of(enrich.enrich_events(make_events({}), as_of=AS_OF))


def test_outcomes(make_events):
    events = make_events(
        {"transaction_digest": "ok"},
        {"transaction_digest": "broken", "parsed_json": "nope"},
        {"transaction_digest": "list", "parsed_json": "[1]"},
        {"transaction_digest": "other", "package_id": "0x9", "parsed_json": "nope"},
        {"transaction_digest": "bad id", "package_id": "zz"},
        {"transaction_digest": None},
        {"transaction_digest": "no sender", "sender": None},
    )
    decided = outcomes.event_outcomes(events, [Rule(package="0x2")])
    got = {r["transaction_digest"]: (r["outcome"], r["reason"]) for r in decided.collect()}
    assert got == {
        "ok": ("success", None),
        "broken": ("error", "payload is not JSON"),
        "list": ("success", None),
        "other": ("filtered", "no rule matched"),
        "bad id": ("error", "package id is invalid"),
        None: ("error", "key is missing"),
        "no sender": ("error", "sender is invalid"),
    }
    assert tuple(outcomes.batch_counts(decided).first()) == (7, 6, 2, 4)
    assert outcomes.quarantine(decided, AS_OF).count() == 4


def test_strict_mode_fails(make_events):
    events = make_events({"parsed_json": "nope"})
    with pytest.raises(Exception, match="payload is not JSON"):
        outcomes.event_outcomes(events, on_error="raise").collect()
    with pytest.raises(ValueError):
        outcomes.event_outcomes(events, on_error="ignore")


def test_wire_event(spark):
    text = (
        '{"id":{"eventSeq":"1","txDigest":"test"},"packageId":"0x2","transactionModule":"test","sender":"0x123",'
        '"type":"0x2::test::Event<u64>","parsedJson":{},"bcs":"","timestampMs":"1000"}'
    )
    rows = decode_wire_events(spark.createDataFrame([(text,), ("garbage",)], "value string")).collect()
    assert (rows[0]["event_seq"], rows[0]["type_name"], rows[0]["timestamp_ms"], rows[0]["parsed_json"]) == (1, "Event", 1000, "{}")
    assert rows[0]["_corrupt_record"] is None and rows[1]["_corrupt_record"] == "garbage"
    assert outcomes.event_outcomes(decode_wire_events(spark.createDataFrame([("x",)], "value string"))).first()["reason"] == "record is not decodable"


def test_thin_event(spark):
    row = (
        "DepositEvent",
        LENDING_PACKAGE_ID,
        "lending",
        "0x1234567890abcdef",
        "0xd899cf7d2b5db716bd2cf55599fb0d5ee38a3061e7b6bb6eebf73fa5bc4c81ca::lending::DepositEvent",
        '{"amount":"1000000000"}',
        None,
    )
    event = from_thin(spark.createDataFrame([row], schemas.THIN_EVENT)).first()
    assert (event["type_name"], event["type_module"]) == ("DepositEvent", "lending")
    assert event["sender"].endswith("1234567890abcdef") and len(event["sender"]) == 66


def test_bad_json_lines_stay(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"transaction_digest":"a","event_seq":1}\n{"event_seq":"x"}\nnot json\n')
    rows = read_events(spark, str(tmp_path), format="json").cache()
    assert rows.count() == 3
    assert rows.where(F.col("_corrupt_record").isNotNull()).count() == 2


def _written(events, tmp_path) -> str:
    """As a file, so that the plan isn't folded into literal rows."""
    events.write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def test_payload_is_parsed_in_one_place(spark, make_events, tmp_path):
    from ledgerflow.functions.payload import PAYLOAD
    from ledgerflow.operators.outcomes import event_outcomes, succeeded

    texts = ['{"amount":"5","sender":"x"}', "[1]", "bad", "null", None, '{"a":1,"a":2}']
    events = make_events(*[{"event_seq": i, "parsed_json": t} for i, t in enumerate(texts)])
    decided = event_outcomes(events, keep_payload=True)
    # A file in between, as in the job: what follows has the value and not the text to go on from.
    decided.write.parquet(str(tmp_path / "decided"))
    held = spark.read.schema(decided.schema).parquet(str(tmp_path / "decided"))
    done = enrich.enrich_events(succeeded(held), as_of=5)
    assert "parseJson" not in plan_of(done)
    checked = event_outcomes(read_events(spark, _written(events, tmp_path)), keep_payload=True)
    assert len([line for line in plan_of(checked).splitlines() if "parseJson" in line]) == 1
    plain = enrich.enrich_events(succeeded(event_outcomes(events)), as_of=5)
    assert PAYLOAD not in plain.columns
    assert sorted(done.collect(), key=str) == sorted(plain.collect(), key=str)
