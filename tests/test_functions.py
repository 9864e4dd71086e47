from __future__ import annotations

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow.functions import ids, payload, times

IDS = {
    "0x2": "0x" + "2".rjust(64, "0"),
    "0xABC": "0x" + "abc".rjust(64, "0"),
    "f" * 64: "0x" + "f" * 64,
    "2": None,
    "0x": None,
    "0xg": None,
    "0x" + "1" * 65: None,
    "": None,
    "0x2\n": None,
    "f" * 64 + "\n": None,
    None: None,
}


def test_ids_agree_on_both_sides(spark):
    rows = spark.createDataFrame([(k,) for k in IDS], "v string").select("v", ids.canonical_id("v").alias("c")).collect()
    assert {r["v"]: r["c"] for r in rows} == IDS
    assert {k: ids.canonical_id_text(k) for k in IDS} == IDS


def test_module_names(spark):
    names = {"coin": True, "_x": True, "a1_": True, "_": False, "1a": False, "": False, "a-b": False, "coin\n": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.is_module_name("n").alias("ok"))
    assert {r["n"]: r["ok"] for r in rows.collect()} == names
    assert {n: ids.is_module_name_text(n) for n in names} == names


def test_type_parts(spark):
    whole = "0x2::coin::Event<0x3::a::B>"
    df = spark.createDataFrame([(whole,), ("bare",)], "t string").select(*ids.type_parts("t"))
    assert tuple(df.collect()[0]) == ("0x" + "2".rjust(64, "0"), "coin", "Event")
    assert tuple(df.collect()[1]) == (None, None, None)
    assert ids.type_parts_text(whole) == ("0x" + "2".rjust(64, "0"), "coin", "Event")
    assert ids.type_parts_text("bare") is None


def test_event_time_falls_back(spark):
    as_of = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(1000,), (None,), (10**17,), (-1,)], "ms bigint")
    got = [r[0] for r in df.select(F.unix_millis(times.event_time("ms", as_of))).collect()]
    assert got == [1000, 1704067200000, 1704067200000, 1704067200000]


@pytest.mark.parametrize(
    "text, field, wanted",
    [
        ('{"amount":"1000000000","coin_type":"0x2::sui::SUI"}', "amount", "1000000000"),
        ('{"amount":"1000000000","coin_type":"0x2::sui::SUI"}', "coin_type", "0x2::sui::SUI"),
        ('{"amount":"1"}', "nonexistent", None),
        ('{"a":18446744073709551615}', "a", "18446744073709551615"),
        ('{"a":7.5}', "a", "7.5"),
        ('{"a":true}', "a", None),
        ('{"a":null}', "a", None),
        ('{"a":{"b":1}}', "a", None),
        ('{"a":[1]}', "a", None),
        ("[1]", "a", None),
        ("broken", "a", None),
        ('{"a b\\"c":"x"}', 'a b"c', "x"),
    ],
)
def test_field_is_text_or_number(spark, text, field, wanted):
    df = spark.createDataFrame([(text,)], "j string").withColumn("m", payload.payload_map("j"))
    row = df.select(payload.json_field("j", field), payload.field_text("m", field)).first()
    assert tuple(row) == (wanted, wanted)


def test_nested_object_and_amount(spark):
    df = spark.createDataFrame([('{"user":{"id":"7"},"n":1}',)], "j string").withColumn("m", payload.payload_map("j"))
    df = df.withColumn("u", payload.object_field("m", "user")).withColumn("n", payload.object_field("m", "n"))
    assert tuple(df.select(payload.field_text("u", "id"), F.col("n").isNull()).first()) == ("7", True)
    amounts = spark.createDataFrame([("18446744073709551615",), ("1.5",), ("x",), ("-1",)], "t string")
    got = [r[0] for r in amounts.select(payload.amount(F.col("t"))).collect()]
    assert [None if v is None else int(v) for v in got] == [18446744073709551615, None, None, None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789abcdefxABCDEFg", max_size=70), min_size=1, max_size=30))
def test_ids_agree_on_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", ids.canonical_id("v").alias("c")).collect()
    assert all(r["c"] == ids.canonical_id_text(r["v"]) for r in rows)


PAYLOADS = {
    '{"a":1}': True, '{"a":[1,{"b":null}]}': True, "[1,2]": True, "null": True, '"t"': True, "7.5": True, '{"k":1,"k":2}': True, '{"a":"]"}': True,
    '{"a":1} x': False, '{"a":1}{"b":2}': False, "1],[2": False, '{"a":1}]': False, "{'k':1}": False, "": False, " ": False, "1 2": False, "1,2": False,
    '{"a":NaN}': False, '{"a":1,}': False, '"abc': False, "]": False, None: False,
    "1e400": False, '{"a":-1E+400}': False, '{"a":1e308}': True, '{"a":"1e400"}': True, '{"q":"1e999\\"","z":2}': True, '{"n":1e400,"t":"1"}': False,
    "1" * 38: True, "1" * 39: False, '{"x":"' + "1" * 50 + '"}': True, '{"x":0.' + "1" * 50 + "}": True,
}


def test_payload_values(spark):
    rows = spark.createDataFrame([(t,) for t in PAYLOADS], "t string")
    found = rows.select("t", payload.is_json("t").alias("ok"), payload.payload_value("t").isNotNull().alias("held")).collect()
    assert {r["t"]: r["ok"] for r in found} == PAYLOADS == {r["t"]: r["held"] for r in found}
