from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plans_of import plan_of
from ledgerflow.fixed_values import LENDING_PACKAGE_ID, LENDING_TYPE_ADDRESS
from ledgerflow.operators import filters, rules
from ledgerflow.operators.rules import Rule
from ledgerflow.sources.readers import read_events


def test_builders():
    assert rules.package_rule("0x2") == Rule(package="0x2")
    assert rules.module_rule("0x2", "coin") == Rule(package="0x2", module="coin")
    assert len(rules.lending_rules("0xabc123")) == 4
    assert "DepositEvent" in rules.deposit_rule("0xabc123").event_type
    assert "WithdrawEvent" in rules.withdraw_rule("0xabc123").event_type
    assert rules.sender_rule("0x1").package is None


@pytest.mark.parametrize(
    "build", [lambda: rules.package_rule("zz"), lambda: rules.module_rule("0x2", "1x"), lambda: rules.sender_rule("no")]
)
def test_builders_refuse_bad_values(build):
    with pytest.raises(ValueError):
        build()


def test_event_type_builder_takes_anything():
    assert rules.event_type_rule("not an id", "1x", "E").event_type == "not an id::1x::E"


def test_filter_stats(spark):
    given = [
        Rule(package="0x2", module="coin"),
        Rule(package="0x02", module="coin"),
        Rule(package="0x2", module="1bad"),
        Rule(package="bad", module="coin"),
        Rule(event_type="A"),
        Rule(event_type="A", sender="0x1"),
        Rule(sender="bad"),
    ]
    row = rules.filter_stats(rules.rules_frame(spark, given)).first()
    assert tuple(row) == (7, 1, 1, 1, 1)


def matching(make_events, event: dict, rule: Rule, **options) -> bool:
    return filters.filter_events(make_events(event), [rule], **options).count() == 1


def test_no_rules_keep_all(make_events):
    assert filters.filter_events(make_events({}, {}), []).count() == 2


def test_parts_must_all_hold(make_events):
    event = {"package_id": "0x2", "transaction_module": "coin", "type_name": "Transfer", "sender": "0x123"}
    assert matching(make_events, event, Rule())
    assert matching(make_events, event, Rule(package="0x0002", module="coin", event_type="Transfer", sender="0x123"))
    for wrong in (Rule(package="0x3"), Rule(module="Coin"), Rule(event_type="transfer"), Rule(sender="0x1")):
        assert not matching(make_events, event, wrong)


def test_unparseable_rule_never_matches(make_events):
    assert not matching(make_events, {}, Rule(package="no id"))
    assert not matching(make_events, {"sender": None}, Rule(sender="no id"))


def test_module_is_the_emitting_one(make_events):
    event = {"transaction_module": "outer", "type_module": "inner"}
    assert matching(make_events, event, Rule(module="outer"))
    assert not matching(make_events, event, Rule(module="inner"))


def test_full_type_rule(make_events):
    event = {
        "package_id": LENDING_PACKAGE_ID,
        "transaction_module": "lending",
        "type_address": LENDING_TYPE_ADDRESS,
        "type_module": "lending",
        "type_name": "DepositEvent",
    }
    rule = Rule(LENDING_PACKAGE_ID, "lending", f"{LENDING_TYPE_ADDRESS}::lending::DepositEvent")
    assert matching(make_events, event, rule)
    # Compared to the bare name, a full type can never be equal.
    assert not matching(make_events, event, rule, type_match="name")
    assert matching(make_events, event, Rule(event_type="DepositEvent"), type_match="name")


def test_null_columns_are_no_match(make_events):
    labelled = filters.match_rules(make_events({"sender": None}), [Rule(sender="0x1"), Rule(package="0x2")])
    assert labelled.first()["matched_filters"] == ["package=0x2"]


def many_rules() -> list[Rule]:
    fill = [Rule(sender=hex(n)) for n in range(1000, 1150)]
    return [
        Rule(event_type="Transfer", name="by name"),
        *fill,
        Rule(package="0x2", module="coin"),
        Rule(event_type="0x2::coin::Transfer"),
        Rule(package="0x2", sender="0x123"),
        Rule(package="bad"),
        Rule(event_type="a::b"),
        Rule(name="everything"),
    ]


@pytest.mark.parametrize("event", [{}, {"sender": "0x3e9"}, {"type_name": "Other"}, {"package_id": "0x9", "sender": None}])
def test_join_form_equals_compiled_form(make_events, monkeypatch, event):
    events = make_events(event)
    joined = filters.match_rules(events, many_rules()).first()["matched_filters"]
    kept = filters.filter_events(events, many_rules()[:-1]).count()
    monkeypatch.setattr(filters, "COMPILED_RULES", 10_000)
    assert joined == filters.match_rules(events, many_rules()).first()["matched_filters"]
    assert kept == filters.filter_events(events, many_rules()[:-1]).count()


def test_rules_as_a_frame(spark, make_events):
    frame = rules.rules_frame(spark, many_rules())
    got = filters.match_rules(make_events({}), frame).first()["matched_filters"]
    assert got == sorted(["by name", "package=0x2,module=coin", "event_type=0x2::coin::Transfer", "package=0x2,sender=0x123", "everything"])


def test_few_rules_reach_parquet(spark, make_events, tmp_path):
    make_events({}).write.parquet(str(tmp_path / "e"))
    stored = read_events(spark, str(tmp_path / "e"), canonical=True)
    plan = plan_of(filters.filter_events(stored, [Rule(module="coin"), Rule(event_type="A")]).select("type_name"))
    pushed = plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "EqualTo(transaction_module,coin)" in pushed and "EqualTo(type_name,A)" in pushed
    assert "parsed_json" not in plan.split("ReadSchema")[1]


def test_many_rules_join_by_equality(make_events):
    plan = plan_of(filters.match_rules(make_events({}), many_rules()))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
