"""Keeping and labelling events by rules.

A handful of rules is compiled into one predicate, evaluated inside the scan and
pushed to Parquet. Many rules become a table that is joined by equality, one join
for each combination of parts that the rules set. Joining on "part equals or part
is unset" in one go would leave Spark only a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.ids import canonical_id, canonical_id_text, type_parts, type_parts_text
from ledgerflow.operators.rules import Rule
from ledgerflow.session import scratch_folder

# Above this many rules the join form is used.
COMPILED_RULES = 100
# Rule tables up to this many characters are broadcast; larger ones are shuffled.
BROADCAST_CHARS = 32 * 1024 * 1024


def filter_events(events: DataFrame, rules: Sequence[Rule] | DataFrame, *, type_match: str = "auto") -> DataFrame:
    """Events that match any rule; all events when there are no rules.

    `type_match` "auto" compares a full type name to the full type and a bare one
    to the bare name; "name" always compares to the bare name.
    """
    _check_type_match(type_match)
    if joins(rules):
        joined, marks = _join_rules(events, *_rule_table(events, rules), type_match, labels=False)
        hit = reduce(or_, [F.col(mark).isNotNull() for mark in marks], F.lit(False))
        return joined.where(hit | no_rules(rules)).drop(*marks)
    if not rules:
        return events
    return events.where(reduce(or_, [rule_predicate(rule, type_match) for rule in rules]))


def joins(rules: Sequence[Rule] | DataFrame) -> bool:
    """Whether rules are joined; results are the same in either form."""
    return isinstance(rules, DataFrame) or len(rules) > COMPILED_RULES


def no_rules(rules: Sequence[Rule] | DataFrame) -> Column:
    """Whether there are no rules at all, in which case every event is kept."""
    if isinstance(rules, DataFrame):
        return rules.agg(F.count("*") == 0).scalar()
    return F.lit(not rules)


def _check_type_match(type_match: str) -> None:
    if type_match not in ("auto", "name"):
        raise ValueError(f"unknown type_match: {type_match}")


def keep_flag(rules: Sequence[Rule], *, type_match: str = "auto") -> Column:
    """Whether any of a few rules matches, never null."""
    _check_type_match(type_match)
    if not rules:
        return F.lit(True)
    return reduce(or_, [_never_null(rule_predicate(rule, type_match)) for rule in rules])


def rule_predicate(rule: Rule, type_match: str = "auto") -> Column:
    """One rule as a condition on raw columns; null columns make it null, not true."""
    tests = [_test(column, value) for column, value in _conditions(rule, type_match)]
    return reduce(and_, tests) if tests else F.lit(True)


def match_rules(events: DataFrame, rules: Sequence[Rule] | DataFrame, *, type_match: str = "auto") -> DataFrame:
    """Add `matched_filters`, the labels of the rules that match, in rule order.

    Rules given as a frame have no order; their labels come sorted.
    """
    _check_type_match(type_match)
    if joins(rules):
        joined, marks = _join_rules(events, *_rule_table(events, rules), type_match, labels=True)
        none = F.array().cast("array<struct<number:bigint,name:string>>")
        every = F.concat(none, *[F.coalesce(F.col(mark), none) for mark in marks])
        names = F.transform(F.array_sort(every), lambda e: e["name"])
        return joined.withColumn("matched_filters", F.array_distinct(names)).drop(*marks)
    labels = [F.when(_never_null(rule_predicate(r, type_match)), F.lit(r.label())) for r in rules]
    empty = F.array().cast("array<string>")
    matched = F.array_distinct(F.array_compact(F.array(*labels))) if labels else empty
    return events.withColumn("matched_filters", matched)


def _conditions(rule: Rule, type_match: str) -> list[tuple[str, str | None]]:
    """(column, wanted value) of each set part; a value of None can never match."""
    result: list[tuple[str, str | None]] = []
    if rule.package is not None:
        result.append(("package_id", canonical_id_text(rule.package)))
    if rule.module is not None:
        result.append(("transaction_module", rule.module))
    if rule.event_type is not None:
        result += _type_conditions(rule.event_type, type_match)
    if rule.sender is not None:
        result.append(("sender", canonical_id_text(rule.sender)))
    return result


def _type_conditions(event_type: str, type_match: str) -> list[tuple[str, str | None]]:
    _check_type_match(type_match)
    if type_match == "name" or "::" not in event_type:
        return [("type_name", event_type)]
    parts = type_parts_text(event_type)
    if parts is None:
        return [("type_name", None)]
    return list(zip(("type_address", "type_module", "type_name"), parts))


def _test(column: str, value: str | None) -> Column:
    return F.lit(False) if value is None else F.col(column) == F.lit(value)


def _never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _parts(rule: Rule) -> tuple[str | None, ...]:
    return rule.package, rule.module, rule.event_type, rule.sender


# --- join form -------------------------------------------------------------

_JOIN_COLUMNS = ["package_id", "transaction_module", "type_address", "type_module", "type_name", "sender"]


def _rule_table(events: DataFrame, rules: Sequence[Rule] | DataFrame) -> tuple[DataFrame, bool]:
    """Rules as a numbered frame, and whether it is known to be small."""
    if isinstance(rules, DataFrame):
        return rules.withColumn("number", F.lit(0).cast("bigint")), False
    rows = [(rule.label(), *_parts(rule), number) for number, rule in enumerate(rules)]
    schema = "name string, package string, module string, event_type string, sender string, number bigint"
    chars = sum(len(text) for row in rows for text in row if isinstance(text, str))
    return events.sparkSession.createDataFrame(rows, schema), chars <= BROADCAST_CHARS


def _rule_keys(rules: DataFrame, type_match: str) -> DataFrame:
    """Rules with the event columns they fix, and `shape`, a bit for each fixed column."""
    qualified = F.col("event_type").contains("::") if type_match == "auto" else F.lit(False)
    address, module, name = type_parts("event_type")
    wanted = {
        "package_id": canonical_id("package"),
        "transaction_module": F.col("module"),
        "type_address": F.when(qualified, address),
        "type_module": F.when(qualified, module),
        "type_name": F.when(qualified, name).otherwise(F.col("event_type")),
        "sender": canonical_id("sender"),
    }
    given = {
        "package_id": F.col("package").isNotNull(),
        "transaction_module": F.col("module").isNotNull(),
        "type_address": F.coalesce(qualified, F.lit(False)),
        "type_module": F.coalesce(qualified, F.lit(False)),
        "type_name": F.col("event_type").isNotNull(),
        "sender": F.col("sender").isNotNull(),
    }
    bits = [F.when(given[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(_JOIN_COLUMNS)]
    usable = reduce(and_, [~given[c] | wanted[c].isNotNull() for c in _JOIN_COLUMNS])
    # A null shape marks a rule that can never match. Filtering here would let Spark
    # move the parsing of ids below whatever the rules are derived by.
    shape = F.when(usable, reduce(lambda a, b: a + b, bits))
    columns = [wanted[c].alias(f"rule_{c}") for c in _JOIN_COLUMNS]
    return rules.select("name", "number", shape.alias("shape"), *columns)


def _join_rules(
    events: DataFrame, rules: DataFrame, small: bool, type_match: str, labels: bool
) -> tuple[DataFrame, list[str]]:
    """Events with one column per shape: the labels that match (or a mark), else null."""
    keys = _rule_keys(rules, type_match)
    if not small:
        # Written once, by shape: every join below reads just its part, and the size
        # of that part tells Spark whether it may be broadcast.
        folder = scratch_folder(events.sparkSession, "rules")
        keys.hint("rebalance", "shape").write.partitionBy("shape").parquet(folder)
        keys = events.sparkSession.read.schema(keys.schema).parquet(folder)
    # At most one row for each combination of the parts, whatever the number of rules.
    shapes = sorted(row["shape"] for row in keys.select("shape").distinct().collect() if row["shape"] is not None)
    found = F.collect_set(F.struct("number", "name")) if labels else F.first(F.lit(True))
    result, marks = events, []
    for shape in shapes:
        mark = f"matched_{shape}"
        columns = [c for i, c in enumerate(_JOIN_COLUMNS) if shape >> i & 1]
        # One row per distinct key, so that the join never multiplies events.
        keyed = keys.where(F.col("shape") == shape).groupBy(*[f"rule_{c}" for c in columns]).agg(found.alias(mark))
        if columns:
            on = [F.col(c) == F.col(f"rule_{c}") for c in columns]
            side = F.broadcast(keyed) if small else keyed
            result = result.join(side, on, "left").drop(*[f"rule_{c}" for c in columns])
        else:
            result = result.withColumn(mark, keyed.select(mark).scalar())
        marks.append(mark)
    return result, marks
