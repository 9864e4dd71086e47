"""Filter rules, their builders and their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow import schemas
from ledgerflow.fixed_values import (
    BORROW_EVENT,
    DEPOSIT_EVENT,
    LENDING_MODULE,
    REPAY_EVENT,
    WITHDRAW_EVENT,
)
from ledgerflow.functions.ids import (
    canonical_id,
    canonical_id_text,
    is_module_name,
    is_module_name_text,
)


@dataclass(frozen=True)
class Rule:
    """Conditions on an event, all of which must hold; an unset part matches anything.

    `event_type` is a bare type name, or a full ``address::module::Name``.
    """

    package: str | None = None
    module: str | None = None
    event_type: str | None = None
    sender: str | None = None
    name: str | None = None

    def label(self) -> str:
        """The name, or else the set parts in words."""
        if self.name:
            return self.name
        parts = ("package", "module", "event_type", "sender")
        words = [f"{part}={getattr(self, part)}" for part in parts if getattr(self, part) is not None]
        return ",".join(words) or "any"


def package_rule(package: str) -> Rule:
    return Rule(package=_checked_id(package, "package id"))


def module_rule(package: str, module: str) -> Rule:
    if not is_module_name_text(module):
        raise ValueError(f"invalid module name: {module}")
    return Rule(package=_checked_id(package, "package id"), module=module)


def event_type_rule(package: str, module: str, event_name: str) -> Rule:
    """One event type of a module, by full name. Parts are taken as they are."""
    return Rule(package=package, module=module, event_type=f"{package}::{module}::{event_name}")


def sender_rule(sender: str) -> Rule:
    return Rule(sender=_checked_id(sender, "sender address"))


def lending_rules(package: str) -> list[Rule]:
    names = (DEPOSIT_EVENT, WITHDRAW_EVENT, BORROW_EVENT, REPAY_EVENT)
    return [event_type_rule(package, LENDING_MODULE, name) for name in names]


def deposit_rule(package: str) -> Rule:
    return event_type_rule(package, LENDING_MODULE, DEPOSIT_EVENT)


def withdraw_rule(package: str) -> Rule:
    return event_type_rule(package, LENDING_MODULE, WITHDRAW_EVENT)


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(rule.label(), *astuple(rule)[:4]) for rule in rules]
    return spark.createDataFrame(rows, schemas.RULES)


def filter_stats(rules: DataFrame) -> DataFrame:
    """One row: number of rules, and of distinct valid packages, modules, types and senders."""
    package = canonical_id("package")
    module = F.when(package.isNotNull() & is_module_name("module"), F.struct(package, F.col("module")))
    return rules.agg(
        F.count("*").alias("total_filters"),
        F.countDistinct(package).alias("package_filters"),
        F.countDistinct(module).alias("module_filters"),
        F.countDistinct("event_type").alias("event_type_filters"),
        F.countDistinct(canonical_id("sender")).alias("sender_filters"),
    )


def _checked_id(value: str, what: str) -> str:
    if canonical_id_text(value) is None:
        raise ValueError(f"invalid {what}: {value}")
    return value
