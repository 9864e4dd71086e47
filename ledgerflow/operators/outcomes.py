"""What becomes of each record: success, filtered or skipped, error.

Bad records never stop a run unless it is strict, and are never lost: they carry
a reason and go to quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas
from ledgerflow.functions.payload import PAYLOAD, payload_value
from ledgerflow.functions.times import as_of_column
from ledgerflow.operators.filters import joins, keep_flag, match_rules, no_rules
from ledgerflow.operators.rules import Rule

SUCCESS, FILTERED, SKIPPED, ERROR = "success", "filtered", "skipped", "error"


def event_outcomes(
    events: DataFrame,
    rules: Sequence[Rule] | DataFrame = (),
    *,
    on_error: str = "quarantine",
    type_match: str = "auto",
    payload_required: bool = True,
    label_rules: bool = False,
    keep_payload: bool = False,
) -> DataFrame:
    """Add `outcome` and `reason` to events.

    An event without usable keys or ids is an error whatever the rules say. One
    that no rule wants is filtered, and its payload is not looked at. With
    `on_error="raise"` the first error fails the job. With `label_rules` the labels of
    the matching rules are added as `matched_filters`, however many rules there are. With
    `keep_payload` the value of each payload that was looked at stays as a column of its own,
    from which the enrichment goes on without parsing it again.
    """
    joined = joins(rules)
    frame = match_rules(events, rules, type_match=type_match) if joined or label_rules else events
    if joined:
        wanted = (F.size("matched_filters") > 0) | no_rules(rules)
    else:
        wanted = keep_flag(rules, type_match=type_match)
    envelope = _first_reason(_envelope_problems(events))
    # Computed before it is used, so that it is parsed once; not at all where nobody asks for it.
    asked = envelope.isNull() & wanted & F.lit(payload_required or keep_payload)
    frame = frame.withColumn(PAYLOAD, F.when(asked, payload_value("parsed_json")))
    unreadable = F.col("parsed_json").isNotNull() & F.col(PAYLOAD).isNull()
    payload = F.when(F.lit(payload_required) & unreadable, F.lit("payload is not JSON"))
    outcome = (
        F.when(envelope.isNotNull(), F.lit(ERROR))
        .when(~wanted, F.lit(FILTERED))
        .when(payload.isNotNull(), F.lit(ERROR))
        .otherwise(F.lit(SUCCESS))
    )
    reason = F.when(envelope.isNotNull(), envelope).when(~wanted, F.lit("no rule matched")).otherwise(payload)
    result = _strict(frame.withColumns({"outcome": outcome, "reason": reason}), on_error)
    extra = set() if label_rules else {"matched_filters"}
    return result.drop(*((extra | (set() if keep_payload else {PAYLOAD})) - set(events.columns)))


def transaction_outcomes(transactions: DataFrame, *, on_error: str = "quarantine") -> DataFrame:
    """Add `outcome` and `reason`: no digest is an error, no effects is skipped.

    Skipped transactions are only marked; they still project to a failed one.
    """
    no_digest = F.col("digest").isNull()
    no_effects = F.col("effects").isNull()
    outcome = F.when(no_digest, ERROR).when(no_effects, SKIPPED).otherwise(SUCCESS)
    reason = F.when(no_digest, "digest is missing").when(no_effects, "effects are missing")
    return _strict(transactions.withColumns({"outcome": outcome, "reason": reason}), on_error)


def succeeded(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == SUCCESS).drop("outcome", "reason")


def quarantine(outcomes: DataFrame, as_of: datetime | int | None = None) -> DataFrame:
    """Error records as rows of the quarantine table, with an id made from their content."""
    skip = {"outcome", "reason", "matched_filters", PAYLOAD}
    parts = [_json_safe(field) for field in outcomes.schema if field.name not in skip]
    record = F.to_json(F.struct(*parts))
    bad = outcomes.where(F.col("outcome") == ERROR)
    return bad.select(
        F.sha2(F.concat_ws(":", "reason", record), 256).alias("record_id"),
        F.col("reason"),
        record.alias("record"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        as_of_column(as_of).alias("quarantined_at"),
    ).select(*schemas.QUARANTINE.fieldNames())


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def batch_counts(outcomes: DataFrame) -> DataFrame:
    """One row: records in, left after the filter, and out."""
    return outcomes.agg(
        F.count("*").alias("records_in"),
        F.count_if(F.col("outcome") != FILTERED).alias("after_filter"),
        F.count_if(F.col("outcome") == SUCCESS).alias("records_out"),
        F.count_if(F.col("outcome") == ERROR).alias("errors"),
    )


def _envelope_problems(events: DataFrame) -> list[tuple[Column, str]]:
    problems = []
    if "_corrupt_record" in events.columns:
        problems.append((F.col("_corrupt_record").isNotNull(), "record is not decodable"))
    problems.append((F.col("transaction_digest").isNull() | F.col("event_seq").isNull(), "key is missing"))
    problems.append((F.col("package_id").isNull(), "package id is invalid"))
    problems.append((F.col("sender").isNull(), "sender is invalid"))
    return problems


def _first_reason(problems: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(problem, F.lit(reason)) for problem, reason in problems])


def _strict(outcomes: DataFrame, on_error: str) -> DataFrame:
    if on_error == "quarantine":
        return outcomes
    if on_error != "raise":
        raise ValueError(f"unknown on_error: {on_error}")
    failed = F.col("outcome") == ERROR
    message = F.concat(F.lit("bad record: "), F.col("reason"))
    checked = F.when(failed, F.raise_error(message).cast("string")).otherwise(F.col("outcome"))
    return outcomes.withColumn("outcome", checked)


def _json_safe(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(field.name).alias(field.name)
    return F.col(field.name)
