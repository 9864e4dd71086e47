"""Enrichment of events (P1-P15, P19): envelope, fields, tags, profiles.

All of it is a narrow stage of built-in expressions: nothing is shuffled and nothing
leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import fixed_values as fixed
from ledgerflow.functions.ids import full_type, row_id
from ledgerflow.functions.payload import PAYLOAD, joined_objects, without_keys
from ledgerflow.functions.times import as_of_column, event_time, run_time
from ledgerflow.schemas import EVENT_KEY, EVENT_METADATA

_TEXT, _KEYS, _DOC, _AMOUNT, _USER = "_text", "_keys", "_doc", "_amount", "_user"
_ADDED, _NAMES = "_added", "_names"
AsOf = datetime | int | None


def in_protocol(prefixes: Sequence[str] = fixed.PREFIX_PROTOCOL_IDS) -> Column:
    """Whether the package id starts with one of the protocol's ids."""
    return reduce(or_, [F.col("package_id").startswith(p) for p in prefixes], F.lit(False))


def mentions_protocol(part: str = fixed.CONTAINED_PROTOCOL_ID) -> Column:
    """Whether the package id contains the protocol's id."""
    return F.col("package_id").contains(part)


def action_label() -> Column:
    """Action of an exactly named event, else null."""
    pairs = [F.when(F.col("type_name") == name, F.lit(action)) for name, action in fixed.ACTION_BY_EVENT.items()]
    return F.coalesce(*pairs)


def event_class(name: Column | str = "type_name") -> Column:
    """Class by a part of the type name; the first that occurs decides."""
    text = F.col(name) if isinstance(name, str) else name
    hits = [F.when(text.contains(part), F.lit(label)) for part, label in fixed.CLASS_BY_NAME_PART]
    return F.coalesce(*hits, F.lit(fixed.OTHER_CLASS))


def event_tags(prefixes: Sequence[str] = fixed.PREFIX_PROTOCOL_IDS) -> Column:
    """Protocol tags, then the action for any package, then the type's module."""
    member = in_protocol(prefixes)
    protocol = [F.when(member, F.lit(tag)) for tag in fixed.PROTOCOL_TAGS]
    return F.array_compact(F.array(*protocol, action_label(), F.col("type_module")))


def with_fields(
    events: DataFrame,
    *,
    include_raw: bool = True,
    custom_fields: bool = True,
    prefixes: Sequence[str] = fixed.PREFIX_PROTOCOL_IDS,
) -> DataFrame:
    """Add `fields`: payload keys, overwritten by envelope keys and protocol keys, as JSON.

    Payloads that are no objects add nothing. Most payloads share no key with what
    is added and repeat none, so their text is used as it is; only others are taken
    apart. A payload is parsed into values for known protocol actions alone.
    """
    known = in_protocol(prefixes) & action_label().isNotNull()
    parsed = events.withColumns(
        {_TEXT: F.get_json_object("parsed_json", "$"), _KEYS: F.json_object_keys("parsed_json")}
    )
    members = _envelope_members(include_raw)
    if custom_fields:
        doc = F.when(known & F.col(_KEYS).isNotNull(), _value(events))
        parsed = parsed.withColumn(_DOC, doc).withColumns(
            {
                _AMOUNT: F.try_variant_get(_DOC, "$.amount", "variant"),
                _USER: F.try_variant_get(_DOC, "$.user", "variant"),
            }
        )
        members |= _protocol_members(prefixes)
    added = {name: value.alias(name) for name, value in members.items()}
    names = [F.when(value.isNotNull(), F.lit(name)) for name, value in members.items()]
    both = parsed.withColumns({_ADDED: F.to_json(F.struct(*added.values())), _NAMES: F.array_compact(F.array(*names))})
    keys, mine = F.col(_KEYS), F.col(_NAMES)
    # Nothing is taken away when no key is among the names and none repeats.
    plain = F.size(F.array_except(keys, mine)) == F.size(keys)
    own = (
        F.when(keys.isNull(), F.lit("{}"))
        .when(plain, F.col(_TEXT))
        .otherwise(F.coalesce(without_keys("parsed_json", mine), F.col(_TEXT)))
    )
    return (
        both.withColumn(_TEXT, own)
        .withColumn("fields", joined_objects(_TEXT, _ADDED))
        .drop(_TEXT, _KEYS, _DOC, _AMOUNT, _USER, _ADDED, _NAMES)
    )


def _envelope_members(include_raw: bool) -> dict[str, Column]:
    members = {
        "package_id": F.col("package_id"),
        "module": F.col("type_module"),
        "event_type": F.col("type_name"),
        "sender": F.col("sender"),
        "transaction_digest": F.col("transaction_digest"),
        "event_sequence": F.col("event_seq"),
        "timestamp_ms": F.col("timestamp_ms"),
    }
    if include_raw:
        members["bcs_data"] = F.when(F.length("bcs") > 0, F.base64("bcs"))
    return members


def _protocol_members(prefixes: Sequence[str]) -> dict[str, Column]:
    """Action fields copy payload values of any type; `asset_id` and `pool_id` keep
    their names, so the payload's own keys serve for them."""
    member = in_protocol(prefixes)
    action = action_label()
    members = {
        "protocol": F.when(member, F.lit(fixed.PROTOCOL_LABEL)),
        "action": F.when(member, F.coalesce(action, F.lit(fixed.UNKNOWN_ACTION))),
    }
    for label in fixed.ACTION_BY_EVENT.values():
        members[f"{label}_amount"] = F.when(action == label, F.col(_AMOUNT))
    members["user_address"] = F.col(_USER)
    members["success"] = F.when(F.col(_DOC).isNotNull(), F.lit(True))
    return members


def _value(events: DataFrame) -> Column:
    """The payload's value, as the outcomes have left it or else parsed here."""
    return F.col(PAYLOAD) if PAYLOAD in events.columns else F.try_parse_json("parsed_json")


def source_event(value: Column | None = None) -> Column:
    """The event as it came, as JSON text with the wire's names; `value` is its payload if that is parsed already."""
    key = F.struct(
        F.col("transaction_digest").alias("txDigest"), F.col("event_seq").cast("string").alias("eventSeq")
    )
    envelope = F.to_json(
        F.struct(
            key.alias("id"),
            F.col("package_id").alias("packageId"),
            F.col("transaction_module").alias("transactionModule"),
            F.col("sender"),
            full_type("type_address", "type_module", "type_name").alias("type"),
            F.base64("bcs").alias("bcs"),
            F.col("timestamp_ms").cast("string").alias("timestampMs"),
        )
    )
    # Through the parsed value: the text itself may be a bare string or end in something else.
    value = F.try_parse_json("parsed_json") if value is None else value
    payload = F.coalesce(F.to_json(value), F.lit("null"))
    # The envelope is never empty, so it can simply follow the payload.
    return F.concat(F.lit('{"parsedJson":'), payload, F.lit(","), F.substr(envelope, F.lit(2)))


def enrich_events(
    events: DataFrame,
    *,
    as_of: AsOf = None,
    extra_tags: Sequence[str] = (),
    prefixes: Sequence[str] = fixed.PREFIX_PROTOCOL_IDS,
    include_raw: bool = True,
    custom_fields: bool = True,
    extract_fields: bool = True,
    add_metadata: bool = True,
    include_source: bool = True,
) -> DataFrame:
    """Processed events of the transformer: full envelope, fields and tags.

    Switches turn off the raw bytes, the protocol fields, the fields, the metadata
    and the source copy; a column that is off is null, so the schema never changes.
    """
    as_of = run_time(as_of)
    if extract_fields:
        events = with_fields(events, include_raw=include_raw, custom_fields=custom_fields, prefixes=prefixes)
    tags = F.concat(event_tags(prefixes), F.array(*[F.lit(t) for t in extra_tags]).cast("array<string>"))
    return _processed(
        events,
        as_of,
        timestamp=event_time("timestamp_ms", as_of),
        fields=F.col("fields") if extract_fields else F.lit(None).cast("string"),
        event_index=F.col("event_seq"),
        matched=_matched(events),
        tags=tags,
        add_metadata=add_metadata,
        include_source=include_source,
    )


#: Processors with this mark go on from the payload that the outcomes have parsed.
enrich_events.takes_payload = True


def enrich_lending_events(events: DataFrame, **options) -> DataFrame:
    """`enrich_events` with the lending protocol's extra tags."""
    return enrich_events(events, extra_tags=fixed.EXTRA_TAGS, **options)


enrich_lending_events.takes_payload = True


def enrich_default(events: DataFrame, *, as_of: AsOf = None, part: str = fixed.CONTAINED_PROTOCOL_ID) -> DataFrame:
    """Default profile: type and payload as fields; labels for the protocol's events only."""
    member = mentions_protocol(part)
    fields = F.to_json(
        F.struct(F.col("type_name").alias("type"), F.try_parse_json("parsed_json").alias("parsed_json"))
    )
    return _simple_processed(
        events,
        as_of,
        fields,
        matched=_when_texts(member, [fixed.MATCHED_PROTOCOL_LABEL]),
        tags=_when_texts(member, fixed.DEFAULT_PROFILE_TAGS),
    )


def enrich_simple(events: DataFrame, *, as_of: AsOf = None) -> DataFrame:
    """Simple profile: the payload as it is, one tag."""
    return _simple_processed(
        events, as_of, F.col("parsed_json"), matched=_texts(()), tags=_texts(fixed.SIMPLE_PROFILE_TAGS)
    )


def enrich_defi(events: DataFrame, *, as_of: AsOf = None, part: str = fixed.CONTAINED_PROTOCOL_ID) -> DataFrame:
    """DeFi profile: the payload as it is, tags by membership in the protocol."""
    member = mentions_protocol(part)
    return _simple_processed(
        events,
        as_of,
        F.col("parsed_json"),
        matched=_when_texts(member, [fixed.MATCHED_PROTOCOL_LABEL]),
        tags=_when_texts(member, fixed.DEFI_PROFILE_TAGS, fixed.DEFI_PROFILE_OTHER_TAGS),
    )


def event_rows(events: DataFrame, *, as_of: AsOf = None, **field_options) -> DataFrame:
    """Flat event rows with number, time in ms and raw bytes, straight from the source events."""
    return with_fields(events, **field_options).select(
        row_id(*EVENT_KEY).alias("id"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        "transaction_digest",
        F.col("event_seq").alias("event_sequence"),
        F.col("type_name").alias("event_type"),
        "package_id",
        F.col("type_module").alias("module_name"),
        "sender",
        "timestamp_ms",
        "bcs",
        "fields",
        as_of_column(as_of).alias("created_at"),
    )


PROFILES = {
    "full": enrich_events,
    "lending": enrich_lending_events,
    "default": enrich_default,
    "simple": enrich_simple,
    "defi": enrich_defi,
}


def _simple_processed(events: DataFrame, as_of: AsOf, fields: Column, matched: Column, tags: Column) -> DataFrame:
    # These profiles stamp events with the run's time and do not number them.
    as_of = run_time(as_of)
    return _processed(
        events,
        as_of,
        timestamp=as_of_column(as_of),
        fields=fields,
        event_index=F.lit(0).cast("bigint"),
        matched=matched,
        tags=tags,
    )


def _processed(
    events: DataFrame,
    as_of: AsOf,
    *,
    timestamp: Column,
    fields: Column,
    event_index: Column,
    matched: Column,
    tags: Column,
    add_metadata: bool = True,
    include_source: bool = True,
) -> DataFrame:
    now = as_of_column(as_of)
    metadata = F.struct(
        now.alias("processed_at"),
        F.lit(None).cast("bigint").alias("processing_duration_ms"),
        event_index.alias("event_index"),
        matched.alias("matched_filters"),
        tags.alias("tags"),
    )
    return events.select(
        row_id(*EVENT_KEY).alias("id"),
        (source_event(_value(events)) if include_source else F.lit(None).cast("string")).alias("event_data"),
        F.col("transaction_digest"),
        F.col("event_seq"),
        F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        timestamp.alias("timestamp"),
        F.col("package_id"),
        F.col("type_module").alias("module_name"),
        F.col("type_name").alias("event_type"),
        F.col("sender"),
        fields.alias("fields"),
        (metadata if add_metadata else F.lit(None).cast(EVENT_METADATA)).alias("metadata"),
        now.alias("processed_at"),
        now.alias("created_at"),
    )


def _matched(events: DataFrame) -> Column:
    return F.col("matched_filters") if "matched_filters" in events.columns else _texts(())


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _when_texts(condition: Column, values: Sequence[str], otherwise: Sequence[str] = ()) -> Column:
    return F.when(condition, _texts(values)).otherwise(_texts(otherwise))
