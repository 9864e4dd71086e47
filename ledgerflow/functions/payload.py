"""JSON payload columns (P3, P16, X6), built on VARIANT so that types survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_MAP = "map<string,variant>"
#: The column that carries a payload's value from its one parse to all that use it.
PAYLOAD = "_payload"


def payload_map(payload: Column | str) -> Column:
    """Top-level keys of a JSON object; null for anything else.

    Put it in a column of its own before reading several keys, so that the text
    is parsed once per row.
    """
    return F.from_json(_col(payload), PAYLOAD_MAP)


def unique_keys(entries: Column) -> Column:
    """The map with repeated keys removed, the last value winning.

    JSON text may repeat a key and `from_json` keeps both, on which `map_concat`
    would fail the job. Ordinary objects take the first branch.
    """
    keys = F.map_keys(entries)
    distinct = F.array_distinct(keys)

    def last_value(key: Column) -> Column:
        same = F.filter(F.map_entries(entries), lambda e: e["key"] == key)
        return F.element_at(same, -1)["value"]

    rebuilt = F.map_from_arrays(distinct, F.transform(distinct, last_value))
    return F.when(F.size(keys) == F.size(distinct), entries).otherwise(rebuilt)


def without_keys(payload: Column | str, keys: Column) -> Column:
    """The JSON text of an object less some keys, repeated keys resolved."""
    entries = unique_keys(payload_map(payload))
    return F.to_json(F.map_filter(entries, lambda key, _: ~F.array_contains(keys, key)))


def joined_objects(first: str, second: str) -> Column:
    """One JSON object text with the members of two, which must not share a key.

    Takes column names, because each text is used more than once.
    """
    head, tail = F.col(first), F.col(second)
    body = F.substr(head, F.lit(1), F.length(head) - 1)
    both = F.concat(body, F.lit(","), F.substr(tail, F.lit(2)))
    return F.when(head == "{}", tail).when(tail == "{}", head).otherwise(both)


def payload_value(payload: Column | str) -> Column:
    """The text's JSON value as VARIANT; null unless the text is one JSON value and nothing else.

    The parser stops behind the first value, so the text is parsed as the only member of a
    list, which only a "]" in the text could close early; texts with one are parsed as a
    member of an object as well, and text that closes the one early is no text for the other.
    All others are parsed once. Numbers beyond a double's range and whole numbers of more
    than 38 digits are errors, as no value could hold them; so is what the parser takes for no
    JSON, such as NaN and a comma behind the last member.
    """
    text = _col(payload)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    value = F.try_variant_get(listed, "$[0]", "variant")
    one = value.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    whole = ~text.contains("]") | F.try_variant_get(held, "$.v", "variant").isNotNull()
    return F.when(one & whole & ~_out_of_range(text), value)


def is_json(payload: Column | str) -> Column:
    """Whether the text has a `payload_value`."""
    return payload_value(payload).isNotNull()


_LONG = "[0-9](?:[eE][+]?[0-9]{3}|[0-9]{38})"
_STRINGS = r'"(?:[^"\\]|\\.)*+"'


def _out_of_range(text: Column) -> Column:
    """Whether JSON text has a number that is too large; most texts show at a glance that they have none."""
    numbers = F.regexp_replace(text, F.lit(_STRINGS), F.lit('""'))
    powers = F.regexp_extract_all(numbers, F.lit("-?[0-9][0-9.]*[eE][+]?[0-9]{3,}"), F.lit(0))
    infinite = F.exists(powers, lambda x: F.abs(x.try_cast("double")) == float("inf"))
    wide = numbers.rlike(r"(^|[^0-9.eE+-])-?[0-9]{39,}($|[^0-9.eE])")
    return F.when(text.rlike(_LONG), infinite | wide).otherwise(F.lit(False))


def variant_text(value: Column) -> Column:
    """Text of a variant that is a string or a number, else null."""
    kind = F.schema_of_variant(value)
    scalar = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(scalar, F.try_variant_get(value, "$", "string"))


def field_text(entries: Column | str, field: str) -> Column:
    """`variant_text` of one key of a payload map column."""
    return variant_text(F.element_at(_col(entries), field))


def json_field(payload: Column | str, field: str) -> Column:
    """Top-level field as text, straight from the JSON text; for a single field."""
    same = F.filter(F.map_entries(payload_map(payload)), lambda e: e["key"] == field)
    return variant_text(F.try_element_at(same, F.lit(-1))["value"])


def object_field(entries: Column | str, field: str) -> Column:
    """A nested object as a payload map of its own; null if it is no object."""
    return F.element_at(_col(entries), field).try_cast(PAYLOAD_MAP)


def amount(text: Column) -> Column:
    """Unsigned 64-bit amounts do not fit BIGINT; null when the text is no whole number."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(38,0)"))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
