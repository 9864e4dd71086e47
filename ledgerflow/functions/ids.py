"""Identifiers: canonical hex ids, module names, type names, row ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 64
# With the prefix, one to 64 digits; without it, exactly 64.
_ID_PATTERN = "(0x[0-9a-fA-F]{1,64}|[0-9a-fA-F]{64})"
_MODULE_PATTERN = "([A-Za-z][A-Za-z0-9_]*|_[A-Za-z0-9_]+)"


def canonical_id(value: Column | str) -> Column:
    """``0x`` plus 64 lower-case hex digits, or null when the text is no id.

    Apply it once, when data enters (the readers do). Stored tables hold the
    canonical form, so predicates on them are plain equality and reach Parquet.
    """
    text = _col(value)
    digits = F.lower(F.regexp_replace(text, "^0x", ""))
    return F.when(text.rlike(_whole(_ID_PATTERN)), F.concat(F.lit("0x"), F.lpad(digits, ID_LENGTH, "0")))


def canonical_id_text(value: str | None) -> str | None:
    """`canonical_id` for one driver-side value, such as a rule part."""
    if value is None or not re.fullmatch(_ID_PATTERN, value):
        return None
    return "0x" + value.removeprefix("0x").lower().rjust(ID_LENGTH, "0")


def is_module_name(value: Column | str) -> Column:
    return _col(value).rlike(_whole(_MODULE_PATTERN))


def is_module_name_text(value: str | None) -> bool:
    return value is not None and re.fullmatch(_MODULE_PATTERN, value) is not None


def full_type(address: Column | str, module: Column | str, name: Column | str) -> Column:
    return F.concat_ws("::", _col(address), _col(module), _col(name))


def type_parts(type_text: Column | str) -> tuple[Column, Column, Column]:
    """(address, module, name) of ``address::module::Name<...>``; generics are cut."""
    plain = F.regexp_replace(_col(type_text), "<.*$", "")
    parts = F.split(plain, "::")
    whole = F.size(parts) == 3
    return (
        F.when(whole, canonical_id(F.get(parts, F.lit(0)))),
        F.when(whole, F.get(parts, F.lit(1))),
        F.when(whole, F.get(parts, F.lit(2))),
    )


def type_parts_text(type_text: str) -> tuple[str | None, str, str] | None:
    """`type_parts` for one driver-side value; None unless it has three parts."""
    parts = type_text.split("<", 1)[0].split("::")
    if len(parts) != 3:
        return None
    return canonical_id_text(parts[0]), parts[1], parts[2]


def row_id(*keys: Column | str) -> Column:
    """Deterministic row id, so that a replay produces the same ids."""
    return F.sha2(F.concat_ws(":", *[_col(k).cast("string") for k in keys]), 256)


def _whole(pattern: str) -> str:
    # "$" would also match before a last line break.
    return rf"\A{pattern}\z"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
