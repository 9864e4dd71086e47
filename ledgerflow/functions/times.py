"""Time columns (X4, P2). One `as_of` per run replaces the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.fixed_values import MAX_EPOCH_MS

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def run_time(as_of: datetime | int | None) -> datetime:
    """The run's time: a datetime (naive means UTC), epoch ms, or now."""
    if as_of is None:
        return datetime.now(timezone.utc)
    if isinstance(as_of, int):
        return _EPOCH + timedelta(milliseconds=as_of)
    return as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)


def as_of_column(as_of: datetime | int | None) -> Column:
    micros = (run_time(as_of) - _EPOCH) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def event_time(ms: Column | str, as_of: datetime | int | None) -> Column:
    """Epoch ms as a timestamp; missing or impossible times become `as_of`."""
    value = F.col(ms) if isinstance(ms, str) else ms
    usable = value.between(F.lit(0).cast("bigint"), F.lit(MAX_EPOCH_MS))
    return F.coalesce(F.when(usable, F.timestamp_millis(value)), as_of_column(as_of))
