"""Paged event reads: filters, cursor, limit, direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.fixed_values import PAGE_SIZE
from ledgerflow.functions.ids import canonical_id_text

PAGE_KEY = ["checkpoint_sequence", "transaction_digest", "event_seq"]


@dataclass(frozen=True)
class Cursor:
    """Key of the last event of a page."""

    checkpoint_sequence: int
    transaction_digest: str
    event_seq: int


@dataclass(frozen=True)
class Page:
    data: DataFrame
    next_cursor: Cursor | None
    has_next_page: bool


def query_events(
    events: DataFrame,
    *,
    transaction_digest: str | None = None,
    sender: str | None = None,
    package_id: str | None = None,
    cursor: Cursor | None = None,
    limit: int = PAGE_SIZE,
    descending: bool = False,
    bucket_size: int | None = None,
    window: int | None = None,
) -> Page:
    """One page of events in key order, behind the cursor.

    Keyset paging: a page costs the same wherever it lies. Only `limit` + 1 rows
    ever leave the executors, each task keeping its own best ones.

    A limit alone cannot stop a scan early. With `window`, the page is first
    looked for in that many checkpoints behind the cursor, and the window grows
    fourfold until the page is full or the data ends, so the result is the same
    while the scan stays near the page. On a table written by the sinks, pass its
    `bucket_size` too, so that ascending windows prune partitions.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    matching = select_events(events, transaction_digest=transaction_digest, sender=sender, package_id=package_id)
    rest = behind(matching, cursor, descending)
    rows = None
    if window is not None:
        rows = _search_windows(rest, matching, cursor, limit, descending, bucket_size, window)
    if rows is None:
        rows = _top(rest, limit, descending)
    more = len(rows) > limit
    kept = rows[:limit]
    data = events.sparkSession.createDataFrame(kept, rest.schema)
    last = Cursor(*[kept[-1][name] for name in PAGE_KEY]) if more else None
    return Page(data, last, more)


def page(
    events: DataFrame, cursor: Cursor | None = None, limit: int = PAGE_SIZE, descending: bool = False
) -> DataFrame:
    """The rows of a page as a lazy frame, for use inside a larger query."""
    return behind(events, cursor, descending).orderBy(*_order(descending)).limit(limit)


def select_events(
    events: DataFrame,
    *,
    transaction_digest: str | None = None,
    sender: str | None = None,
    package_id: str | None = None,
) -> DataFrame:
    """All given parts must hold. An id that is none matches nothing."""
    result = events
    if transaction_digest is not None:
        result = result.where(F.col("transaction_digest") == F.lit(transaction_digest))
    for name, value in (("sender", sender), ("package_id", package_id)):
        if value is not None:
            wanted = canonical_id_text(value)
            result = result.where(F.lit(False) if wanted is None else F.col(name) == F.lit(wanted))
    return result


def behind(events: DataFrame, cursor: Cursor | None, descending: bool = False) -> DataFrame:
    """Events after the cursor, or before it when descending."""
    if cursor is None:
        return events
    here = F.struct(*[F.col(name) for name in PAGE_KEY])
    there = F.struct(
        F.lit(cursor.checkpoint_sequence).cast("bigint").alias("checkpoint_sequence"),
        F.lit(cursor.transaction_digest).alias("transaction_digest"),
        F.lit(cursor.event_seq).cast("bigint").alias("event_seq"),
    )
    # The struct comparison decides; the plain one is implied and reaches Parquet.
    first = F.col("checkpoint_sequence")
    if descending:
        return events.where((first <= cursor.checkpoint_sequence) & (here < there))
    return events.where((first >= cursor.checkpoint_sequence) & (here > there))


def _search_windows(rest, matching, cursor, limit, descending, bucket_size, window):
    if window < 1:
        raise ValueError("window must be at least 1")
    first = F.col("checkpoint_sequence")
    ends = matching.agg(F.min(first), F.max(first)).first()
    if ends[0] is None:
        return []
    low, high = ends
    start = cursor.checkpoint_sequence if cursor else (high if descending else low)
    while True:
        edge = start - window if descending else start + window
        inside = first >= edge if descending else first <= edge
        if bucket_size and not descending:
            # A folder may begin before the edge that lies in it, so downwards it is the files' statistics that prune.
            inside = inside & (F.col("checkpoint_bucket") <= edge // bucket_size)
        rows = _top(rest.where(inside), limit, descending)
        if len(rows) > limit or (edge <= low if descending else edge >= high):
            return rows
        window *= 4


def _top(df: DataFrame, limit: int, descending: bool) -> list:
    return df.orderBy(*_order(descending)).limit(limit + 1).collect()


def _order(descending: bool) -> list[Column]:
    return [F.col(name).desc() if descending else F.col(name).asc() for name in PAGE_KEY]
