"""User extensions: protocol handlers and custom row logic.

A processor is any function from a frame of events to a frame, used with
`DataFrame.transform`; written with Spark columns it stays inside the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions.ids import canonical_id_text

Processor = Callable[[DataFrame], DataFrame]


def route_columns(handlers: Mapping[str, Column], otherwise: Column, column: str = "package_id") -> Column:
    """The handler column of the event's protocol, in one pass over the events."""
    result = None
    for package, value in handlers.items():
        hit = F.col(column) == F.lit(_known_id(package))
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return otherwise if result is None else result.otherwise(otherwise)


def route_frames(
    events: DataFrame, handlers: Mapping[str, Processor], otherwise: Processor | None = None, column: str = "package_id"
) -> DataFrame:
    """Each protocol's events through its own processor, put together again.

    This reads the events once per handler; where the handlers differ only in
    expressions, `route_columns` reads them once. Events of no known protocol go
    through `otherwise`, or are left out without one.
    """
    ids = {_known_id(package): handler for package, handler in handlers.items()}
    parts = [handler(events.where(F.col(column) == F.lit(package))) for package, handler in ids.items()]
    if otherwise is not None:
        known = F.coalesce(F.col(column).isin(*ids), F.lit(False)) if ids else F.lit(False)
        parts.append(otherwise(events.where(~known)))
    if not parts:
        raise ValueError("no handler given")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def pandas_processor(
    function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, columns: list[str] | None = None
) -> Processor:
    """A processor from a function on pandas batches, for logic Spark columns cannot express.

    Batches cross to Python through Arrow. Name the `columns` that the function
    needs, so that the others are never read.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    def process(events: DataFrame) -> DataFrame:
        source = events.select(*columns) if columns else events
        return source.mapInPandas(batches, schema)

    return process


def _known_id(package: str) -> str:
    known = canonical_id_text(package)
    if known is None:
        raise ValueError(f"invalid package id: {package}")
    return known
