"""Tables of partial results that batches add to and that are merged as they grow.

Each batch writes a folder of its own. `FAN` folders of a level are merged into one of
the next by the table's own rule, so n batches leave about FAN * log(n) folders and a row is
merged once per level. Batches have growing numbers; one that comes again is left out if it
counts already and replaces what it had written if it doesn't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerflow.sinks.files import drop_folder
from ledgerflow.sinks.manifest import Manifest, Parts


@dataclass(frozen=True)
class SegmentTable:
    """`merge` turns rows of several segments into fewer that mean the same."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]

    def last_batch(self) -> int | None:
        return self._parts().mark

    def add(self, batch: int, rows: DataFrame) -> DataFrame | None:
        """The rows as they were written, or None if the batch or a later one counts already."""
        parts = self._parts()
        if parts.mark is not None and batch <= parts.mark:
            return None
        name = f"batch-{batch}"
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._path(name))
        parts = parts.with_part(name, mark=batch)
        while full := parts.full_level():
            level, names = full
            whole = f"merged-{uuid.uuid4().hex}"
            self.merge(self._read(names)).select(*self.schema.fieldNames()).write.parquet(self._path(whole))
            parts = parts.with_merge(level, names, whole)
        for old in self._manifest.replace(parts):
            drop_folder(self._path(old))
        return self.batch(batch)

    def batch(self, batch: int) -> DataFrame:
        """What a recent batch has written, also if it is merged by now."""
        return self._read([f"batch-{batch}"])

    def read(self) -> DataFrame:
        """Rows of all segments; `merge` them to have one for each key."""
        return self._read(self._parts().names())

    def _parts(self) -> Parts:
        return self._manifest.read() or Parts()

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path(name) for name in names])

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    @cached_property
    def _manifest(self) -> Manifest:
        return Manifest(self.folder)
