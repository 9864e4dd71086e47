"""Small tables that grow by a row per batch, in a bounded number of files (K3).

Each row is a file at first. As soon as `FAN` files of one level exist they are merged
into one of the next, so n rows take about FAN * log(n) files, and each row is written
again once per level. The files that count stand in a manifest.

Written by the driver alone, one writer per log. The folder must be on a file system that
Arrow can write to (a local or mounted path, file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerflow.sinks.manifest import Manifest, Parts

_ARROW = {
    T.LongType: pa.int64(),
    T.StringType: pa.string(),
    T.BooleanType: pa.bool_(),
    T.TimestampType: pa.timestamp("us", tz="UTC"),
}


@dataclass(frozen=True)
class SmallLog:
    folder: str
    schema: T.StructType

    def append(self, row: dict[str, object]) -> None:
        """One more row; the values have the schema's types, times have a zone."""
        parts = self._parts()
        self._manifest.files.create_dir(self._manifest.path(""), recursive=True)
        parts = parts.with_part(self._write(pa.Table.from_pylist([row], schema=self._arrow)))
        while full := parts.full_level():
            level, names = full
            parts = parts.with_merge(level, names, self._write(pa.concat_tables([self._read(name) for name in names])))
        for name in self._manifest.replace(parts):
            self._manifest.files.delete_file(self._manifest.path(name))

    def paths(self) -> list[str]:
        return [f"{self.folder.rstrip('/')}/{name}" for name in self._parts().names()]

    def read(self, spark: SparkSession) -> DataFrame:
        paths = self.paths()
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def last(self) -> dict | None:
        newest = self.tail(1)
        return newest[0] if newest else None

    def tail(self, n: int) -> list[dict]:
        """The newest `n` rows, newest last, from as few files as hold them."""
        found: list[dict] = []
        for name in reversed(self._parts().names()):
            if len(found) >= n:
                break
            rows = self._read(name)
            found = rows.slice(max(0, rows.num_rows - n)).to_pylist() + found
        return found[-n:]

    # --- internals ---------------------------------------------------------

    @cached_property
    def _manifest(self) -> Manifest:
        return Manifest(self.folder)

    @cached_property
    def _arrow(self) -> pa.Schema:
        return pa.schema([(field.name, _ARROW[type(field.dataType)]) for field in self.schema])

    def _parts(self) -> Parts:
        """Row files from before there were manifests count as well."""
        old = [name for name in self._manifest.entries() if name.startswith("part-") and name.endswith(".parquet")]
        return self._manifest.read() or Parts(live=tuple((name, 0) for name in sorted(old)))

    def _read(self, name: str) -> pa.Table:
        with self._manifest.files.open_input_file(self._manifest.path(name)) as file:
            return pq.ParquetFile(file).read().cast(self._arrow)

    def _write(self, rows: pa.Table) -> str:
        name = f"rows-{uuid.uuid4().hex}.parquet"
        with self._manifest.files.open_output_stream(self._manifest.path(name)) as file:
            pq.write_table(rows, file)
        return name
