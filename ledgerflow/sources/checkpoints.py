"""Events by checkpoint: a streaming source whose offsets are checkpoint numbers.

    register(spark)
    spark.readStream.format("checkpoints").option("path", folder).option("start", 5).load()

Files arrive in a folder. An offset says up to which checkpoint everything was read, so a
stream can be started at, stopped at and set back to a checkpoint, which the arrival order of
files can't tell. `step` is the most checkpoints that one micro-batch takes; a run over all that
is available at once takes one step, too, and the next run the next one.

A file must arrive before the head moves past its checkpoints: `delay` checkpoints behind
the newest one are waited for. What arrives later than that is for a batch run to find.
Unknown checkpoints count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerflow import schemas
from ledgerflow.sinks.files import place

COLUMN = "checkpoint_sequence"
DEFAULT_STEP = 10_000


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(CheckpointSource)
    return spark


@dataclass
class Stretch(InputPartition):
    """The checkpoints from `start` to before `end` of one row group of a file."""

    path: str
    group: int
    start: int
    end: int


@dataclass(frozen=True)
class Group:
    """A row group and the checkpoints in it; null where they are unknown."""

    path: str
    group: int
    low: int
    high: int


class CheckpointSource(DataSource):
    """Events in Parquet files below `path`; options start, step, delay."""

    @classmethod
    def name(cls) -> str:
        return "checkpoints"

    def schema(self) -> T.StructType:
        return schemas.EVENTS

    def streamReader(self, schema: T.StructType) -> CheckpointReader:
        start, step, delay = (int(self.options.get(name, value)) for name, value in (("start", 0), ("step", DEFAULT_STEP), ("delay", 0)))
        if step < 1:
            raise ValueError("step must be at least 1")
        return CheckpointReader(self.options["path"], start, step, delay, schema)


class CheckpointReader(DataSourceStreamReader):
    def __init__(self, path: str, start: int, step: int, delay: int, schema: T.StructType):
        self._folder, self._start, self._step, self._delay = path, start, step, delay
        self._names = schema.fieldNames()
        self._groups: dict[str, list[Group]] = {}
        self._reached = start

    def __getstate__(self) -> dict:
        """Tasks get a partition each and need no list of all."""
        return {**self.__dict__, "_groups": {}}

    def initialOffset(self) -> dict:
        return {"checkpoint": self._start}

    def latestOffset(self) -> dict:
        """One step beyond what was given out last, but not beyond the head."""
        self._look()
        head = max((group.high for groups in self._groups.values() for group in groups), default=-1) + 1 - self._delay
        self._reached = max(self._reached, min(head, self._reached + self._step))
        return {"checkpoint": self._reached}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self._look()
        # A stream that is started again names the offset it had reached here before it asks for the next.
        self._reached = max(self._reached, end["checkpoint"])
        first, last = start["checkpoint"], end["checkpoint"]
        near = (group for groups in self._groups.values() for group in groups if group.low < last and group.high >= first)
        return [Stretch(group.path, group.group, first, last) for group in near]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, path = place(partition.path)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(row_groups=[partition.group], columns=self._names):
                checkpoint = pc.fill_null(batch.column(COLUMN), 0)
                mask = pc.and_(pc.greater_equal(checkpoint, partition.start), pc.less(checkpoint, partition.end))
                kept = batch.filter(mask).select(self._names)
                if kept.num_rows:
                    yield kept

    def commit(self, end: dict) -> None:
        pass

    def _look(self) -> None:
        """Read the statistics of files that are new; the rest is remembered."""
        system, path = place(self._folder)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(".parquet") and info.base_name not in self._groups:
                with system.open_input_file(info.path) as file:
                    self._groups[info.base_name] = _groups(f"{self._folder.rstrip('/')}/{info.base_name}", pq.ParquetFile(file))


def _groups(path: str, file: pq.ParquetFile) -> list[Group]:
    """The checkpoints of each row group, from its statistics or else from the column."""
    found = []
    for number in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(number)
        columns = (group.column(i) for i in range(group.num_columns))
        stats = next((c.statistics for c in columns if c.path_in_schema == COLUMN), None)
        if stats is None or not stats.has_min_max or stats.null_count is None:
            own = pc.fill_null(file.read_row_group(number, columns=[COLUMN]).column(COLUMN), 0)
            ends = pc.min_max(own).as_py()
            low, high = ends["min"], ends["max"]
        else:
            low, high = stats.min, stats.max
            if stats.null_count:
                low, high = min(low, 0), max(high, 0)
        if low is not None:
            found.append(Group(path, number, low, high))
    return found
