"""What the operators share: word splitting, per-batch mapping and kept results."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import scratch_folder

#: Rows of one Arrow batch that are worked on together; bounds a worker's memory.
SLICE_ROWS = 1000
_C_LIBRARY = ctypes.CDLL(None)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(frame: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The frame as a written table in the shared folder: computed once, lineage cut.

    The files outlive lost executors. They stay until the folder is cleared.
    """
    folder = scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder, compression=codec)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """At the end of a task: its worker lives on, and what its batches took goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C_LIBRARY, "malloc_trim"):
        _C_LIBRARY.malloc_trim(0)


def map_slices(
    frame: DataFrame, work: Callable[[Callable], Callable], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """`work()` builds a task's function once; it turns a record batch into columns by name."""
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for part in sliced(batches, rows):
            columns = function(part)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)
        del function
        give_back()

    return frame.mapInArrow(run, schema)


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for letter in schema:
        depth += (letter == "<") - (letter == ">")
        if letter == "," and not depth:
            parts.append("")
        else:
            parts[-1] += letter
    return parts


def filter_slices(frame: DataFrame, work: Callable[[], Callable], rows: int = SLICE_ROWS) -> DataFrame:
    """The rows for which `work()`'s function of a record batch gives True; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for part in sliced(batches, rows):
            yield part.filter(pa.array(function(part), pa.bool_()))
        del function
        give_back()

    return frame.mapInArrow(run, frame.schema)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def _table(is_gap: Callable[[int], bool]) -> bytes:
    lowered = (c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
    return bytes(0x20 if is_gap(c) else c for c in lowered)


#: Lower-cases A-Z and nothing else; bytes.split() then cuts at \x20 and \x09-\x0D.
SPACED = _table(lambda c: False)
#: Also makes a gap of every ASCII character that is neither letter nor digit.
_ALPHANUMERIC = _table(lambda c: c < 0x80 and not chr(c).isalnum())


def spaced_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    return text.translate(SPACED).split()


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z in lower case."""
    return text.translate(_ALPHANUMERIC).split()


def joined_plain_words(text: bytes) -> bytes:
    """The plain words of a text with one space between them."""
    return b" ".join(plain_words(text))


def plain_lines(text: bytes) -> list[list[bytes]]:
    """The words of each line."""
    return [line.translate(_ALPHANUMERIC).split() for line in text.split(b"\n")]
