"""Which keys a stored table holds: sorted key files with Bloom filters (K1, K2).

Beside a table lie its keys, sorted by their hash, and a filter for every `FILTER_KEYS` of
them in a row. An append asks the filters first; only key files whose filters may hold one
of its keys are read, and there the keys themselves are compared. A batch of new keys thus
reads neither the stored table nor its keys, but for the few files that a filter names in vain.

The order of an append is: a begin mark, keys, rows, filters, an end mark. Keys count once
they have filters. An append that died leaves a begin mark without its end; the next
append then looks up the dead one's keys in the stored table, and those found there get
filters. A table from before there was an index is indexed by one scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.functions.times import run_time
from ledgerflow.sinks.files import CODEC
from ledgerflow.sinks.small_log import SmallLog

HASH, BUCKET = "_hash", "checkpoint_bucket"
#: Keys of one filter at most, and bits for each; eight probes of 24 bits let 4 in 100,000 strangers pass.
FILTER_KEYS = 1 << 20
KEY_BITS, PROBES = 24, 8
#: Keys of one file at most.
FILE_KEYS = 4 << 20
#: Bytes of filters, and number of keys, that one task compares.
TASK_BYTES = 32 << 20
TASK_KEYS = 1 << 20

SEGMENTS = T.StructType(
    [T.StructField("segment", T.StringType()), T.StructField("state", T.StringType()), T.StructField("at", T.TimestampType())]
)
_FILTERS = "segment string, file string, low long, high long, first_bucket long, last_bucket long, n_keys long, bits binary"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class KeyIndex:
    """The index of `table` below `root`; `schema` has the key columns."""

    spark: SparkSession
    root: str
    table: str
    schema: T.StructType

    @property
    def keys(self) -> list[str]:
        return self.schema.fieldNames()

    # --- what is stored ------------------------------------------------------

    def stored_among(self, keyed: DataFrame, n: int, buckets: tuple[int, int] | None = None) -> DataFrame | None:
        """Those of `n` distinct keys (`hashed`) that the table holds, within a range of buckets; None if no filter knows any."""
        filters = self._filters()
        if filters is None:
            return None
        if buckets:
            filters = filters.where((F.col("last_bucket") >= buckets[0]) & (F.col("first_bucket") <= buckets[1]))
        held = filters.agg(F.sum("n_keys")).first()[0]
        if not held or not n:
            return None
        files = sorted(r["file"] for r in _hits(keyed.select(HASH), filters, _slice_bits(n, held)).distinct().collect())
        if not files:
            return None
        known = self.spark.read.schema(self._key_schema).parquet(*[f"{self._folder('keys')}/{file}" for file in files])
        if buckets:
            known = known.where(F.col(BUCKET).between(*buckets))
        same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in (HASH, *self.keys)]
        other = known.select(*[F.col(name).alias(f"_{name}") for name in (HASH, *self.keys)])
        return keyed.select(HASH, *self.keys).join(other, same, "left_semi").select(*self.keys)

    # --- appends -------------------------------------------------------------

    def settle(self, stored: DataFrame | None) -> None:
        """Bring the index up to the stored table after an append that died, or for a table without an index."""
        last = self._log.last()
        if last is None:
            if stored is not None:
                self._index(stored)
        elif last["state"] == "begun":
            try:
                left = self.spark.read.schema(self._key_schema).parquet(f"{self._folder('keys')}/{last['segment']}")
            except AnalysisException as problem:
                if problem.getCondition() != "PATH_NOT_FOUND":
                    raise
                left = None
            if stored is not None and left is not None:
                same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in self.keys]
                other = stored.select(*[F.col(name).alias(f"_{name}") for name in self.keys])
                self._index(left.join(other, same, "left_semi"))
            self._mark(last["segment"], "dropped")

    def begin(self, rows: DataFrame) -> str:
        """Note the keys of rows that are about to be stored; rows have the key columns and a bucket."""
        segment = uuid.uuid4().hex
        self._mark(segment, "begun")
        self._write_keys(rows, segment)
        return segment

    def finish(self, segment: str) -> None:
        """The rows are stored: their keys count from now on."""
        self._write_filters(segment)
        self._mark(segment, "done")

    # --- internals -----------------------------------------------------------

    def _index(self, rows: DataFrame) -> None:
        segment = uuid.uuid4().hex
        self._write_keys(rows, segment)
        self._write_filters(segment)
        self._mark(segment, "done")

    def _write_keys(self, rows: DataFrame, segment: str) -> None:
        made = hashed(rows.select(*self.keys, BUCKET), self.keys).select(*self._key_schema.fieldNames())
        ordered = made.repartitionByRange(HASH).sortWithinPartitions(HASH)
        ordered.write.option("compression", CODEC).option("maxRecordsPerFile", FILE_KEYS).parquet(f"{self._folder('keys')}/{segment}")

    def _write_filters(self, segment: str) -> None:
        place = F.concat(F.lit(f"{segment}/"), F.col("_metadata.file_name")).alias("file")
        written = self.spark.read.schema(self._key_schema).parquet(f"{self._folder('keys')}/{segment}")
        made = written.select(F.lit(segment).alias("segment"), place, HASH, BUCKET).mapInArrow(_build, _FILTERS)
        made.write.mode("append").parquet(self._folder("filters"))

    def _filters(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_FILTERS).parquet(self._folder("filters"))
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _mark(self, segment: str, state: str) -> None:
        self._log.append({"segment": segment, "state": state, "at": run_time(None)})

    @property
    def _log(self) -> SmallLog:
        return SmallLog(self._folder("segments"), SEGMENTS)

    @property
    def _key_schema(self) -> T.StructType:
        return T.StructType([T.StructField(HASH, T.LongType()), *self.schema.fields, T.StructField(BUCKET, T.LongType())])

    def _folder(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{self.table}_{part}"


def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn(HASH, F.xxhash64(*keys))


def _slice_bits(n: int, held: int) -> int:
    """The hash space is cut into 2^bits slices, so that a task's keys and filters have their bounds."""
    slices = max(-(-n // TASK_KEYS), -(-held * KEY_BITS // 8 // TASK_BYTES))
    return (slices - 1).bit_length()


def _hits(hashes: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """The files whose filters may hold one of the hashes. Equal slices of both meet in one task."""

    def slice_of(name: str):
        return F.shiftright(name, 64 - bits) if bits else F.lit(0).cast("bigint")

    left = hashes.select(HASH, slice_of(HASH).alias("slice"))
    right = filters.select("file", "low", "high", "bits", F.explode(F.sequence(slice_of("low"), slice_of("high"))).alias("slice"))

    def probe(own: pa.Table, filters: pa.Table) -> pa.Table:
        asked = np.sort(own.column(HASH).to_numpy())
        files = set()
        for row in filters.to_pylist():
            if row["file"] not in files:
                inside = asked[np.searchsorted(asked, row["low"]) : np.searchsorted(asked, row["high"], side="right")]
                if may_hold(row["bits"], inside).any():
                    files.add(row["file"])
        return pa.table({"file": pa.array(sorted(files), pa.string())})

    return left.groupBy("slice").cogroup(right.groupBy("slice")).applyInArrow(probe, "file string")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each run of keys of one file, closed at `FILTER_KEYS`."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    place, n = None, 0

    def closed() -> pa.RecordBatch:
        hashes, buckets = (np.concatenate(part) for part in zip(*held, strict=True))
        row = {"segment": place[0], "file": place[1], "low": int(hashes.min()), "high": int(hashes.max())}
        row |= {"first_bucket": int(buckets.min()), "last_bucket": int(buckets.max()), "n_keys": len(hashes), "bits": bloom(hashes)}
        return pa.RecordBatch.from_pylist([row])

    for batch in batches:
        files = batch.column("file").to_pylist()
        at = 0
        while at < len(files):
            own = (batch.column("segment")[at].as_py(), files[at])
            if held and (own != place or n >= FILTER_KEYS):
                yield closed()
                held, n = [], 0
            place, end = own, at
            while end < len(files) and files[end] == own[1] and end - at < FILTER_KEYS - n:
                end += 1
            part = batch.slice(at, end - at)
            held.append((part.column(HASH).to_numpy(), part.column(BUCKET).to_numpy()))
            n += end - at
            at = end
    if held:
        yield closed()


def bloom(hashes: np.ndarray) -> bytes:
    """The filter of a set of 64-bit hashes, one bit to a bit."""
    # Very few keys would have too few places to differ in.
    flags = np.zeros(max(1024, -(-len(hashes) * KEY_BITS // 8) * 8), bool)
    for places in _places(hashes, len(flags)):
        flags[places] = True
    return np.packbits(flags).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the filter may hold it; it never denies one that it holds."""
    held = np.frombuffer(bits, np.uint8)
    found = np.ones(len(hashes), bool)
    for places in _places(hashes, len(held) * 8):
        found &= (held[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _places(hashes: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    """`PROBES` places for each hash. Hashes of one filter lie close together, so they are mixed first."""
    mixed = hashes.astype(np.int64).view(np.uint64) * _MIX[0]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
    first, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * step) % np.uint64(n_bits)
