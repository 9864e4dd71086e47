"""Where the page keys of a stored table lie, file by file, and pages read from these files alone.

A small table beside the stored one has for each run of rows of a file its least and
greatest page key and a filter of its transaction digests. A page is looked for in the files
nearest behind the cursor, then in the next ones until it is full; a digest names its files
itself. New files are added when a page is asked for, by one scan of their key columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.fixed_values import PAGE_SIZE
from ledgerflow.sinks.files import drop_folder, place
from ledgerflow.sinks.key_index import bloom, may_hold
from ledgerflow.sinks.store import Store
from ledgerflow.sources.paging import PAGE_KEY, Cursor, Page, behind, select_events

#: Rows of one zone at most; bounds its filter.
ZONE_ROWS = 1 << 20
#: Zones that are looked into first; each further look takes four times as many.
FIRST_ZONES = 4

_KEY = "struct<checkpoint_sequence: long, transaction_digest: string, event_seq: long>"
_ZONES = f"file string, n long, low {_KEY}, high {_KEY}, bits binary"
_HASH = "_hash"
_ARROW_KEY = pa.struct([("checkpoint_sequence", pa.int64()), ("transaction_digest", pa.string()), ("event_seq", pa.int64())])
_ARROW_ZONES = pa.schema([("file", pa.string()), ("n", pa.int64()), ("low", _ARROW_KEY), ("high", _ARROW_KEY), ("bits", pa.binary())])


@dataclass(frozen=True)
class Zones:
    """The zones of a store's processed events."""

    store: Store
    table: str = "processed_events"

    def refresh(self) -> None:
        """Add the files that have no zones yet."""
        known = self._read()
        seen = set() if known is None else {row["file"] for row in known.select("file").distinct().collect()}
        new = sorted(set(self._files()) - seen)
        if new:
            # The folder is named, so that the bucket of a file's path stays a column of it.
            rows = self._rows(new).select(
                _file_of(F.col("_metadata.file_path")).alias("file"), *PAGE_KEY, F.xxhash64("transaction_digest").alias(_HASH)
            )
            rows.mapInArrow(_build, _ZONES).write.mode("append").parquet(self._folder)

    def page(
        self,
        *,
        transaction_digest: str | None = None,
        sender: str | None = None,
        package_id: str | None = None,
        cursor: Cursor | None = None,
        limit: int = PAGE_SIZE,
        descending: bool = False,
    ) -> Page:
        """`query_events` on the stored table, reading only the files that the page can lie in.

        The rows stay on the executors: they are written to a table of at most limit + 1 rows,
        which is good until the next page.
        """
        if limit < 1:
            raise ValueError("limit must be at least 1")
        self.refresh()
        zones = self._read()
        wanted = dict(transaction_digest=transaction_digest, sender=sender, package_id=package_id)
        if zones is not None and cursor is not None:
            there = F.struct(*[F.lit(getattr(cursor, name)).alias(name) for name in PAGE_KEY]).cast(_KEY)
            zones = zones.where(F.col("low") < there if descending else F.col("high") > there)
        if zones is not None and transaction_digest is not None:
            zones = _with_digest(zones, transaction_digest)
        drop_folder(self._pages)
        found, n, edge, take = None, 0, None, FIRST_ZONES
        looked: set[str] = set()
        while zones is not None and n <= limit:
            files, edge = _next_files(zones, edge, take, descending)
            parts = [] if found is None else [found.drop("_inside")]
            if new := [file for file in files if file not in looked]:
                parts.append(behind(select_events(self._rows(new), **wanted), cursor, descending).drop("checkpoint_bucket"))
            if not parts:
                break
            # All rows up to the edge lie in these files or in those looked into before, and the
            # best of the latter were kept.
            found, n = self._kept(reduce(DataFrame.unionByName, parts), _within(edge, descending), limit, descending)
            looked.update(files)
            take *= 4
            if edge is None:
                break
        if found is None:
            return Page(self.store.processed_events().drop("checkpoint_bucket").limit(0), None, False)
        data = found.where("_inside").drop("_inside").orderBy(*_order(descending)).limit(limit)
        more = n > limit
        last = None
        if more:
            key = F.struct(*[F.col(name) for name in PAGE_KEY])
            last = data.agg((F.min(key) if descending else F.max(key)).alias("k")).first()["k"]
        return Page(data, Cursor(*last) if last else None, more)

    # --- internals -----------------------------------------------------------

    def _kept(self, rows: DataFrame, inside: Column, limit: int, descending: bool) -> tuple[DataFrame, int]:
        """The best limit + 1 rows, marked whether they lie inside the edge, and how many do."""
        best = rows.orderBy(*_order(descending)).limit(limit + 1).withColumn("_inside", inside)
        folder = self.store.work_folder("pages")
        best.write.parquet(folder)
        kept = rows.sparkSession.read.schema(best.schema).parquet(folder)
        return kept, kept.where("_inside").count()

    def _rows(self, files: list[str]) -> DataFrame:
        root = self.store.table_path(self.table)
        return self.store.spark.read.schema(self.store.processed_events().schema).option("basePath", root).parquet(*[f"{root}/{file}" for file in files])

    def _files(self) -> list[str]:
        system, path = place(self.store.table_path(self.table))
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        names = [info.path[len(path) :].lstrip("/") for info in found if info.type == fs.FileType.File]
        return [name for name in names if name.endswith(".parquet") and not any(part.startswith(("_", ".")) for part in name.split("/"))]

    def _read(self) -> DataFrame | None:
        try:
            return self.store.spark.read.schema(_ZONES).parquet(self._folder)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @property
    def _folder(self) -> str:
        return self.store.table_path(f"{self.table}_zones")

    @property
    def _pages(self) -> str:
        return self.store.table_path("_work/pages")


def _file_of(path: Column) -> Column:
    """Bucket folder and name, as below the table's folder."""
    return F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")


def _order(descending: bool) -> list[Column]:
    return [F.col(name).desc() if descending else F.col(name).asc() for name in PAGE_KEY]


def _within(edge, descending: bool) -> Column:
    if edge is None:
        return F.lit(True)
    here = F.struct(*[F.col(name) for name in PAGE_KEY])
    there = F.struct(*[F.lit(edge[name]).alias(name) for name in PAGE_KEY]).cast(_KEY)
    return here >= there if descending else here <= there


def _next_files(zones: DataFrame, edge, take: int, descending: bool) -> tuple[list[str], object]:
    """Files of the next `take` zones beyond the edge, and the new edge: up to it nothing lies in other files.

    The edge is None when no zone is left behind these.
    """
    near, far = ("high", "low") if descending else ("low", "high")
    left = zones
    if edge is not None:
        there = F.struct(*[F.lit(edge[name]).alias(name) for name in PAGE_KEY]).cast(_KEY)
        left = zones.where(F.col(near) < there if descending else F.col(near) > there)
    order = F.col(near).desc() if descending else F.col(near).asc()
    first = left.orderBy(order).limit(take).select("file", near, far).collect()
    if not first:
        return [], None
    new_edge = (min if descending else max)((row[far] for row in first), key=_nulls_first)
    there = F.struct(*[F.lit(new_edge[name]).alias(name) for name in PAGE_KEY]).cast(_KEY)
    # Zones that begin before the edge may hold rows up to it.
    inside = F.col(near) >= there if descending else F.col(near) <= there
    files = sorted(row["file"] for row in left.where(inside).select("file").distinct().collect())
    return files, (new_edge if left.where(~inside).limit(1).count() else None)


def _with_digest(zones: DataFrame, digest: str) -> DataFrame:
    """Zones whose filter may hold the digest."""
    asked = zones.sparkSession.range(1).select(F.xxhash64(F.lit(digest))).first()[0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([asked], np.int64)
            yield batch.filter(pa.array([bool(may_hold(bits, own)[0]) for bits in batch.column("bits").to_pylist()], pa.bool_()))

    return zones.mapInArrow(probe, zones.schema)


def _nulls_first(key: tuple) -> tuple:
    return tuple((part is not None, part) if part is not None else (False,) for part in key)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A zone for each run of rows of one file, closed at `ZONE_ROWS`."""
    file, n, low, high, hashes = None, 0, None, None, []

    def closed() -> pa.RecordBatch:
        names = dict(zip(PAGE_KEY, low, strict=True)), dict(zip(PAGE_KEY, high, strict=True))
        row = {"file": file, "n": n, "low": names[0], "high": names[1], "bits": bloom(np.unique(np.concatenate(hashes)))}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW_ZONES)

    for batch in batches:
        files = batch.column("file").to_pylist()
        at = 0
        while at < len(files):
            if file is not None and (files[at] != file or n >= ZONE_ROWS):
                yield closed()
                n, low, high, hashes = 0, None, None, []
            file, end = files[at], at
            while end < len(files) and files[end] == file and end - at < ZONE_ROWS - n:
                end += 1
            part = batch.slice(at, end - at)
            keys = list(zip(*[part.column(name).to_pylist() for name in PAGE_KEY], strict=True))
            low = min(keys if low is None else [*keys, low], key=_nulls_first)
            high = max(keys if high is None else [*keys, high], key=_nulls_first)
            hashes.append(part.column(_HASH).to_numpy())
            n += end - at
            at = end
    if n:
        yield closed()
