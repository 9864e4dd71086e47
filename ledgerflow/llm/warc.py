"""Pages as WARC records in ZIP packages, and their records read back by ranges (operator 11).

Method: every package is a ZIP file whose archives (`archive/*.warc.gz`, one gzip member per
record) and index (`indexes/index.cdxj`) are stored uncompressed. The reader parses the central
directory, ZIP64 included, finds where archives and index lie in the package, and reads
records by the index's ranges without extracting anything.

Of records with equal payloads that with the largest page_id is the response and the others
revisit it; among repeated rows of that id any one is. A missing page_id is smaller than
all others. A null html is an empty payload; a null url is left out. Payloads are equal when their SHA-1 is.
An empty table makes no package and no rows. Further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import packages
from ledgerflow.llm.common import keep, map_slices, sliced, texts_as_bytes
from ledgerflow.session import scratch_folder

#: A package is closed when it holds so many records or bytes; bounds its index in memory.
PACKAGE_RECORDS = 20_000
PACKAGE_BYTES = 256 << 20
#: An archive within a package is closed at so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20

INDEX = "indexes/index.cdxj"
# Fixed values of the WARC format.
RESPONSE, REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GAP, _LINE = b"\r\n\r\n", b"\r\n"
#: Record ids name the page and the row it stood in.
_ID = "urn:x-page:"


# --- what is written -----------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_rows(pages: DataFrame) -> DataFrame:
    """One kept row per page: row (a number of its own), page_id, url, payload, payload_bytes, payload_digest."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            payloads = texts_as_bytes(part.column("html"))
            return {name: part.column(name) for name in ("row", "page_id", "url")} | {
                "payload": pa.array(payloads, pa.binary()),
                "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                "payload_digest": pa.array(map(digest, payloads), pa.string()),
            }

        return batch

    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    schema = "row long, page_id long, url string, payload binary, payload_bytes long, payload_digest string"
    return keep(map_slices(rows, work, schema), "payloads", codec="zstd")


def with_responses(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds response_page and response_row to rows whose payload another row's response holds.

    Only digests that repeat are joined back, so a payload on most rows is one row there.
    """
    own = rows.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", F.struct("page_id", "row").alias("place"))
    shared = own.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("place").alias("response")).where("n > 1")
    shared = keep(shared.select(F.col("payload_digest").alias("digest"), "response"), "shared-payloads")
    repeats = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least_bytes)
    other = F.col("response.row") != F.col("row")
    return rows.join(shared, repeats, "left").select(
        *rows.columns,
        F.when(other, F.col("response.page_id")).alias("response_page"),
        F.when(other, F.col("response.row")).alias("response_row"),
    )


@dataclass
class Package:
    """A package being written."""

    uri: str
    lines: list[str] = field(default_factory=list)
    archives: int = 0

    def __post_init__(self) -> None:
        system, path = packages.file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self._stream = system.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED)
        self._archive, self._at = None, 0

    @property
    def full(self) -> bool:
        return len(self.lines) >= PACKAGE_RECORDS or self._stream.tell() >= PACKAGE_BYTES

    def add(self, record: bytes, entry: dict[str, object]) -> None:
        if self._archive is not None and self._at >= ARCHIVE_BYTES:
            self._close_archive()
        if self._archive is None:
            self.archives += 1
            self._archive, self._at = self._open(f"archive/{self.archives:05d}.warc.gz"), 0
        packer = zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS | 16)
        packed = packer.compress(record) + packer.flush()
        self._archive.write(packed)
        place = {"filename": f"{self.archives:05d}.warc.gz", "offset": self._at, "length": len(packed)}
        self._at += len(packed)
        # The url is sorted by, the rest is JSON; neither holds a line break.
        self.lines.append(f"{entry['url'] or '-'} {entry['timestamp']} {json.dumps(entry | place)}\n")

    def close(self) -> tuple[str, int, int]:
        """The package's place, records and bytes."""
        self._close_archive()
        with self._open(INDEX) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self._zip.close()
        size = self._stream.tell()
        self._stream.close()
        return self.uri, len(self.lines), size

    def _open(self, name: str):
        return self._zip.open(zipfile.ZipInfo(name), "w", force_zip64=True)

    def _close_archive(self) -> None:
        if self._archive is not None:
            self._archive.close()
            self._archive = None


def record_id(page_id: int | None, row: int) -> str:
    return f"{_ID}{'' if page_id is None else page_id}:{row}"


def page_of(identifier: str | None) -> int | None:
    """The page_id that a record id names."""
    name = (identifier or "").removeprefix(_ID).rpartition(":")[0]
    return int(name) if name else None


def clean_url(url: str | None) -> str | None:
    """The url as one word of ASCII: other characters are percent-encoded."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(row: dict, date: str) -> bytes:
    """One page as a WARC record: its HTTP response, or only that response's head if it revisits another."""
    revisit = row["response_row"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = head.encode() if revisit else head.encode() + row["payload"]
    url = clean_url(row["url"])
    fields = [
        ("WARC-Type", REVISIT if revisit else RESPONSE),
        ("WARC-Record-ID", f"<{record_id(row['page_id'], row['row'])}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{record_id(row['response_page'], row['response_row'])}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None]]
    return "\r\n".join(lines).encode() + _GAP + block + _GAP


def write_packages(rows: DataFrame, folder: str, date: datetime | None = None) -> DataFrame:
    """Writes rows of `with_responses`; gives one kept row per package: package, records, bytes.

    `folder` must be a URI or path that Arrow can write to and all executors share. Each
    attempt of a task writes packages of its own names, and only those of the attempts that
    Spark accepted are listed.
    """
    when = date or datetime.now(timezone.utc)
    stamp = when.strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for part in sliced(batches):
            for i in range(part.num_rows):
                row = {name: part.column(name)[i].as_py() for name in part.schema.names}
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                entry = {
                    "url": clean_url(row["url"]),
                    "timestamp": when.strftime("%Y%m%d%H%M%S"),
                    "digest": f"sha1:{row['payload_digest']}",
                    "type": RESPONSE if row["response_row"] is None else REVISIT,
                }
                package.add(record(row, stamp), entry)
                if package.full:
                    yield _listed(package.close())
                    package = None
        if package:
            yield _listed(package.close())

    def _listed(row: tuple[str, int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("package", "records", "bytes"), row, strict=True))])

    return keep(rows.mapInArrow(write, "package string, records long, bytes long"), "packages")


# --- what is read back ---------------------------------------------------------


def locate(listed: DataFrame) -> DataFrame:
    """The records of the packages in column `package`: package, at and length (their range), url, type, digest."""
    # A package is a task's work: it is read through its index and nothing else.
    spread = listed.select("package").repartition(max(1, min(listed.count(), MOST_TASKS)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for uri in part.column("package").to_pylist():
                with packages.open_file(uri) as file:
                    entries = index_entries(packages.reader(file), file.size())
                found = [{"package": uri, **entry} for entry in entries]
                for at in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_pylist(found[at : at + 1000], schema=_ENTRIES)

    return spread.mapInArrow(find, "package string, at long, length long, url string, type string, digest string")


#: Tasks that packages are dealt to at most; each then reads several.
MOST_TASKS = 50_000
_ENTRIES = pa.schema([("package", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string())])


def index_entries(read_at: packages.ReadAt, size: int) -> list[dict]:
    """The index's records with their ranges in the package itself, in the order of their places."""
    known = {member.name: member for member in packages.members(read_at, size)}
    if INDEX not in known:
        raise ValueError(f"the package has no {INDEX}")
    starts: dict[str, int] = {}
    found = []
    for line in packages.content(read_at, known[INDEX]).decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])
        name = f"archive/{entry['filename']}"
        if name not in starts:
            starts[name] = packages.stored_at(read_at, known[name])
        at, length = int(entry["offset"]), int(entry["length"])
        if at + length > known[name].size:
            raise ValueError(f"the index goes beyond {name}")
        found.append({"at": starts[name] + at, "length": length, "url": entry.get("url"), "type": entry.get("type"), "digest": entry.get("digest")})
    return sorted(found, key=lambda entry: entry["at"])


def read_records(entries: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at rows of `locate`, or some of them.

    Gives record_id, type, url, refers_to, payload_bytes, payload_digest and payload; a revisit's
    payload is null, its size and digest are those of the response. A payload that doesn't
    have its record's digest is an error. `payloads=False` leaves payloads null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for part in sliced(batches):
            rows = part.select(["package", "at", "length"]).to_pylist()
            held: list[dict] = []
            n_bytes = 0
            for place, data in ranged(rows):
                if place["package"] != uri:
                    if file is not None:
                        file.close()
                    uri, file = place["package"], packages.open_file(place["package"])
                for found in map(parsed, data(packages.reader(file))):
                    held.append(found if payloads else found | {"payload": None})
                    n_bytes += len(held[-1]["payload"] or b"")
                if n_bytes >= RANGE_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                    held, n_bytes = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
        if file is not None:
            file.close()

    schema = "record_id string, type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return entries.select("package", "at", "length").mapInArrow(read, schema)


_RECORDS = pa.schema(
    [(name, pa.string()) for name in ("record_id", "type", "url", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def ranged(rows: list[dict]):
    """Runs of records that lie side by side, each with a function that reads the run and cuts it."""
    runs: list[list[dict]] = []
    for row in rows:
        last = runs[-1][-1] if runs else None
        joins = last and last["package"] == row["package"] and last["at"] + last["length"] == row["at"]
        if joins and row["at"] + row["length"] - runs[-1][0]["at"] <= RANGE_BYTES:
            runs[-1].append(row)
        else:
            runs.append([row])
    for run in runs:
        start = run[0]["at"]

        def data(read_at: packages.ReadAt, run=run, start=start) -> Iterator[bytes]:
            held = read_at(start, run[-1]["at"] + run[-1]["length"] - start)
            for row in run:
                yield held[row["at"] - start : row["at"] - start + row["length"]]

        yield run[0], data


def parsed(packed: bytes) -> dict:
    """One record from its gzip member."""
    plain = zlib.decompress(packed, zlib.MAX_WBITS | 16)
    head, _, rest = plain.partition(_GAP)
    version, fields = _fields(head)
    if not version.startswith("WARC/"):
        raise ValueError("this is no WARC record")
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the record ends early")
    http_head, _, payload = block.partition(_GAP)
    revisit = fields["warc-type"] == REVISIT
    wanted = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != wanted:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    size = int(_fields(http_head)[1]["content-length"]) if revisit else len(payload)
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "type": fields["warc-type"],
        "url": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if revisit else None,
        "payload_bytes": size,
        "payload_digest": wanted,
        "payload": None if revisit else payload,
    }


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes every page to packages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    listed = write_packages(with_responses(payload_rows(pages), least_bytes), folder)
    found = read_records(locate(listed), payloads=False)
    page = lambda name: F.nullif(F.regexp_extract(name, f"^{_ID}(-?[0-9]*):", 1), F.lit("")).cast("long")
    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
