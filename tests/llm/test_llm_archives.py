"""ZIP packages and WARC records: directories of every form, odd rows, ranges, damage."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zipfile
import zlib
from collections import defaultdict

import pytest

from ledgerflow.llm import packages, warc

SMALL = "/root/testdata/sf0.001"


def read_at(data: bytes):
    return lambda at, length: data[at : at + length]


def zipped(files: dict[str, bytes], method=zipfile.ZIP_STORED, comment=b"") -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", method) as package:
        for name, data in files.items():
            package.writestr(name, data)
        package.comment = comment
    return held.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note", b"PK\x05\x06" + b"\0" * 40])
def test_directory_equals_the_library(comment):
    files = {"a": b"one", "b/ü.txt": b"", "c": b"three" * 100}
    data = zipped(files, comment=comment)
    found = list(packages.members(read_at(data), len(data)))
    # The library itself takes the last comment for a directory, so it gets none.
    with zipfile.ZipFile(io.BytesIO(zipped(files))) as package:
        assert [(m.name, m.size, m.packed_size, m.header_at) for m in found] == [
            (i.filename, i.file_size, i.compress_size, i.header_offset) for i in package.infolist()
        ]
    at = packages.stored_at(read_at(data), found[2])
    assert data[at : at + found[2].size] == b"three" * 100


def test_zip64_values_and_many_members(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    wide = zipped({"a": b"x" * 50, "b": b"y" * 500, "c": b"z" * 50})
    assert b"PK\x06\x06" in wide
    found = list(packages.members(read_at(wide), len(wide)))
    assert [(m.name, m.size) for m in found] == [("a", 50), ("b", 500), ("c", 50)]
    for member, letter in zip(found, b"xyz", strict=True):
        at = packages.stored_at(read_at(wide), member)
        assert wide[at : at + member.size] == bytes([letter]) * member.size
    monkeypatch.undo()
    many = zipped({f"m{i}": b"" for i in range(70_000)})
    assert [m.name for m in packages.members(read_at(many), len(many))] == [f"m{i}" for i in range(70_000)]


def test_directory_is_read_by_ranges():
    data = zipped({f"m{i}": b"q" * 1000 for i in range(500)})
    asked = []

    def watched(at, length):
        asked.append((at, length))
        return data[at : at + length]

    assert len(list(packages.members(watched, len(data)))) == 500
    assert sum(length for _, length in asked) < len(data) / 2


def test_what_is_no_stored_member_is_refused():
    packed = zipped({"a": b"one" * 50}, method=zipfile.ZIP_DEFLATED)
    (member,) = packages.members(read_at(packed), len(packed))
    assert packages.content(read_at(packed), member) == b"one" * 50
    with pytest.raises(ValueError, match="not stored"):
        packages.stored_at(read_at(packed), member)
    for data in (b"", b"no package at all", packed[:-30]):
        with pytest.raises(ValueError):
            list(packages.members(read_at(data), len(data)))


PAGES = (
    (1, "http://a/1", "same"),
    (2, "http://a/2", "same"),
    (9, "http://a/9", "same"),
    (9, "http://a/9", "same"),
    (3, "bad\r\nurl é", "déjà vu"),
    (4, None, None),
    (5, "http://a/5", ""),
    (None, "http://a/n", "same"),
    (None, "http://a/m", "alone"),
    (-7, "http://a/-7", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://a/6", "long é " * 200_000),
)
SCHEMA = "page_id long, url string, html string, row long, digest string, payload string, response long"


def brute(rows) -> list[tuple]:
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    found = []
    for payload, ids in groups.items():
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first, *others = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        found.append((first, len(payload), name, "response", None))
        found += [(i, len(payload), name, "revisit", first) for i in others]
    return found


def rows_of(frame) -> list[tuple]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.fixture
def make_pages(spark):
    def make(*rows):
        return spark.createDataFrame([(*row, 1, "d", "p", 2) for row in rows], SCHEMA)

    return make


def test_odd_pages(make_pages):
    assert rows_of(warc.archived(make_pages(*PAGES))) == sorted(brute(PAGES), key=str)
    assert rows_of(warc.archived(make_pages())) == []


def test_small_payloads_may_all_be_responses(make_pages):
    found = rows_of(warc.archived(make_pages(*PAGES), least_bytes=5))
    assert {kind for _, n, _, kind, _ in found if n < 5} == {"response"}
    assert len(found) == len(PAGES)


def test_packages_and_archives_are_closed_in_time(spark, make_pages, tmp_path, monkeypatch):
    rng = random.Random(3)
    pages = [(i, f"http://h/{i % 7}", rng.choice(["x", "y"]) * (i % 40)) for i in range(300)]
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 50)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2500)
    rows = warc.with_responses(warc.payload_rows(make_pages(*pages).coalesce(1))).coalesce(1).collect()
    package = warc.Package(f"{tmp_path}/deep/one.wacz")
    for row in rows[:100]:
        row = row.asDict()
        entry = {"url": warc.clean_url(row["url"]), "timestamp": "20240101000000", "digest": "d", "type": "t"}
        package.add(warc.record(row, "2024-01-01T00:00:00Z"), entry)
    assert package.full and package.archives > 3
    uri, n, size = package.close()
    with packages.open_file(uri) as file:
        assert file.size() == size
        entries = warc.index_entries(packages.reader(file), size)
        assert len(entries) == n == 100
        runs = list(warc.ranged([{"package": uri, **e} for e in entries]))
        assert len(runs) < 30
        found = [warc.parsed(data) for _, cut in runs for data in cut(packages.reader(file))]
    assert [f["record_id"] for f in found] == [warc.record_id(r["page_id"], r["row"]) for r in rows[:100]]
    with zipfile.ZipFile(uri) as other:
        assert other.testzip() is None
    listed = spark.createDataFrame([(uri,)], "package string")
    located = warc.locate(listed)
    one = warc.read_records(located.where("url = 'http://h/3' and type = 't'")).collect()
    assert sorted(r["record_id"] for r in one) == sorted(f["record_id"] for f in found if f["url"] == "http://h/3")
    assert all(r["payload"] is not None or r["type"] == "revisit" for r in one)


def test_damage_is_an_error(make_pages):
    row = warc.payload_rows(make_pages((1, "u", "text"))).first().asDict() | {"response_row": None}
    good = warc.record(row, "2024-01-01T00:00:00Z")
    pack = lambda data: zlib.compress(data, wbits=31)
    assert warc.parsed(pack(good))["payload"] == b"text"
    for bad, why in ((good.replace(b"\r\n\r\ntext", b"\r\n\r\ntexT"), "damaged"), (good[:-8], "early"), (b"HTTP" + good, "no WARC")):
        with pytest.raises(ValueError, match=why):
            warc.parsed(pack(bad))


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert rows_of(warc.archived(pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", pages["page_id"] + 10_000)))) == sorted(
        brute(rows + [(i + 10_000, u, h) for i, u, h in rows if i % 3 == 0]), key=str
    )
