"""Substring dedup: paragraphs that repeat, by MinHash banding and exact verification.

A paragraph is a line of at least `least_words` words, its set the shingles of five words.
Bands of MinHash values bring together candidates; pairs are verified on the whole sets,
and of each component all but the first paragraph are to be removed.

A passage may also stand inside lines that differ otherwise. Such passages are found word
for word: shared windows of `least_words` + 1 words, wherever they begin. So that not every
window has to be compared, anchors come first: windows that are PICK_EVERY - 1 words
shorter, from the words on that a local minimum of hashes picks. Of every PICK_EVERY words
in a row at least one begins an anchor, so each whole window holds one, the same one in
equal windows. Only whole windows around an anchor that several texts hold are compared.

Equal texts are one class: only the first of them (by doc_id) is cut, signed and compared,
and what is found in it is then given to its copies. A whole text of several documents is
a passage of each of them, whichever of its windows stand elsewhere too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm import near
from ledgerflow.llm.common import SPACED, give_back, keep, map_slices, sliced, texts_as_bytes

PICK_EVERY = 8
#: Bounds of the filter of shared anchors; beyond the upper one more windows are compared, none less.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Anchors are compared by 42 bits: these of their bucket and 32 within it. Equal ones in one of two cost some windows more.
BUCKET_BITS = 10
#: Places by which an anchor is shifted for its second bit in that filter.
SECOND_BIT = 12
#: Anchors (4 bytes each as sent, 8 as held) that a task sorts together.
BLOCK_ANCHORS = 4_000_000
#: Rows of a side of a join up to which it is sent to every executor.
BROADCAST_ROWS = 4_000_000
#: Bytes of a text whose words are hashed together.
HASHED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = near.mix(near.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)))
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class MinHashBands:
    """`bands` signatures of `rows` MinHash values each.

    A pair of similarity s is missed with probability (1 - s ** rows) ** bands: at the
    defaults 3.5e-4 at 0.8 and 4e-8 at 0.9.
    """

    bands: int = 20
    rows: int = 5

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        features = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        found = np.tile(np.arange(self.bands, dtype=np.uint64), (len(sets), 1))
        for lane, seed in enumerate(near.mix(np.arange(1, self.bands * self.rows + 1, dtype=np.uint64) << np.uint64(20))):
            least = near.mix(np.minimum.reduceat((features ^ seed) * (seed | np.uint64(1)), starts))
            band = lane // self.rows
            found[:, band] = near.mix(found[:, band] + least)
        return found


def _differ(values: np.ndarray, back: int = 1) -> np.ndarray:
    """Which values are not equal to the one `back` places before."""
    return np.concatenate((np.ones(min(back, len(values)), bool), values[back:] != values[:-back]))


@functools.cache
def _powers(base: int) -> np.ndarray:
    return _power_row(base, HASHED_BYTES)


def _power_row(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(size - 1, 0), base, np.uint64))))


def _first_powers(base: int, size: int) -> np.ndarray:
    return _powers(base)[:size] if size <= HASHED_BYTES else _power_row(base, size)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z in lower case: their hashes and where they stand, from all bytes at once."""

    def __init__(self, text: bytes):
        self.letters = np.frombuffer(text.translate(SPACED), np.uint8)
        gap = np.concatenate(([True], _IS_GAP[self.letters], [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.begins, self.ends = edges[::2], edges[1::2]
        self.ascii = text.isascii()

    def __len__(self) -> int:
        return len(self.begins)

    def hashes(self) -> np.ndarray:
        found = np.empty(len(self), np.uint64)
        at = 0
        while at < len(found):
            begin = self.begins[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + HASHED_BYTES, "right")))
            size = int(self.ends[to - 1] - begin)
            upto = np.zeros(size + 1, np.uint64)
            np.cumsum(_OF_BYTE[self.letters[begin : begin + size]] * _first_powers(_BASE, size), out=upto[1:])
            first, last = self.begins[at:to] - begin, self.ends[at:to] - begin
            own = (upto[last] - upto[first]) * _first_powers(_BASE_INVERSE, size)[first]
            found[at:to] = near.mix(own + (last - first).astype(np.uint64))
            at = to
        return found

    def characters(self, places: np.ndarray) -> np.ndarray:
        """How many characters stand before each of some bytes."""
        if self.ascii:
            return places
        return np.concatenate(([0], np.cumsum((self.letters & 0xC0) != 0x80)))[places]


@dataclass(frozen=True)
class ParagraphShingles:
    width: int
    least_words: int

    def __call__(self) -> near.Cutter:
        return self._cut

    def _cut(self, text: bytes) -> list[near.Unit]:
        if len(text) < 2 * self.least_words - 1:
            return []
        words = Words(text)
        breaks = np.flatnonzero(words.letters == 0x0A)
        edges = np.concatenate(([0], np.searchsorted(words.begins, breaks), [len(words)]))
        long = np.flatnonzero(np.diff(edges) >= self.least_words)
        if not len(long):
            return []
        hashes = words.hashes()
        # The shingles of all lines at once, and of each line those that lie in it.
        size = max(len(hashes) - self.width + 1, 0)
        joined = hashes[:size]
        for i in range(1, self.width):
            joined = near.mix(joined) + hashes[i : size + i]
        joined = near.mix(joined + np.uint64(self.width))
        starts = words.characters(np.concatenate(([0], breaks + 1))[long]).tolist()
        ends = words.characters(np.concatenate((breaks, [len(text)]))[long]).tolist()
        found = []
        for line, start, end in zip(long, starts, ends, strict=True):
            at, to = edges[line], edges[line + 1]
            if to - at < self.width:
                found.append((start, end, near.shingles(hashes[at:to], self.width)))
                continue
            own = np.sort(joined[at : to - self.width + 1])
            found.append((start, end, own[_differ(own)]))
        return found


@dataclass(frozen=True)
class _Texts:
    """One row of each text.

    rows: doc_id, high (the largest doc_id of its text), part and text of the first row of each
    text; part tells texts of one doc_id apart. classes: text_hash, low, high and part of texts
    that documents with different ids hold, `low` being the first. copies: text_hash, doc_id,
    low and part of each row that was left out.
    """

    rows: DataFrame
    classes: DataFrame
    copies: DataFrame


def _one_of_each(docs: DataFrame, least_words: int) -> _Texts:
    """Texts too short to have so many words take no part."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    rows = rows.where(f"doc_id is not null and octet_length(text) >= {2 * least_words - 1}").withColumn("text_hash", F.xxhash64("text"))
    hashes = keep(rows.select("doc_id", "text_hash"), "texts")
    each = hashes.distinct()
    several = each.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    numbered = F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash"))
    parts = each.join(several.select("doc_id"), "doc_id", "left_semi").withColumn("part", numbered)
    parts = keep(parts, "parts")
    classes = each.groupBy("text_hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    classes = classes.join(parts.withColumnRenamed("doc_id", "low"), ["low", "text_hash"], "left")
    classes = keep(classes.select("text_hash", "low", "high", F.coalesce("part", F.lit(0)).alias("part")), "classes")

    repeated = hashes.join(_sent(classes), "text_hash")
    copies = repeated.where("doc_id > low").select("text_hash", "doc_id", "low", "part")
    # What is to be known of a row when its text is read: whether it is left out, and its class.
    odd = each.join(_sent(classes.drop("part")), "text_hash", "left").join(parts, ["doc_id", "text_hash"], "left")
    odd = odd.where("low is not null or part is not null")
    odd = keep(odd.select(F.xxhash64("doc_id", "text_hash").alias("row_hash"), "low", "high", "part"), "repeated")
    rows = rows.withColumn("row_hash", F.xxhash64("doc_id", "text_hash")).join(_sent(odd), "row_hash", "left")
    rows = rows.where("low is null or low = doc_id")
    named = rows.select("doc_id", F.coalesce("high", "doc_id").alias("high"), F.coalesce("part", F.lit(0)).alias("part"), "text")
    return _Texts(named, classes, copies)


def _sent(frame: DataFrame) -> DataFrame:
    """A kept table, sent to every executor in joins while it is small: no task gets all rows of a common key."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def repeated_paragraphs(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = 50) -> DataFrame:
    """One row per paragraph with near copies elsewhere, and one per passage that other documents hold too.

    kind (paragraph or passage), doc_id, start and end (characters, end exclusive), group_id,
    component_id (the smallest doc_id of the group), n_copies and removed: false for the first
    place (by doc_id, then start) of a group. n_copies is counted for paragraphs, null for
    passages. A repeated paragraph may come back as a passage as well. Null and empty texts have
    neither, rows without a doc_id take no part; repeated rows hold copies of each other's
    paragraphs, but a passage must stand in documents with different ids.
    """
    texts = _one_of_each(docs, least_words)
    passages = _passages(texts, least_words + 1)
    return _paragraphs(texts, width, percent, least_words).unionByName(passages, allowMissingColumns=True)


def _paragraphs(texts: _Texts, width: int, percent: int, least_words: int) -> DataFrame:
    cutter = ParagraphShingles(width, least_words)
    units = keep(near.unit_rows(texts.rows, cutter, text_hash=True), "paragraphs")
    labels = near.connect(texts.rows, units, cutter, MinHashBands(), percent)
    classes = units.select("key").distinct().join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("group_id"))
    again = units.join(_sent(texts.classes), "text_hash", "left_semi").drop("doc_id").distinct()
    columns = ("doc_id", "start", "end", "key")
    copied = texts.copies.select("text_hash", "doc_id").join(_sent(keep(again, "again")), "text_hash")
    named = units.select(*columns).union(copied.select(*columns)).join(classes, "key")
    # The first place and the size of a group come from partial sums: a group has no bound.
    groups = named.groupBy("group_id").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n_copies"))
    found = named.join(groups.where("n_copies > 1"), "group_id")
    return found.select(
        F.lit("paragraph").alias("kind"),
        "doc_id",
        "start",
        "end",
        "group_id",
        F.col("first.doc_id").alias("component_id"),
        "n_copies",
        F.expr("struct(doc_id, start) <> first").alias("removed"),
    )


def repeated_passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """kind, doc_id, start, end, group_id, component_id and removed of passages of `words` words or more.

    Overlapping windows of a document are one passage, removed if any of them stands in an
    earlier document. The component is the smallest doc_id that holds one of them, the group
    the least of their hashes: places of one passage where still more is equal may differ in it.
    """
    return _passages(_one_of_each(docs, words), words)


def _passages(texts: _Texts, words: int) -> DataFrame:
    windows = _shared_windows(texts, words)
    spans = windows.withColumnsRenamed({"key": "group_id", "first": "component_id"}).withColumn("removed", F.expr("doc_id <> component_id"))
    runs = keep(_merged(spans, "doc_id", "part"), "runs")
    # A text of several documents is one run.
    wholes = runs.withColumnRenamed("doc_id", "low").join(_sent(texts.classes), ["low", "part"], "left_semi").drop("removed")
    copied = texts.copies.drop("text_hash").join(_sent(keep(wholes, "wholes")), ["low", "part"]).withColumn("removed", F.lit(True))
    found = _merged(runs.drop("part").unionByName(copied.drop("low", "part")), "doc_id")
    return found.select(F.lit("passage").alias("kind"), "doc_id", "start", "end", "group_id", "component_id", "removed")


def _shared_windows(texts: _Texts, words: int) -> DataFrame:
    """key, doc_id, part, whole, start, end and first: windows that several documents hold, and the first of these.

    A text of several documents stands here as one row, with the least of its windows' keys (whole),
    besides those of its windows that other texts hold too.
    """
    blocks = texts.rows.select("text").mapInArrow(_anchor_blocks(words), "bucket int, block binary")
    anchors = keep(blocks.groupBy("bucket").applyInArrow(_in_several_texts, "key long"), "anchors")
    filter_ = _key_filter(anchors)
    schema = "key long, doc_id long, high long, part int, whole boolean, start long, end long"
    windows = keep(map_slices(texts.rows, lambda: _window_batch(words, filter_.value), schema), "windows")
    shared = windows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("high").alias("last")).where("first < last")
    return windows.drop("high").join(shared.drop("last"), "key")


def _merged(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping spans (of one value of `by`) as one, with the least group_id and component_id, and removed if any was."""
    named = (F.min("group_id").alias("group_id"), F.min("component_id").alias("component_id"), F.bool_or("removed").alias("removed"))
    return _merged_places(spans, by, *named)


def _merged_places(spans: DataFrame, by: Sequence[str], *named: Column) -> DataFrame:
    own = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("begins", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *named).drop("run")


def _key_filter(keys: DataFrame) -> Broadcast:
    """Two bits for each of the keys, as a broadcast array: no key is missed, few others pass."""
    bits = 1 << min(max(16 * keys.count(), LEAST_BITS).bit_length(), MOST_BITS.bit_length() - 1)
    # One row per 64 bits at most.
    each = F.explode(F.expr(f"array(key & {bits - 1}L, shiftright(key, {SECOND_BIT}) & {bits - 1}L)"))
    parts = keys.select(each.alias("bit")).groupBy(F.expr("bit div 64").alias("at"))
    found = parts.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(held)


def _passes(held: np.ndarray, key: np.ndarray) -> np.ndarray:
    found = np.ones(len(key), bool)
    for shift in (0, SECOND_BIT):
        bit = key >> np.uint64(shift) & np.uint64(64 * len(held) - 1)
        found &= (held[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _short(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(32 - BUCKET_BITS)


def _anchor_blocks(words: int):
    """Rising anchors of the texts of a task, four bytes each, by bucket: once those of one text, twice those of several."""

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
        keys = keys[_differ(keys, 2)]
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(_differ(bucket))
        low = keys.astype(np.uint32)
        parts = [low[at:to].tobytes() for at, to in zip(starts, np.append(starts, len(keys))[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for part in sliced(batches):
            for text in texts_as_bytes(part.column("text")):
                own = Words(text)
                if len(own) >= words:
                    held.append(np.unique(_short(picked_windows(own.hashes(), words - PICK_EVERY + 1)[1])))
                    count += len(held[-1])
            if count >= BLOCK_ANCHORS:
                yield blocks(held)
                held, count = [], 0
        yield blocks(held)
        del held
        give_back()

    return run


def _in_several_texts(part: pa.Table) -> pa.Table:
    """The anchors of a bucket that stand there twice."""
    keys = np.sort(np.frombuffer(b"".join(part.column("block").to_pylist()), np.uint32))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]]).astype(np.int64)
    return pa.table({"key": pa.array(twice + (part.column("bucket")[0].as_py() << 32), pa.int64())})


def _window_batch(words: int, held: np.ndarray):
    def batch(part: pa.RecordBatch) -> dict:
        names = ("key", "doc_id", "high", "part", "whole", "start", "end")
        columns: list[list[np.ndarray]] = [[] for _ in names]
        given = zip(*[part.column(name).to_pylist() for name in ("doc_id", "high", "part")], texts_as_bytes(part.column("text")), strict=True)
        for doc_id, high, number, text in given:
            own = Words(text)
            if len(own) < words:
                continue
            hashed = own.hashes()
            lowest = lowest_places(hashed)
            anchor, key = picked_windows(hashed, words - PICK_EVERY + 1, lowest)
            # A window's own anchor is the first that is picked in it: the lowest of its first places.
            every = np.arange(len(own) - words + 1)
            at = every[_passes(held, _short(key))[np.searchsorted(anchor, lowest[: len(every)])]]
            key = _window_keys(hashed, at, words).view(np.int64)
            starts, ends = own.characters(own.begins[at]), own.characters(own.ends[at + words - 1])
            if whole := high > doc_id:
                key = np.append(key, _window_keys(hashed, every, words).view(np.int64).min())
                edges = own.characters(np.array([own.begins[0], own.ends[-1]]))
                starts, ends = np.append(starts, edges[0]), np.append(ends, edges[1])
            rows = len(key)
            values = (key, np.full(rows, doc_id), np.full(rows, high), np.full(rows, number), np.arange(rows) >= rows - whole, starts, ends)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        types = {"part": pa.int32(), "whole": pa.bool_()}
        return {
            name: pa.array(np.concatenate(column) if column else [], types.get(name, pa.int64()))
            for name, column in zip(names, columns, strict=True)
        }

    return batch


def lowest_places(hashes: np.ndarray) -> np.ndarray:
    """Of each PICK_EVERY words in a row, the first with the lowest hash of it and the two words behind it."""
    local = hashes[:-2]
    for i in (1, 2):
        local = near.mix(local) + hashes[i : len(hashes) - 2 + i]
    local = near.mix(local)
    lowest = np.lib.stride_tricks.sliding_window_view(local, PICK_EVERY).argmin(axis=1)
    return lowest + np.arange(len(lowest))


def picked_windows(hashes: np.ndarray, words: int, lowest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words of the picked windows, and a hash of each window's words in order."""
    at = lowest_places(hashes) if lowest is None else lowest
    # They never go back.
    at = at[_differ(at) & (at + words <= len(hashes))]
    return at, _window_keys(hashes, at, words)


def _window_keys(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    powers, back = (_first_powers(base, len(hashes)) for base in (_BASE, _BASE_INVERSE))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(near.mix(hashes) * powers)))
    return near.mix((upto[at + words] - upto[at]) * back[at])


def remove_repeated_paragraphs(docs: DataFrame, width: int = 5, percent: int = 80, least_words: int = 50) -> DataFrame:
    """`docs` without removed paragraphs and passages (and the character behind each, a break or space).

    A document's spans come back to it as one list; rows that share a doc_id are cut alike.
    """
    columns = ("doc_id", "start", "end")
    texts = _one_of_each(docs, least_words)
    paragraphs = _paragraphs(texts, width, percent, least_words).where("removed").select(*columns)
    windows = keep(_shared_windows(texts, least_words + 1), "shared")
    # Windows that stand here first are kept, also where they touch removed ones; copies go as a whole.
    own = windows.where("doc_id <> first and not whole").select(*columns, "part")
    wholes = keep(windows.where("whole").selectExpr("doc_id as low", "part", "start", "end").distinct(), "wholes")
    passages = own.drop("part").union(texts.copies.join(_sent(wholes), ["low", "part"]).select(*columns))
    passages = _merged_places(passages, ["doc_id"]).select(*columns)
    spans = paragraphs.union(passages).groupBy(F.col("doc_id").alias("cut_id"))
    spans = spans.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    kept = """aggregate(spans, struct('' as done, 0L as at),
        (s, x) -> struct(concat(s.done, substring(text, int(s.at + 1), int(greatest(x.start - s.at, 0)))) as done, greatest(s.at, x.end + 1) as at),
        s -> concat(s.done, substring(text, int(s.at + 1), 2147483647)))"""
    joined = docs.join(spans, F.col("doc_id") == F.col("cut_id"), "left")
    return joined.withColumn("text", F.expr(f"case when spans is null then text else {kept} end")).select(*docs.columns)
