"""Benchmark decontamination with an FM-index per shard of documents.

A shard is one Arrow batch. Its words become numbers of the benchmark's vocabulary;
any other word can't be part of a match and ends a run, and runs shorter than the
shortest window are left out, which loses nothing. Over the runs a suffix array is
sorted, its Burrows-Wheeler transform put into a wavelet tree, and all windows are
searched backwards together. Occurrences are located by walking to sampled suffix
positions, and the words they cover are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import filter_slices, keep, map_slices, plain_words, texts_as_bytes

#: Every so many text positions the suffix array is kept.
SAMPLE_EVERY = 8
#: Characters of benchmark text that one search holds; more text is searched in several blocks.
BLOCK_CHARS = 16_000_000
SHARD_ROWS = 4000


class WaveletTree:
    """Rank over a sequence of numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        # Where a symbol's block begins on the last level.
        self.begin = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, upto) - self.begin[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol, at - self.begin[symbol]


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence, by doubling; its last value must be its only 0."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    size, step = len(values), 1
    while True:
        follow = np.full(size, -1, np.int64)
        follow[: size - step] = rank[step:]
        key = rank * (size + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(size, np.int64)
        rank[order] = new
        if new[-1] == size - 1:
            return order
        step *= 2


class FmIndex:
    """Backward search over numbers from 1; 0 is kept for the end."""

    def __init__(self, values: np.ndarray, symbols: int):
        text = np.concatenate((values, [0])).astype(np.int64)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], symbols)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:symbols]
        self.size = len(text)
        sampled = order % SAMPLE_EVERY == 0
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of each pattern; patterns fill their rows from the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, width - 1 - step]
            low[on] = self.below[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.below[symbol] + self.tree.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk towards the front until a sampled one."""
        found = np.empty(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            here = self.sampled_before[at + 1] > self.sampled_before[at]
            found[left[here]] = self.positions[self.sampled_before[at[here]]] + walked
            left, at = left[~here], at[~here]
            if len(left):
                symbol, rank = self.tree.symbol_and_rank(at)
                at, walked = self.below[symbol] + rank, walked + 1
        return found


@dataclass
class Windows:
    """Distinct windows of benchmark items, with the items of each."""

    words: dict[bytes, int] = field(default_factory=dict)
    patterns: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple], width: int) -> Windows:
        """From (item_id, text); an item of fewer words is one window, one of none has no window."""
        words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item_id, text in rows:
            numbers = [words.setdefault(w, len(words) + 1) for w in plain_words((text or "").encode())]
            for at in range(max(len(numbers) - width, 0) + 1 if numbers else 0):
                found.setdefault(tuple(numbers[at : at + width]), set()).add(item_id)
        patterns = np.zeros((len(found), max(map(len, found), default=1)), np.int64)
        for i, window in enumerate(found):
            patterns[i, patterns.shape[1] - len(window) :] = window
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return cls(words, patterns, lengths, [tuple(sorted(i for i in ids if i is not None)) for ids in found.values()])


def search_shard(texts: Iterable[bytes], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
    """Number of words, merged spans of hit words, and items with occurring windows, of each text.

    Words are numbered text by text: of a shard's words only the numbers are held.
    """
    known = windows.words.get
    gap = len(windows.words) + 1
    parts: list[np.ndarray] = []
    for text in texts:
        words = plain_words(text)
        words.append(b"")  # no word is empty: a gap behind each text
        parts.append(np.fromiter((known(word, gap) for word in words), np.int32, len(words)))
    n_words = [len(part) - 1 for part in parts]
    spans: list[list[tuple[int, int]]] = [[] for _ in parts]
    items: list[set] = [set() for _ in parts]
    if not len(windows.lengths) or not parts:
        return n_words, spans, items
    shortest = int(windows.lengths.min())
    starts = np.cumsum([0, *map(len, parts)])
    numbers = np.concatenate(parts)
    # Runs of known words; those that no window fits into go.
    edges = np.flatnonzero(np.diff(np.concatenate(([True], numbers == gap, [True])).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    long = last - first >= shortest
    first, last = first[long], last[long]
    if not len(first):
        return n_words, spans, items
    sizes = last - first + 1  # each run with the gap behind it
    ends = np.cumsum(sizes)
    original = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
    index = FmIndex(numbers[original], gap + 1)
    low, high = index.search(windows.patterns, windows.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    at = original[index.locate(rows)]
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + windows.lengths[which], -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(depth) > 0).astype(np.int8), [0]))))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        text = int(np.searchsorted(starts, begin, side="right")) - 1
        spans[text].append((begin - int(starts[text]), end - int(starts[text])))
    found = np.unique(np.stack((np.searchsorted(starts, at, side="right") - 1, which)), axis=1)
    for text, window in found.T.tolist():
        items[text].update(windows.items[window])
    return n_words, spans, items


def _texts(part: pa.RecordBatch) -> Iterator[bytes]:
    """The shard's texts a hundred at a time, so that few of them are held as Python's bytes."""
    column = part.column("text")
    for at in range(0, len(column), 100):
        yield from texts_as_bytes(column.slice(at, 100))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, merged spans of hit words (start, end) and item ids.

    Null or empty texts have no words and no hits; items without words have no windows;
    an item without an id hits words but isn't listed. Repeated documents are searched
    each, repeated items count once. With an empty benchmark nothing is hit. Benchmarks
    above `block_chars` are searched block by block and the blocks' spans united.
    """
    items, blocks = _blocks(benchmark, block_chars)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    if blocks == 1:
        return _search(rows, items.collect(), width, numbered=False)
    # Written once, so that a row has the same number in the search of each block.
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return _united(items, blocks, rows, width).select("doc_id", "n_words", "spans", "items")


def _united(items: DataFrame, blocks: int, rows: DataFrame, width: int) -> DataFrame:
    """row, doc_id, n_words, spans and items of numbered rows, found block by block."""
    parts = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = _search(rows, own, width, numbered=True)
        parts = part if parts is None else parts.unionByName(part)
    # A row comes once from each block.
    united = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    joined = """aggregate(spans, cast(array() as array<struct<start: long, end: long>>), (done, s) ->
        case when size(done) > 0 and s.start <= element_at(done, -1).end
             then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
             else concat(done, array(s)) end)"""
    return united.select("row", "doc_id", "n_words", F.expr(joined).alias("spans"), "items")


def _search(rows: DataFrame, items: list, width: int, numbered: bool) -> DataFrame:
    windows = Windows.of([(row["item_id"], row["text"]) for row in items], width)
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            n_words, spans, found = search_shard(_texts(part), shared.value)
            return {
                "doc_id": part.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], _SPANS),
                "items": pa.array([sorted(map(str, own)) for own in found], pa.list_(pa.string())),
            } | ({"row": part.column("row")} if numbered else {})

        return batch

    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    return map_slices(rows, work, schema + ", row long" * numbered, SHARD_ROWS)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row."""
    return _digest(find_contamination(docs, benchmark), "doc_id")


def _digest(found: DataFrame, *own: str) -> DataFrame:
    counted = found.select(
        *own,
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.expr("cast(size(items) as long)").alias("n_items"),
        F.sha2(F.expr("array_join(array_sort(items), ',')"), 256).alias("items_sha256"),
    )
    return counted.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


_ROW = "_numbered_row"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` without contaminated rows, each row judged by its own text; every column stays as it is.

    The number of blocks that a benchmark makes changes nothing but the way: with several,
    rows are numbered in a written table and judged by what all blocks have found.
    """
    items, blocks = _blocks(benchmark, block_chars)
    if blocks > 1:
        numbered = keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
        rows = numbered.select(F.col(_ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        bad = _digest(_united(items, blocks, rows, 13), "row").where("contaminated")
        return numbered.join(bad, F.col(_ROW) == F.col("row"), "left_anti").drop(_ROW)
    windows = Windows.of([(row["item_id"], row["text"]) for row in items.collect()], 13)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def clean(part: pa.RecordBatch) -> list[bool]:
        n_words, spans, _ = search_shard(_texts(part), shared.value)
        hits = (sum(end - start for start, end in own) for own in spans)
        return [not n or 20 * n < words for n, words in zip(hits, n_words, strict=True)]

    return filter_slices(docs, lambda: clean, SHARD_ROWS)


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The items, and the number of blocks of at most about `block_chars` that they make."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, -(-size // block_chars) or 1
