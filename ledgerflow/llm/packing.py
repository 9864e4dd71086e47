"""Harmonic packing of token sequences.

A class k holds pieces that fit k times into a sequence, and each of its bins takes
exactly k of them. Documents are cut where that leaves little padding: a rest that
nearly fills its class stays whole, any other rest gives one full piece of the next
smaller class and goes on. Bins are filled apart within (class, worker bucket), so
buckets share nothing; the number of buckets of a class follows its piece count. The
bins that a bucket leaves open, one for each class at most, are put into each other.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import keep, map_slices

#: Words and other parts of chunks whose ids a worker remembers, and the longest of them.
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
#: A word of plain letters (those below U+0100) and the stops behind it.
_WORD_AND_STOPS = (
    rf"^(?P<word>[A-Za-z\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{FF}}]{{1,{LONGEST_REMEMBERED}}})(?P<rest>[.,]*)$"
)
#: Texts whose chunks are looked up together.
TEXTS_AT_ONCE = 200
#: Pieces that one bucket of a class takes, at least; a bucket leaves one bin unfilled at most.
BUCKET_PIECES = 4096


def harmonic_classes(capacity: int) -> list[int]:
    """Counts per bin, rising: all up to 32, then doubling steps, and single ids at the end."""
    counts = [*range(1, 33), 48, *(2**i for i in range(6, 40))]
    return sorted({k for k in counts if k < capacity} | {capacity})


def cut_lengths(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces in order; each fits its class with at most

    `slack` ids, or a 64th of the piece, to spare.
    """
    units = sorted((capacity // k, k) for k in harmonic_classes(capacity))
    units = [u for i, u in enumerate(units) if i == 0 or units[i - 1][0] != u[0]]
    sizes = [u for u, _ in units]
    pieces = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        at = bisect_left(sizes, rest)
        spare = sizes[at] - rest
        if spare and spare > max(slack, sizes[at] // 64):
            at -= 1
        pieces.append((min(rest, sizes[at]), units[at][1]))
        rest -= pieces[-1][0]
    return pieces


class Remembered(dict):
    """Remembers about `most` keys: those of the last half, and of those before that what was asked for since."""

    def __init__(self, most: int):
        super().__init__()
        self._most = most // 2
        self._older: dict = {}

    def missing(self, keys: set) -> list:
        """Keys that aren't remembered; the others are here until the next call."""
        if len(self) > self._most:
            self._older = dict(self)
            self.clear()
        # A set minus a dict's keys would go through all of the dict.
        asked = {key for key in keys if key not in self}
        again = {key for key in asked if key in self._older}
        self.update((key, self._older[key]) for key in again)
        return [*(asked - again)]


class ChunkIds:
    """Ids of space-separated chunks as little-endian bytes.

    The tokenizer drops white space and its pattern never crosses it, so a text's
    ids are those of its chunks in order. A chunk of letters with stops behind it
    is its lower-case word and its stops; words are encoded once each, many at a
    time, and told apart by the mark on a word's last piece. Chunks are split, told
    apart and put together again as whole columns: Python handles each word of a
    group of texts once.
    """

    def __init__(self, tokenizer: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer)
        size = self._tokenizer.get_vocab_size()
        last = (self._tokenizer.id_to_token(i) or "" for i in range(size))
        self._is_last = np.fromiter((token.endswith("</w>") for token in last), bool, size)
        # No rest is a word, so one memory holds both.
        self._known = Remembered(remembered)

    def join(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null has none."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, _WORD_AND_STOPS)
        words = pc.utf8_lower(pc.struct_field(parts, "word")).dictionary_encode()
        rests = pc.coalesce(pc.struct_field(parts, "rest"), chunks.dictionary).dictionary_encode()
        named, left = (column.dictionary.to_numpy(zero_copy_only=False).tolist() for column in (words, rests))

        keys = [*named, *left]
        ids = [*map(self._known.get, keys)]
        absent = [at for at, found in enumerate(ids) if found is None]
        new = set(self._known.missing({keys[at] for at in absent}))
        self._encode_words([keys[at] for at in absent if at < len(named) and keys[at] in new])
        self._encode_rests([keys[at] for at in absent if at >= len(named) and keys[at] in new])
        for at in absent:
            ids[at] = self._known[keys[at]]
            if len(keys[at]) > LONGEST_REMEMBERED:
                del self._known[keys[at]]
        ids.append(b"")

        # First the ids of each distinct chunk (its word, if any, and its rest), then those of the texts.
        word_at = pc.fill_null(words.indices, len(ids) - 1).to_numpy(zero_copy_only=False)
        both = np.stack((word_at, rests.indices.to_numpy() + len(named)), axis=1).ravel()
        flat, sizes = _gathered(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, both)
        flat, sizes = _gathered(flat, sizes.reshape(-1, 2).sum(axis=1), chunks.indices.to_numpy())
        upto = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        whole = memoryview(flat.tobytes())
        return [bytes(whole[4 * start : 4 * end]) for start, end in zip(upto, upto[1:], strict=False)]

    def _encode_words(self, new: list[str]) -> None:
        groups = [new[at : at + 1000] for at in range(0, len(new), 1000)]
        coded = self._tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if groups else []
        for group, encoding in zip(groups, coded, strict=True):
            ids = np.asarray(encoding.ids, "<u4")
            ends = (4 * (np.flatnonzero(self._is_last[ids]) + 1)).tolist()
            whole, start = ids.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self._known[word] = whole[start:end]
                start = end

    def _encode_rests(self, new: list[str]) -> None:
        coded = self._tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self._known.update((rest, np.asarray(e.ids, "<u4").tobytes()) for rest, e in zip(new, coded, strict=True))


def _gathered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes behind each other: those that `order` names, and their sizes."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[order]
    ends = np.cumsum(own)
    return flat[np.repeat(starts[order] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], own


@functools.cache
def _chunk_ids(tokenizer: str, remembered: int) -> ChunkIds:
    """One per worker process: what it remembers serves the tasks that follow."""
    return ChunkIds(tokenizer, remembered)


def _joined(texts: pa.Array, ids_of: ChunkIds) -> Iterator[bytes]:
    """The ids of each text; the chunks of `TEXTS_AT_ONCE` texts are held at a time."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        yield from ids_of.join(texts.slice(at, TEXTS_AT_ONCE))


def document_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, slack: int, remembered: int = REMEMBERED, across_tasks: bool = True
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and class of each piece."""

    def work():
        ids_of = _chunk_ids(tokenizer, remembered) if across_tasks else ChunkIds(tokenizer, remembered)
        end = np.asarray([end_id], "<u4").tobytes()
        plans: dict[int, list[tuple[int, int]]] = {}

        def batch(part: pa.RecordBatch) -> dict:
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), _joined(part.column("text"), ids_of), strict=True):
                whole = memoryview(ids + end)
                total, start = len(whole) // 4, 0
                tail = total % capacity
                if tail not in plans:
                    plans[tail] = cut_lengths(tail, capacity, slack)
                for length, k in [(capacity, 1)] * (total // capacity) + plans[tail]:
                    crc = zlib.crc32(whole[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, total, k))
                    start += length
            columns = list(zip(*rows, strict=True))
            return {
                name: pa.array(values, pa.int64())
                for name, values in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"), columns, strict=True)
            }

        return batch

    columns = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long"
    return map_slices(columns, work, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    slack: int = 8,
    bucket_pieces: int = BUCKET_PIECES,
    remembered: int = REMEMBERED,
    across_tasks: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of a document (its text's ids, then `end_id`) lies in exactly one piece and
    no sequence exceeds `capacity`. Null and empty texts are the end id alone; repeated
    rows are packed each; a null doc_id stays null. An empty table gives no rows.
    `remembered` trades memory for time and changes no result; without `across_tasks` a
    worker forgets at the end of each task, and has that memory for other work.
    """
    spark = docs.sparkSession
    pieces = keep(document_pieces(docs, tokenizer, capacity, end_id, slack, remembered, across_tasks), "packing-pieces")
    # At most one row for each class, of which there are few: they decide the buckets.
    counts = pieces.groupBy("class").count().collect()
    buckets = {row["class"]: -(-row["count"] // max(bucket_pieces, 64 * row["class"])) for row in counts}
    table = spark.createDataFrame(sorted(buckets.items()) or [(1, 1)], "class long, buckets long")
    dealt = pieces.join(F.broadcast(table), "class").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    )
    # Spark gives no order among equal rows: none of the columns below tells them apart either.
    within = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    binned = dealt.withColumn("place", F.row_number().over(within)).withColumn("bin", F.expr("(place - 1) div class"))
    own = ["class", "bucket", "bin"]
    every = Window.partitionBy(*own)
    before = every.orderBy("doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumns(
        {
            "offset": F.coalesce(F.sum("length").over(before), F.lit(0)),
            "filled": F.sum("length").over(every),
            "open": F.count("*").over(every) < F.col("class"),
        }
    )
    # A class and bucket leave one bin open at most, so a bucket has fewer of them than there are classes.
    rests = placed.where("open").select(*own, "filled").distinct()
    moves = rests.groupBy("bucket").applyInPandas(
        lambda bins: _joined_bins(bins, capacity), "class long, bucket long, bin long, host_class long, host_bin long, shift long"
    )
    moved = placed.join(moves, own, "left")
    numbers = F.array(*[F.lit(k).cast("long") for k in harmonic_classes(capacity)])
    host_class, host_bin = F.coalesce("host_class", "class"), F.coalesce("host_bin", "bin")
    return moved.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        # Classes are numbered; each takes 2^48 ids, a bucket 2^22 of them.
        (F.array_position(numbers, host_class) * F.lit(1 << 48) + F.col("bucket") * F.lit(1 << 22) + host_bin).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"),
    )


def _joined_bins(bins: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Open bins put into each other, largest first, each into the first one with room."""
    hosts: list[list] = []  # class, bin, filled
    rows = []
    for own in bins.sort_values(["filled", "class"], ascending=[False, True]).itertuples(index=False):
        k, bucket, number, filled = own
        host = next((h for h in hosts if h[2] + filled <= capacity), None)
        if host is None:
            host = [k, number, 0]
            hosts.append(host)
        rows.append((k, bucket, number, host[0], host[1], host[2]))
        host[2] += filled
    return pd.DataFrame(rows, columns=["class", "bucket", "bin", "host_class", "host_bin", "shift"])
