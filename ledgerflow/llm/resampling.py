"""Importance resampling of documents towards the benchmark's n-grams (operator 13).

Method: overlapped regex scanning. A text's separators are collapsed to single spaces;
`regex.finditer` with `overlapped=True` then gives the span of every run of words, whose
bytes go straight into the CRC. Bucket numbers of each text are written once; counts,
gains and weights are sums over that table.

Null and empty texts have no words, no features and weight 0. A missing doc_id is drawn
for as the empty text would be and sorts first among ties. Repeated rows are weighted and
ranked each. An empty target or an empty corpus has counts of 0; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import joined_plain_words, keep, map_slices, sliced, texts_as_bytes


class FeatureScan:
    """Runs of 1 to `most_words` consecutive words of a text, and their CRC buckets."""

    def __init__(self, most_words: int, buckets: int):
        self.buckets = buckets
        # The left boundary is the literal that the scan looks for, the right one a lookahead.
        self._patterns = [regex.compile(rb" ([^ ]+(?: [^ ]+){%d})(?= )" % n) for n in range(most_words)]

    def spans(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Places of all runs in `joined_plain_words(text)`, runs of one word first."""
        padded = b" %s " % joined_plain_words(text)
        for pattern in self._patterns:
            for match in pattern.finditer(padded, overlapped=True):
                yield match.start(1) - 1, match.end(1) - 1

    def hashed(self, text: bytes) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each run, repeats included, in ascending order."""
        words = joined_plain_words(text)
        if not words:
            return 0, np.empty(0, np.int64)
        padded = b" %s " % words
        parts = []
        for pattern in self._patterns:
            runs = map(itemgetter(1), pattern.finditer(padded, overlapped=True))
            parts.append(np.fromiter(map(zlib.crc32, runs), np.int64))
        found = np.concatenate(parts) % self.buckets
        found.sort()
        return words.count(b" ") + 1, found


def _number_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed_features(texts: DataFrame, id_column: str, most_words: int = 2, buckets: int = 10_000) -> DataFrame:
    """Per row of `texts`: id, n_words and `features`, the little-endian bucket numbers of its runs."""
    number = _number_type(buckets)

    def work():
        scan = FeatureScan(most_words, buckets)

        def batch(part: pa.RecordBatch) -> dict:
            found = [scan.hashed(text) for text in texts_as_bytes(part.column("text"))]
            return {
                "id": part.column("id"),
                "n_words": pa.array([n for n, _ in found], pa.int64()),
                "features": pa.array([own.astype(number).tobytes() for _, own in found], pa.binary()),
            }

        return batch

    rows = texts.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, work, "id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> list[int]:
    """How many runs fall into each bucket. Tasks count for themselves; at most `buckets` rows leave each."""
    number = _number_type(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in sliced(batches):
            joined = b"".join(part.column("features").to_pylist())
            total += np.bincount(np.frombuffer(joined, number), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    found = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in found.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    buckets, all_source, all_target = len(source), float(sum(source)), float(sum(target))
    return [
        math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(source, target, strict=True)
    ]


def weights(features: DataFrame, gains: list[int]) -> DataFrame:
    """Per row of `features`: id, n_words, n_features and weight, the floored mean of its runs' gains."""
    number = _number_type(len(gains))
    shared = features.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def work():
        gain = shared.value

        def batch(part: pa.RecordBatch) -> dict:
            rows = [np.frombuffer(own, number) for own in part.column("features").to_pylist()]
            return {
                "id": part.column("id"),
                "n_words": part.column("n_words"),
                "n_features": pa.array(map(len, rows), pa.int64()),
                "weight": pa.array([int(gain[own].sum()) // len(own) if len(own) else 0 for own in rows], pa.int64()),
            }

        return batch

    return map_slices(features, work, "id long, n_words long, n_features long, weight long")


def with_scores(weighted: DataFrame, seed: int = 7) -> DataFrame:
    """Adds `score`: the weight and Gumbel noise that follows from the seed and the id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + F.floor(noise).cast("long"))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds `rank` to the best `percent` of the rows of `least_words` words or more, ties to smaller ids.

    A range shuffle sorts the rows over all tasks; each part's rows are numbered on from
    those of the parts before, so no task sees more than its part.
    """
    fit = F.col("n_words") >= least_words
    numbered = keep(scored.withColumns({"fit": fit, "row": F.monotonically_increasing_id()}), "scored")
    ordered = numbered.orderBy(F.desc("fit"), F.desc("score"), F.asc("id"), F.asc("row"))
    # The id's upper bits are the number of the sorted part, the lower 33 the place in it.
    placed = keep(ordered.withColumn("place", F.monotonically_increasing_id()), "places").withColumns(
        {"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}
    )
    sizes = sorted((r["part"], r["n"], r["n_fit"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit")).collect())
    quota = percent * sum(n_fit for _, _, n_fit in sizes) // 100
    before, firsts = 0, []
    for part, n, _ in sizes:
        firsts.append((part, before))
        before += n
    first = F.broadcast(placed.sparkSession.createDataFrame(firsts, "part long, before long"))
    rank = F.col("before") + F.col("place") + 1
    # Rows that are fit come first, so that their places are their ranks.
    return placed.join(first, "part").withColumn("rank", F.when(F.col("fit") & (rank <= quota), rank))


def importance(
    docs: DataFrame,
    target: DataFrame,
    target_id: str = "item_id",
    most_words: int = 2,
    buckets: int = 10_000,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_features, weight, score and rank (null where it isn't drawn)."""
    features = keep(hashed_features(docs, "doc_id", most_words, buckets), "features", codec="zstd")
    wanted = hashed_features(target, target_id, most_words, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    found = ranked(with_scores(weights(features, gains), seed), percent, least_words)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs` with all their columns; rows that share a drawn id come together."""
    drawn = importance(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id"))
    return docs.join(drawn.distinct(), F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi")
