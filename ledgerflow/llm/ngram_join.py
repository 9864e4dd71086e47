"""N-gram Jaccard join of documents by PartEnum signatures.

Set sizes are cut into bands, each as wide as the threshold lets similar sets differ in
size. Between two sets whose larger one lies in a band at most k features differ. The
feature domain is cut into groups of `parts` parts, so many that one group has at most
`spare` differing features; of each group all subsets of parts - spare parts are
enumerated, and similar sets agree on one subset at least. A set signs in its own band
and in the next, where its larger partners are.

A subset without features would collide for unrelated sets, so it doesn't sign. There are
some groups to spare for that. A set that has still more such subsets signs in a second, independent cut of the domain as well, and with each pair of a
subset without features in the first cut and one in the second. Similar sets that share no
other signature must share such a pair.
"""

from __future__ import annotations

import functools
import itertools
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import near
from ledgerflow.llm.common import keep, spaced_words

_OTHER_CUT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PartEnum:
    """Signatures for 100 * intersection >= percent * union."""

    percent: int = 85
    parts: int = 2
    spare: int = 1

    def __call__(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        return [self.signatures(features) for features in sets]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        size = len(features)
        uppers = _uppers(self.percent)
        band = bisect_left(uppers, size)
        found = [self._signed(features, band, uppers[band])]
        if 100 * size // self.percent > uppers[band]:
            found.append(self._signed(features, band + 1, uppers[band + 1]))
        return np.concatenate(found)

    def _signed(self, features: np.ndarray, band: int, upper: int) -> np.ndarray:
        # |a ^ b| <= (1 - t) / (1 + t) * (|a| + |b|)
        differ = 2 * upper * (100 - self.percent) // (100 + self.percent)
        least = differ // (self.spare + 1) + 1
        # More groups than needed: similar sets agree in one group more for each of them, and
        # in one subset that isn't empty if either has no more empty subsets than that.
        extra = least // 30
        groups = least + extra
        base = near.mix(np.uint64([(band + 1) << 40]))[0]
        if differ == 0:
            return near.mix(np.add.reduce(features, dtype=np.uint64) + base[None])
        sums, counts = self._subsets(features, groups)
        numbers = np.arange(len(sums), dtype=np.uint64)
        empty = counts == 0
        out = near.mix(near.mix(sums) + numbers + base)[~empty]
        if empty.sum() <= extra:
            return out
        again, counts = self._subsets(np.sort(near.mix(features ^ _OTHER_CUT)), groups)
        empty_again = counts == 0
        tags = numbers[empty][:, None] * np.uint64(1 << 32) + numbers[empty_again][None, :]
        return np.concatenate(
            (
                out,
                near.mix(near.mix(again) + numbers + ~base)[~empty_again],
                near.mix(near.mix(tags.ravel() + base) + ~base),
            )
        )

    def _subsets(self, features: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the features of each enumerated subset; features are rising."""
        count = groups * self.parts
        part = ((features >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        ends = np.searchsorted(part, np.arange(count + 1, dtype=np.uint64))
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(features, dtype=np.uint64)))
        sums = (upto[ends[1:]] - upto[ends[:-1]]).reshape(groups, self.parts)
        counts = np.diff(ends).reshape(groups, self.parts)
        chosen = [list(c) for c in itertools.combinations(range(self.parts), self.parts - self.spare)]
        if self.parts - self.spare > 1:
            sums = near.mix(sums)  # parts must not be mistaken for each other
            weights = np.arange(1, 2 * self.parts, 2, dtype=np.uint64)
            sums = sums * weights
        return (
            np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) for c in chosen], axis=1).ravel(),
            np.stack([counts[:, c].sum(axis=1) for c in chosen], axis=1).ravel(),
        )


@functools.cache
def _uppers(percent: int) -> list[int]:
    """The largest size of each band, beyond any text's number of words."""
    found, low = [], 1
    while low < 1 << 40:
        found.append(100 * low // percent)
        low = found[-1] + 1
    return found


@dataclass(frozen=True)
class DocumentShingles:
    """Makes the function that takes a text's one unit: its set of word n-grams."""

    width: int

    def __call__(self) -> near.Cutter:
        hashes = near.WordHashes()

        def cut(text: bytes) -> list[near.Unit]:
            words = spaced_words(text)
            return [(0, len(words), near.shingles(hashes.of(words), self.width))]

        return cut


def join_documents(docs: DataFrame, width: int = 4, percent: int = 85, signatures: PartEnum | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two texts are linked when 100 * common >= percent * united shingles. Texts without words
    (null too) have no shingles and stand alone. Repeated rows come back repeated; rows of one
    doc_id with several texts keep a component for each text. A row without a doc_id is counted
    but takes no part in links, and its component is null. Features are 64-bit hashes of shingles.
    """
    cutter = DocumentShingles(width)
    units = keep(near.unit_rows(docs, cutter), "units")
    labels = near.connect(docs, units, cutter, signatures or PartEnum(percent), percent)
    joined = near.with_components(units, labels)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one row of each component, one with its smallest doc_id.

    Rows are told apart by doc_id and text, so a row goes only for what its own text is
    linked with. Rows without an id or without words stay; of repeated rows one stays.
    """
    cutter = DocumentShingles(width)
    units = keep(near.unit_rows(docs, cutter, text_hash=True), "units")
    labels = near.connect(docs, units, cutter, PartEnum(percent), percent)
    rows = units.where("key is not null and doc_id is not null").groupBy("key", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    named = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    # The smallest id first, then the smallest hash among the rows of that id.
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    judged = keep(
        named.join(first, "label").select(
            F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n",
            ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"),
        ),
        "judged",
    )
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(_small(judged.where("not stays").select("_id", "_hash")), same, "left_anti")
    repeated = judged.where("stays and n > 1").select("_id", "_hash")
    if repeated.isEmpty():
        return kept
    once = kept.join(_small(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(_small(repeated), same, "left_anti").unionByName(once)


def _small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Two numbers a row; up to `most` rows are sent to every executor."""
    return F.broadcast(rows) if rows.count() <= most else rows
