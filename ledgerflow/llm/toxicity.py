"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= j) = sigmoid(cut_j - w.x): all thresholds share the weights w of sparse text
features, and the expected grade is the severity. Features are the counts, on a log
scale, of words that occur much more often in texts labelled toxic. The model is fitted
on a bounded sample of labelled rows; scoring covers every word of every text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import filter_slices, map_slices, plain_words, texts_as_bytes

#: Bound of the fit: labelled rows (those with the smallest hashed ids). It bounds the words of the model too.
TRAIN_ROWS = 20_000
#: Occurrences of marked words from which a toxic text has grade 2 and grade 3.
GRADE_COUNTS = (2, 5)


@dataclass(frozen=True)
class SparseRows:
    """A matrix of few values other than zero; it can be multiplied by a vector from the right."""

    shape: tuple[int, int]
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.column], self.shape[0])

    @property
    def T(self) -> SparseRows:  # noqa: N802
        return SparseRows(self.shape[::-1], self.column, self.row, self.value)


@dataclass(frozen=True)
class OrdinalModel:
    words: tuple[bytes, ...]
    weights: np.ndarray
    cuts: np.ndarray

    def features(self, counts: list[dict[int, int]]) -> SparseRows:
        row = np.repeat(np.arange(len(counts)), [len(own) for own in counts])
        column = np.array([column for own in counts for column in own], np.int64)
        n = np.array([n for own in counts for n in own.values()], np.float64)
        return SparseRows((len(counts), len(self.words)), row, column, 1 + np.log2(n) / 2)

    def above(self, x: SparseRows) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return _sigmoid((x @ self.weights)[:, None] - self.cuts[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(x: np.ndarray | SparseRows, grade: np.ndarray, grades: int, penalty: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts of the penalised likelihood, by Adam; cuts are held apart by exponents."""
    rows, width = x.shape
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] + 0.5
    start = np.log(share / (rows + 1 - share))
    p = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    index = np.arange(rows)
    for step in range(1, steps + 1):
        gaps = np.exp(p[width + 1 :])
        cuts = p[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        below = np.concatenate((np.zeros((rows, 1)), _sigmoid(cuts[None, :] - (x @ p[:width])[:, None]), np.ones((rows, 1))), axis=1)
        slope = below * (1 - below)
        chance = np.maximum(below[index, grade + 1] - below[index, grade], 1e-9)
        high, low = slope[index, grade + 1] / chance, slope[index, grade] / chance
        by_cut = np.array([-(high[grade == j].sum() - low[grade == j + 1].sum()) for j in range(grades - 1)]) / rows
        g = np.concatenate((x.T @ (high - low) / rows + penalty * p[:width] / 10, [by_cut.sum()], gaps * by_cut[::-1].cumsum()[::-1][1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:width], p[width] + np.concatenate(([0.0], np.cumsum(np.exp(p[width + 1 :]))))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic and text of at most `rows` labelled documents, one for each id."""
    known = labels.selectExpr("cast(doc_id as long) as doc_id", "cast(toxic as int) as toxic").where("doc_id is not null and toxic is not null")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id")


def _word_counts(sample: DataFrame) -> DataFrame:
    """doc_id, toxic, sketch (equal for most near copies) and the counts of a text's words."""

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            counts, sketches = [], []
            for text in texts_as_bytes(part.column("text")):
                words = plain_words(text)
                grams = (b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1)))
                sketches.append(min(map(xxhash.xxh64_intdigest, grams)) - (1 << 63))
                counts.append(list(Counter(words).items()))
            return {
                "doc_id": part.column("doc_id"),
                "toxic": part.column("toxic"),
                "sketch": pa.array(sketches, pa.int64()),
                "counts": pa.array(counts, pa.map_(pa.binary(), pa.int64())),
            }

        return batch

    columns = sample.select("doc_id", "toxic", "text")
    return map_slices(columns, work, "doc_id long, toxic int, sketch long, counts map<binary, bigint>", 500)


def _marked_batch(words: tuple[bytes, ...]):
    place = {word: i for i, word in enumerate(words)}

    def batch(part: pa.RecordBatch) -> dict:
        found = [[(place[word], n) for word, n in own if word in place] for own in part.column("counts").to_pylist()]
        return {
            "toxic": part.column("toxic"),
            "at": pa.array([[at for at, _ in own] for own in found], pa.list_(pa.int32())),
            "n": pa.array([[n for _, n in own] for own in found], pa.list_(pa.int64())),
        }

    return batch


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most `rows` labelled documents.

    Of near copies (equal sketch) one is used. A word is marked if at least 5 texts hold it,
    most of them toxic, far more than chance gives. Labels say toxic or not: a toxic text is
    graded 1, 2 or 3 by its occurrences of marked words (GRADE_COUNTS). Without labels, or
    without marked words, the model grades every text 0.
    """
    counted = _word_counts(_sample(docs, labels, rows))
    one = counted.groupBy("sketch").agg(F.min_by(F.struct("toxic", "counts"), "doc_id").alias("row")).select("row.*")
    one = one.persist()
    try:
        total = one.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
        rate = total["toxic"] / max(total["n"], 1)
        held = one.select("toxic", F.explode(F.map_keys("counts")).alias("word"))
        each = held.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
        spread = F.sqrt(F.col("n") * F.lit(max(rate * (1 - rate), 1e-9)))
        marked = each.where("n >= 5 and 2 * toxic > n").withColumn("z", (F.col("toxic") - F.col("n") * F.lit(rate)) / spread)
        chosen = marked.where("z >= 5").orderBy(F.desc("z"), "word").collect()
        words = tuple(bytes(row["word"]) for row in chosen)
        nothing = OrdinalModel((), np.zeros(0), np.full(3, 40.0))
        if not words:
            return nothing
        # Bounded by rows and words of the fit; most texts hold none of the words.
        found = map_slices(one.select("toxic", "counts"), lambda: _marked_batch(words), "toxic int, at array<int>, n array<long>").collect()
    finally:
        one.unpersist()
    model = OrdinalModel(words, np.zeros(len(words)), np.zeros(3))
    own = [dict(zip(row["at"], row["n"], strict=True)) for row in found]
    toxic = np.array([row["toxic"] > 0 for row in found])
    marks = np.array([sum(counts.values()) for counts in own])
    grade = np.where(toxic, 1 + sum((marks >= least).astype(int) for least in GRADE_COUNTS), 0)
    if not toxic.any() or toxic.all():
        return nothing
    weights, cuts = fit_ordinal(model.features(own), grade, len(GRADE_COUNTS) + 2)
    return OrdinalModel(words, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """Per row of `docs`: doc_id, severity (the expected grade), p_toxic (P(grade > 0)) and toxic.

    Null and empty texts have no features and get the grade of a text without marked words;
    repeated rows are scored each, a null doc_id stays null, other columns are left out.
    """

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            above = model.above(_counts(part, model))
            return {
                "doc_id": part.column("doc_id"),
                "severity": pa.array(above.sum(axis=1)),
                "p_toxic": pa.array(above[:, 0]),
                "toxic": pa.array(above[:, 0] >= threshold),
            }

        return batch

    columns = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return map_slices(columns, work, "doc_id long, severity double, p_toxic double, toxic boolean")


def _counts(part: pa.RecordBatch, model: OrdinalModel) -> SparseRows:
    place, counts = {word: i for i, word in enumerate(model.words)}, []
    for text in texts_as_bytes(part.column("text")):
        counts.append(Counter(place[word] for word in plain_words(text) if word in place))
    return model.features(counts)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose text is toxic; every column stays as it is."""
    model = train(docs, labels)
    return filter_slices(docs, lambda: lambda part: model.above(_counts(part, model))[:, 0] < threshold)
