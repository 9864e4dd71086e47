"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is trained on a bounded sample and every vector is put into its leaf. A query
walks the tree best bin first: a priority queue holds the branches not taken, by the
nearness of their centres, and gives leaf after leaf. How many leaves are visited is
calibrated: it widens until the exact neighbours of some queries, found by a scan of all
vectors, are reached to the wanted share.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import keep, map_slices

#: Bounds of the training sample and of the queries that calibrate (smallest hashed ids).
TRAIN_ROWS = 20_000
CALIBRATE_ROWS = 128
#: Share of exact neighbours that calibration must reach.
TARGET_RECALL = 0.97
BRANCHES = 8
#: Sample vectors that make a leaf, at most.
LEAF_SAMPLE = 64
#: Vectors and queries that meet in one task, at most about so many.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096


@dataclass(frozen=True)
class KMeansTree:
    """Node 0 is the root; children[i] is empty for a leaf, leaf[i] its number or -1."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going down to the nearest centre."""
        at = np.zeros(len(unit), np.int64)
        moving = np.arange(len(unit)) if self.children[0] else np.empty(0, np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                own = moving[at[moving] == node]
                kids = np.array(self.children[node])
                at[own] = kids[np.argmax(unit[own] @ self.centres[kids].T, axis=1)]
            moving = moving[[bool(self.children[node]) for node in at[moving]]]
        return self.leaf[at]

    def visit(self, unit: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves for one query, best bin first; more until their `sizes` add up to `least`."""
        near = (self.centres @ unit).tolist()
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < least):
            node = heapq.heappop(queue)[1]
            while self.children[node]:
                kids = sorted(self.children[node], key=lambda k: -near[k])
                for other in kids[1:]:
                    heapq.heappush(queue, (-near[other], other))
                node = kids[0]
            found.append(int(self.leaf[node]))
            held += 0 if sizes is None else int(sizes[found[-1]])
        return found


def fit_tree(unit: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, rounds: int = 8) -> KMeansTree:
    """Spherical k-means, node by node, until a node has few sample vectors."""
    centres, children, leaf = [np.zeros(unit.shape[1])], [()], [-1]
    work, leaves = [(0, np.arange(len(unit)))], 0
    rng = np.random.default_rng(7)
    while work:
        node, own = work.pop()
        parts: list[np.ndarray] = []
        if len(own) > leaf_sample:
            means = unit[rng.choice(own, branches, replace=False)]
            for _ in range(rounds):
                nearest = np.argmax(unit[own] @ means.T, axis=1)
                sums = np.stack([unit[own[nearest == b]].sum(axis=0) for b in range(branches)])
                size = np.linalg.norm(sums, axis=1, keepdims=True)
                means = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), means)
            nearest = np.argmax(unit[own] @ means.T, axis=1)
            parts = [own[nearest == b] for b in range(branches)]
        if sum(len(p) > 0 for p in parts) < 2:  # few, or all alike
            leaf[node], leaves = leaves, leaves + 1
            continue
        kids = []
        for b, part in enumerate(parts):
            if len(part):
                kids.append(len(centres))
                centres.append(means[b])
                children.append(())
                leaf.append(-1)
                work.append((kids[-1], part))
        children[node] = tuple(kids)
    return KMeansTree(np.array(centres), tuple(children), np.array(leaf))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, which changes no digit: squares then neither overflow nor vanish."""
    _, power = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -power)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each row by itself, so that equal vectors get equal scores wherever they stand."""
    vectors, query = _scaled(vectors), _scaled(query)
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def best(query: np.ndarray, query_id: int, vectors: np.ndarray, ids: np.ndarray, rough: np.ndarray, count: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the nearest vectors; `rough` are cosines from a product of matrices."""
    other = ids != query_id
    if other.sum() > count:
        least = np.partition(rough[other], -count)[-count] - 1e-9
        other &= rough >= least
    near = np.flatnonzero(other)
    score = cosines(query, vectors[near])
    order = np.lexsort((ids[near], -score))[:count]
    return [(query_id, int(ids[near[i]]), float(score[i])) for i in order]


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows with an id and a vector that has a direction.

    Null, empty and zero vectors and those with null or non-finite components take no part,
    nor do those whose number of components isn't the commonest one.
    """
    rows = table.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as vector").where(
        "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('infinity'))"
        " and exists(vector, x -> x <> 0)"
    )
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


_FOUND = "query_id long, vec_id long, score double"


def _as_batch(rows: list[tuple[int, int, float]]) -> dict:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}


def _ranked(found: DataFrame, count: int) -> DataFrame:
    # Copies of one row may be found through several blocks: an id counts once.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_neighbours(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, count: int) -> DataFrame:
    """The exact nearest vectors of a bounded number of queries, by one scan."""

    def work():
        unit = _unit(queries)

        def batch(part: pa.RecordBatch) -> dict | None:
            own, matrix = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
            rough = unit @ _unit(matrix).T
            return _as_batch([x for i, q in enumerate(queries) for x in best(q, int(ids[i]), matrix, own, rough[i], count)])

        return batch

    return _ranked(map_slices(vectors, work, _FOUND, 4000), count)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    own = rows.collect()
    return np.array([r["vec_id"] for r in own], np.int64), np.array([r["vector"] for r in own], np.float64)


def _with_leaf(vectors: DataFrame, tree: KMeansTree) -> DataFrame:
    def work():
        def batch(part: pa.RecordBatch) -> dict:
            leaf = tree.assign(_unit(_matrix(part.column("vector"))))
            return {"vec_id": part.column("vec_id"), "vector": part.column("vector"), "leaf": pa.array(leaf, pa.int64())}

        return batch

    return map_slices(vectors, work, "vec_id long, vector array<double>, leaf long", 4000)


def _visits(queries: DataFrame, tree: KMeansTree, most: int, ids: np.ndarray, least: int) -> DataFrame:
    def work():
        def batch(part: pa.RecordBatch) -> dict:
            leaves = [tree.visit(q, most, ids, least) for q in _unit(_matrix(part.column("vector")))]
            return {"vec_id": part.column("vec_id"), "vector": part.column("vector"), "leaves": pa.array(leaves, pa.list_(pa.int64()))}

        return batch

    return map_slices(queries, work, "vec_id long, vector array<double>, leaves array<long>")


def _calibrated(vectors: DataFrame, placed: DataFrame, queries: DataFrame, tree: KMeansTree, count: int, target: float) -> int:
    """Leaves to visit so that `target` of the exact neighbours of some queries are reached."""
    chosen = queries.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATE_ROWS)
    ids, own = _collected(chosen)
    if not len(ids):
        return tree.leaves
    wanted = exact_neighbours(vectors, ids, own, count).select("query_id", "vec_id")
    # At most `count` rows for each of the bounded queries; copies of an id keep one leaf.
    found = placed.select("vec_id", "leaf").join(F.broadcast(wanted), "vec_id").groupBy("query_id", "vec_id").agg(F.min("leaf").alias("leaf"))
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(q, tree.leaves))} for i, q in zip(ids, _unit(own), strict=True)}
    place = np.sort([order[row["query_id"]][row["leaf"]] for row in found.collect()])
    if not len(place):
        return tree.leaves
    return int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1


def search(
    table: DataFrame, every: int = 50, count: int = 5, train_rows: int = TRAIN_ROWS, target: float = TARGET_RECALL
) -> DataFrame:
    """query_id, rank, vec_id and score of the `count` nearest found for each query.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows with
    another vec_id. Nearest first by cosine, ties to the smaller vec_id; fewer rows if there
    are fewer candidates. Rows that `usable_vectors` leaves out take no part; of rows that
    share an id the nearest counts. Without usable queries there are no rows.
    """
    spark = table.sparkSession
    vectors = usable_vectors(table)
    _, sample = _collected(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_tree(_unit(sample))
    placed = keep(_with_leaf(vectors, tree), "vectors-by-leaf")
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "vector")
    most = _calibrated(placed.select("vec_id", "vector"), placed, queries, tree, count, target)

    # An id counts in one leaf only, so that leaves never seem to hold more ids than they do.
    once = placed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()
    ids = np.zeros(tree.leaves, np.int64)
    ids[[r["leaf"] for r in once]] = [r["count"] for r in once]
    # The query's own id may be among them.
    asked = keep(_visits(queries, tree, most, ids, count + 1).withColumn("leaf", F.explode("leaves")).drop("leaves"), "visits")
    # One row per leaf, whose number the sample bounds.
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    loads = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame(
        [(leaf, -(-n // BLOCK_VECTORS), -(-loads.get(leaf, 1) // BLOCK_QUERIES)) for leaf, n in sizes.items()],
        "leaf long, v_blocks long, q_blocks long",
    )
    dealt = placed.join(F.broadcast(blocks), "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("vec_id"), F.col("v_blocks")).alias("v"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
        "vec_id",
        "vector",
    )
    asking = asked.join(F.broadcast(blocks), "leaf").select(
        "leaf",
        F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("v"),
        F.pmod(F.xxhash64("vec_id"), F.col("q_blocks")).alias("q"),
        "vec_id",
        "vector",
    )

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if queries.num_rows and candidates.num_rows:
            ids, matrix = candidates.column("vec_id").to_numpy(), _matrix(candidates.column("vector"))
            wanted, asked_ids = _matrix(queries.column("vector")), queries.column("vec_id").to_numpy()
            for at in range(0, len(wanted), 256):
                rough = _unit(wanted[at : at + 256]) @ _unit(matrix).T
                for i, near in enumerate(rough, at):
                    rows += best(wanted[i], int(asked_ids[i]), matrix, ids, near, count)
        return pa.table(_as_batch(rows))

    groups = asking.groupBy("leaf", "v", "q").cogroup(dealt.groupBy("leaf", "v", "q"))
    return _ranked(groups.applyInArrow(meet, _FOUND), count)
