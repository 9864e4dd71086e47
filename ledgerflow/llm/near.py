"""Linking of near-equal sets without forming all pairs of a group.

Units (documents or paragraphs) with equal sets form one class, named by a 64-bit key
of the set; classes are what is linked. Signatures put classes into buckets. Within a
bucket every class is first paired with one hub; verified pairs give components, and a
bucket whose classes all lie in one component needs nothing more. The others are paired
with the bucket's most linked class. What is left after that is compared by the rarest
features of the sets, of which similar sets must share one, before the pairs across
components are verified. No link between different components is lost; links inside one
are not all listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import give_back, keep, map_slices, sliced, texts_as_bytes

#: Words whose hash a task remembers; a longer memory saves little and costs 180 bytes a word.
REMEMBERED = 100_000
#: Class keys that a task knows to have signed.
SIGNED = 500_000
#: Ids (8 bytes each) of wanted documents up to which they are sent to every executor.
BROADCAST_IDS = 1_000_000

#: A unit: first and last (exclusive) word or byte, and its features in rising order.
Unit = tuple[int, int, np.ndarray]
Cutter = Callable[[bytes], list[Unit]]
#: The signatures of each of several sets.
Signer = Callable[[list[np.ndarray]], Sequence[np.ndarray]]

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct features of `width` words in a row, rising; fewer words are one feature."""
    size = len(hashes)
    if not size:
        return hashes
    width = min(width, size)
    joined = hashes[: size - width + 1]
    for i in range(1, width):
        joined = mix(joined) + hashes[i : size - width + 1 + i]
    return np.unique(mix(joined + np.uint64(width)))


def set_key(features: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(features.tobytes()) - (1 << 63)


def sketch(features: np.ndarray) -> bytes:
    """How many features fall into each of 256 parts of their domain (255 stands for more).

    The summed differences of two sketches never exceed the number of features that differ.
    """
    return np.minimum(np.bincount((features >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text")


def unit_rows(docs: DataFrame, cutter: Callable[[], Cutter], text_hash: bool = False) -> DataFrame:
    """doc_id, start, end, n (features) and key (null without features) of each unit of each row.

    With `text_hash` also that, for telling rows of one doc_id apart.
    """

    def work():
        cut = cutter()

        def batch(part: pa.RecordBatch) -> dict:
            given = zip(*[part.column(name).to_pylist() for name in own], texts_as_bytes(part.column("text")), strict=True)
            rows = [
                (*named, start, end, len(features), set_key(features) if len(features) else None)
                for *named, text in given
                for start, end, features in cut(text)
            ]
            names = (*own, "start", "end", "n", "key")
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return {n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}

        return batch

    own, rows = ["doc_id"], _rows(docs)
    if text_hash:
        own, rows = [*own, "text_hash"], rows.withColumn("text_hash", F.xxhash64("text"))
    schema = ", ".join(f"{name} long" for name in (*own, "start", "end", "n", "key"))
    return map_slices(rows, work, schema)


def signature_rows(docs: DataFrame, cutter: Callable[[], Cutter], sign: Signer) -> DataFrame:
    """sig and key of each class; a class that a task meets again isn't signed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, signed = cutter(), set()
        for part in sliced(batches, 500):
            sets: dict[int, np.ndarray] = {}
            for text in texts_as_bytes(part.column("text")):
                for _, _, features in cut(text):
                    if len(features) and (key := set_key(features)) not in signed:
                        sets[key] = features
                        if len(signed) < SIGNED:
                            signed.add(key)
            if sets:
                sigs = sign(list(sets.values()))
                keys = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(own) for own in sigs])
                arrays = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(arrays, names=["sig", "key"])
        del cut, signed
        give_back()

    return _rows(docs).where("doc_id is not null").mapInArrow(run, "sig long, key long")


def stars(rows: DataFrame) -> DataFrame:
    """sig, hub and key: each bucket's first class paired with every other one of it.

    Rows arrive sorted, so a bucket of any size passes through in a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_key = last_hub = None
        for part in batches:
            sig = part.column("sig").to_numpy(zero_copy_only=False)
            key = part.column("key").to_numpy(zero_copy_only=False)
            if not len(sig):
                continue
            first = np.concatenate(([last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]))
            same = np.concatenate(([last_key is not None and key[0] == last_key], key[1:] == key[:-1])) & ~first
            head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            hub = np.where(head >= 0, key[head], last_hub if last_hub is not None else 0)
            last_sig, last_key, last_hub = sig[-1], key[-1], hub[-1]
            out = ~first & ~same
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, hub, key)], names=["sig", "hub", "key"])

    return rows.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(run, "sig long, hub long, key long")


def fetch_sets(docs: DataFrame, cutter: Callable[[], Cutter], wanted: DataFrame) -> DataFrame:
    """key, features and sketch of each class in `wanted` (key and the doc_id of one member)."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = _rows(docs).join(ids, F.col("doc_id") == F.col("wanted_id"), "left_semi")

    def work():
        cut = cutter()

        def batch(part: pa.RecordBatch) -> dict:
            found = {
                set_key(features): features
                for text in texts_as_bytes(part.column("text"))
                for _, _, features in cut(text)
                if len(features)
            }
            arrays = [features.view(np.int64) for features in found.values()]
            ends = np.cumsum([0, *map(len, arrays)])
            flat = pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64))
            return {
                "key": pa.array([*found], pa.int64()),
                "features": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                "sketch": pa.array(map(sketch, found.values()), pa.binary()),
            }

        return batch

    sets = map_slices(rows, work, "key long, features array<long>, sketch binary", 500)
    return sets.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def components(links: DataFrame) -> DataFrame:
    """node and label (the component's smallest node) of each node of `links` (a, b).

    Smallest labels spread along the links and along labels, so that long chains need
    few rounds; every round is written.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("further"))
        new = keep(
            step.join(jump, F.col("next") == F.col("at")).select("node", F.least("next", "further").alias("label"), "old"),
            "labels",
        )
        done = new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def connect(
    docs: DataFrame, units: DataFrame, cutter: Callable[[], Cutter], sign: Signer, percent: int
) -> DataFrame:
    """key and label of each class that is linked to another one.

    Classes are linked when 100 * intersection >= percent * union of their sets.
    """
    buckets = keep(stars(signature_rows(docs, cutter, sign)), "stars")
    # A bucket's hub is done with once it has been paired with all of the bucket.
    members = buckets.select("sig", "key")
    classes = members.select("key").union(buckets.select("hub")).distinct()
    wanted = units.where("key is not null and doc_id is not null").join(classes, "key", "left_semi")
    wanted = keep(wanted.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "wanted")
    sets = keep(fetch_sets(docs, cutter, wanted), "sets")

    star = buckets.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct()
    tested = keep(star, "pairs")
    links = keep(_verified(tested, sets, percent), "verified")
    labels = components(links)
    for find in (_hub_pairs, _rare_pairs):
        open_ = keep(_unresolved(members, labels), "open")
        if open_.isEmpty():
            break
        left = find(open_, links, sets, percent).join(tested, ["a", "b"], "left_anti")
        left = keep(left, "pairs")
        new = keep(_verified(left, sets, percent), "verified")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(links)
        tested = tested.unionByName(left)
    return labels.withColumnsRenamed({"node": "key"})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Whole sets move only for pairs whose sketches allow it."""
    brief = sets.select("key", F.size("features").alias("n"), "sketch")
    close = pairs
    for end in ("a", "b"):
        close = close.join(brief.withColumnsRenamed({"key": end, "n": f"n_{end}", "sketch": f"sketch_{end}"}), end)
    close = close.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def work():
        def batch(part: pa.RecordBatch) -> dict:
            counts = [
                np.frombuffer(b"".join(part.column(f"sketch_{end}").to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16)
                for end in ("a", "b")
            ]
            differ = np.abs(counts[0] - counts[1]).sum(axis=1)
            size = part.column("n_a").to_numpy().astype(np.int64) + part.column("n_b").to_numpy()
            near = pa.array((100 + percent) * differ <= (100 - percent) * size)
            return {end: part.column(end).filter(near) for end in ("a", "b")}

        return batch

    likely = map_slices(close.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), work, "a long, b long", 4000)
    one = sets.select(F.col("key").alias("a"), F.col("features").alias("of_a"))
    two = sets.select(F.col("key").alias("b"), F.col("features").alias("of_b"))
    common = likely.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return common.where(f"100 * common >= {percent} * (size(of_a) + size(of_b) - common)").select("a", "b")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, key and label of the classes in buckets that several components share."""
    named = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sig")
    return named.join(mixed, "sig", "left_semi")


def _hub_pairs(open_: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The most linked class of each bucket with the classes of the bucket's other components."""
    ends = links.select(F.col("a").alias("key")).unionAll(links.select(F.col("b").alias("key")))
    ranked = open_.join(ends.groupBy("key").agg(F.count("*").alias("degree")), "key", "left")
    best = ranked.groupBy("sig").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "key", "label")).alias("hub"))
    paired = open_.join(best, "sig").where("label <> hub.label")
    return paired.select(F.least("hub.key", "key").alias("a"), F.greatest("hub.key", "key").alias("b")).distinct()


def _rare_pairs(open_: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that may be similar enough, found by their rarest features.

    In any one order of all features, two such sets share one of the first n - c + 1 of each,
    where c is what they must have in common at least: percent of the larger set's n, and more
    of the smaller one's. At the first one that they share, enough features must be left in
    both. Only features that several components hold can be shared by such a pair, so a set
    that has too few of them has no partner at all; rarest first, a set's own features come
    before those of its group, and large groups of copies that differ too much fall out here.
    """
    # The sets that have no partner go first: they are most of what is open as a rule.
    each = _features(open_.select("key", "label").distinct(), sets)
    most = each.join(_held(each).where("shared").select("feature"), "feature").groupBy("key", "label").agg(F.count("*").alias("most"))
    sized = most.join(sets.select("key", F.size("features").alias("n")), "key").where(f"100 * most >= {percent} * n")
    hopeful = keep(sized.select("key", "label", "n"), "hopeful")
    each = _features(hopeful.select("key", "label"), sets)
    own = Window.partitionBy("key")
    counted = each.join(_held(each), "feature").withColumns(
        {"place": F.row_number().over(own.orderBy("holders", "feature")), "most": F.count_if("shared").over(own)}
    )
    counted = counted.where("shared").join(hopeful.select("key", "n"), "key").where(f"100 * most >= {percent} * n")
    counted = keep(counted, "features")
    columns = ("key", "label", "n", "most", "place")
    both = 100 + percent
    one = counted.where(f"place <= n - (2 * n * {percent} + {both - 1}) div {both} + 1").select("feature", *columns)
    two = counted.where(f"place <= n - (n * {percent} + 99) div 100 + 1").select("feature", *(F.col(c).alias(f"other_{c}") for c in columns))
    fitting = (
        "label <> other_label and (n < other_n or n = other_n and key < other_key) and "
        f"{both} * least(most, other_most, 1 + n - place, 1 + other_n - other_place) >= {percent} * (n + other_n)"
    )
    pairs = one.join(two, (one.feature == two.feature) & F.expr(fitting))
    return pairs.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct()


def _features(labels: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.join(labels, "key").select("key", "label", F.explode("features").alias("feature"))


def _held(each: DataFrame) -> DataFrame:
    """How many sets hold each feature, and whether they are of several components."""
    found = each.groupBy("feature").agg(F.count("*").alias("holders"), F.min("label").alias("low"), F.max("label").alias("high"))
    return found.select("feature", "holders", (F.col("low") != F.col("high")).alias("shared"))


def with_components(units: DataFrame, labels: DataFrame) -> DataFrame:
    """Each unit's component_id: the smallest doc_id of the classes that are linked with its own.

    A unit without features stands alone; one without a doc_id has no component.
    """
    classes = units.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    class_component = named.join(least, "label").select("key", "component")
    return (
        units.join(class_component, "key", "left")
        .withColumn("component_id", F.expr("case when doc_id is not null then coalesce(component, doc_id) end"))
        .drop("component")
    )


