"""Checkpoint ranges and work planning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stretches a range is cut into at most, to look for gaps in each by itself.
STRETCHES = 10_000


@dataclass(frozen=True)
class CheckpointRange:
    """Checkpoints from `start` to `end`, both included."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError("the start of a checkpoint range cannot be after its end")

    def __len__(self) -> int:
        return self.end - self.start + 1


def members(spark: SparkSession, wanted: CheckpointRange) -> DataFrame:
    """One row per checkpoint of the range."""
    return spark.range(wanted.start, wanted.end + 1).withColumnRenamed("id", "checkpoint_sequence")


def split_range(spark: SparkSession, wanted: CheckpointRange, size: int) -> DataFrame:
    """Chunks (start, end) of at most `size` checkpoints; the last may be shorter.

    Chunks are made on the executors, so a range may have any number of them.
    """
    if size < 1:
        raise ValueError("chunk size must be at least 1")
    starts = spark.range(wanted.start, wanted.end + 1, size)
    end = F.least(F.col("id") + (size - 1), F.lit(wanted.end))
    return starts.select(F.col("id").alias("start"), end.cast("bigint").alias("end"))


def chunk_counts(present: DataFrame, wanted: CheckpointRange, size: int, column: str) -> DataFrame:
    """The chunks of a range with the number of rows that fall into each."""
    chunks = split_range(present.sparkSession, wanted, size)
    inside = present.where(F.col(column).between(wanted.start, wanted.end))
    offset = F.col(column) - F.lit(wanted.start)
    start = (offset - offset % size + wanted.start).cast("bigint")
    counts = inside.groupBy(start.alias("start")).agg(F.count("*").alias("present"))
    return chunks.join(counts, "start", "left").withColumn("present", F.coalesce("present", F.lit(0).cast("bigint")))


def missing_checkpoints(present: DataFrame, wanted: CheckpointRange, column: str = "checkpoint_sequence") -> DataFrame:
    """Checkpoints of the range that have no row in `present`."""
    inside = present.where(F.col(column).between(wanted.start, wanted.end))
    seen = inside.select(F.col(column).alias("checkpoint_sequence")).distinct()
    return members(present.sparkSession, wanted).join(seen, "checkpoint_sequence", "left_anti")


def missing_intervals(present: DataFrame, wanted: CheckpointRange, column: str = "checkpoint_sequence") -> DataFrame:
    """The gaps of `missing_checkpoints` as (start, end, length), one row for each, however long it is.

    Only checkpoints that are there are looked at: the range is cut into stretches, a gap
    within a stretch lies between two neighbours in it, and one across stretches between the
    last checkpoint of one and the first of the next that has any.
    """
    size = -(-len(wanted) // STRETCHES)
    at = F.col(column).cast("bigint")
    inside = present.where(at.between(wanted.start, wanted.end)).select(at.alias("at")).distinct()
    stretched = inside.withColumn("stretch", F.floor((F.col("at") - wanted.start) / size))
    following = F.lead("at").over(Window.partitionBy("stretch").orderBy("at"))
    within = stretched.select("at", following.alias("next"))
    # One row a stretch, at most STRETCHES, and the two ends of the range.
    ends = present.sparkSession.createDataFrame(
        [(wanted.start - 1, wanted.start - 1), (wanted.end + 1, wanted.end + 1)], "first bigint, last bigint"
    )
    edges = stretched.groupBy("stretch").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("stretch").union(ends)
    between = edges.select(F.col("last").alias("at"), F.lead("first").over(Window.orderBy("first")).alias("next"))
    gaps = within.union(between).where(F.col("next") - F.col("at") > 1)
    return gaps.select(
        (F.col("at") + 1).alias("start"), (F.col("next") - 1).alias("end"), (F.col("next") - F.col("at") - 1).alias("length")
    )


def next_checkpoint(latest: DataFrame) -> DataFrame:
    """The checkpoint to do next, from the row of `latest_progress`: 0 when nothing is done."""
    following = F.coalesce(F.col("latest_checkpoint") + 1, F.lit(0).cast("bigint"))
    return latest.select(following.alias("next_checkpoint"))


def start_checkpoint(configured: int | None, next_one: int, *, reset: bool = False) -> int:
    """Where a run starts: behind what is done and not before the configured start.

    With `reset` the configured start wins even over what is done.
    """
    if configured is None:
        return next_one
    return configured if reset else max(configured, next_one)
