"""Batch and streaming readers.

Raw data gets its ids canonicalised while it is read. Tables written by the
sinks are canonical already: read them with ``canonical=True`` so that filters
on ids stay plain comparisons that Parquet can use to skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import schemas
from ledgerflow.functions.ids import canonical_id, type_parts

CORRUPT = "_corrupt_record"


def read_events(spark: SparkSession, path: str, *, format: str = "parquet", canonical: bool = False) -> DataFrame:
    """Event scan. JSON lines that do not parse stay, with their text in `_corrupt_record`."""
    return _events(spark.read, path, format, canonical)


def read_transactions(
    spark: SparkSession, path: str, *, format: str = "parquet", canonical: bool = False
) -> DataFrame:
    df = _scan(spark.read, path, format, schemas.TRANSACTIONS)
    if canonical:
        return df
    checkpoint = F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint"))
    return df.withColumns({"sender": canonical_id("sender"), "checkpoint_sequence": checkpoint})


def read_checkpoints(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    return _scan(spark.read, path, format, schemas.CHECKPOINTS)


def stream_events(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    start: int | None = None,
    max_files_per_trigger: int | None = None,
    canonical: bool = False,
) -> DataFrame:
    """Continuous event source over arriving files, from checkpoint `start` on.

    For a message log, read it with its own format and pass the text column
    through `decode_wire_events`; everything after that is the same.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return from_checkpoint(_events(reader, path, format, canonical), start)


def from_checkpoint(df: DataFrame, start: int | None) -> DataFrame:
    """Rows of checkpoint `start` and later, and those whose checkpoint is unknown (null or 0)."""
    if start is None:
        return df
    checkpoint = F.col("checkpoint_sequence")
    return df.where((checkpoint >= F.lit(start)) | checkpoint.isNull() | (checkpoint == 0))


def checkpoint_at(checkpoints: DataFrame, sequence: int) -> DataFrame:
    """Point lookup of one checkpoint."""
    return checkpoints.where(F.col("sequence_number") == F.lit(sequence))


def chain_head(checkpoints: DataFrame) -> DataFrame:
    """One row: the newest known checkpoint, null when there is none."""
    return checkpoints.agg(F.max("sequence_number").alias("head"))


def canonical_events(df: DataFrame) -> DataFrame:
    """Bring the id columns of raw events into canonical form; an unknown checkpoint is 0."""
    ids = {name: canonical_id(name) for name in ("package_id", "type_address", "sender")}
    checkpoint = F.coalesce("checkpoint_sequence", F.lit(0).cast("bigint"))
    return df.withColumns({**ids, "checkpoint_sequence": checkpoint})


def decode_wire_events(df: DataFrame, text: str | Column = "value") -> DataFrame:
    """Events from their JSON wire text; undecodable text lands in `_corrupt_record`."""
    source = F.col(text) if isinstance(text, str) else text
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    wire = df.select(F.from_json(source.cast("string"), schemas.WIRE_EVENT, options).alias("w")).select("w.*")
    return from_wire(wire)


def from_wire(wire: DataFrame) -> DataFrame:
    """Wire columns to event columns."""
    address, module, name = type_parts("type")
    return wire.select(
        F.col("id.txDigest").alias("transaction_digest"),
        F.col("id.eventSeq").try_cast("bigint").alias("event_seq"),
        F.coalesce("checkpoint", F.lit(0).cast("bigint")).alias("checkpoint_sequence"),
        F.col("timestampMs").try_cast("bigint").alias("timestamp_ms"),
        canonical_id("packageId").alias("package_id"),
        F.col("transactionModule").alias("transaction_module"),
        address.alias("type_address"),
        module.alias("type_module"),
        name.alias("type_name"),
        canonical_id("sender").alias("sender"),
        F.col("parsedJson").alias("parsed_json"),
        F.try_to_binary("bcs", F.lit("base64")).alias("bcs"),
        F.col(CORRUPT),
    )


def from_thin(thin: DataFrame) -> DataFrame:
    """Events of the reduced wire form, which has no digest, sequence, checkpoint or time."""
    address, module, name = type_parts("type_")
    return thin.select(
        F.lit(None).cast("string").alias("transaction_digest"),
        F.lit(None).cast("bigint").alias("event_seq"),
        F.lit(None).cast("bigint").alias("checkpoint_sequence"),
        F.lit(None).cast("bigint").alias("timestamp_ms"),
        canonical_id("package_id").alias("package_id"),
        F.col("transaction_module"),
        address.alias("type_address"),
        F.coalesce(module, F.col("transaction_module")).alias("type_module"),
        F.coalesce(name, F.col("event_type")).alias("type_name"),
        canonical_id("sender").alias("sender"),
        F.col("contents").alias("parsed_json"),
        F.col("bcs"),
    )


def _events(reader, path: str, format: str, canonical: bool) -> DataFrame:
    df = _scan(reader, path, format, schemas.EVENTS)
    return df if canonical else canonical_events(df)


def _scan(reader, path: str, format: str, schema: T.StructType) -> DataFrame:
    if format != "json":
        return reader.schema(schema).format(format).load(path)
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        reader.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
