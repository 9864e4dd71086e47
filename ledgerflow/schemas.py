"""Table schemas (K5). Payloads are JSON text at rest, ids are canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT = T.StringType()
LONG = T.LongType()
TIME = T.TimestampType()
BYTES = T.BinaryType()
FLAG = T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


EVENT_KEY = ["transaction_digest", "event_seq"]

EVENTS = _struct(
    transaction_digest=TEXT,
    event_seq=LONG,
    checkpoint_sequence=LONG,
    timestamp_ms=LONG,
    package_id=TEXT,
    transaction_module=TEXT,
    type_address=TEXT,
    type_module=TEXT,
    type_name=TEXT,
    sender=TEXT,
    parsed_json=TEXT,
    bcs=BYTES,
)

# JSON form of one event on the wire. A payload declared as text keeps its JSON.
WIRE_EVENT = _struct(
    id=_struct(txDigest=TEXT, eventSeq=TEXT),
    packageId=TEXT,
    transactionModule=TEXT,
    sender=TEXT,
    type=TEXT,
    parsedJson=TEXT,
    bcs=TEXT,
    timestampMs=TEXT,
    checkpoint=LONG,
    _corrupt_record=TEXT,
)

# Reduced wire form: flat, all parts optional, no keys and no time.
THIN_EVENT = _struct(
    event_type=TEXT,
    package_id=TEXT,
    transaction_module=TEXT,
    sender=TEXT,
    type_=TEXT,
    contents=TEXT,
    bcs=BYTES,
)

EFFECTS = _struct(
    status=TEXT,
    gas=_struct(computation_cost=LONG, storage_cost=LONG, storage_rebate=LONG),
)

TRANSACTIONS = _struct(
    digest=TEXT,
    checkpoint_sequence=LONG,
    timestamp_ms=LONG,
    sender=TEXT,
    effects=EFFECTS,
    events=T.ArrayType(_struct(event_seq=LONG, type_name=TEXT)),
)

CHECKPOINTS = _struct(
    sequence_number=LONG,
    digest=TEXT,
    previous_digest=TEXT,
    epoch=LONG,
    round=LONG,
    timestamp_ms=LONG,
    network_total_transactions=LONG,
    transactions=T.ArrayType(TEXT),
    end_of_epoch_data=_struct(
        next_epoch_committee=T.ArrayType(_struct(authority_name=TEXT, stake=LONG)),
        next_epoch_protocol_version=LONG,
        epoch_start_timestamp_ms=LONG,
    ),
    validator_signature=TEXT,
)

RULES = _struct(name=TEXT, package=TEXT, module=TEXT, event_type=TEXT, sender=TEXT)

EVENT_METADATA = _struct(
    processed_at=TIME,
    processing_duration_ms=LONG,
    event_index=LONG,
    matched_filters=T.ArrayType(TEXT),
    tags=T.ArrayType(TEXT),
)

PROCESSED_EVENTS = _struct(
    id=TEXT,
    event_data=TEXT,
    transaction_digest=TEXT,
    event_seq=LONG,
    checkpoint_sequence=LONG,
    timestamp=TIME,
    package_id=TEXT,
    module_name=TEXT,
    event_type=TEXT,
    sender=TEXT,
    fields=TEXT,
    metadata=EVENT_METADATA,
    processed_at=TIME,
    created_at=TIME,
)

TRANSACTION_METADATA = _struct(
    processed_at=TIME,
    processing_duration_ms=LONG,
    event_count=LONG,
    gas_used=LONG,
    success=FLAG,
)

PROCESSED_TRANSACTIONS = _struct(
    id=TEXT,
    transaction_data=TEXT,
    digest=TEXT,
    checkpoint_sequence=LONG,
    timestamp=TIME,
    sender=TEXT,
    gas_used=LONG,
    status=TEXT,
    effects=TEXT,
    metadata=TRANSACTION_METADATA,
    processed_at=TIME,
    created_at=TIME,
)

EVENT_ROWS = _struct(
    id=TEXT,
    checkpoint_sequence=LONG,
    transaction_digest=TEXT,
    event_sequence=LONG,
    event_type=TEXT,
    package_id=TEXT,
    module_name=TEXT,
    sender=TEXT,
    timestamp_ms=LONG,
    bcs=BYTES,
    fields=TEXT,
    created_at=TIME,
)

TRANSACTION_ROWS = _struct(
    id=TEXT,
    digest=TEXT,
    checkpoint_sequence=LONG,
    timestamp_ms=LONG,
    sender=TEXT,
    gas_used=LONG,
    gas_price=LONG,
    success=FLAG,
    error_message=TEXT,
    created_at=TIME,
)

# `generation` counts deliberate resets; only rows of the newest one are current.
PROGRESS = _struct(
    checkpoint_sequence=LONG,
    status=TEXT,
    updated_at=TIME,
    batch_id=LONG,
    reset=FLAG,
    generation=LONG,
)

# What each source of a run has brought, by batch.
SOURCE_PROGRESS = _struct(
    source=TEXT,
    run_id=TEXT,
    batch_id=LONG,
    records=LONG,
    checkpoint_sequence=LONG,
    updated_at=TIME,
)

# Batches that a named sink has taken.
DELIVERIES = _struct(run_id=TEXT, batch_id=LONG, sink=TEXT, delivered_at=TIME)

EVENT_LEDGER = _struct(
    id=TEXT,
    transaction_digest=TEXT,
    event_sequence=LONG,
    checkpoint_sequence=LONG,
    processed_at=TIME,
    processing_duration_ms=LONG,
    status=TEXT,
    error_message=TEXT,
)

TRANSACTION_LEDGER = _struct(
    id=TEXT,
    transaction_digest=TEXT,
    checkpoint_sequence=LONG,
    processed_at=TIME,
    processing_duration_ms=LONG,
    status=TEXT,
    error_message=TEXT,
)

EVENT_STATS = _struct(
    date=T.DateType(),
    package_id=TEXT,
    module_name=TEXT,
    event_type=TEXT,
    event_count=LONG,
    unique_senders=LONG,
    total_gas_used=LONG,
)

BATCH_LOG = _struct(
    run_id=TEXT,
    batch_id=LONG,
    events=LONG,
    transactions=LONG,
    errors=LONG,
    event_ms=LONG,
    transaction_ms=LONG,
    checkpoint_sequence=LONG,
    started_at=TIME,
    finished_at=TIME,
)

QUARANTINE = _struct(
    record_id=TEXT,
    reason=TEXT,
    record=TEXT,
    checkpoint_sequence=LONG,
    quarantined_at=TIME,
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in its order; fails on a missing column or type."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    wrong = [
        f"{f.name} is {df.schema[f.name].dataType.simpleString()}, expected {f.dataType.simpleString()}"
        for f in schema
        if df.schema[f.name].dataType.simpleString() != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*schema.fieldNames())
