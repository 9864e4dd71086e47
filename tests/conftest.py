from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from ledgerflow.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from dicts; parts that are left out get plain values."""
    from ledgerflow import schemas
    from ledgerflow.sources.readers import canonical_events

    plain = {
        "transaction_digest": "tx1",
        "event_seq": 0,
        "checkpoint_sequence": 7,
        "timestamp_ms": 1000,
        "package_id": "0x2",
        "transaction_module": "coin",
        "type_address": "0x2",
        "type_module": "coin",
        "type_name": "Transfer",
        "sender": "0x123",
        "parsed_json": "{}",
        "bcs": None,
    }

    def make(*rows: dict):
        full = [tuple({**plain, **row}.values()) for row in rows]
        return canonical_events(spark.createDataFrame(full, schemas.EVENTS))

    return make
