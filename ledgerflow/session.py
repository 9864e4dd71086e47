"""Session settings the semantics rely on, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin what decides results: UTC, and the last value of a repeated JSON key.

    All of these are session settings, so an existing session can be passed.
    Partition counts are left to the cluster and to adaptive execution.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which every executor can reach.

    Only a local session may fall back to the machine's own temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerflow-")
