"""Spark settings this package works well with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Timestamps mean the same on every machine.
    "spark.sql.session.timeZone": "UTC",
    # A batch of source texts must stay small in the Python workers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Texts are large: small input splits keep tasks within executor memory.
    "spark.sql.files.maxPartitionBytes": "64m",
}


def build_session(name: str = "scanloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the rows of ``SETTINGS`` where they are larger: a batch of texts lies in a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= int(SETTINGS[name]):
        spark.conf.set(name, SETTINGS[name])
