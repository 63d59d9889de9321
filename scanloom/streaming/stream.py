"""Scanning files as they arrive.

``scan_files`` looks at one row at a time, so it works on streams as it is.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.gate import gate
from scanloom.operators.scan import findings, scan_files
from scanloom.sources.tables import shared_folder


def scan_stream(source_files: DataFrame, custom_rules=(), issues: bool = True) -> DataFrame:
    """Scanned files of a stream: stateless, nothing is shuffled."""
    return scan_files(source_files, custom_rules, issues=issues)


def new_arrivals(source_files: DataFrame, delay: str = "1 day", salts: int = 16) -> DataFrame:
    """Drop a file that arrives again unchanged within the delay.

    Copies are first dropped within a salt, taken from the input partition, so
    that a file of which very many copies arrive is spread over ``salts``
    tasks; at most one copy a salt is left for the second step. State holds
    one hash a file and salt, and no longer than the watermark allows.
    """
    key = ["repo", "path", "digest"]
    marked = source_files.withWatermark("mtime", delay).withColumns(
        {"digest": F.sha2(F.coalesce("text", F.lit("")), 256), "salt": F.spark_partition_id() % salts}
    )
    once_a_salt = marked.dropDuplicatesWithinWatermark([*key, "salt"])
    return once_a_salt.dropDuplicatesWithinWatermark(key).drop("digest", "salt")


def windowed_findings(source_files: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Findings per rule and time window; files later than the delay are dropped.

    In append mode a window comes out once it is closed; ``run_windows`` gives open ones as well.
    """
    scanned = scan_files(source_files.withWatermark("mtime", delay), issues=False)
    found = scanned.select("mtime", F.inline("findings"))
    return (
        found.groupBy(F.window("mtime", width), "rule_id")
        .agg(F.count("*").alias("n_findings"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "rule_id", "n_findings")
    )


def gate_each_batch(folder: str, grain: str = "corpus"):
    """A ``foreachBatch`` function that writes the gate of each micro-batch.

    Each batch has its own folder, which a repeated batch writes again, so a
    restart leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        gate(batch, grain).write.mode("overwrite").parquet(os.path.join(folder, f"batch_id={batch_id}"))

    return write


def latest_each_batch(folder: str):
    """A ``foreachBatch`` function that keeps the rows each micro-batch changed, under its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(folder, f"batch_id={batch_id}"))

    return write


def _batches(spark, folder: str, schema: T.StructType) -> DataFrame:
    """What ``gate_each_batch`` or ``latest_each_batch`` wrote; no rows where nothing has arrived, so that no batch ran."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(os.path.join(folder, "batch_id=-1"))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that has arrived, write it as parquet and return it as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/data").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def run_windows(windows: DataFrame, name: str) -> DataFrame:
    """Process all that has arrived and return every window, those still open included.

    Each micro-batch writes the counts it changed; of a window's counts the latest stands.
    """
    spark = windows.sparkSession
    folder = shared_folder(spark, name)
    query = (
        windows.writeStream.foreachBatch(latest_each_batch(f"{folder}/data"))
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = _batches(spark, f"{folder}/data", windows.schema)
    keys = [c for c in windows.columns if c != "n_findings"]
    return written.groupBy(*keys).agg(F.max_by("n_findings", "batch_id").alias("n_findings"))


def run_gate(stream: DataFrame, name: str, grain: str = "corpus") -> DataFrame:
    """Process all that has arrived and return the gate of each micro-batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (
        stream.writeStream.foreachBatch(gate_each_batch(f"{folder}/data", grain))
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _batches(spark, f"{folder}/data", gate(spark.createDataFrame([], stream.schema), grain).schema)


__all__ = [
    "findings",
    "gate_each_batch",
    "new_arrivals",
    "run_gate",
    "run_to_table",
    "run_windows",
    "scan_stream",
    "shared_folder",
    "windowed_findings",
]
