"""A gate that stays right while files arrive again and again.

State holds, for each file, the digest, time and counts of its latest version. A version that arrives gives the change
of the counts against the one before; the sums of all changes are the gate of the latest versions. So a later fix
unblocks a repository, and a file that arrives unchanged, late or several times in a batch counts once.

``gate_changes`` emits changes, and can forget files; each file is then a call of a Python processor. Where files are never
forgotten, ``latest_counts`` keeps the same state as a maximum, which starts no processor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanloom.operators.gate import gate_from_changes
from scanloom.operators.scan import scan_files
from scanloom.sources.tables import shared_folder
from scanloom.streaming.stream import _batches, latest_each_batch, run_to_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "repo string, path string, n_files long, n_findings long, n_syntax long"


class FileCounts(StatefulProcessor):
    """Keyed by (repo, path): emits by how much the counts of a file have changed."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, digest string, n_findings long, n_syntax long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        new = max((r.at, r.digest, r.n_findings, r.n_syntax) for r in rows)
        if old and new[:2] <= old[:2]:
            return
        self.latest.update(new)
        if self.forget_ms is not None:
            self.handle.registerTimer(new[0] + self.forget_ms)
        if not old:
            yield Row(repo=key[0], path=key[1], n_files=1, n_findings=new[2], n_syntax=new[3])
        elif new[2:] != old[2:]:
            yield Row(repo=key[0], path=key[1], n_files=0, n_findings=new[2] - old[2], n_syntax=new[3] - old[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        # A timer of an older version goes off as well, and changes nothing.
        if old and old[0] + self.forget_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield Row(repo=key[0], path=key[1], n_files=-1, n_findings=-old[2], n_syntax=-old[3])

    def close(self) -> None:
        pass


def _counted(source_files: DataFrame, custom_rules) -> DataFrame:
    return scan_files(source_files, custom_rules).select(
        F.coalesce("repo", F.lit("")).alias("repo"),
        "path",
        "mtime",
        F.coalesce(F.unix_millis("mtime"), F.lit(0)).alias("at"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"),
        F.size("findings").cast("long").alias("n_findings"),
        F.size("syntax_issues").cast("long").alias("n_syntax"),
    )


def gate_changes(source_files: DataFrame, forget: str | None = None, delay: str = "1 day", custom_rules=()) -> DataFrame:
    """Changes of counts of a stream of files: (repo, path, n_files, n_findings, n_syntax), to be summed.

    The version with the greatest ``mtime`` counts, of several with the same the one with the greatest digest; files
    without a time are older than all others. With ``forget``, such as ``30 days``, a file that has not arrived for so
    long, by the watermark of ``mtime`` less ``delay``, is taken to be gone: its counts are taken back and its state goes.
    Without it, state grows with the number of files. Only counts and digests are shuffled, no texts. The session must
    have the RocksDB state store (``PROVIDER``), which ``run_gate_changes`` sees to.
    """
    if forget:
        source_files = source_files.withWatermark("mtime", delay)
    counted = _counted(source_files, custom_rules)
    forget_ms = None
    if forget:
        forget_ms = source_files.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {forget})").first()[0]
    grouped = (counted if forget else counted.drop("mtime")).groupBy("repo", "path")
    return grouped.transformWithState(FileCounts(forget_ms), CHANGE, "Append", "EventTime" if forget else "None")


def run_gate_changes(changes: DataFrame, name: str, grain: str = "corpus") -> DataFrame:
    """Process all that has arrived, keep the changes as a table and return the gate of the latest versions."""
    return gate_from_changes(with_rocksdb(changes.sparkSession, lambda: run_to_table(changes, name)), grain)


def latest_counts(source_files: DataFrame, custom_rules=()) -> DataFrame:
    """Counts of the latest version of each file of a stream: (repo, path, n_findings, n_syntax), to be run in update mode.

    Of several versions the one that ``gate_changes`` takes counts. State grows with the number of files.
    """
    version = F.struct("at", "digest", "n_findings", "n_syntax")
    latest = _counted(source_files, custom_rules).groupBy("repo", "path").agg(F.max(version).alias("latest"))
    return latest.select("repo", "path", "latest.n_findings", "latest.n_syntax")


def run_latest_counts(latest: DataFrame, name: str, grain: str = "corpus") -> DataFrame:
    """Process all that has arrived, keep what each batch changed as a table and return the gate of the latest versions."""
    spark = latest.sparkSession
    folder = shared_folder(spark, name)

    def run():
        writer = latest.writeStream.foreachBatch(latest_each_batch(f"{folder}/data")).outputMode("update")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    with_rocksdb(spark, run)
    counts = F.max_by(F.struct("n_findings", "n_syntax"), "batch_id").alias("counts")
    files = _batches(spark, f"{folder}/data", latest.schema).groupBy("repo", "path").agg(counts)
    return gate_from_changes(files.select("repo", "path", F.lit(1).cast("long").alias("n_files"), "counts.*"), grain)


def with_rocksdb(spark: SparkSession, run):
    """Run with the state store that arbitrary state needs; the session's own comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


__all__ = ["FileCounts", "gate_changes", "latest_counts", "run_gate_changes", "run_latest_counts", "with_rocksdb"]
