"""The gate of the latest versions, batch after batch."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from scanloom.functions.text import detect_language
from scanloom.operators import scan
from scanloom.operators.gate import gate, gate_from_changes
from scanloom.streaming import stream
from scanloom.streaming.state import gate_changes, latest_counts, run_gate_changes, run_latest_counts, with_rocksdb

SCHEMA = "repo string, path string, text string, mtime timestamp, error string"
DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def row(path, text, day, repo="r"):
    return repo, path, text, None if day is None else DAY + timedelta(days=day), None


def with_language(frame):
    return frame.withColumn("language", detect_language(F.col("path")))


@pytest.fixture
def arrivals(spark, tmp_path):
    """A folder of arriving files, and its stream."""

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return with_language(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))

    return arrive, stream


def run(spark, changes, tmp_path):
    """Everything that has arrived, on the same checkpoint each time."""
    def go():
        writer = changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    with_rocksdb(spark, go)
    return spark.read.parquet(str(tmp_path / "out"))


def as_row(frame):
    return {r.repo: (r.n_files, r.n_findings, r.n_syntax, r.deployable) for r in frame.collect()}


def test_a_later_fix_unblocks_and_a_restart_goes_on(spark, arrivals, tmp_path):
    arrive, stream = arrivals
    arrive(row("a.py", "DEBUG = True\nDEBUG = True", 1), row("b.py", "x = (", 1), row("c.py", "x = 1", 1), row("a.py", "DEBUG = True", 0))
    assert as_row(gate_from_changes(run(spark, gate_changes(stream()), tmp_path), "repo")) == {"r": (3, 2, 1, False)}
    # The same again, an older version late, and a version without a time.
    arrive(row("a.py", "DEBUG = True\nDEBUG = True", 1), row("c.py", "DEBUG = True", 0), row("c.py", "DEBUG = True", None))
    assert as_row(gate_from_changes(run(spark, gate_changes(stream()), tmp_path), "repo")) == {"r": (3, 2, 1, False)}
    arrive(row("a.py", "x = 2", 2))
    arrive(row("b.py", "x = ()", 2), row("d.py", "DEBUG = True", 2, "s"))
    changes = run(spark, gate_changes(stream()), tmp_path)
    assert as_row(gate_from_changes(changes, "repo")) == {"r": (3, 0, 0, True), "s": (1, 1, 0, False)}
    whole = gate_from_changes(changes).first()
    assert (whole.n_files, whole.n_findings, whole.deployable) == (4, 1, False)


def test_files_not_seen_for_long_are_taken_back(spark, arrivals, tmp_path):
    arrive, stream = arrivals
    changes = lambda: run(spark, gate_changes(stream(), forget="10 days", delay="1 day"), tmp_path)
    arrive(row("a.py", "DEBUG = True", 0), row("b.py", "DEBUG = True", 0))
    assert as_row(gate_from_changes(changes(), "repo")) == {"r": (2, 2, 0, False)}
    arrive(row("b.py", "DEBUG = True\nDEBUG = True", 8))
    assert as_row(gate_from_changes(changes(), "repo")) == {"r": (2, 3, 0, False)}
    arrive(row("c.py", "x = 1", 15, "s"))
    assert as_row(gate_from_changes(changes(), "repo")) == {"r": (1, 2, 0, False), "s": (1, 0, 0, True)}
    arrive(row("c.py", "x = 1", 40, "s"))
    assert as_row(gate_from_changes(changes(), "repo")) == {"s": (1, 0, 0, True)}


def test_agrees_with_the_batch_gate(spark, arrivals, tmp_path):
    arrive, stream = arrivals
    texts = ["", "x = 1", "DEBUG = True", "x = (", "DEBUG = True\nDEBUG = True", "import random\nDEBUG = True"]
    versions = {}
    for batch in range(3):
        rows = [row(f"f{i}.py", texts[(i * 7 + batch * 5 + i // 6) % 6], batch, f"r{i % 3}") for i in range(60) if (i + batch) % 4]
        versions |= {(r[0], r[1]): r for r in rows}
        arrive(*rows)
    spark_provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = as_row(run_gate_changes(gate_changes(stream()), "gate-test", "repo"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == spark_provider
    from scanloom.operators.scan import scan_files

    assert got == as_row(gate(scan_files(with_language(spark.createDataFrame(list(versions.values()), SCHEMA))), "repo"))


def test_unknown_grain(spark):
    with pytest.raises(ValueError):
        gate_from_changes(spark.createDataFrame([], "repo string, n_files long, n_findings long, n_syntax long"), "file")


def test_streams_read_a_folder_of_parts_as_a_single_file(spark, tmp_path):
    from scanloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/orders.parquet").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("stream_dedup", "stream_findings"):
        want = sorted(map(tuple, QUERIES[name](spark, sf).collect()))
        assert want and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_nothing_has_arrived(spark, tmp_path):
    folder = tmp_path / "empty"
    folder.mkdir()
    files = with_language(spark.readStream.schema(SCHEMA).parquet(str(folder)))
    scanned = stream.scan_stream(files)
    assert stream.run_to_table(scanned, "none").collect() == []
    assert stream.run_windows(stream.windowed_findings(files), "none").collect() == []
    by_batch = stream.run_gate(scanned, "none", "repo")
    assert by_batch.collect() == [] and by_batch.columns == [*gate(spark.createDataFrame([], scanned.schema), "repo").columns, "batch_id"]
    assert [(r.n_files, r.deployable) for r in run_gate_changes(gate_changes(files), "none").collect()] == [(0, True)]


@pytest.mark.parametrize("grain", ["repo", "corpus"])
def test_latest_counts_agree_with_changes_without_a_processor(spark, arrivals, grain):
    arrive, stream = arrivals
    arrive(row("a.py", "DEBUG = True", 1), row("b.py", "x = (", 1), row("c.py", None, None), row("a.py", "eval(1)", 1))
    arrive(row("a.py", "x = 1", 3), row("b.py", "x = (", 1), row("a.py", "DEBUG = True", 2), row("d.py", "DEBUG = True", None, None))
    arrive(row("a.py", "DEBUG = True", 2), row("c.py", "DEBUG = True", 0), row("b.py", "x = 1", 0), row("e.py", "DEBUG = True", 0, "s"))
    latest = latest_counts(stream())
    assert "TransformWithState" not in latest._jdf.queryExecution().analyzed().toString()
    got = run_latest_counts(latest, "latest-test", grain).collect()
    want = run_gate_changes(gate_changes(stream()), "changes-test", grain).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == (3 if grain == "repo" else 1)


def test_windows_count_findings_of_files_that_are_parsed_only_where_a_rule_may_apply(spark, arrivals):
    arrive, files = arrivals
    arrive(row("a.py", "DEBUG = True", 1))
    asked = []
    facts = scan.syntax.facts_column
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(scan.syntax, "facts_column", lambda text, focus=True, problems=True: asked.append(problems) or facts(text, focus, problems))
        scan._scan_column.cache_clear()
        stream.windowed_findings(files())
    scan._scan_column.cache_clear()
    assert asked == [False]
