import os

import pytest
from pyspark.sql import functions as F

from scanloom.operators import gate, scan
from scanloom.plans.corpus import corpus
from scanloom.sources import tables, tree
from scanloom.streaming import stream


@pytest.fixture()
def root(tmp_path):
    base = tmp_path / "project with spaces"
    texts = {
        "a.py": "DEBUG = True\n", "pkg/__init__.py": "x = 1\n", "pkg/_p.PY": "x = 1\n", ".hidden/h.js": "exec(1)\n", "deep/er/f.tsx": "let x\n",
        "node_modules/m.js": "exec(1)\n", "pkg/build/b.py": "DEBUG = True\n", "notes.txt": "x", "crlf.js": "a\r\ntry {\r\n} catch (e) {\r\n}\r\n",
    }
    for name, text in texts.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (base / "bytes.py").write_bytes(b"x = '\xff'\n")
    os.symlink(base / "a.py", base / "link.py")
    os.symlink(base / "deep", base / "linked")
    return base


@pytest.mark.parametrize("splits", [1, 3, 256])
def test_tree_lists_what_it_should(spark, root, splits):
    listed = tree.list_tree(spark, root, splits).collect()
    names = sorted(os.path.relpath(r.path, root) for r in listed)
    assert names == sorted(["a.py", "pkg/__init__.py", "pkg/_p.PY", ".hidden/h.js", "deep/er/f.tsx", "crlf.js", "bytes.py"])


def test_tree_is_read_and_scanned(spark, root):
    files = tree.read_tree(spark, root, repo_depth=1, tasks=3)
    rows = {os.path.relpath(r.path, root): r for r in scan.scan_files(files).collect()}
    assert rows["bytes.py"].text == "x = '�'\n"
    assert rows["crlf.js"].findings[0].line == 3
    assert rows["deep/er/f.tsx"].language == "typescript" and rows["deep/er/f.tsx"].repo == "deep"
    assert rows["a.py"].mtime is not None
    assert {n for n, r in rows.items() if r.findings} == {"a.py", ".hidden/h.js", "crlf.js"}


def test_listing_has_no_more_tasks_than_asked_for(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}" / "below").mkdir(parents=True)
        (tmp_path / f"d{i}" / "below" / "a.py").write_text("x = 1\n")
    listed = tree.list_tree(spark, tmp_path, 4)
    assert listed.count() == 40 and len(tree.SourceTreeReader({"path": str(tmp_path), "splits": "4"}).partitions()) <= 8


def test_texts_are_read_by_several_tasks(spark, root):
    files = tree.read_tree(spark, root, tasks=5)
    files.collect()
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_single_file_missing_path_and_ignored_root(spark, root):
    assert [r.path for r in tree.read_tree(spark, root / "a.py").collect()] == [str(root / "a.py")]
    assert tree.read_tree(spark, root / "notes.txt").count() == 0
    assert tree.read_tree(spark, root / "absent").count() == 0
    # Names are left out below the root only.
    assert tree.read_tree(spark, root / "node_modules").count() == 1


def test_unreadable_file_is_a_syntax_issue(spark, root):
    gone = spark.createDataFrame([(str(root / "gone.py"), None)], "path string, mtime timestamp")
    texts = gone.mapInArrow(tree._read_batches, "path string, text string, mtime timestamp, error string")
    files = texts.select(F.lit("r").alias("repo"), "path", F.lit("python").alias("language"), "text", "mtime", "error")
    issue = scan.syntax_issues(scan.scan_files(files)).first()
    assert "gone.py" in issue.message and issue.line == 0
    assert not gate.gate(scan.scan_files(files)).first().deployable


def test_tables_as_sources_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, bytearray(b"DEBUG = True\n")), (2, bytearray(b"\xff"))], "id int, code binary")
    files = tables.from_table(frame, "id", "code", language="python", repo="id")
    assert files.columns == ["repo", "path", "language", "text", "mtime", "error"]
    scanned = scan.scan_files(files)
    tables.write_json(scanned, tmp_path / "json")
    read = spark.read.json(str(tmp_path / "json"))
    assert sorted((r.file, r.fail_count) for r in read.collect()) == [("1", 1), ("2", 0)]
    tables.write_findings(scan.findings(scanned), tmp_path / "findings")
    assert spark.read.parquet(str(tmp_path / "findings")).where("rule_id = 'NO_DEBUG_MODE'").count() == 1


SF = "/root/testdata/sf0.001"


def arriving(spark, tmp_path, parts):
    """Orders in several files, read one file a micro-batch."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderdate", F.expr("timestamp '2020-01-01' + make_dt_interval(0, o_orderkey)"))
    folder = str(tmp_path / "in")
    for i in range(parts):
        orders.where(F.col("o_orderkey") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    stream_ = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    files = corpus(stream_, "o_orderkey", F.col("o_orderpriority"), F.col("o_orderdate"))
    return files, corpus(orders, "o_orderkey", F.col("o_orderpriority"), F.col("o_orderdate"))


def test_streams_find_what_batches_find(spark, tmp_path):
    files, batch = arriving(spark, tmp_path, 3)
    streamed = stream.run_to_table(scan.findings(stream.scan_stream(files)), "t-findings")
    want = scan.findings(scan.scan_files(batch))
    assert streamed.exceptAll(want).count() == 0 and want.exceptAll(streamed).count() == 0


def test_each_batch_has_its_gate(spark, tmp_path):
    files, batch = arriving(spark, tmp_path, 3)
    gates = stream.run_gate(stream.scan_stream(files), "t-gate")
    whole = gate.gate(scan.scan_files(batch)).first()
    assert gates.count() == 3
    assert tuple(gates.agg(F.sum("n_files"), F.sum("n_findings")).first()) == (whole.n_files, whole.n_findings)


def test_repeated_batch_leaves_no_duplicates(spark, files, tmp_path):
    scanned = scan.scan_files(files({"a.py": "DEBUG = True\n"}))
    write = stream.gate_each_batch(str(tmp_path / "gates"))
    write(scanned, 0)
    write(scanned, 0)
    assert spark.read.parquet(str(tmp_path / "gates")).count() == 1


def test_unchanged_files_that_come_again_are_dropped(spark, tmp_path):
    files, batch = arriving(spark, tmp_path, 2)
    twice = files.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    assert stream.run_to_table(stream.new_arrivals(twice, "30 days"), "t-dedup").count() == batch.count()
