"""A tree as a stream, and new versions of a tree."""

import os
import pickle
import time
from contextlib import contextmanager

import pytest

from scanloom.operators.gate import gate
from scanloom.operators.patch import apply_patches
from scanloom.operators.scan import findings, scan_files
from scanloom.sources import tree
from scanloom.sources.tree import read_tree, stream_tree, write_tree


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")


def run(spark, frame, folder, **trigger):
    """Batches of (batch, path) that have come out so far."""
    writer = frame.select("path", "text").writeStream.option("checkpointLocation", str(folder / "state"))

    def keep(batch, number):
        batch.coalesce(1).write.mode("overwrite").parquet(str(folder / f"out/batch={number}"))

    query = writer.foreachBatch(keep).trigger(**(trigger or {"availableNow": True})).start()
    if trigger:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    rows = spark.read.parquet(str(folder / "out")).collect() if (folder / "out").exists() else []
    return sorted((r.batch, os.path.basename(r.path), r.text) for r in rows)


def test_files_come_once_and_again_when_changed(spark, tmp_path):
    root, folder = tmp_path / "tree", tmp_path / "work"
    put(root, "a.py", "1")
    put(root, "deep/__init__.py", "2")
    put(root, "node_modules/x.js", "ignored")
    put(root, "notes.txt", "ignored")
    stream = lambda: stream_tree(spark, root, tasks=2, settle=0)
    assert run(spark, stream(), folder) == [(0, "__init__.py", "2"), (0, "a.py", "1")]
    # A restart: nothing comes twice.
    assert len(run(spark, stream(), folder)) == 2
    put(root, "a.py", "changed")
    put(root, "b.ts", "new")
    os.utime(root / "b.ts", (1, 1))  # with an old time of its own
    got = run(spark, stream(), folder)
    assert [r for r in got if r[0] > 0] == [(1, "a.py", "changed"), (1, "b.ts", "new")]
    assert len(run(spark, stream(), folder)) == 4


def test_batches_are_bounded(spark, tmp_path):
    root, folder = tmp_path / "tree", tmp_path / "work"
    for i in range(5):
        put(root, f"d{i}/f{i}.py", str(i))
    stream = lambda: stream_tree(spark, root, tasks=2, max_files=2, progress=str(folder / "progress"), settle=0)
    got = run(spark, stream(), folder, processingTime="0 seconds")
    assert sorted(r[1] for r in got) == [f"f{i}.py" for i in range(5)]
    assert max(sum(r[0] == b for r in got) for b in range(5)) == 2
    # After a restart batches are bounded too, and where the note is lost nothing comes twice.
    for i in range(5, 9):
        put(root, f"f{i}.py", str(i))
    got = run(spark, stream(), folder, processingTime="0 seconds")
    assert sorted(r[1] for r in got) == [f"f{i}.py" for i in range(9)]
    assert max(sum(r[0] == b for r in got) for b in range(9)) == 2
    (folder / "progress").write_text("lost")
    for i in range(9, 12):
        put(root, f"f{i}.py", str(i))
    got = run(spark, stream(), folder, processingTime="0 seconds")
    assert sorted(r[1] for r in got) == sorted(f"f{i}.py" for i in range(12))


def test_bounds_need_a_note(spark, tmp_path):
    put(tmp_path, "a.py", "1")
    with pytest.raises(Exception, match="progress"):
        run(spark, stream_tree(spark, tmp_path, max_files=1), tmp_path / "work")


def test_files_added_while_the_stream_runs(spark, tmp_path):
    root, folder = tmp_path / "tree", tmp_path / "work"
    put(root, "a.py", "1")
    query = (
        findings(scan_files(stream_tree(spark, root, tasks=2, settle=0)))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(folder / "state"))
        .trigger(processingTime="0 seconds")
        .start(str(folder / "out"))
    )
    try:
        query.processAllAvailable()
        for i in range(3):
            put(root, f"b{i}.py", "DEBUG = True")
            time.sleep(0.05)
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(os.path.basename(r.path) for r in spark.read.parquet(str(folder / "out")).collect()) == ["b0.py", "b1.py", "b2.py"]


def test_a_patched_tree_is_written_beside_the_old_one(spark, tmp_path):
    old, new = tmp_path / "v1", tmp_path / "v2"
    put(old, "app/a.py", "DEBUG = True\n")
    put(old, "app/b.py", "x = 'é'\r\ny = 1\n")
    put(old, "empty.js", "")
    files = read_tree(spark, old, tasks=3)
    fixed = spark.createDataFrame([("v1", str(old / "app/a.py"), True, "DEBUG = False\n", "t")], "repo string, path string, accepted boolean, text string, tool string")
    write_tree(apply_patches(files, fixed), new, old)
    assert {str(p.relative_to(new)): p.read_bytes() for p in new.rglob("*") if p.is_file()} == {
        "app/a.py": b"DEBUG = False\n", "app/b.py": "x = 'é'\ny = 1\n".encode(), "empty.js": b"",
    }
    assert (old / "app/a.py").read_text() == "DEBUG = True\n"
    assert gate(scan_files(read_tree(spark, new, tasks=3))).first().deployable
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v1", "v2"]


@pytest.mark.parametrize("bad", ["../out.py", "same.py", ""])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = [("same.py", "1"), ("other/x.py", "2"), (bad, "3")]
    with pytest.raises(Exception):
        write_tree(spark.createDataFrame(rows, "path string, text string").repartition(3), tmp_path / "new")
    assert list(tmp_path.iterdir()) == []


def test_a_tree_is_never_overwritten(spark, tmp_path):
    put(tmp_path / "new", "a.py", "1")
    rows = spark.createDataFrame([("b.py", "2"), ("none.py", None)], "path string, text string")
    with pytest.raises(Exception, match="FileExistsError"):
        write_tree(rows, tmp_path / "new")
    write_tree(rows, tmp_path / "other")
    assert [p.name for p in (tmp_path / "other").iterdir()] == ["b.py"]


def test_texts_of_a_tree_come_to_python_in_small_batches(spark, files, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, left in [("10000", "1000"), ("0", "1000"), ("10", "10")]:
            spark.conf.set(name, given)
            write_tree(files({"a.py": "x = 1"}), str(tmp_path / given))
            assert spark.conf.get(name) == left
            spark.conf.set(name, given)
            assert read_tree(spark, str(tmp_path / given)).count() == 1 and spark.conf.get(name) == left
    finally:
        spark.conf.set(name, before)


def test_files_of_a_batch_are_listed_by_tasks(tmp_path, monkeypatch):
    """The driver tells tasks of directories, whatever lies in them; a large directory is listed by several, each file once."""
    for i in range(400):
        put(tmp_path, f"f{i}.py", "x")
    put(tmp_path, "below/g.py", "x")
    monkeypatch.setattr(tree, "_SLICE_ENTRIES", 100)
    reader = tree.SourceTreeStreamReader({"path": str(tmp_path), "settle": "0", "splits": "64"})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert max(len(pickle.dumps(part)) for part in parts) < 1000
    rows = [[row[0] for row in reader.read(part)] for part in parts]
    assert len([r for r in rows if r]) >= 5 and max(map(len, rows)) < 200
    assert sorted(os.path.basename(p) for r in rows for p in r) == sorted(["g.py", *(f"f{i}.py" for i in range(400))])
    assert reader.partitions(end, end) == []
    put(tmp_path, "f7.py", "changed")
    again = [row[0] for part in reader.partitions(end, reader.latestOffset()) for row in reader.read(part)]
    assert [os.path.basename(p) for p in again] == ["f7.py"]
    # What has changed since the batch was bounded is left to a later one.
    assert "f7.py" not in {os.path.basename(row[0]) for part in parts for row in reader.read(part)}


def test_a_batch_reader_deals_a_large_directory(tmp_path, monkeypatch):
    for i in range(400):
        put(tmp_path, f"f{i}.py", "x")
    monkeypatch.setattr(tree, "_SLICE_ENTRIES", 100)
    reader = tree.SourceTreeReader({"path": str(tmp_path)})
    rows = [[row[0] for row in reader.read(part)] for part in reader.partitions()]
    assert len(rows) == 5 and max(map(len, rows)) < 200 and len({p for r in rows for p in r}) == sum(map(len, rows)) == 400


def test_a_file_removed_while_its_directory_is_listed_hides_no_other(tmp_path, monkeypatch):
    for i in range(5):
        put(tmp_path, f"f{i}.py", "x")
    listed = os.scandir

    class Entry:
        def __init__(self, entry):
            self.name, self.path, self.is_dir, self.is_file, self.entry = entry.name, entry.path, entry.is_dir, entry.is_file, entry

        def stat(self, **kind):
            if self.name == "f2.py":
                raise FileNotFoundError(self.path)
            return self.entry.stat(**kind)

    @contextmanager
    def scandir(folder):
        with listed(folder) as entries:
            yield sorted(map(Entry, entries), key=lambda e: e.name)

    monkeypatch.setattr(os, "scandir", scandir)
    stream, batch = tree.SourceTreeStreamReader({"path": str(tmp_path), "settle": "0"}), tree.SourceTreeReader({"path": str(tmp_path)})
    for reader, parts in [(stream, stream.partitions(stream.initialOffset(), stream.latestOffset())), (batch, batch.partitions())]:
        names = sorted(os.path.basename(row[0]) for part in parts for row in reader.read(part))
        assert names == ["f0.py", "f1.py", "f3.py", "f4.py"]
