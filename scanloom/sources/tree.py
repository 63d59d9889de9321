"""A directory tree of source files as a table.

Spark's own file sources hide names that begin with ``_`` or ``.``, so
``__init__.py`` would be lost. The ``source_tree`` data source lists such
trees on the executors, where they must be mounted; paths are then spread by
hash and the texts are read.
"""

from __future__ import annotations

import heapq
import json
import os
import shutil
import sys
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from scanloom.functions import fixed
from scanloom.functions.text import detect_language
from scanloom.session import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENDINGS = tuple(fixed.LANGUAGES)
_IGNORED = frozenset(fixed.IGNORED_DIRECTORIES)
_LISTING = "path string, size long, mtime timestamp"


def _wanted(entry: os.DirEntry | Path) -> bool:
    dot = entry.name.rfind(".")
    return dot > 0 and entry.name[dot:].lower() in _ENDINGS


def _row(path: str, info: os.stat_result) -> tuple:
    return path, info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc)


#: A directory of very many entries is listed by a task for each so many of them, but by no more than so many tasks: every one
#: of them goes over all names, and looks at its own files only.
_SLICE_ENTRIES, _SLICES = 50_000, 16


def _below(directory: str, number: int = 0, slices: int = 1) -> Iterator[tuple[str, os.stat_result | None]]:
    """What lies in a directory, links left out: (path, None) for directories to enter, (path, state) for wanted files.

    Of several slices each gives the files whose names hash to its number, and every directory.
    """
    try:
        with os.scandir(directory) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in _IGNORED:
                        yield entry.path, None
                elif entry.is_file(follow_symlinks=False) and _wanted(entry):
                    if slices == 1 or zlib.crc32(os.fsencode(entry.name)) % slices == number:
                        try:
                            info = entry.stat(follow_symlinks=False)
                        except FileNotFoundError:
                            continue  # removed meanwhile; the rest of the directory is still there
                        yield entry.path, info
    except OSError:
        pass  # gone or unreadable: it holds nothing to scan


def _directories(directory: str) -> tuple[list[str], int]:
    """Directories to enter, and how many entries there are; no file is looked at."""
    found, entries = [], 0
    try:
        with os.scandir(directory) as listed:
            for entry in listed:
                entries += 1
                if entry.is_dir(follow_symlinks=False) and entry.name not in _IGNORED:
                    found.append(entry.path)
    except OSError:
        pass  # gone or unreadable: it holds nothing to scan
    return found, entries


class _Part(InputPartition):
    """Directories that one task lists, each as (path, slice, number of slices); with ``deep``, all that lies below them too.

    Of a stream, only files after ``low`` and up to ``high`` count.
    """

    def __init__(self, directories: list[tuple[str, int, int]], deep: bool, low=None, high=None):
        self.directories, self.deep, self.low, self.high = directories, deep, low, high

    def files(self) -> Iterator[tuple[str, os.stat_result]]:
        waiting = list(self.directories)
        while waiting:
            for path, info in _below(*waiting.pop()):
                if info is not None:
                    yield path, info
                elif self.deep:
                    waiting.append((path, 0, 1))


def _parts(root: str, splits: int, low=None, high=None) -> list[_Part]:
    """Enter the tree breadth first until there is a directory for every task; tasks walk the rest.

    Directories are dealt to ``splits`` tasks at most, however many lie side by side. Files are listed by tasks alone.
    """
    waiting, entered = deque([root]), []
    while waiting and len(waiting) + len(entered) < splits and os.path.isdir(waiting[0]):
        directory = waiting.popleft()
        found, entries = _directories(directory)
        slices = min(_SLICES, splits, 1 + entries // _SLICE_ENTRIES)
        entered += [(directory, i, slices) for i in range(slices)]
        waiting.extend(found)
    below = [(directory, 0, 1) for directory in waiting]
    dealt = [(entered[i::splits], False) for i in range(min(splits, len(entered)))]
    dealt += [(below[i::splits], True) for i in range(min(splits, len(below)))]
    return [_Part(directories, deep, low, high) for directories, deep in dealt]


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.splits = int(options.get("splits", "256"))

    def partitions(self):
        return _parts(self.root, self.splits)

    def read(self, partition):
        first = partition.directories[0][0]
        if os.path.isfile(first):
            file = Path(first)
            if _wanted(file):
                yield _row(str(file), file.stat())
            return
        for path, info in partition.files():
            yield _row(path, info)


# The tree as a stream


def _walk(root: str) -> Iterator[tuple[int, str]]:
    """(time, path) of every source file below a root; the time is when its entry last changed."""
    for path, info in _Part([(root, 0, 1)], True).files():
        yield info.st_ctime_ns, path


def _position(offset: dict) -> tuple[int, str]:
    return int(offset["time"]), offset["path"]


class SourceTreeStreamReader(DataSourceStreamReader):
    """New and changed files in the order of (time, path), which is the offset.

    The time is that of the entry's last change, which the system sets: a file moved in or written with an old time of its
    own is later than all before it. ``maxFilesPerTrigger`` bounds a batch. After a restart Spark does not tell a reader
    where it stands, so the first batch then takes all that is new. A file younger than ``settle`` seconds waits, so that
    none is passed by another of the same moment; where a mount keeps attributes for a while, ``settle`` must be longer.
    The driver looks for the last position only. The files of a batch are listed by its tasks, each in directories, or
    slices of one, of its own; a file that changes meanwhile comes with a later batch.
    """

    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.splits = int(options.get("splits", "256"))
        self.progress = options.get("progress")
        self.most = int(options.get("maxFilesPerTrigger", "0"))
        self.settle_ns = int(float(options.get("settle", "1")) * 1e9)
        # Where the query stands, or None where that is not known.
        self.reached = (0, "") if self.progress and not os.path.exists(self.progress) else self._noted()
        if self.most and not self.progress:
            raise ValueError("maxFilesPerTrigger needs progress, a file that outlives restarts")

    def _noted(self) -> tuple[int, str] | None:
        try:
            with open(self.progress or "", encoding="utf-8") as file:
                return _position(json.load(file))
        except (OSError, ValueError, KeyError):
            return None

    def _note(self, offset: dict) -> None:
        self.reached = max(_position(offset), self.reached or (0, ""))
        if self.progress:
            os.makedirs(os.path.dirname(os.path.abspath(self.progress)), exist_ok=True)
            with open(f"{self.progress}.new", "w", encoding="utf-8") as file:
                json.dump({"time": str(self.reached[0]), "path": self.reached[1]}, file)
            os.replace(f"{self.progress}.new", self.progress)

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        now = datetime.now(timezone.utc).timestamp() * 1e9 - self.settle_ns
        start = self.reached or (0, "")
        new = (position for position in _walk(self.root) if start < position and position[0] <= now)
        if self.most and self.reached is not None:
            admitted = heapq.nsmallest(self.most, new)
            end = admitted[-1] if admitted else start
        else:
            end = max(new, default=start)
        return {"time": str(end[0]), "path": end[1]}

    def partitions(self, start: dict, end: dict):
        low, high = _position(start), _position(end)
        self._note(end)
        return _parts(self.root, self.splits, low, high) if low < high else []

    def read(self, partition):
        for path, info in partition.files():
            if partition.low < (info.st_ctime_ns, path) <= partition.high:
                yield _row(path, info)

    def commit(self, end: dict) -> None:
        self._note(end)


# A new version of a tree


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class SourceTreeWriter(DataSourceArrowWriter):
    """Writes (path, text) as files of a new tree; paths are relative to it.

    Tasks write below a staging folder beside the tree, each attempt in a folder of its own. Commit puts the files of
    the attempts that counted together and gives the folder its name, which must not be taken: readers see nothing or
    all. Abort and commit both remove the staging folder, so a failed task leaves nothing.
    """

    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("a tree is never overwritten: write the new version beside the old one")
        self.root = os.path.abspath(options["path"])
        if os.path.lexists(self.root):
            raise FileExistsError(self.root)
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        os.makedirs(folder)
        files, made = 0, {folder}
        for batch in iterator:
            # Strings of Spark are UTF-8 already: they are written as they are.
            texts = batch.column("text")
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for path, text in zip(batch.column("path").to_pylist(), texts.to_pylist(), strict=True):
                target = os.path.normpath(f"{folder}/{path}")
                if text is None:
                    continue  # a file that could not be read has nothing to write
                if not path or path.endswith("/") or not target.startswith(folder + "/"):
                    raise ValueError(f"not a path inside the tree: {path!r}")
                if (parent := os.path.dirname(target)) not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                with open(target, "xb", buffering=0) as file:
                    rest = memoryview(text)
                    while rest:
                        rest = rest[file.write(rest) :]
                files += 1
        return _Written(folder, files)

    def commit(self, messages):
        whole = f"{self.staging}/whole"
        try:
            os.makedirs(whole)
            for message in messages:
                if message:
                    _join_trees(message.folder, whole)
            os.rename(whole, self.root)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


def _join_trees(source: str, target: str) -> None:
    """Move what lies below one directory into another; directories meet, files must not."""
    for entry in list(os.scandir(source)):
        there = f"{target}/{entry.name}"
        if not os.path.lexists(there):
            os.rename(entry.path, there)
        elif entry.is_dir(follow_symlinks=False) and os.path.isdir(there):
            _join_trees(entry.path, there)
        else:
            raise FileExistsError(f"two files for one path: {entry.name}")


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: path, size and time of each source file.

    ``readStream`` gives new and changed files as they come, ``write`` a new tree from (path, text).
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return _LISTING

    def reader(self, schema):
        return SourceTreeReader(self.options)

    def streamReader(self, schema):
        return SourceTreeStreamReader(self.options)

    def writer(self, schema, overwrite):
        return SourceTreeWriter(self.options, overwrite)


_BATCH_BYTES = 8 << 20


def _read(path: str) -> tuple[str | None, str | None]:
    """Text of a file, or what kept it from being read. Bytes that are no UTF-8 become replacement characters."""
    try:
        with open(path, "rb", buffering=0) as file:
            text = file.read().decode("utf-8", "replace")
    except OSError as problem:
        return None, str(problem)
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text), None


def _read_batches(batches):
    """Texts of listed files, in batches of a few megabytes."""
    kinds = pa.schema(
        [("path", pa.string()), ("text", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")), ("error", pa.string())]
    )
    for batch in batches:
        paths, mtimes = batch.column("path"), batch.column("mtime").cast(kinds.field("mtime").type)
        start, texts, errors, held = 0, [], [], 0
        for number, path in enumerate(paths.to_pylist(), 1):
            text, error = _read(path)
            texts.append(text)
            errors.append(error)
            held += len(text or "")
            if held > _BATCH_BYTES or number == len(paths):
                size = number - start
                columns = [paths.slice(start, size).cast(pa.string()), pa.array(texts, pa.string()), mtimes.slice(start, size), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
                start, texts, errors, held = number, [], [], 0


def list_tree(spark: SparkSession, root: str, splits: int = 256) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("splits", splits).load(str(root))


def read_tree(spark: SparkSession, root: str, repo_depth: int = 0, tasks: int | None = None) -> DataFrame:
    """``source_files`` of a directory or a single file that all executors can see.

    Paths are spread by hash before texts are read, so that one large
    directory is read by many tasks. Their number is ``tasks``, or that of
    shuffle partitions: left to itself, Spark would join the tasks again, as
    paths are much smaller than the texts behind them. ``repo_depth``
    directories below the root name the repository; with 0 it is the name of
    the root.
    """
    real = os.path.realpath(str(root))
    listed = list_tree(spark, real)
    return _source_files(listed, real, repo_depth, tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))


def stream_tree(
    spark: SparkSession, root: str, repo_depth: int = 0, tasks: int | None = None,
    max_files: int | None = None, progress: str | None = None, settle: float = 1,
) -> DataFrame:
    """``source_files`` of a directory as a stream: every file once, and again whenever it has changed.

    ``max_files`` bounds a batch, and needs ``progress``, a file of this query alone beside its checkpoint; a trigger
    ``availableNow`` makes one batch of at most so many files. Paths are listed and texts read by tasks. Removed files give no row. The rest is as in ``read_tree``.
    """
    spark.dataSource.register(SourceTree)
    real = os.path.realpath(str(root))
    stream = spark.readStream.format("source_tree").option("settle", str(settle))
    if max_files:
        stream = stream.option("maxFilesPerTrigger", str(max_files))
    if progress:
        stream = stream.option("progress", os.path.abspath(progress))
    return _source_files(stream.load(real), real, repo_depth, tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_tree(source_files: DataFrame, root: str, old_root: str = "") -> None:
    """Write files as a new tree, which must not exist yet and be mounted on every machine.

    ``old_root`` is taken off the front of paths, so that a tree read with ``read_tree`` and patched is written beside
    the old one. Rows without a text are left out; two rows with one path, or a path that leads outside, fail the whole.
    Only source files are rows, so other files of the old tree are not in the new one.
    """
    source_files.sparkSession.dataSource.register(SourceTree)
    small_batches(source_files.sparkSession)
    old = os.path.realpath(old_root).rstrip("/") + "/" if old_root else ""
    below = F.when(F.startswith("path", F.lit(old)), F.substring(F.col("path"), len(old) + 1, 1 << 30)).otherwise(F.col("path"))
    source_files.select(below.alias("path"), "text").write.format("source_tree").mode("append").save(str(root))


def _source_files(listed: DataFrame, real: str, repo_depth: int, tasks: int) -> DataFrame:
    small_batches(listed.sparkSession)
    # Every path is the root itself or lies below it.
    inside = listed.where((F.col("path") == real) | F.startswith("path", F.lit(real.rstrip("/") + "/")))
    spread = inside.repartition(tasks, "path")
    texts = spread.select("path", "mtime").mapInArrow(
        _read_batches, "path string, text string, mtime timestamp, error string"
    )
    repo = F.lit(os.path.basename(real))
    if repo_depth:
        below = F.split(F.substring(F.col("path"), len(real.rstrip("/")) + 2, 1 << 30), "/")
        repo = F.array_join(F.slice(below, 1, repo_depth), "/")
    return texts.select(
        repo.alias("repo"), "path", detect_language(F.col("path")).alias("language"), "text", "mtime", "error"
    )
