"""Helpers that the operators of this subpackage share: tables, shared storage, words as arrays, exact running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are worked on in slices of about so many bytes, so that arrays of eight bytes a character stay small.
SLICE_BYTES = 1 << 19
#: Rows that Spark hands to Python at once, at most: texts are long.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def buckets_for(rows: int, most: int) -> int:
    """A number of parts of about ``most`` rows each."""
    return max(1, -(-rows // most))


# --- Arrow columns as arrays -------------------------------------------------------------------------------------


def one_chunk(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (nulls are empty)."""
    texts = pc.fill_null(one_chunk(column).cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1) if at is not None and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, of one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high
        low = high


# --- Hashing -----------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: equal in, equal out, one to one."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_int(x: int) -> int:
    return int(mixed(np.array([x & (2**64 - 1)], np.uint64))[0])


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _UNDO, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    return _powers(1 << max(16, int(size).bit_length()))


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    if fold:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    codes[list(SPACES)] = 0
    return codes


FOLDED, PLAIN = _byte_codes(True), _byte_codes(False)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and behind-last byte of each word of a slice, and where each text's words begin. Offsets start at 0.

    ``between`` tells of each byte whether it separates words.
    """
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = between[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(size, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of byte codes times powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, low: int, high: int, codes: np.ndarray = FOLDED):
    """Hashes of the words of rows low to high, and where each row's words begin."""
    at = offsets[low : high + 1] - offsets[low]
    part = data[offsets[low] : offsets[high]]
    starts, ends, begin = word_spans(part, at)
    return word_hashes(part, starts, ends, codes), begin


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte, so that the shuffle's compression finds the zeros."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, in their order."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


# --- Running sums over any number of rows --------------------------------------------------------------------------

#: Parts of a group, by ranges of a hash: a group with a third of all rows becomes so many window groups.
PARTS = 4096
HASH_RANGE = 1 << 31


def order_hash(*columns: str) -> Column:
    """A hash in [0, 2^31) that any engine with md5 can repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") * 8


def part_of(order: str) -> Column:
    return F.floor(F.col(order) * F.lit(PARTS) / F.lit(HASH_RANGE)).cast("int")


def part_sums(rows: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Sum of sizes and number of rows of each part of each group: a small table, written."""
    sums = rows.groupBy(F.col(group).alias("__group"), part_of(order).alias("__part"))
    return written(sums.agg(F.sum(size).alias("__size"), F.count(F.lit(1)).alias("__rows")), "sums")


def running(rows: DataFrame, group: str, order: str, ties: list[str], size: str, sums: DataFrame) -> DataFrame:
    """Add ``before`` (sum of ``size`` of earlier rows) and ``rank_before`` (their number) within each group.

    ``sums`` comes from ``part_sums``; further columns it has are added. Windows run inside parts only, and the join
    and the windows share one shuffle.
    """
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__size", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    base = base.withColumn("__rows", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    empty = F.lit("" if sums.schema["__group"].dataType.typeName() == "string" else -1)
    base = base.withColumn("__none", F.col("__group").isNull()).withColumn("__group", F.coalesce("__group", empty))
    keyed = rows.withColumn("__part", part_of(order)).withColumn("__none", F.col(group).isNull()).withColumn("__group", F.coalesce(F.col(group), empty))
    keys = ["__group", "__none", "__part"]
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(base, keys)
    out = out.withColumn("before", F.col("__size") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    out = out.withColumn("rank_before", F.col("__rows") + F.count(F.lit(1)).over(inside))
    return out.drop(*keys, "__size", "__rows")


#: Rows of a range, about, where a table has more than the session's shuffle partitions hold at that size.
ROWS_OF_RANGE = 500_000


def range_sums(rows: DataFrame, group: str, order: list[str], size: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``before`` (sum of ``size`` of earlier rows of the group), and (__group, __part, __size) by range.

    ``order`` ends in a column that no two rows share, and ``rows`` come from a table: ranges of (group, order) are then
    even, whatever ties there are, and windows run inside a range. Sums have a row a range and group that meet.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(rows.count(), ROWS_OF_RANGE))
    line = rows.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id())
    line = written(line, "ranges")
    sums = written(line.groupBy(F.col(group).alias("__group"), "__part").agg(F.sum(size).alias("__size")), "sums")
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__group", F.col("__part").alias("__of"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    out = line.join(starts, (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.select(*rows.columns, (F.col("__start") + F.col("__inside")).alias("before")), sums


# --- Connected components ------------------------------------------------------------------------------------------


#: Parts that the neighbours of a node are dealt into where they meet what is known of it: a node can have very many.
NEIGHBOUR_SALTS = 16


def _told(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with what ``known`` says of a; the pairs of one node lie in ``NEIGHBOUR_SALTS`` tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(NEIGHBOUR_SALTS - 1)))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(NEIGHBOUR_SALTS)).cast("int"))
    return salted.join(known.withColumn("salt", salts), ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Each round joins every node to the least node it or its neighbours know; a round's pairs are written before the
    next one, and only a count and a checksum reach the driver. Rounds grow with the logarithm of the longest chain.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        # Large star: neighbours above a node hang on the least node it sees.
        both = pairs.union(pairs.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _told(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and those below it hang on the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _told(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = written(small.select("e.*").where("a <> b").distinct(), "links")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
