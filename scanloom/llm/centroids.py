"""Lloyd's clustering with vectors cut by dimension.

Vectors become integers and are written as blocks: a row holds a chunk of vectors and a slice of their dimensions.
In each round every block adds up exact partial distances to its slice of the centroids; partial distances meet by
chunk, are summed, and the least one labels each vector. Labels go back to the blocks, which lie bucketed by chunk and
slice, so that only labels are shuffled; each block sums its vectors by label, and every slice of the centroids is moved
from the sums of its own blocks.

Only centroids, whose size is a parameter, pass through the driver. A round reads the written blocks, so lineage stays
short; a cluster is no key of any shuffle of vectors, so a large one does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import binary_column, from_planes, one_chunk, planes, shared_folder, table

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Dimensions of a slice, and vectors of a chunk.
SLICE = 32
CHUNK = 4096
#: Components beyond this count as this, so that distances fit 64 bits.
MOST = 1 << 27
#: The block that holds ids instead of components.
IDS = -1

_BLOCK = "chunk long, slice int, n int, body binary"


def _cast(values: np.ndarray) -> np.ndarray:
    """The narrowest signed integers that hold the values."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind)


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers byte by byte in their narrowest width, which the first byte names."""
    some = _cast(values.ravel())
    return bytes([some.dtype.itemsize]) + planes(some)


def numbers(raw: bytes) -> np.ndarray:
    return from_planes(raw[1:], f"<i{raw[0]}").astype(np.int64)


def usable(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dimensions`` finite numbers, and those rows as doubles."""
    column = one_chunk(column)
    rows = len(column)
    if not rows:
        return np.zeros(0, bool), np.zeros((0, dimensions))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    right = sizes == dimensions
    kept = column.filter(pa.array(right))
    flat = kept.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    finite = np.isfinite(values).all(axis=1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, values[finite]


def integers(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64)


def _write_blocks(dimensions: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def chunk() -> pa.RecordBatch:
            nonlocal number
            every = np.concatenate(vectors)
            names = packed_numbers(np.concatenate(ids))
            bodies = [np.packbits(np.concatenate(known)).tobytes() + names]
            starts = range(0, dimensions, width)
            bodies += [packed_numbers(every[:, s : s + width]) for s in starts]
            n = len(bodies)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(place << 32) + number] * n, pa.int64()),
                    pa.array([IDS, *range(n - 1)], pa.int32()),
                    pa.array([len(every)] * n, pa.int32()),
                    binary_column(bodies),
                ],
                ["chunk", "slice", "n", "body"],
            )
            number += 1
            for held in (ids, known, vectors):
                held.clear()
            return out

        size = 0
        for batch in batches:
            right, values = usable(batch.column(1), dimensions)
            names = batch.column(0).filter(pa.array(right))
            for low in range(0, len(values), CHUNK):
                some = names.slice(low, CHUNK)
                known.append(np.asarray(some.is_valid()))
                ids.append(np.asarray(some.fill_null(0)))
                vectors.append(integers(values[low : low + CHUNK]))
                size += len(some)
                if size >= CHUNK:
                    yield chunk()
                    size = 0
        if size:
            yield chunk()

    return run


@dataclass
class Blocks:
    """Written blocks of vectors, bucketed by chunk and slice, and the table that names them."""

    spark: SparkSession
    name: str
    dimensions: int
    width: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def vectors(self) -> DataFrame:
        return self.rows.where(F.col("slice") != IDS)

    @property
    def slices(self) -> int:
        return -(-self.dimensions // self.width)

    def dropped(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def blocks_of(vectors: DataFrame, dimensions: int = DIMENSIONS, width: int = SLICE) -> Blocks:
    spark = vectors.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_write_blocks(dimensions, width), _BLOCK)
    dealt = rows.repartition(buckets, "chunk", "slice").write.bucketBy(buckets, "chunk", "slice").sortBy("chunk", "slice")
    dealt.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return Blocks(spark, name, dimensions, width)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The kept vectors with the smallest hashes of their ids; rows that share an id by their components."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, values = usable(batch.column(1), dimensions)
            whole = pa.array(list(integers(values)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right)), whole], ["name", "vector"])

    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "embedding").mapInArrow(kept, "name string, vector array<long>")
    first = rows.orderBy("name", "vector").limit(clusters).collect()
    return np.array([r.vector for r in first], np.int64).reshape(-1, dimensions)


def _partial(centroids: np.ndarray, width: int):
    """Partial distances of a block's vectors to its slice of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for which, n, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                mine = centroids[:, which * width : (which + 1) * width]
                part = numbers(body.as_py()).reshape(n, -1)
                far = np.stack([((part - c) ** 2).sum(axis=1) for c in mine])
                out.append(packed_numbers(far))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), binary_column(out)], ["chunk", "n", "far"])

    return run


def _labelled(held: pa.Table) -> pa.Table:
    """Blocks of one chunk added up; of each vector the nearest centroid, the smaller number first, and its distance."""
    n = held["n"][0].as_py()
    far = sum(numbers(x.as_py()) for x in held["far"]).reshape(-1, n)
    label = far.argmin(axis=0)
    least = packed_numbers(far[label, np.arange(n)])
    return pa.table({"chunk": held["chunk"][:1], "labels": binary_column([packed_numbers(label)]), "far": binary_column([least])})


def labels_of(blocks: Blocks, centroids: np.ndarray) -> DataFrame:
    """(chunk, labels, far) of all chunks: one row for each is shuffled from every slice."""
    partial = blocks.vectors.mapInArrow(_partial(centroids, blocks.width), "chunk long, n int, far binary")
    return partial.groupBy("chunk").applyInArrow(_labelled, "chunk long, labels binary, far binary")


def _label_sums(clusters: int):
    """Sums of the components of each label, by slice; a task adds up all its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for which, n, body, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                part, label = numbers(body.as_py()).reshape(n, -1), numbers(labels.as_py())
                sums, counts = total.setdefault(which, (np.zeros((clusters, part.shape[1]), object), np.zeros(clusters, np.int64)))
                for c in np.unique(label).tolist():
                    mine = part[label == c]
                    sums[c] += mine.sum(axis=0).astype(object)
                    counts[c] += len(mine)
        rows = [(which, c, at, int(s), int(counts[c])) for which, (sums, counts) in total.items() for c in np.flatnonzero(counts).tolist() for at, s in enumerate(sums[c])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38), pa.int64()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "cluster", "at", "total", "n"])

    return run


def moved(blocks: Blocks, labels: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each slice of each centroid becomes the floor of the mean of its vectors; an empty cluster stays."""
    every = F.explode(F.array(*[F.lit(i) for i in range(blocks.slices)]))
    sent = labels.select("chunk", "labels", every.alias("slice"))
    held = blocks.vectors.join(sent, ["chunk", "slice"]).select("slice", "n", "body", "labels")
    sums = held.mapInArrow(_label_sums(len(centroids)), "slice int, cluster int, at int, total decimal(38,0), n long")
    sums = sums.groupBy("slice", "cluster", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    after = centroids.copy()
    for r in sums.collect():  # a row for each component of each centroid
        after[r.cluster, r.slice * blocks.width + r["at"]] = int(r.total) // r.n
    return after


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, body, labels, far in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = -(-n // 8)
            known = np.unpackbits(np.frombuffer(body, np.uint8, bits), count=n).astype(bool)
            ids = pa.array(numbers(body[bits:]), pa.int64(), mask=~known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers(labels).astype(np.int32)), pa.array(numbers(far))], ["vec_id", "cluster", "distance"])


_ROW = "vec_id long, cluster int, distance long"


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, width: int = SLICE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable row of ``vectors`` (vec_id, embedding, any other columns), and the centroids.

    Rows whose embedding is null, has another length or a null, infinite or undefined component have no row. Repeated
    rows count each; a null id stays null. With fewer vectors than ``clusters`` there are fewer centroids, with none an
    empty result. Components beyond ``MOST`` (an embedding's of 131,072) count as that. Ties go to the smaller cluster.
    Other columns, whatever their names, are not carried.
    """
    centroids = first_centroids(vectors, clusters, seed, dimensions)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _ROW), centroids
    blocks = blocks_of(vectors, dimensions, width)
    for _ in range(rounds):
        centroids = moved(blocks, labels_of(blocks, centroids), centroids)
    ids = blocks.rows.where(F.col("slice") == IDS).select("chunk", "n", "body")
    held = ids.join(labels_of(blocks, centroids), "chunk").select("n", "body", "labels", "far")
    path = f"{shared_folder(blocks.spark)}/clusters-{uuid.uuid4().hex}"
    held.mapInArrow(_unfolded, _ROW).write.parquet(path)
    blocks.dropped()
    return blocks.spark.read.schema(_ROW).parquet(path), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # Sums can pass 64 bits only with components near the bound; then they stay at the greatest number.
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    whole = lambda c: F.least(c, most).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("of_cluster"))
    every = sums.agg(whole(F.sum("of_cluster"))).first()[0]
    sums = sums.join(named, "cluster").select("cluster", whole(F.col("of_cluster")).alias("cluster_inertia"), "centroid_sha256")
    # A row a cluster.
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


QUERIES = {"op13_centroids": op13_centroids}


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT row, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS far
  FROM (SELECT v.row, c.cluster, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM v, c{i} c)
  GROUP BY row)"""


def _moved_sql(i: int) -> str:
    return f"""
m{i} AS (
  SELECT cluster, pos, sum(x) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM v JOIN a{i} USING (row)) GROUP BY cluster, pos),
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c
  LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS q FROM m{i} GROUP BY cluster) m USING (cluster))"""


ORACLE = {
    "op13_centroids": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (
    SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {CLUSTERS})),
{",".join(_round_sql(i) + "," + _moved_sql(i) for i in range(ROUNDS))},
{_round_sql(ROUNDS)},
i AS (SELECT cluster, CAST(sum(far) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.far AS distance, cluster_inertia,
       CAST((SELECT sum(cluster_inertia) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (row) JOIN i ON i.cluster = a.cluster JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""
}
