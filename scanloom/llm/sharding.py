"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's key on the ring is the hash of its text, so equal texts go together; each shard has many virtual nodes.
A key belongs to the next node clockwise; where that shard is full, it goes on clockwise, so no shard holds more than
its bound. Spark sums bytes by ring cell and finds the few heavy groups of equal texts (a fixed number at most, as
each has more than a fixed share of all bytes); cells and heavy groups, a table whose size does not grow with the
data, are placed on the ring, and the placement is joined back to the rows. A heavy group is placed whole where it
fits; one that no shard has room for goes round clockwise in parts, dealt by hash of the id.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import order_hash, part_sums, running, table, written

SHARDS = 24
NODES = 64
CELLS = 1 << 16
#: A group of equal texts is heavy above a shard's fair share over this.
HEAVY = 64
PARTS_OF_GROUP = 1 << 10
#: A shard's bound over its fair share: the first of these with which everything finds room.
SLACKS = (1.001, 1.003, 1.01, 1.03, 1.1, 1.3, 2.0)


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes by point, points in [0, CELLS)."""
    name = lambda s, i: int.from_bytes(hashlib.md5(f"shard {s} node {i}".encode()).digest()[:8], "big") * CELLS / 2**64
    return sorted((name(s, i), s) for s in range(shards) for i in range(nodes))


def place(items: list[tuple[float, int, object]], shards: int, bound: float, nodes: int = NODES, loads: list[float] | None = None) -> tuple[dict, list]:
    """{item: shard} for (point, bytes, item), in this order: clockwise from its point, the first shard with room.

    Returns what found no room as well.
    """
    points = ring(shards, nodes)
    keys = [p for p, _ in points]
    loads = loads if loads is not None else [0.0] * shards
    found, left = {}, []
    for point, size, item in items:
        at = bisect.bisect_left(keys, point)
        tried = set()
        for step in range(len(points)):
            shard = points[(at + step) % len(points)][1]
            if shard in tried:
                continue
            if loads[shard] + size <= bound:
                loads[shard] += size
                found[item] = shard
                break
            tried.add(shard)
            if len(tried) == shards:
                left.append((point, size, item))
                break
        else:
            left.append((point, size, item))
    return found, left


def placement(cells: dict[int, int], heavy: dict[int, tuple[float, int, dict[int, int]]], shards: int) -> dict[tuple[int, int], int]:
    """{(group, part): shard}: group -1 has the cells as parts; other groups are placed whole (part -1) or by part."""
    total = sum(cells.values()) + sum(size for _, size, _ in heavy.values())
    groups = sorted(((p, size, g) for g, (p, size, _) in heavy.items()), key=lambda x: (-x[1], x[2]))
    for slack in SLACKS:
        bound = total / shards * slack
        loads = [0.0] * shards
        whole, split = place(groups, shards, bound, loads=loads)
        parts = [(p, size, (g, part)) for p, _, g in split for part, size in sorted(heavy[g][2].items())]
        items = [*parts, *((float(c), size, (-1, c)) for c, size in sorted(cells.items()))]
        found, left = place(items, shards, bound, loads=loads)
        if not left:
            break
    for _, size, item in left:  # a part larger than any bound (all rows of one id and text): the emptiest shard
        shard = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += size
        found[item] = shard
    return {(g, -1): s for g, s in whole.items()} | found


def sharded(docs: DataFrame, shards: int = SHARDS, texts: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot; every row gets one, repeated rows each its own slot.

    Size is the text's UTF-8 bytes plus 8; a null text counts as none and hashes as empty. A null id is dealt as one
    id. Columns of ``docs`` with the names of new ones give way.
    Shards no row falls into (fewer keys than shards) stay empty. Sums and slots come from a table of hashes and
    sizes; texts and other columns are read once more at the end, unless ``texts`` is false.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    clash = [c for c in ("size", "text_crc32", "shard", "slot") if c in docs.columns]
    docs = docs.drop(*clash)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text").withColumn("size", (F.octet_length(text) + 8).cast("long")).withColumn("text_crc32", F.crc32(text.cast("binary")))
    keyed = keyed.withColumn("__key", F.xxhash64(text)).withColumn("__dealt", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS_OF_GROUP)).cast("int"))
    keyed = keyed.withColumn("__cell", F.shiftrightunsigned("__key", 48).cast("int")).withColumn("__order", order_hash("doc_id", "text_crc32"))
    small = written(keyed.drop("__row", "text"), "keys")
    total = small.agg(F.sum("size")).first()[0] or 0
    # Fewer than shards * HEAVY groups can have this many bytes.
    heavy = small.groupBy("__key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (shards * HEAVY) > total)
    names = {key: i for i, key in enumerate(sorted(r["__key"] for r in heavy.collect()))}
    marks = F.broadcast(spark.createDataFrame(list(names.items()), "__key long, __group int"))
    in_group = F.col("__group") >= 0

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(marks, "__key", "left").withColumn("__group", F.coalesce("__group", F.lit(-1)))

    sums = grouped(small).groupBy("__group", F.when(in_group, F.col("__dealt")).otherwise(F.col("__cell")).alias("item")).agg(F.sum("size").alias("bytes"))
    cells, parts = {}, {}
    for r in sums.collect():  # CELLS rows, and PARTS_OF_GROUP for each heavy group, at most
        (cells if r["__group"] < 0 else parts.setdefault(r["__group"], {}))[r["item"]] = int(r["bytes"])
    point = {g: (k % 2**64) / 2**48 for k, g in names.items()}
    placed = placement(cells, {g: (point[g], sum(p.values()), p) for g, p in parts.items()}, shards)
    where = F.broadcast(spark.createDataFrame([(*k, s) for k, s in placed.items()], "__group int, __item int, shard int"))
    whole = [g for g, item in placed if g >= 0 and item == -1]

    def dealt(rows: DataFrame) -> DataFrame:
        item = F.when(F.col("__group") < 0, F.col("__cell")).when(F.col("__group").isin(whole), F.lit(-1)).otherwise(F.col("__dealt"))
        return grouped(rows).withColumn("__item", item).join(where, ["__group", "__item"], "left")

    sums = part_sums(dealt(small), "shard", "__order", "size")
    columns = ["__row.*"] if texts else ["doc_id"]
    slots = running(dealt(keyed if texts else small), "shard", "__order", ["doc_id", "text_crc32", "size"], "size", sums)
    return slots.select(*columns, "size", "text_crc32", "shard", F.col("rank_before").cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents"), texts=False)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


QUERIES = {"op10_sharding": op10_sharding}
