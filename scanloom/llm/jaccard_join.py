"""N-gram Jaccard self-join by parity sketches.

A text's set holds the 64-bit hashes of its distinct word shingles. Its parity sketch has P cells; each shingle is
XORed into the cell that its leading bits name, so two sketches differ in at most ``|A xor B|`` cells. Texts that link
have ``|A xor B| <= d`` (d follows from sizes and similarity); with equal parts of the sketch as pigeonholes, any two
of them agree in one of the first d + 1 filled cells of either, in any order that all texts share. These cells are the
join keys of a size band (P doubles from band to band; a text near a band's end also takes part in the next one).
The shared order puts cells that many texts have last, so passages of a whole corpus make no large groups.

Keys travel as sorted blocks, one a task and range of hashes. Texts that share a key are compared by a second parity
sketch of single bits, whose Hamming distance bounds the symmetric difference too; what is left forms small clusters,
and inside these whole texts are compared exactly. Large clusters are compared in blocks of bounded size, never as
one group, and copies with equal sets count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import (
    binary_column,
    buckets_for,
    components,
    from_planes,
    mixed,
    mixed_int,
    one_chunk,
    packed,
    planes,
    slices,
    small_batches,
    table,
    text_bytes,
    unpacked,
    words_of,
    written,
)

WIDTH = 5
PERCENT = 75
#: Bands below this size use a cell for each shingle.
SMALL = 32
#: Keys kept for the end of the shared order: the most frequent ones, a bounded list (it only changes the order).
FREQUENT_KEYS = 1 << 16
#: A task reports keys that so many of its different texts have.
FREQUENT_IN_TASK = 4
#: Members of a block; a task compares two blocks at most.
BLOCK = 2000
#: Keys that a task holds before it sends them on.
HELD_KEYS = 1_000_000

_SHINGLE = [np.uint64(mixed_int(i + 77) | 1) for i in range(64)]


def shingle_sets(words: np.ndarray, begin: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, from hashes of its words."""
    count = len(words) - width + 1
    if count > 0:
        hashes = words[:count] * _SHINGLE[0]
        for i in range(1, width):
            hashes = hashes + words[i : count + i] * _SHINGLE[i]
        hashes = mixed(hashes)
    sets = []
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        n = high - low
        if n >= width:
            sets.append(np.unique(hashes[low : high - width + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for i in range(low, high):
                whole = mixed(whole + words[i : i + 1] * _SHINGLE[i - low + 32])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def text_sets(column, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of a column's texts, slice by slice."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets):
        words, begin = words_of(data, offsets, low, high)
        yield low, shingle_sets(words, begin, width)


def signature(members: np.ndarray) -> int:
    """A hash of a whole set, as a signed number."""
    return int(mixed(np.array([mixed(members).sum(dtype=np.uint64) + np.uint64(len(members))]))[0].astype(np.int64))


def most_apart(sizes, percent: int):
    """The largest symmetric difference that two linked sets with these sizes in all can have."""
    return sizes * (100 - percent) // (100 + percent)


def _band(n: int) -> int:
    return 0 if n < SMALL else n.bit_length() - 1


def cells(members: np.ndarray, band: int) -> np.ndarray:
    """Keys of the filled cells of a sketch."""
    if band == 0:
        return mixed(members ^ np.uint64(0x5851F42D4C957F2D))
    cell = members >> np.uint64(63 - band)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    parity = np.bitwise_xor.reduceat(members, first)
    return mixed(parity + mixed(cell[first] + np.uint64(band << 40)))


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, number of keys to send) of a set with n members: its own band, and those that larger partners are in."""
    largest = n * 100 // percent
    out = []
    for band in sorted({_band(n), *range(max(_band(n), _band(SMALL)), _band(largest) + 1)}):
        end = SMALL - 1 if band == 0 else (2 << band) - 1
        out.append((band, most_apart(n + min(largest, end), percent) + 1))
    return out


def bit_sketch(members: np.ndarray) -> bytes:
    """One bit a member, toggled; twice to four times as many bits as members."""
    bits = 1 << min(15, max(6, (2 * len(members) - 1).bit_length()))
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


# --- First pass: sizes, signatures, sketches, frequent keys ---------------------------------------------------------

_SUMMARY = "doc_id long, name long, n long, sig long, sketch binary, key long, texts long"


def _summarise(width: int, percent: int):
    def run(batches):
        seen, held, size = set(), [], 0

        def frequent():
            keys = np.concatenate(held)
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[first], np.diff(np.append(first, len(keys)))
            often = counts >= FREQUENT_IN_TASK
            keys, counts = keys[often], counts[often].astype(np.int64)
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts)],
                ["doc_id", "name", "n", "sig", "sketch", "key", "texts"],
            )

        for batch in batches:
            sizes, sigs, sketches = [], [], []
            for _, sets in text_sets(batch.column(2), width):
                for members in sets:
                    sizes.append(len(members))
                    if not len(members):
                        sigs.append(None)
                        sketches.append(None)
                        continue
                    sig = signature(members)
                    sigs.append(sig)
                    if sig in seen:
                        sketches.append(None)
                        continue
                    seen.add(sig)
                    sketches.append(bit_sketch(members))
                    for band, _ in bands(len(members), percent):
                        held.append(cells(members, band))
                        size += len(held[-1])
                if size > HELD_KEYS:
                    yield frequent()
                    held, size = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(one_chunk(batch.column(i)).cast(pa.int64()) for i in (0, 1)), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), binary_column(sketches), none, none],
                ["doc_id", "name", "n", "sig", "sketch", "key", "texts"],
            )
        if held:
            yield frequent()

    return run


# --- Second pass: keys in blocks, groups of texts that share one ----------------------------------------------------


def _send_keys(width: int, percent: int, frequent: np.ndarray, parts: int):
    def run(batches):
        seen, keys, owners, size = set(), [], [], 0

        def blocks():
            key, owner = np.concatenate(keys), np.concatenate(owners)
            part = (key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
            order = np.lexsort((key, part))
            key, owner, part = key[order], owner[order], part[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                    binary_column([packed(key[a:b]) for a, b in spans]),
                    binary_column([planes(owner[a:b]) for a, b in spans]),
                ],
                ["part", "keys", "owners"],
            )

        for batch in batches:
            for _, sets in text_sets(batch.column(0), width):
                for members in sets:
                    if not len(members):
                        continue
                    sig = signature(members)
                    if sig in seen:
                        continue
                    seen.add(sig)
                    for band, most in bands(len(members), percent):
                        key = np.sort(cells(members, band))
                        if len(key) > most:
                            if len(frequent):
                                often = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
                                if often.any():
                                    key = np.concatenate((key[~often], key[often]))
                            key = key[:most]
                        keys.append(key)
                        owners.append(np.full(len(key), sig, np.int64))
                        size += len(key)
                if size > HELD_KEYS:
                    yield blocks()
                    keys, owners, size = [], [], 0
        if keys:
            yield blocks()

    return run


def _groups(held: pa.Table) -> pa.Table:
    """Lists of texts that share a key; equal lists of a part once, long ones as pairs of blocks."""
    key = np.concatenate([unpacked(x.as_py()) for x in held["keys"]])
    owner = np.concatenate([from_planes(x.as_py(), np.int64) for x in held["owners"]])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
    key, owner = key[fresh], owner[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    shared = count > 1
    first, count = first[shared], count[shared]
    out_id, out = [], []
    if len(first):
        spread = mixed(owner.view(np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
        named = mixed(total[first + count] - total[first])
        _, one = np.unique(named, return_index=True)
        for i in one.tolist():
            members = owner[first[i] : first[i] + count[i]]
            chunks = [members[j : j + BLOCK] for j in range(0, len(members), BLOCK)]
            for a in range(len(chunks)):
                for b in range(a, len(chunks)) if len(chunks) < 3 else range(a + 1, len(chunks)):
                    if len(chunks) == 2 and (a, b) != (0, 1):
                        continue
                    out.append(chunks[a] if a == b else np.concatenate((chunks[a], chunks[b])))
                    out_id.append(int(named[i].astype(np.int64)) ^ (a << 32 | b))
    return pa.table({"gid": pa.array(out_id, pa.int64()), "members": pa.array(out, pa.list_(pa.int64()))})


# --- Comparing inside groups ---------------------------------------------------------------------------------------


def forest(sizes: np.ndarray, sketches: list[np.ndarray], percent: int, exact=None) -> list[tuple[int, int]]:
    """Links that connect all members which linked pairs connect; pairs already connected are not looked at.

    A pair passes when its bit sketches are near enough for a link, and, with ``exact``, when that holds too.
    """
    if len(sizes) == 2 and exact is None:
        a, b = sketches
        width = min(len(a), len(b))
        apart = int(np.bitwise_count(_fold(a, width) ^ _fold(b, width)).sum())
        fits = min(sizes) * 100 >= max(sizes) * percent and apart <= most_apart(int(sizes[0] + sizes[1]), percent)
        return [(0, 1)] if fits else []
    by_width: dict[int, np.ndarray] = {}
    for w in sorted({len(s) for s in sketches}):
        by_width[w] = np.array([i for i, s in enumerate(sketches) if len(s) == w])
    rows = {w: np.stack([sketches[i] for i in at]) for w, at in by_width.items()}
    halves = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in rows.items() if w > 1}
    waiting = {w: np.ones(len(at), bool) for w, at in by_width.items()}
    where = {int(i): (w, k) for w, at in by_width.items() for k, i in enumerate(at)}
    links = []
    for start in range(len(sizes)):
        w, k = where[start]
        if not waiting[w][k]:
            continue
        waiting[w][k] = False
        queue = [start]
        while queue:
            p = queue.pop()
            w = where[p][0]
            mine = sketches[p]
            for width, matrix, own in (
                (w // 2, rows.get(w // 2), _fold(mine, w // 2) if w > 1 else None),
                (w, rows[w], mine),
                (2 * w, halves.get(2 * w), mine),
            ):
                if matrix is None or own is None:
                    continue
                left = np.flatnonzero(waiting[width])
                if not len(left):
                    continue
                at = by_width[width][left]
                n = sizes[at]
                apart = np.bitwise_count(matrix[left] ^ own).sum(axis=1, dtype=np.int64)
                near = (apart <= most_apart(n + sizes[p], percent)) & (np.minimum(n, sizes[p]) * 100 >= np.maximum(n, sizes[p]) * percent)
                for j, q in zip(left[near].tolist(), at[near].tolist(), strict=True):
                    if exact is None or exact(p, q):
                        waiting[width][j] = False
                        links.append((p, q))
                        queue.append(q)
    return links


def _fold(sketch: np.ndarray, width: int) -> np.ndarray:
    while len(sketch) > width:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _edges_table(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compare_sketches(percent: int):
    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("gid")
        gid, sig, size = (held[c].to_numpy() for c in ("gid", "sig", "n"))
        raw = held["sketch"].to_pylist()
        edges = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1], [True])))
        out_a, out_b = [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sketches = [np.frombuffer(x, np.uint64) for x in raw[low:high]]
            for a, b in forest(size[low:high], sketches, percent):
                out_a.append(int(sig[low + a]))
                out_b.append(int(sig[low + b]))
        return _edges_table(out_a, out_b)

    return run


def _compare_texts(width: int, percent: int):
    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("task")
        task, wanted = held["task"].to_numpy(), held["sig"].to_pylist()
        sets = [s for _, some in text_sets(held["text"], width) for s in some]
        edges = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
        out_a, out_b = [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own: dict[int, np.ndarray] = {}
            for i in range(low, high):
                # Rows that share an id can bring another text along.
                if wanted[i] not in own and len(sets[i]) and signature(sets[i]) == wanted[i]:
                    own[wanted[i]] = sets[i]
            names, some = list(own), list(own.values())
            if len(names) < 2:
                continue
            sizes = np.array([len(s) for s in some])

            def linked(p: int, q: int, some=some) -> bool:
                both = np.intersect1d(some[p], some[q], assume_unique=True).size
                return 100 * both >= percent * (len(some[p]) + len(some[q]) - both)

            for a, b in forest(sizes, [np.frombuffer(bit_sketch(s), np.uint64) for s in some], percent, linked):
                out_a.append(names[a])
                out_b.append(names[b])
        return _edges_table(out_a, out_b)

    return run


# --- The join ------------------------------------------------------------------------------------------------------


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose id and text no earlier row of the task has, so that equal rows are few wherever they meet."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(task, sig, text): each text that stands for a set, once for each task that compares it."""
    few = texts.mapInArrow(_first_in_task, texts.schema)
    same = F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.name") == F.col("t.name"))
    return few.alias("t").join(wanted.alias("w"), same).select("w.task", "w.sig", "t.text")


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text, any other columns).

    Rows with equal sets link. A text without words, empty or null, has no shingle and stays alone; a null id counts
    as no id: such a row takes the least id of what it links with, or null. Repeated rows stay, each with its row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("name"), "text")
    summary = written(texts.mapInArrow(_summarise(width, percent), _SUMMARY), "sketches")
    total = summary.agg(F.sum("n")).first()[0] or 0
    often = summary.where("key is not null").groupBy("key").agg(F.sum("texts").alias("texts"))
    often = [r.key for r in often.orderBy(F.desc("texts"), "key").limit(FREQUENT_KEYS).select("key").collect()]
    frequent = np.sort(np.array(often, np.int64).view(np.uint64))
    ranges = max(parts, buckets_for(total, 1_000_000))
    sent = texts.select("text").mapInArrow(_send_keys(width, percent, frequent, ranges), "part int, keys binary, owners binary")
    groups = sent.groupBy("part").applyInArrow(_groups, "gid long, members array<long>").dropDuplicates(["gid"])
    groups = written(groups, "groups")
    # Of the texts with one set, that of the least id stands for all; ids may be missing or shared, so its hash goes along.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("one")
    known = summary.where("sig is not null").groupBy("sig").agg(one, F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    known = known.select("sig", "n", "sketch", "one.doc_id", "one.name")
    members = groups.select("gid", F.explode("members").alias("sig"))
    spread = max(parts, buckets_for(members.count(), 20_000))
    compared = members.join(known.select("sig", "n", "sketch"), "sig").groupBy(F.pmod("gid", F.lit(spread)).alias("part"))
    near = compared.applyInArrow(_compare_sketches(percent), "a long, b long")
    clusters = written(components(near), "clusters")

    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    blocks = clusters.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.col("node").alias("sig"), F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    held = wanted_texts(texts, blocks.join(known.select("sig", "doc_id", "name"), "sig"))
    checked = held.groupBy(F.pmod("task", F.lit(max(parts, buckets_for(clusters.count(), 1000)))).alias("part"))
    links = components(checked.applyInArrow(_compare_texts(width, percent), "a long, b long"))

    labels = known.select("sig", "doc_id").join(links.withColumnRenamed("node", "sig"), "sig", "left")
    labels = labels.select("sig", "doc_id", F.coalesce("root", "sig").alias("root"))
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "root").select("sig", "component_id")
    rows = summary.where("n is not null").select("doc_id", "n", "sig").join(labels, "sig", "left")
    alone = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def first_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the least id, and repeated rows once.

    Ids are expected to name one text; rows that share an id stay or go together. Rows without an id stay.
    """
    from pyspark.sql import Window

    kept = near_copies(docs, width, percent).where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    held = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.lit(1)))
    held = held.withColumn("__text", F.xxhash64("text")).withColumn("__again", again).where("__again = 1").drop("__text", "__again")
    return held.select(*docs.columns).union(docs.where("doc_id is null"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
