"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-cased words, each weighing the bytes of text that it covers (count times length).
For each of ``SAMPLES`` draws, every word has two gamma variables and a uniform one, made from its hash; they turn its
weight into a point, and the word with the least one is the sample, with the level its weight reached. Two texts draw
the same sample with the probability of their generalised Jaccard similarity (sum of least weights over sum of
greatest), so the share of equal draws estimates it. A draw is kept as 16 bits of its hash.

The query also compares each text with its edited text and with the next document. Documents are range-sorted by
descending id, so neighbours meet in one task; the first and last of each task are paired in a small second step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import FOLDED, buckets_for, mixed, mixed_int, slices, table, text_bytes, word_hashes, word_spans, written

SAMPLES = 64
ROWS_OF_TASK = 20_000
#: Bytes of text whose words share one table of variables.
TABLE_BYTES = 1 << 19

_LEVELS = np.uint64(0x9FB21C651E98DF25)


def _multipliers(seed: int) -> np.ndarray:
    return mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


_FIRST, _SECOND = _multipliers(1), _multipliers(2)


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """21 bits of a hash as a number strictly between 0 and 1."""
    return (((x >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)


def variables(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word and draw: a gamma(2, 1) variable, the log of another, and a uniform one."""
    x, y = words[:, None] * _FIRST, words[:, None] * _SECOND
    rate = -np.log(_uniform(x, 43) * _uniform(x, 22))
    log_size = np.log(-np.log(_uniform(y, 43) * _uniform(y, 22)))
    return rate, log_size, _uniform(x ^ (y >> np.uint64(7)), 1)


def _draws(rate, log_size, shift, log_weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The 16-bit samples of one weighted set, from its words' variables."""
    level = np.floor(log_weight[:, None] / rate + shift)
    point = log_size - rate * (level - shift + np.float32(1))
    best = point.argmin(axis=0)
    at = level[best, np.arange(SAMPLES)].astype(np.int64).view(np.uint64)
    return (mixed(words[best] ^ (at * _LEVELS)) >> np.uint64(48)).astype(np.uint16)


def weighted_words(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the logs of their weights, from all words and their lengths in bytes."""
    words, first, count = np.unique(words, return_index=True, return_counts=True)
    return words, np.log((count * lengths[first]).astype(np.float32))


def fingerprints(column: pa.Array) -> list[bytes]:
    """The fingerprint of each text of an Arrow column: 2 bytes a draw; empty for texts without words (or null)."""
    data, offsets = text_bytes(column)
    out: list[bytes] = []
    for low, high in slices(offsets, TABLE_BYTES):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, begin = word_spans(part, at)
        hashes = word_hashes(part, starts, ends, FOLDED)
        lengths = ends - starts
        sets = [weighted_words(hashes[a:b], lengths[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        known = np.unique(hashes)
        drawn: list[bytes] = [b""] * len(sets)
        if len(known) <= 1 << 16:
            rate, log_size, shift = variables(known)
            for i, (words, weight) in enumerate(sets):
                if len(words):
                    k = np.searchsorted(known, words)
                    drawn[i] = _draws(rate[k], log_size[k], shift[k], weight, words).tobytes()
        else:  # one very long text: its words in blocks, the least point of all blocks
            for i, (words, weight) in enumerate(sets):
                if len(words):
                    drawn[i] = _in_blocks(words, weight).tobytes()
        out += drawn
    return out


def _in_blocks(words: np.ndarray, weight: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    least, code = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint16)
    for low in range(0, len(words), block):
        w, g = words[low : low + block], weight[low : low + block]
        rate, log_size, shift = variables(w)
        level = np.floor(g[:, None] / rate + shift)
        point = (log_size - rate * (level - shift + np.float32(1))).min(axis=0)
        drawn = _draws(rate, log_size, shift, g, w)
        code = np.where(point < least, drawn, code)
        least = np.minimum(point, least)
    return code


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal draws; texts without words are like each other only."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, sha binary, own binary, edit binary, near_edited double, near_next double"
_SORTED = _ROW + ", kind int, place int, text string"
#: Kinds of rows of a task: finished; the last, which lacks its next; the first, which the task before needs.
_DONE, _LAST, _FIRST_ROW = 0, 1, 2


def _compared(ids: list, texts: list[str], own: list[bytes], edits: list[str], marks: list[bytes], next_own: list[bytes]) -> list[pa.Array]:
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).digest() for e in edits], pa.binary()),
        pa.array(own, pa.binary()),
        pa.array(marks, pa.binary()),
        pa.array([likeness(a, b) for a, b in zip(own, marks, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, next_own, strict=True)], pa.float64()),
    ]


_NAMES = ["doc_id", "n_chars", "sha", "own", "edit", "near_edited", "near_next"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted task, each with its next one; only one row is kept from batch to batch."""
    place = TaskContext.get().partitionId()
    held: tuple | None = None

    def batch(columns: list[pa.Array], kind: int, texts: list[str | None]) -> pa.RecordBatch:
        n = len(texts)
        extra = [pa.array([kind] * n, pa.int32()), pa.array([place] * n, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *extra], [*_NAMES, "kind", "place", "text"])

    def end(row: tuple, kind: int) -> pa.RecordBatch:
        i, text, own = row
        nothing = [pa.nulls(1, pa.binary()), pa.array([own], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return batch([pa.array([i], pa.int64()), pa.array([len(text)], pa.int64()), *nothing], kind, [text])

    for got in batches:
        for low in range(0, got.num_rows, 1000):
            some = got.slice(low, 1000)
            ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
            before = [held[1]] if held else []
            edits = [edited(a, b) for a, b in zip([*before, *texts], [*before, *texts][1:], strict=False)]
            # A text stands beside its edited text, with which it shares words.
            marks = fingerprints(pa.array([x for pair in zip_longest(texts, edits[len(before) :]) for x in pair] + edits[: len(before)], pa.string()))
            own = marks[: 2 * len(texts) : 2]
            rows = [*([held] if held else []), *zip(ids, texts, own, strict=True)]
            if not held:
                yield end(rows[0], _FIRST_ROW)
            if len(rows) > 1:
                i, t, f = (list(x) for x in zip(*rows, strict=True))
                of_edits = marks[2 * len(texts) :] + marks[1 : 2 * len(texts) - 1 : 2]
                yield batch(_compared(i[:-1], t[:-1], f[:-1], edits, of_edits, f[1:]), _DONE, [None] * len(edits))
            held = rows[-1]
    if held:
        yield end(held, _LAST)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        c = {n: got.column(n).to_pylist() for n in got.schema.names}
        edits = [edited(a, b) for a, b in zip(c["text"], c["next_text"], strict=True)]
        marks = fingerprints(pa.array(edits, pa.string()))
        yield pa.RecordBatch.from_arrays(_compared(c["doc_id"], c["text"], c["own"], edits, marks, c["next_own"]), _NAMES)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text, ...) and its edited text, and their likeness.

    A null text is empty. Rows are ordered by descending id, nulls last, then by a hash of the text, so repeated rows are
    each other's next; after the last comes the first, and a single row is its own next. Texts without words have an
    empty fingerprint. Words of any length weigh all their bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows with one id, or none, are dealt by text, and equal rows by their number.
    rows = rows.withColumns({"name": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("name"), F.col("row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(docs.count(), ROWS_OF_TASK))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = written(ordered.select("doc_id", "text").mapInArrow(_neighbours, _SORTED), "neighbours")
    # Two rows a task: the last of each and the first of the next.
    firsts = done.where(F.col("kind") == _FIRST_ROW).select(F.col("place").alias("to"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    line = Window.orderBy("place")
    after = done.where(F.col("kind") == _LAST).select("place", F.lead("place").over(line).alias("to"), F.min("place").over(Window.partitionBy()).alias("first"))
    after = after.select("place", F.coalesce("to", "first").alias("to"))
    lasts = done.where(F.col("kind") == _LAST).join(after, "place").join(firsts, "to")
    fixed = lasts.select("doc_id", "text", "own", "next_text", "next_own").mapInArrow(_joined, _ROW)
    return done.where(F.col("kind") == _DONE).select(*_NAMES).union(fixed)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared_with_next(table(spark, sf_dir, "documents"))
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id",
        "n_chars",
        hexed("sha").alias("edited_sha256"),
        hexed("own").alias("fingerprint"),
        hexed("edit").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES = {"op7_fingerprints": op7_fingerprints}
