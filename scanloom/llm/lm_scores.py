"""Language-model scores by stupid backoff, computed as joins of n-gram tables.

Documents are dealt into parts by hash, packed; equal rows of a task go to different parts. Each part counts its
distinct n-grams and sends them, with their counts, to the range of hashes they belong to; a range adds up the counts of
all parts, which is its share of the n-gram table, and answers every part with the totals of its n-grams, except those
that no other part has. Joined back to the documents of the part, the totals (less the document's own occurrences, so
that no text vouches for itself) give each word's score, summed per document.

A word scores count(n-gram) / count(context) for the longest n-gram that other documents have, times ``BACKOFF`` for
each order given up. Counts travel as sorted blocks, and an n-gram occurs once a part, so frequent n-grams make no hot key.

Blocks travel in steps (``Route``). In a step a sender has a block for each of at most ``FAN`` narrower ranges, and a node
adds up the blocks of at most ``FAN`` senders before it sends on; answers go the same way back. So the number of blocks
grows with the number of parts times the steps, which is its logarithm, and not with parts times ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import binary_column, buckets_for, from_planes, mixed, mixed_int, packed, planes, slices, small_batches, table, text_bytes, unpacked, words_of

ORDER = 2
#: The query's tables go up to this order; scores of both orders come from them.
HIGH_ORDER = 3
BACKOFF = 0.4
PART_BYTES = 8_000_000
RANGE_BYTES = 4_000_000
#: Bytes of text of a task that are dealt out at once.
DEALT_BYTES = 32_000_000
CODEC = "zstd"
#: A sender has blocks for at most so many nodes of the next step, and a node hears from at most so many.
FAN = 8192
#: The name under which the number of all words is kept, beside the n-grams.
ALL_WORDS = np.uint64(0)

_PLACES = [np.uint64(mixed_int(i + 900) | 1) for i in range(16)]


def text_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column's texts, and where each text's words begin."""
    data, offsets = text_bytes(column)
    words, begins, size = [], [np.zeros(1, np.int64)], 0
    for low, high in slices(offsets):
        some, begin = words_of(data, offsets, low, high)
        words.append(some)
        begins.append(begin[1:] + size)
        size += len(some)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(begins)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that end at each place from n - 1 on (also across texts; callers leave those out)."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, np.uint64(mixed_int(n)))
    for i in range(n):
        total = total + words[i : i + count] * _PLACES[i]
    return np.maximum(mixed(total), np.uint64(1))


def grams_of(words: np.ndarray, begin: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each n: where n-grams inside one text end, their hashes, their texts. And each word's place in its text."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    place = np.arange(len(words)) - begin[:-1][owner] if len(words) else np.zeros(0, np.int64)
    out = []
    for n in range(1, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        out.append((ends, ngrams(words, n)[ends - n + 1], owner[ends]))
    return out, place


def _small(raw: bytes) -> bytes:
    """Compressed, with its size in front."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def _large(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, codec=CODEC, asbytes=True) if size else b""


def _deal(pieces: int):
    """Rows packed by part. A row that repeats others of its task goes to the next parts in turn."""

    def packs(held: list[pa.RecordBatch], parts: list[int]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order = np.argsort(parts, kind="stable")
        table, sorted_parts = table.take(pa.array(order)).combine_chunks(), np.array(parts)[order]
        names, first = np.unique(sorted_parts, return_index=True)
        for name, low, high in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(parts)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table.slice(low, high - low))
            body = _small(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), binary_column([body])], ["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held, parts, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                again = seen.get(name, 0)
                seen[name] = again + 1
                parts.append((name + again) % pieces)
            rows = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2).cast(pa.large_string())], ["doc_id", "text"])
            held.append(rows)
            size += rows.nbytes
            if size > DEALT_BYTES:
                yield from packs(held, parts)
                held, parts, size = [], [], 0
        if parts:
            yield from packs(held, parts)

    return run


def _unpacked_rows(held: pa.Table) -> pa.Table:
    bodies = [_large(x.as_py()) for x in held["body"]]
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in bodies]) if bodies else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.large_string())})


def _distinct(words: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a part with their numbers; the number of words first."""
    every = [h for _, h, _ in grams_of(words, begin, order)[0]]
    names, counts = np.unique(np.concatenate(every), return_counts=True)
    return np.concatenate(([ALL_WORDS], names)), np.concatenate(([len(words)], counts)).astype(np.uint64)


@dataclass(frozen=True)
class Route:
    """The way from parts to ranges. A node of step n is (group of parts, run of ranges); groups widen as runs narrow.

    Step 0 are the parts, all ranges each; in the last step there is one group, of all parts, and each run is one range.
    """

    parts: int
    ranges: int
    fan: int
    steps: int

    def runs(self, step: int) -> int:
        """Number of runs of ranges in a step."""
        return -(-self.ranges // self.fan ** (self.steps - step))

    def group(self, step: int, sender: int) -> int:
        """The group that hears from a sender: from a part in step 1, else from a group of the step before."""
        return sender * self.fan ** (self.steps - 1) // self.parts if step == 1 else sender // self.fan

    def narrower(self, step: int, run: int) -> range:
        """The runs of the next step inside one of this step."""
        return range(run * self.fan, min((run + 1) * self.fan, self.runs(step + 1)))


def route(parts: int, ranges: int, fan: int = FAN) -> Route:
    """The fewest steps that ``fan`` allows, each about as wide."""
    most = max(parts, ranges, 1)
    steps = 1
    while fan**steps < most:
        steps += 1
    width = next(w for w in range(max(1, int(most ** (1 / steps)) - 1), most + 1) if w**steps >= most)
    return Route(parts, ranges, width, steps)


@lru_cache(maxsize=8)
def _bounds(way: Route, step: int, run: int) -> np.ndarray:
    """The hashes at which the narrower runs of a run begin, the first left out."""
    width = way.fan ** (way.steps - step - 1)
    return np.array([((i * width) << 64) // way.ranges for i in way.narrower(step, run)[1:]], np.uint64)


def _edges(way: Route, step: int, run: int, names: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(names, _bounds(way, step, run)), [len(names)]))


_BLOCKS = "group int, range int, sender int, names binary, counts binary"
#: ``group`` and ``range`` name who asked; ``at`` is the narrower range that answers.
_ANSWERS = "group int, range int, at int, totals binary"


def _blocks(way: Route, step: int, run: int, sender: int, names: np.ndarray, counts: np.ndarray) -> pa.Table:
    """What a sender of a step sends to the next one."""
    edges = _edges(way, step, run, names)
    spans = [(i, int(a), int(b)) for i, a, b in zip(way.narrower(step, run), edges[:-1], edges[1:], strict=True) if b > a]
    return pa.table(
        {
            "group": pa.array([way.group(step + 1, sender)] * len(spans), pa.int32()),
            "range": pa.array([i for i, _, _ in spans], pa.int32()),
            "sender": pa.array([sender] * len(spans), pa.int32()),
            "names": binary_column([_small(packed(names[a:b])) for _, a, b in spans]),
            "counts": binary_column([_small(planes(counts[a:b])) for _, a, b in spans]),
        }
    )


def _send(order: int, way: Route):
    def run(key: tuple, held: pa.Table) -> pa.Table:
        return _blocks(way, 0, 0, key[0].as_py(), *_distinct(*text_words(_unpacked_rows(held)["text"]), order))

    return run


def _added(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct n-grams of a node's blocks, their sums; of all blocks in a row: which n-gram, what count, where each begins."""
    names = [unpacked(_large(x.as_py())) for x in held["names"]]
    counts = np.concatenate([from_planes(_large(x.as_py()), np.uint64) for x in held["counts"]])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    line = every[order]
    new = np.concatenate(([True], line[1:] != line[:-1]))
    first = np.flatnonzero(new)
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(new) - 1
    edges = np.cumsum([0, *map(len, names)])
    return line[first], np.add.reduceat(counts[order], first), which, counts, edges.tolist()


def _answers(way: Route, step: int, run: int, held: pa.Table, total: np.ndarray, counts: np.ndarray, edges: list[int]) -> pa.Table:
    """For each block, which of its n-grams (bits) others have, and the counts of all parts."""
    shared = total != counts
    blocks = [_small(np.packbits(shared[a:b]).tobytes() + planes(total[a:b][shared[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    rows = len(blocks)
    asked = run // way.fan if step > 1 else 0
    return pa.table({"group": held["sender"], "range": pa.array([asked] * rows, pa.int32()), "at": pa.array([run] * rows, pa.int32()), "totals": binary_column(blocks)})


def _pass_on(way: Route, step: int):
    """A node adds up what it heard and sends it on."""

    def run(key: tuple, held: pa.Table) -> pa.Table:
        group, at = (k.as_py() for k in key)
        return _blocks(way, step, at, group, *_added(held)[:2])

    return run


def _total(way: Route):
    """A range of the n-gram table answers those it heard from."""

    def run(key: tuple, held: pa.Table) -> pa.Table:
        _, sums, which, counts, edges = _added(held)
        return _answers(way, way.steps, key[1].as_py(), held, sums[which], counts, edges)

    return run


def _pass_back(way: Route, step: int):
    """A node that was answered answers those it heard from."""

    def run(key: tuple, held: pa.Table, totals: pa.Table) -> pa.Table:
        at = key[1].as_py()
        names, sums, which, counts, edges = _added(held)
        first = at * way.fan
        spans = [i - first for i in totals["at"].to_pylist()]
        total = _answered(sums, _edges(way, step, at, names), spans, totals["totals"].to_pylist()).astype(np.uint64)
        return _answers(way, step, at, held, total[which], counts, edges)

    return run


def _answered(counts: np.ndarray, edges: np.ndarray, spans: list[int], blocks: list[bytes]) -> np.ndarray:
    """Counts of all parts, from a part's own and the answers of the ranges."""
    total = counts.astype(np.int64)
    for i, block in zip(spans, blocks, strict=True):
        block, low, high = _large(block), int(edges[i]), int(edges[i + 1])
        bits = -(-(high - low) // 8)
        shared = np.unpackbits(np.frombuffer(block, np.uint8, bits), count=high - low).astype(bool)
        total[low + np.flatnonzero(shared)] = from_planes(block[bits:], np.uint64).astype(np.int64)
    return total


def _scored_columns(orders: tuple[int, ...]) -> str:
    more = "".join(f", log_score_{n} double, backed_off_{n} long" for n in orders[1:])
    return "doc_id long, n_words long, log_score double, backed_off long" + more


def _score(orders: tuple[int, ...], backoff: float, way: Route):
    def values(order: int, other: list[np.ndarray], every: np.ndarray, begin: np.ndarray, owner: np.ndarray, place: np.ndarray):
        """Log score and number of words backed off, by text."""
        score, backed = np.zeros(len(begin) - 1), np.zeros(len(begin) - 1, np.int64)
        value = np.full(len(place), -np.inf)
        open_ = np.ones(len(place), bool)
        for n in range(order, 0, -1):
            here = np.flatnonzero(open_ & (other[n - 1] > 0))
            context = other[n - 2][here - 1] if n > 1 else every[here]
            skipped = np.minimum(order, place[here] + 1) - n
            value[here] = np.log(other[n - 1][here] / context) + skipped * np.log(backoff)
            open_[here] = False
            np.add.at(backed, owner[here], (skipped > 0).astype(np.int64))
        rest = np.flatnonzero(open_)
        value[rest] = np.minimum(order, place[rest] + 1) * np.log(backoff) - np.log(every[rest])
        np.add.at(backed, owner[rest], 1)
        some = np.flatnonzero(np.diff(begin))
        score[some] = np.add.reduceat(value, begin[:-1][some])
        return score, backed

    def run(held: pa.Table, totals: pa.Table) -> pa.Table:
        docs = _unpacked_rows(held)
        words, begin = text_words(docs["text"])
        rows = len(begin) - 1
        found = [(np.zeros(rows), np.zeros(rows, np.int64)) for _ in orders]
        if len(words):
            names, counts = _distinct(words, begin, max(orders))
            total = _answered(counts, _edges(way, 0, 0, names), totals["at"].to_pylist(), totals["totals"].to_pylist())
            grams, place = grams_of(words, begin, max(orders))
            owner = np.repeat(np.arange(rows), np.diff(begin))
            # What other documents have of the n-gram, by order, at the place where it ends; -1 where there is none.
            other = []
            for ends, hashes, texts in grams:
                at = np.searchsorted(names, hashes)
                _, same, own = np.unique(texts * len(names) + at, return_inverse=True, return_counts=True)
                there = np.full(len(words), -1, np.int64)
                there[ends] = total[at] - own[same]
                other.append(there)
            every = np.maximum(total[0] - np.diff(begin)[owner], 1)
            found = [values(n, other, every, begin, owner, place) for n in orders]
        out = {"doc_id": docs["doc_id"], "n_words": pa.array(np.diff(begin), pa.int64())}
        for end, (score, backed) in zip(["", *(f"_{n}" for n in orders[1:])], found, strict=True):
            out |= {f"log_score{end}": pa.array(score), f"backed_off{end}": pa.array(backed)}
        return pa.table(out)

    return run


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, more: tuple[int, ...] = (), fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, log_score, backed_off) of each row of ``docs`` (doc_id, text, any other columns).

    ``log_score`` is the sum of the words' log scores under all other rows, copies of the row included; words that no
    other row has score as one backoff below a single occurrence. Texts without words (null, empty) score 0. Repeated rows
    have their rows each; null ids stay; whole texts count, of any length (one text is one part's work); an empty table
    gives an empty one; other columns, whatever their names, are not carried. ``docs`` should come from a table, as it is
    read again where a task is lost.
    ``backed_off`` counts words for which an order was given up. Each order n of ``more`` adds log_score_n, backed_off_n.
    ``fan`` bounds the blocks of a sender and so sets the number of steps; it never changes a result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces, ranges = max(parts, buckets_for(size, PART_BYTES)), max(parts, buckets_for(size, RANGE_BYTES))
    small_batches(spark)
    named = docs.select(F.xxhash64("doc_id", "text").alias("name"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = named.mapInArrow(_deal(pieces), "part int, body binary")
    way = route(pieces, ranges, fan)
    sent = [rows.groupBy("part").applyInArrow(_send(max(order, *more, 1), way), _BLOCKS)]
    for step in range(1, way.steps):
        sent.append(sent[-1].groupBy("group", "range").applyInArrow(_pass_on(way, step), _BLOCKS))
    answers = sent[-1].groupBy("group", "range").applyInArrow(_total(way), _ANSWERS)
    for step in range(way.steps - 1, 0, -1):
        both = sent[step - 1].groupBy("group", "range").cogroup(answers.groupBy("group", "range"))
        answers = both.applyInArrow(_pass_back(way, step), _ANSWERS)
    return rows.groupBy("part").cogroup(answers.groupBy("group")).applyInArrow(_score((order, *more), backoff, way), _scored_columns((order, *more)))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents"), more=(HIGH_ORDER,))
    mean = lambda score: F.when(F.col("n_words") > 0, F.col(score) / F.col("n_words"))
    high = [f"log_score_{HIGH_ORDER}", mean(f"log_score_{HIGH_ORDER}").alias(f"mean_log_score_{HIGH_ORDER}"), f"backed_off_{HIGH_ORDER}"]
    return rows.select("doc_id", "n_words", "log_score", mean("log_score").alias("mean_log_score"), "backed_off", *high)


QUERIES = {"op2_lm_scores": op2_lm_scores}
