"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Every word (hashed to a row of a table) has a sparse random index vector. A word's vector is the sum of the index
vectors of the words around it in all documents, scaled, plus its own. Marks for what a word looks like
(signs attached to it, capitals, the word before repeated) stand in the text as words of their own. A document is the
mean of its words' vectors; a network with one hidden layer gives a logit, and a temperature fitted on documents kept
from training makes it a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scanloom.llm.common import FOLDED, IS_SPACE, binary_column, from_planes, held_out, mixed, mixed_int, planes, powers, slices, table, text_bytes, word_spans, written

ROWS = 1 << 14
SIZE = 64
NONZERO = 4
WINDOW = 2
HIDDEN = 32
#: At most about so many labelled documents are learned from, dealt by hash of the id.
LABELLED = 20_000
TASKS = 16
CHUNK = 256
#: Sums of tasks are added up in two steps, so many groups of tasks first.
SUM_GROUPS = 1024
CUT = 0.7

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_SIGN = ~_ALNUM & ~IS_SPACE
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_CODES = np.where(_ALNUM, FOLDED, np.uint64(0))
_SIGN_CODES = np.where(_SIGN, mixed(np.arange(256, dtype=np.uint64) + np.uint64(9000)), np.uint64(0))
_CAPITALS, _AGAIN = mixed_int(501), mixed_int(502)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[ends] - total[starts]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words and marks of a slice's texts, in order, and where each text's begin."""
    starts, ends, begin = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    up, down = powers(len(data))
    core = _sums(_CODES[data] * up[: len(data)], starts, ends) * down[starts]
    letters = _sums(_ALNUM[data].astype(np.int64), starts, ends)
    signs = _sums(_SIGN_CODES[data], starts, ends)
    capitals = _sums(_UPPER[data].astype(np.int64), starts, ends)
    small = _sums(_LOWER[data].astype(np.int64), starts, ends)
    word = mixed(core + letters.astype(np.uint64))
    first = np.zeros(len(starts) + 1, bool)
    first[begin] = True
    again = np.concatenate(([False], word[1:] == word[:-1])) & ~first[:-1]
    parts = np.stack([word, np.where(signs > 0, mixed(signs), 0), np.full(len(word), _CAPITALS, np.uint64), np.full(len(word), _AGAIN, np.uint64)], axis=1)
    there = np.stack([letters > 0, signs > 0, (capitals > 1) & (small == 0), again], axis=1)
    count = np.concatenate(([0], np.cumsum(there.sum(axis=1))))
    return (parts[there] >> np.uint64(50)).astype(np.int64), count[begin]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few ones in each row's index vector."""
    x = mixed(np.arange(ROWS * NONZERO, dtype=np.uint64) + np.uint64(1 << 33)).reshape(ROWS, NONZERO)
    return (x % np.uint64(SIZE)).astype(np.int64), np.where((x >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)


def context_sums(column: pa.Array) -> np.ndarray:
    """Sums of the index vectors around each word, of all texts of a column."""
    places, signs = index_vectors()
    total = np.zeros(ROWS * SIZE)
    data, offsets = text_bytes(column)
    for low, high in slices(offsets):
        rows, begin = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        owner = np.repeat(np.arange(high - low), np.diff(begin))
        for away in range(1, WINDOW + 1):
            fits = owner[:-away] == owner[away:] if len(owner) > away else np.zeros(0, bool)
            a, b = rows[:-away][fits] if len(fits) else rows[:0], rows[away:][fits] if len(fits) else rows[:0]
            for word, other in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(word * SIZE + places[other, k], signs[other, k], minlength=ROWS * SIZE)
    return total.reshape(ROWS, SIZE)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """A context of length one, and the word's own index vector."""
    places, signs = index_vectors()
    own = np.zeros((ROWS, SIZE))
    np.add.at(own, (np.arange(ROWS)[:, None], places), signs)
    length = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (contexts / np.maximum(length, 1e-9) + own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text; zeros for a text without words."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, SIZE), np.float32)
    for low, high in slices(offsets, 1 << 19):
        rows, begin = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        count = np.diff(begin)
        some = np.flatnonzero(count)
        if len(some):
            out[low + some] = np.add.reduceat(vectors[rows], begin[:-1][some], axis=0) / count[some, None]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.first + self.bias, 0)
        return hidden @ self.second + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """A network for these pooled texts and labels: Adam on log loss; every fifth row calibrates the temperature.

    Without rows of both labels the score is their share (one half without any).
    """
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(SIZE), np.ones(SIZE), np.zeros((SIZE, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    rnd = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    train, label = x[~aside].astype(float), y[~aside].astype(float)
    mean, scale = train.mean(axis=0), train.std(axis=0) + 1e-3
    net = Network(mean, scale, rnd.normal(0, SIZE**-0.5, (SIZE, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    weights = [net.first, net.bias, net.second, np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    inputs, step = (train - mean) / scale, 0
    for _ in range(epochs):
        order = rnd.permutation(len(label))
        for low in range(0, len(order), 256):
            at = order[low : low + 256]
            z = inputs[at] @ weights[0] + weights[1]
            hidden = np.maximum(z, 0)
            error = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - label[at]
            back = np.outer(error, weights[2]) * (z > 0)
            slopes = [inputs[at].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
                g = g / len(at) + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.offset = float(weights[3][0])
    logits, kept = net.logits(x[aside].astype(float)), y[aside]
    loss = lambda t: np.logaddexp(0, np.where(kept > 0, -logits, logits) / t).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors around each word over the texts of all rows: a table of fixed size.

    A task adds up its own; whole numbers, so the order of adding makes no difference.
    """

    def sums(batches):
        total = np.zeros((ROWS, SIZE))
        for batch in batches:
            total += context_sums(batch.column(0))
        whole = total.astype(np.int64)
        chunks = [i for i in range(ROWS // CHUNK) if whole[i * CHUNK : (i + 1) * CHUNK].any()]
        group = TaskContext.get().partitionId() % SUM_GROUPS
        bodies = [planes(whole[i * CHUNK : (i + 1) * CHUNK].ravel()) for i in chunks]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([group] * len(chunks), pa.int32()), binary_column(bodies)], ["chunk", "group", "sums"])

    def added(held: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK * SIZE, np.int64)
        for x in held["sums"]:
            total += from_planes(x.as_py(), np.int64)
        return pa.table({"chunk": held["chunk"][:1], "group": held["group"][:1], "sums": binary_column([planes(total)])})

    kind = "chunk int, group int, sums binary"
    some = docs.select("text").mapInArrow(sums, kind).groupBy("chunk", "group").applyInArrow(added, kind)
    contexts = np.zeros((ROWS, SIZE))
    for r in some.groupBy("chunk").applyInArrow(added, kind).collect():
        contexts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = from_planes(r["sums"], np.int64).reshape(CHUNK, SIZE)
    return contexts


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` (doc_id, text) and a network from ``labels`` (doc_id, label).

    Rows without label or id teach nothing; an id with several labels has their mean, rounded.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    share = int(min(1.0, most / max(1, known.count())) * 1_000_000)
    # Of bounded size: about ``most`` ids and labels.
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = written(rows.repartition(TASKS, "doc_id"), "labelled")

    contexts = corpus_contexts(docs)
    vectors = word_vectors(contexts)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), binary_column([v.tobytes() for v in x])], ["doc_id", "y", "x"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(features, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (mixed_int(r.doc_id), r.y, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(-1, SIZE)
    return vectors, fitted(x, np.array([r.y for r in got]))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """``docs`` with a score from its text alone, 0 to 1; null and empty texts have the score of no words.

    Repeated rows have the same score; whole texts count, of any length; an empty table gives an empty one. A column
    ``score`` of ``docs`` gives way.
    """
    docs = docs.drop("score")
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            score = network.scores(pooled(batch.column(place), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = learned(docs, table(spark, sf_dir, "labels").where(~out))
    predicted = (F.col("score") >= CUT).cast("int").alias("predicted")
    return scored(docs, *model).select("doc_id", out.alias("held_out"), "score", predicted)


QUERIES = {"op5_quality": op5_quality}
