"""Documents drawn by how much more likely their features are in the benchmark than in the corpus.

A feature is a run of words, hashed into buckets. Bucket counts of both tables give every bucket an integer gain, kept
as bit planes: plane j of one sign holds the buckets whose gain has that sign and bit j. A document's bucket counts
become planes too, one a bit of the count. AND of a count plane and a gain plane, and the number of bits left, times
two to the sum of their places, added up over all pairs, is the document's weight: integers throughout, so exact.

Drawing adds a Gumbel variable made from the id. Documents are range-sorted by score and numbered by the parts' sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import buckets_for, slices, small_batches, table, text_bytes, word_spans, written

BUCKETS = 10_000
#: Features are runs of one to so many words.
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Documents whose planes are made at once, and bytes of text whose words are hashed at once.
DOCUMENTS = 64
TEXT_BYTES = 1 << 18
#: Words up to so many bytes are hashed side by side; longer ones, few, one after the other.
LONG_WORD = 64
ROWS_OF_PART = 500_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_BETWEEN = ~_IN_WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    """The step of the CRC-32 of zip files for each byte, from its polynomial."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


_STEP = _crc_table()


def crc_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span, all spans a byte at a time."""
    state, size = state.copy(), ends - starts
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    sorted_size = size[order]
    long = int(np.searchsorted(-sorted_size, -LONG_WORD, side="left"))
    for i in order[:long].tolist():
        state[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]], int(~state[i])))
    short, sizes = order[long:], sorted_size[long:]
    at, register = starts[short], state[short]
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, side="left"))
        some = register[:n]
        register[:n] = _STEP[(some ^ data[at[:n] + i]) & np.uint32(0xFF)] ^ (some >> np.uint32(8))
    state[short] = register
    return state


def text_buckets(data: np.ndarray, offsets: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature of a slice's texts, and each text's number of words. Offsets start at 0."""
    data = _LOWER[data]
    starts, ends, begin = word_spans(data, offsets, _BETWEEN)
    words = np.diff(begin)
    owner = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(starts)) - np.repeat(begin[:-1], words)
    state = crc_after(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    out, texts = [(~state) % np.uint32(buckets)], [owner]
    space = np.uint32(0x20)
    for n in range(2, run + 1):
        # A run of n words: the run of n - 1 before it, a space, and this word.
        here = np.flatnonzero(place >= n - 1)
        before = np.zeros(len(starts), np.uint32)
        some = state[here - 1]
        before[here] = crc_after(_STEP[(some ^ space) & np.uint32(0xFF)] ^ (some >> np.uint32(8)), data, starts[here], ends[here])
        state = before
        out.append((~state[here]) % np.uint32(buckets))
        texts.append(owner[here])
    return np.concatenate(out).astype(np.int64), np.concatenate(texts), words


def _of_batch(column: pa.Array, run: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and behind-last row, buckets, their texts and numbers of words, of slices of a column of texts."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets, TEXT_BYTES):
        part = data[offsets[low] : offsets[high]]
        yield low, high, *text_buckets(part, offsets[low : high + 1] - offsets[low], run, buckets)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the texts of all rows: a task adds up its own, a row for each bucket is shuffled."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _, _ in _of_batch(batch.column(0), run, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: a thousand times the log of its smoothed share in ``target`` over that in ``corpus``."""
    spark = corpus.sparkSession
    s = bucket_counts(corpus, run, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, run, buckets).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]).select("bucket", "s", "t")
    # One row a bucket: their number is a parameter.
    rows = both.toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.int64), rows["t"].to_numpy(np.int64)
    up = (t + 1.0) * float(s.sum() + buckets)
    down = (s + 1.0) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    raw = np.packbits(bits, axis=-1)
    wide = np.zeros((*raw.shape[:-1], -(-raw.shape[-1] // 8) * 8), np.uint8)
    wide[..., : raw.shape[-1]] = raw
    return wide.view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(sign, place, plane) of all planes that hold a bit."""
    size = np.abs(gains)
    out = []
    for sign, mine in ((1, gains > 0), (-1, gains < 0)):
        for place in range(int(size.max()).bit_length() if len(size) else 0):
            bits = mine & ((size >> place) & 1).astype(bool)
            if bits.any():
                out.append((sign, place, _packed_bits(bits[None])[0]))
    return out


def plane_weights(found: np.ndarray, owner: np.ndarray, texts: int, planes: list[tuple[int, int, np.ndarray]], buckets: int = BUCKETS) -> np.ndarray:
    """Weights of texts from the buckets of their features, by ANDs of planes and counts of bits."""
    weight = np.zeros(texts, np.int64)
    order = np.argsort(owner, kind="stable")
    found, edges = found[order], np.searchsorted(owner[order], np.arange(texts + 1))
    for low in range(0, texts, DOCUMENTS):
        high = min(texts, low + DOCUMENTS)
        a, b = edges[low], edges[high]
        if a == b:
            continue
        name = np.repeat(np.arange(high - low), np.diff(edges[low : high + 1])) * buckets + found[a:b]
        counts = np.bincount(name, minlength=(high - low) * buckets).reshape(high - low, buckets)
        for k in range(int(counts.max()).bit_length()):
            bits = ((counts >> k) & 1).astype(bool)
            some = np.flatnonzero(bits.any(axis=1))
            mine = _packed_bits(bits[some])
            for sign, place, plane in planes:
                weight[low + some] += (sign << (k + place)) * np.bitwise_count(mine & plane).sum(axis=1, dtype=np.int64)
    return weight


def weighted(docs: DataFrame, gains: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    buckets, planes = len(gains), gain_planes(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for low, high, found, owner, n in _of_batch(batch.column(1), run, buckets):
                words[low:high] = n
                features[low:high] = np.bincount(owner, minlength=high - low)
                weights[low:high] = plane_weights(found, owner, high - low, planes, buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weights)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variable made from the id, rounded down; a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (doc_id, n_words, score, ...) with ``rank``: 1, 2, 3 ... of the drawn by falling score, else null.

    Of the rows with enough words, ``percent`` in a hundred are drawn. Ties go to the smaller id, null last; rows alike in
    both are ranked in any order. Ranges of the score, id and a number of the row are even however many rows tie.
    """
    spark = rows.sparkSession
    rows = written(rows, "scores")
    enough = F.col("n_words") >= least_words
    number = rows.where(enough).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(number, ROWS_OF_PART))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")]
    line = rows.where(enough).withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    line = written(line.withColumn("__part", F.spark_partition_id()), "ranges")
    # One row a range.
    sizes = line.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = line.join(starts, "__part").withColumn("rank", rank.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= number * percent // 100, F.col("rank")))
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rows.columns, "rank").unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text, any other columns).

    ``target`` has a column ``text``; whole texts of both count, of any length. Null and empty texts have no features,
    weigh 0 and are not drawn while words are asked for. Repeated rows count each; a null id draws as an empty one. An
    empty table of documents gives an empty result, an empty target a share of its smoothing alone. Other columns of
    ``docs``, whatever their names, are not carried.
    """
    gains = bucket_gains(docs, target, run, buckets)
    scores = weighted(docs, gains, run).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return drawn(scores, percent, least_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance": op12_importance}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op12_importance": f"""
WITH RECURSIVE steps(b, k, r) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(CAST(r AS BIGINT) ORDER BY b) AS step FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
dw AS MATERIALIZED (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
names AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bs FROM names),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT b AS bucket, CAST(floor(1000 * ln(
           (CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS} AS DOUBLE)
           / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * CAST((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weights AS (SELECT row, CAST(sum(dw.n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT count(*) FROM ranked) * {PERCENT} // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""
}
