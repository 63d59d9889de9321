"""Token counts by an exact length histogram.

Documents are counted by their number of tokens inside each task; adding up these small tables gives the histogram.
Sums over it from either end answer, for every context limit, how many documents are longer, how many tokens there
are, how many stay if each document is cut at the limit, and which share of documents fits (all quantiles).
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabulary splits a text before merging (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of a block; sums over blocks come first, so that no task has to see all lengths.
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, documents) of all rows' texts in tokens; null and empty texts have length 0, repeats count each."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encode, seen = encoder(shared.value).encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        lengths = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array([seen[n] for n in lengths], pa.int64())], ["length", "documents"])

    counted = docs.select("text").mapInArrow(run, "length long, documents long")
    return counted.groupBy("length").agg(F.sum("documents").alias("documents"))


def by_limit(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens in all, longer documents, and tokens kept.

    (limit, documents, tokens, longer_documents, longer_tokens, kept_tokens, share_fitting): documents of this length
    and their tokens; documents above it and their tokens (the suffix sums); tokens if all are cut at the limit; share
    of documents that fit. Any other limit x has the row of the greatest length below it, with kept_tokens more by
    (x - limit) * longer_documents.
    """
    rows = histogram.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("block", F.floor(F.col("length") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    above, below = (Window.orderBy("block").rowsBetween(*ends) for ends in ((1, Window.unboundedFollowing), (Window.unboundedPreceding, -1)))
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("block", total("d", above).alias("d_above"), total("t", above).alias("t_above"), total("d", below).alias("d_below"), total("t", below).alias("t_below"))
    inside = Window.partitionBy("block").orderBy("length")
    later, earlier = inside.rowsBetween(1, Window.unboundedFollowing), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "block").select(
        F.col("length").alias("limit"),
        "documents",
        "tokens",
        (F.col("d_above") + total("documents", later)).alias("longer_documents"),
        (F.col("t_above") + total("tokens", later)).alias("longer_tokens"),
        (F.col("d_below") + total("documents", earlier)).alias("fitting"),
        (F.col("t_below") + total("tokens", earlier)).alias("fitting_tokens"),
    )
    kept = F.col("fitting_tokens") + F.col("limit") * F.col("longer_documents")
    share = F.col("fitting") / (F.col("fitting") + F.col("longer_documents"))
    return rows.select("limit", "documents", "tokens", "longer_documents", "longer_tokens", kept.alias("kept_tokens"), share.alias("share_fitting"))


def quantile(limits: DataFrame, share: float) -> Column:
    """The least length that this share of documents does not exceed, as an aggregate over ``by_limit``."""
    return F.min(F.when(F.col("share_fitting") >= share, F.col("limit")))


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, kept_tokens) for any limits."""
    kept = [F.struct(F.lit(n).alias("limit"), F.sum(F.least("length", F.lit(n)) * F.col("documents")).alias("kept_tokens")) for n in limits]
    return histogram.agg(F.array(*kept).alias("k")).select(F.inline("k"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_limit(written(length_histogram(table(spark, sf_dir, "documents")), "lengths"))


QUERIES = {"op4_token_counts": op4_token_counts}
