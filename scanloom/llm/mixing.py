"""Mixing sources to target weights along a time-varying curriculum.

A source's target is its share of all words by weight, at most ``MOST_REPEATS`` times what it has; what it cannot give
is shared by weight among the others (a level is found at which the sum fits). Its schedule says how its share moves
over training time; the integral of the schedule times the target is the source's cumulative demand. Documents stand
in hash order along their source, pass after pass, and each one's training position is where demand reaches its
middle: the inverse of the integral. Documents are then sorted by position with a range shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import WORD, order_hash, range_sums, table, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Knots (time, density) of the schedules, one a weight class: fading, even, and growing sources. Lines join knots.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, place, target) from sums of sizes; the sources' order by code point gives the weights."""
    sources = sums.groupBy(F.col("__group").alias("source")).agg(F.sum("__size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("place", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    sources = sources.withColumn("ratio", F.col("most") / F.col("weight"))
    line = Window.orderBy("ratio", "place")
    filled = F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    sources = sources.withColumn("level", (F.sum("source_size").over(every) - filled) / others)
    # The first source, by ratio, that the level does not fill sets it for all behind.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    return sources.withColumn("target", F.least(F.col("most").cast("double"), level["level"] * F.col("weight"))).select("source", "source_size", "place", "target")


def _integral(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(share so far, time, density, slope, share behind) of each piece, the whole share being 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    pieces, share = [], 0.0
    for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False):
        more = (t1 - t0) * (d0 + d1) / 2 / area
        pieces.append((share, t0, d0 / area, (d1 - d0) / area / (t1 - t0), share + more))
        share += more
    return pieces


def time_at(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a schedule has used this share: the integral's inverse, a root in each piece."""
    out = None
    for low, start, density, slope, high in reversed(_integral(knots)):
        rest = F.greatest(share - low, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(density * density) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        here = F.lit(start) + F.when(rest == 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(density) + root))
        out = here if out is None else F.when(share <= high, here).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """``docs`` (doc_id, source, size, tie, any other columns) with source_size, target, copies and first position.

    ``copies`` whole passes over a document; its position is null where there is none. A source's last document is
    taken if its middle lies before the target, so a source ends within half a document of its target. Sizes of null
    or empty texts are 0: such documents are taken with their neighbours and add no words. Rows that agree in id,
    size and tie are alike, so whichever is taken gives the same result. A null source is a source of its own. Columns of
    ``docs`` with the names of new ones give way. Sums run inside even ranges of (source, order, row), so that rows
    without an id, or with the same one, are no one task's work.
    """
    new = ["source_size", "place", "target", "before", "copies", "position"]
    old = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*old).alias("__whole"), "doc_id", "source", "size", "tie", order_hash("doc_id").alias("__order"))
    # A written number names the row from here on: other columns wait until positions are known.
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    line, sums = range_sums(rows.drop("__whole"), "source", ["__order", "doc_id", "size", "tie", "__row"], "size")
    targets = source_targets(sums, weights, most)
    line = line.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    line = line.select("__row", F.col("size").alias("__size"), "source_size", "place", "target", "before")
    out = rows.select("__row", "__whole").join(line, "__row").withColumn("size", F.col("__size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("before") + F.col("size") / F.lit(2.0)
    out = out.withColumn("copies", (whole + (middle < rest).cast("int")).cast("int"))
    out = out.withColumn("position", F.when(F.col("copies") > 0, position(F.lit(0), len(weights), schedules)))
    return out.select(*[F.col("__whole")[c].alias(c) for c in old], *new)


def position(copy: Column, classes: int, schedules) -> Column:
    """Training position, 0 to 1, of a copy (0 is the first) of a mixed document."""
    share = (copy * F.col("source_size") + F.col("before") + F.col("size") / F.lit(2.0)) / F.col("target")
    share = F.when(F.col("target") > 0, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    out = None
    for i in range(classes):
        at = time_at(share, schedules[i % len(schedules)])
        out = at if out is None else F.when(F.col("place") % classes == i, at).otherwise(out)
    return F.round(out, 9)


def training_order(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: a row for every copy, in training order, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("__whole"), "doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    mixed = mixed_documents(rows, weights, most, schedules).where("copies > 0")
    mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mixed = mixed.withColumn("__position", position(F.col("__copy"), len(weights), schedules))
    return mixed.orderBy("__position", "doc_id").select("__whole.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"), F.lit(0).alias("tie"))
    mixed = mixed_documents(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", taken, "copies", "position")


QUERIES = {"op1_mixing": op1_mixing}

ORACLE = {
    "op1_mixing": """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) * 8 AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, place,
         least(CAST(most AS DOUBLE), (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight) AS target
  FROM l),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.place, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM b),
e AS (
  SELECT *, CAST(whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END AS INTEGER) AS copies,
         CASE WHEN target > 0 THEN least(greatest((before + size / 2.0) / target, 0.0), 1.0) ELSE 0.0 END AS share
  FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE place % 3
         WHEN 0 THEN CASE WHEN share = 0 THEN 0.0 ELSE 2.0 * share / (1.5 + sqrt(2.25 - 2.0 * share)) END
         WHEN 1 THEN CASE WHEN share = 0 THEN 0.0 ELSE 2.0 * share / (1.0 + sqrt(1.0)) END
         ELSE CASE WHEN share <= 0.3125 THEN CASE WHEN share = 0 THEN 0.0 ELSE 2.0 * share / (0.25 + sqrt(0.0625 + 3.0 * share)) END
                   ELSE 0.5 + 2.0 * (share - 0.3125) / (1.0 + sqrt(1.0 + 3.0 * (share - 0.3125))) END END, 9) END AS position
FROM e
"""
}
