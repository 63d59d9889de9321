"""Scanning each content once, however many paths hold it and however often the corpus is scanned.

Results lie in a store, a table by digest, language and version of the rules. A scan reads the digests of all files, scans
one file of each content that the store lacks, appends what it found, and joins results back to all paths.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.scan import scan_files
from scanloom.sources.tables import shared_folder

#: A content of at least one in so many files is hot; there are at most so many.
HOT = 1024
SALTS = 32
CONTENT = ["digest", "language"]


def _digest(source_files: DataFrame) -> DataFrame:
    return source_files.withColumn("digest", F.sha2("text", 256))


def _store_schema(spark: SparkSession) -> T.StructType:
    empty = spark.createDataFrame([], "repo string, path string, language string, text string, error string")
    scanned = scan_files(empty, languages=())
    fields = [T.StructField("digest", T.StringType()), T.StructField("language", T.StringType())]
    return T.StructType([*fields, *(scanned.schema[c] for c in ("findings", "syntax_issues")), T.StructField("run", T.StringType()), T.StructField("version", T.StringType())])


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows: digest, language, findings, syntax_issues, run, version. None where there is no store yet."""
    schema = _store_schema(spark)
    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def contents(source_files: DataFrame) -> DataFrame:
    """(digest, language, n_files, file) of the distinct contents, with one file that holds each."""
    # The text is asked, not the digest: a filter on what is computed would compute it a second time.
    return _digest(source_files.where("text IS NOT NULL")).groupBy(*CONTENT).agg(
        F.count("*").alias("n_files"), F.min(F.struct("repo", "path")).alias("file")
    )


def scan_contents(source_files: DataFrame, store: str, version: str, run: str, custom_rules=()) -> DataFrame:
    """``source_files`` with ``findings`` and ``syntax_issues``, as ``scan_files`` gives them, each content scanned once.

    ``version`` names the rules: results of another version are not used. ``run`` is kept with what this scan adds, so that
    ``scanned_by_run`` can tell how much it was. Texts stay where they are: only digests are counted, and one file a
    content is read again. Files without a text are not stored. The table ``store`` is only appended to, in one
    commit; two scans at once may add the same content twice, which does no harm. Files are read again by whatever
    uses the result, and should come from a table or tree that does not change meanwhile.
    """
    spark = source_files.sparkSession
    known = stored(spark, store).where(F.col("version") == version)
    folder = shared_folder(spark, "contents")
    contents(source_files).write.parquet(folder)
    every = spark.read.parquet(folder)
    new = every.join(known.select(*CONTENT), CONTENT, "left_anti").select("digest", F.col("file.repo").alias("repo"), F.col("file.path").alias("path"))
    chosen = _digest(source_files).join(new.withColumnRenamed("digest", "wanted"), ["repo", "path"])
    # Where two files share a path, only the text that was chosen counts.
    chosen = chosen.where("digest = wanted").select(*source_files.columns, "digest")
    found = scan_files(chosen, custom_rules).select(*CONTENT, "findings", "syntax_issues", F.lit(run).alias("run"), F.lit(version).alias("version"))
    found.write.mode("append").partitionBy("version").parquet(store)
    return with_results(source_files, stored(spark, store).where(F.col("version") == version), every)


def with_results(source_files: DataFrame, results: DataFrame, every: DataFrame) -> DataFrame:
    """Results joined to all paths; a content that very many files share is dealt into ``SALTS`` parts.

    ``every`` comes from ``contents``. A hot content makes at least a ``HOT``-th of all files, so the broadcast table
    of hot digests has at most that many rows.
    """
    total = every.agg(F.sum("n_files")).first()[0] or 0
    hot = F.broadcast(every.where(F.col("n_files") * HOT >= total).select(*CONTENT, F.lit(True).alias("hot")))
    last = F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0))
    held = results.select(*CONTENT, "findings", "syntax_issues").dropDuplicates(CONTENT)
    held = held.join(hot, CONTENT, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("hot")
    files = _digest(source_files.where("text IS NOT NULL"))
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("repo", "path"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    texts = files.join(hot, CONTENT, "left").withColumn("salt", dealt)
    scanned = texts.join(held, [*CONTENT, "salt"]).select(*source_files.columns, "findings", "syntax_issues")
    without = scan_files(source_files.where("text IS NULL"), languages=())
    return scanned.unionByName(without)


def scanned_by_run(spark: SparkSession, store: str) -> DataFrame:
    """(version, run, n_scanned): how many contents each run had to scan."""
    return stored(spark, store).groupBy("version", "run").agg(F.count("*").alias("n_scanned"))
