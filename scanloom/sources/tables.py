"""Tables of texts and labelled cases as sources, JSON and report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.text import decode_text, detect_language
from scanloom.operators.report import scan_json

MANIFEST = (
    "case_id string, dataset string, category string, language string, rule string, file string, "
    "expected_lines array<int>, expected_count int, patchable boolean, source_datasets array<string>, "
    "fixed_file string, blind_spot_reason string"
)
AI_RESULTS = (
    "file string, language string, source string, total_lines int, "
    "violations_detected array<struct<rule:string,line:int,snippet:string>>, "
    "known_limitations array<struct<rule:string,line:int,reason:string>>"
)


def from_table(
    table: DataFrame,
    path: Column | str,
    text: Column | str,
    language: Column | str | None = None,
    repo: Column | str | None = None,
    mtime: Column | str | None = None,
) -> DataFrame:
    """``source_files`` from any table that holds texts.

    ``language`` is a column or a name of a language; without it the ending of
    the path decides. Binary texts are decoded as UTF-8.
    """

    def column(given, otherwise):
        return otherwise if given is None else F.col(given) if isinstance(given, str) else given

    path = column(path, None).cast("string")
    languages = ("python", "javascript", "typescript", "unknown")
    language = F.lit(language) if language in languages else column(language, detect_language(path))
    selected = table.select(
        column(repo, F.lit("")).cast("string").alias("repo"),
        path.alias("path"),
        language.alias("language"),
        column(text, None).alias("text"),
        column(mtime, F.lit(None)).cast("timestamp").alias("mtime"),
        F.lit(None).cast("string").alias("error"),
    )
    if dict(selected.dtypes)["text"] == "binary":
        selected = selected.withColumn("text", decode_text(F.col("text")))
    return selected


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder the session names, or else below its warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to a new shared folder and read again: for what several results come from."""
    folder = shared_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def save_bucketed(files: DataFrame, name: str, buckets: int) -> None:
    """Save files, candidates or verdicts as a table bucketed by file.

    Tables saved with the same number of buckets are joined by file without a
    shuffle, which matters most where the texts of a corpus take part.
    """
    files.write.bucketBy(buckets, "repo", "path").sortBy("repo", "path").saveAsTable(name)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, one JSON object a line."""
    return spark.read.schema(MANIFEST).json(str(path))


def read_ai_results(spark: SparkSession, path: str) -> DataFrame:
    """Published findings of generated files: one JSON array of objects."""
    return spark.read.schema(AI_RESULTS).option("multiLine", True).json(str(path))


def write_json(scanned: DataFrame, path: str, redact: bool = False) -> None:
    """One JSON document a scanned file, one a line."""
    scan_json(scanned, redact).select(F.col("json").alias("value")).write.mode("errorifexists").text(str(path))


def write_findings(found: DataFrame, path: str) -> None:
    """Findings as parquet, one folder a rule, so that a rule can be read alone.

    Rows are spread by rule, repository and file, so a rule with most findings is still
    written by many tasks.
    """
    found.repartition("rule_id", "repo", "path").write.partitionBy("rule_id").mode("errorifexists").parquet(str(path))
