"""Evaluation of a scan against labelled cases (a manifest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.gate import gate
from scanloom.operators.scan import findings as findings_of


def _keys(expected: DataFrame) -> list[str]:
    """What names a file: repository and path, or the path alone in a manifest of one repository (without ``repo``)."""
    return ["repo", "path"] if "repo" in expected.columns else ["path"]


def labelled_files(expected: DataFrame) -> DataFrame:
    """Every file of a manifest once a category; counterparts count as ``fixed``."""
    repo = _keys(expected)[:-1]
    given = expected.select(*repo, "category", F.col("file").alias("path"))
    fixed = expected.where(F.col("fixed_file").isNotNull()).select(
        *repo, F.lit("fixed").alias("category"), F.col("fixed_file").alias("path")
    )
    return given.unionByName(fixed).distinct()


def evaluate_files(file_gate: DataFrame, expected: DataFrame) -> DataFrame:
    """Confusion counts at file grain: a vulnerable file should be blocked, any other approved.

    Files of the manifest that were not scanned are left out.
    """
    keys = _keys(expected)
    joined = labelled_files(expected).join(file_gate.select(*keys, "deployable"), keys)
    return joined.groupBy("category").agg(
        F.count("*").alias("n_files"),
        F.count_if(~F.col("deployable")).alias("n_blocked"),
        F.count_if("deployable").alias("n_approved"),
        F.count_if(F.col("deployable") == (F.col("category") != "vulnerable")).alias("n_right"),
    )


def expected_hits(expected: DataFrame) -> DataFrame:
    """One row a case and expected line; cases without lines keep one row."""
    return expected.select(
        *_keys(expected)[:-1], "case_id", "category", "language", "rule", F.col("file").alias("path"), F.explode_outer("expected_lines").alias("line")
    )


def found_lines(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings in files named in the manifest, counted by line: repeats on a line stay one row.

    The null tests are those that joins would add; given here, all joins with
    this table have the same input and Spark computes it once.
    """
    keys = _keys(expected)
    named = expected.select(*keys[:-1], F.col("file").alias("path")).distinct()
    whole = findings.where("path IS NOT NULL AND rule_id IS NOT NULL AND line IS NOT NULL")
    return whole.join(named, keys, "left_semi").groupBy(*keys, "rule_id", "line").agg(F.count("*").alias("n_found"))


def _match(found: DataFrame, expected: DataFrame) -> DataFrame:
    hits = expected_hits(expected).where(F.col("line").isNotNull()).withColumnRenamed("rule", "rule_id")
    return hits.join(found, [*_keys(expected), "rule_id", "line"], "full_outer").select(
        *_keys(expected)[:-1],
        "case_id",
        "category",
        "path",
        "rule_id",
        "line",
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.when(F.col("case_id").isNull(), "unexpected")
        .when(F.col("n_found").isNull(), "missed")
        .otherwise("hit")
        .alias("outcome"),
    )


def match_lines(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and found lines side by side: ``hit``, ``missed`` or ``unexpected``.

    Only files named in the manifest take part.
    """
    return _match(found_lines(findings, expected), expected)


def evaluate_cases(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: lines hit and missed, and whether the number of findings is the expected one.

    Cases bring their number of findings in the file, and their lines, in two
    joins that share one counted layout of the findings.
    """
    keys = _keys(expected)
    found = found_lines(findings, expected)
    lines = expected_hits(expected).select("case_id", F.col("rule").alias("rule_id"), *keys, "line").where(
        F.col("line").isNotNull()
    )
    per_case = (
        lines.join(found, [*keys, "rule_id", "line"], "left")
        .groupBy("case_id")
        .agg(
            F.count("n_found").alias("n_hit"),
            F.count_if(F.col("n_found").isNull()).alias("n_missed"),
        )
    )
    counts = found.groupBy(*keys, "rule_id").agg(F.sum("n_found").alias("n_found"))
    cases = expected.select(
        *keys[:-1], "case_id", "category", "language", F.col("rule").alias("rule_id"), F.col("file").alias("path"), "expected_count"
    )
    return (
        cases.join(per_case, "case_id", "left")
        .join(counts, [*keys, "rule_id"], "left")
        .select(
            *keys[:-1],
            "case_id",
            "category",
            "language",
            "rule_id",
            "path",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_missed", F.lit(0)).alias("n_missed"),
            F.coalesce("n_found", F.lit(0)).alias("n_found"),
            (F.coalesce("n_found", F.lit(0)) == F.col("expected_count")).alias("count_agrees"),
        )
    )


def rule_quality(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Per rule: hits, misses, unexpected lines, precision and recall.

    Blind spots are expected not to be found, so their lines do not count as misses.
    """
    lines = match_lines(findings, expected).where(
        F.coalesce("category", F.lit("")).isin("", "vulnerable", "false_positive")
    )
    tp, fn, fp = (F.count_if(F.col("outcome") == o) for o in ("hit", "missed", "unexpected"))
    return lines.groupBy("rule_id").agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp")).select(
        "*",
        F.expr("try_divide(tp, tp + fp)").alias("precision"),
        F.expr("try_divide(tp, tp + fn)").alias("recall"),
    )


def blind_spots(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases that are known not to be found, and whether that still holds."""
    cases = evaluate_cases(findings, expected.where(F.col("category") == "blind_spot"))
    reasons = expected.select("case_id", "blind_spot_reason")
    return cases.join(reasons, "case_id", "left").select(
        "case_id", "rule_id", "path", "n_hit", "n_missed", (F.col("n_hit") == 0).alias("still_blind"), "blind_spot_reason"
    )


def sources_by_rule(expected: DataFrame) -> DataFrame:
    """How many cases of each rule come from each source data set."""
    return expected.select("rule", F.explode("source_datasets").alias("source_dataset")).groupBy(
        "rule", "source_dataset"
    ).agg(F.count("*").alias("n_cases"))


def counterparts(file_gate: DataFrame, expected: DataFrame) -> DataFrame:
    """Vulnerable files next to their fixed counterparts, with both verdicts."""
    repo = _keys(expected)[:-1]
    pairs = expected.where(F.col("fixed_file").isNotNull()).select(*repo, "file", "fixed_file").distinct()
    # All files' verdicts are no table to broadcast, however small the table they are made from.
    verdict = file_gate.select(*repo, "path", "deployable").hint("merge")
    return (
        pairs.join(verdict.select(*repo, F.col("path").alias("file"), "deployable"), [*repo, "file"], "left")
        .join(verdict.select(*repo, F.col("path").alias("fixed_file"), F.col("deployable").alias("fixed_deployable")), [*repo, "fixed_file"], "left")
        .select(*repo, "file", "fixed_file", "deployable", "fixed_deployable")
    )


def ai_result_counts(results: DataFrame) -> DataFrame:
    """Published findings of generated files: lines and findings a file."""
    return results.select(
        "file", "language", "total_lines", F.size("violations_detected").alias("n_findings"),
        F.size("known_limitations").alias("n_limitations"),
    )


def ai_result_lines(results: DataFrame) -> DataFrame:
    """Published findings of generated files, one row a finding."""
    return results.select("file", F.inline("violations_detected")).select("file", F.col("rule").alias("rule_id"), "line", "snippet")


def evaluate(scanned: DataFrame, expected: DataFrame, grain: str = "file") -> DataFrame:
    """Evaluation of scanned files at the grain of files, cases, lines or rules."""
    if grain == "file":
        return evaluate_files(gate(scanned, "file"), expected)
    by_grain = {"case": evaluate_cases, "line": match_lines, "rule": rule_quality}
    if grain not in by_grain:
        raise ValueError(f"unknown grain: {grain}")
    return by_grain[grain](findings_of(scanned), expected)
