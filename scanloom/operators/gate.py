"""Deployment gate and summaries.

Everything starts from scanned files (one row a file, findings inside), so the
file grain needs no shuffle and larger grains shuffle partial sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import fixed
from scanloom.functions.fixed_rules import RULE_IDS
from scanloom.functions.text import detect_language
from scanloom.operators.rules import with_rules


def _verdict(n_findings: Column, n_syntax: Column) -> list[Column]:
    deployable = (n_findings == 0) & (n_syntax == 0)
    return [deployable.alias("deployable"), F.when(deployable, 0).otherwise(1).alias("exit_code")]


def gate(scanned: DataFrame, grain: str = "corpus") -> DataFrame:
    """Whether code may be deployed: it has neither findings nor syntax issues.

    ``grain`` is ``file``, ``repo`` or ``corpus``. Files without findings count
    too; an empty corpus is deployable.
    """
    counted = scanned.select(
        "repo",
        "path",
        F.size("findings").cast("long").alias("n_findings"),
        F.size("syntax_issues").cast("long").alias("n_syntax"),
    )
    return verdicts(counted, grain)


def gate_from_tables(
    source_files: DataFrame, findings: DataFrame, syntax_issues: DataFrame, grain: str = "corpus"
) -> DataFrame:
    """The gate from unfolded tables; files without findings count as well.

    Rows of the three tables are summed by file in one aggregate, which
    combines before its shuffle, instead of being joined.
    """

    def counts(rows: DataFrame, files: int, found: int, syntax: int) -> DataFrame:
        numbers = {"is_file": files, "n_findings": found, "n_syntax": syntax}
        return rows.select("repo", "path", *(F.lit(n).cast("long").alias(name) for name, n in numbers.items()))

    rows = counts(source_files, 1, 0, 0).unionByName(counts(findings, 0, 1, 0)).unionByName(counts(syntax_issues, 0, 0, 1))
    by_path = rows.groupBy("repo", "path").agg(*(F.sum(c).alias(c) for c in ("is_file", "n_findings", "n_syntax")))
    return verdicts(by_path.where("is_file > 0").drop("is_file"), grain)


def verdicts(counted: DataFrame, grain: str) -> DataFrame:
    """Verdicts from one row a file with ``n_findings`` and ``n_syntax``."""
    if grain in ("repo", "corpus"):
        counted = counted.groupBy(*(["repo"] if grain == "repo" else [])).agg(
            F.count("*").alias("n_files"),
            F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings"),
            F.coalesce(F.sum("n_syntax"), F.lit(0)).alias("n_syntax"),
        )
    elif grain != "file":
        raise ValueError(f"unknown grain: {grain}")
    return counted.select("*", *_verdict(F.col("n_findings"), F.col("n_syntax")))


def gate_from_changes(changes: DataFrame, grain: str = "corpus") -> DataFrame:
    """The gate from changes of counts, as ``streaming.state.gate_changes`` emits them: their sums are the counts of now.

    Repositories all of whose files have gone have no row.
    """
    if grain not in ("repo", "corpus"):
        raise ValueError(f"unknown grain: {grain}")
    sums = changes.groupBy(*(["repo"] if grain == "repo" else [])).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_files", "n_findings", "n_syntax"))
    )
    if grain == "repo":
        sums = sums.where(F.col("n_files") > 0)
    return sums.select("*", *_verdict(F.col("n_findings"), F.col("n_syntax")))


def _of_rule(rule: str):
    return lambda f: f["rule_id"] == rule


def scan_counts(scanned: DataFrame, rule_ids=RULE_IDS) -> DataFrame:
    """One row: findings, rules without findings, files, verdict.

    One flag a rule is carried through the aggregate, so nothing is collected.
    """
    flags = [
        F.coalesce(F.bool_or(F.exists("findings", _of_rule(rule))), F.lit(False)).alias(f"has_{i}")
        for i, rule in enumerate(rule_ids)
    ]
    one = scanned.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("fail_count"),
        F.coalesce(F.sum(F.size("syntax_issues")), F.lit(0)).alias("n_syntax"),
        *flags,
    )
    clean = sum((F.when(F.col(f"has_{i}"), 0).otherwise(1) for i in range(len(rule_ids))), F.lit(0))
    return one.select(
        "n_files", "fail_count", clean.alias("pass_count"), "n_syntax", *_verdict(F.col("fail_count"), F.col("n_syntax"))
    )


def by_file(scanned: DataFrame) -> DataFrame:
    """Files that have findings, with their findings in scan order."""
    return scanned.where(F.size("findings") > 0).select(
        "repo", "path", F.size("findings").alias("n_findings"), "findings"
    )


def files_with_findings(scanned: DataFrame) -> DataFrame:
    """The source rows of files that have findings."""
    return scanned.where(F.size("findings") > 0).drop("findings", "syntax_issues")


def scanned_files(scanned: DataFrame) -> DataFrame:
    return scanned.select("repo", "path")


def severity_rank(severity: Column) -> Column:
    """1 for critical, 2 for high and so on; unknown severities come last."""
    order = F.array(*(F.lit(s) for s in fixed.SEVERITY_LABELS))
    at = F.array_position(order, severity)
    return F.when(at == 0, F.size(order) + 1).otherwise(at).cast("int")


def summary(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings by severity and rule, with subtotals and the total.

    Findings are counted by rule before the join, so the rollup sees one row a rule.
    """
    counted = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    rows = with_rules(counted, rules)
    return rows.rollup("severity", "rule_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"))


def summary_by_language(findings: DataFrame) -> DataFrame:
    return findings.groupBy(detect_language(F.col("path")).alias("language"), "rule_id").agg(
        F.count("*").alias("n_findings")
    )
