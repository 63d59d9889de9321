"""The rules as a table, and joins of findings with it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import fixed, fixed_rules
from scanloom.functions.text import canonical_rule_id


def local_table(spark: SparkSession, rows: list[dict], columns: dict[str, pa.DataType]) -> DataFrame:
    """A driver-side table with known size, which the optimizer broadcasts by itself."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=pa.schema(list(columns.items()))))


def default_rules(spark: SparkSession) -> DataFrame:
    """The seven rules, one row each."""
    names = ("rule_id", "name", "description", "raw_nl", "rule_type", "severity", "why", "fix", "guidance",
             "patch_title", "patch_summary")
    rows = [r._asdict() | {"name": r.rule_id, "rule_type": r.rule_id} for r in fixed_rules.RULES]
    return local_table(spark, rows, dict.fromkeys(names, pa.string()))


def rules_with_own(spark: SparkSession, custom_rules) -> DataFrame:
    """The seven rules and own ones, given as (rule id, language, pattern, severity, description); the last two may be left out."""
    names = ("rule_id", "name", "severity", "description", "rule_type")
    own = {rule[0]: rule for rule in custom_rules}
    rows = [
        {"rule_id": r[0], "name": r[0], "severity": (*r, None, None)[3], "description": (*r, None, None)[4], "rule_type": "CUSTOM"}
        for r in own.values()
    ]
    return default_rules(spark).unionByName(local_table(spark, rows, dict.fromkeys(names, pa.string())), allowMissingColumns=True)


def rule_aliases(spark: SparkSession) -> DataFrame:
    rows = [{"alias": a, "rule_id": r} for a, r in fixed.RULE_ALIASES.items()]
    return local_table(spark, rows, {"alias": pa.string(), "rule_id": pa.string()})


def _names() -> list[Column]:
    return [
        F.coalesce("name", "rule_id").alias("rule_name"),
        F.col("description").alias("explanation"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
    ]


def _advice() -> list[Column]:
    return [
        F.coalesce("guidance", F.lit(fixed_rules.OTHER_GUIDANCE)).alias("guidance"),
        F.coalesce(F.split("why", "\n")[0], F.lit("")).alias("why"),
        F.coalesce("fix", F.lit("")).alias("fix"),
    ]


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the name, description and severity of their rule.

    A rule that is not in the table keeps its id as name and counts as medium.
    """
    return findings.join(rules, "rule_id", "left").select(*findings.columns, *_names())


def with_guidance(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the guidance, reason and fix of their rule, with defaults."""
    return findings.join(rules, "rule_id", "left").select(*findings.columns, *_advice())


def with_everything(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Both of the above from one join."""
    return findings.join(rules, "rule_id", "left").select(*findings.columns, *_names(), *_advice())


def failed_rules(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"))


def clean_rules(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules without any finding. Only distinct rule ids are shuffled."""
    return rules.join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def with_canonical_rule(findings: DataFrame) -> DataFrame:
    return findings.withColumn("rule_id", canonical_rule_id(F.col("rule_id")))
