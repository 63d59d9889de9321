"""Report rows and JSON documents for people and other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import fixed, fixed_rules
from scanloom.functions.fixed_rules import RULE_IDS
from scanloom.functions.text import base_name, canonical_rule_id, redact as mask, strip_both
from scanloom.operators.gate import severity_rank
from scanloom.operators.rules import with_everything
from scanloom.operators.scan import FINDINGS


def _label(severity: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.SEVERITY_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), severity), F.lit("▪"))


def _shown(snippet: Column, redact: bool) -> Column:
    plain = strip_both(snippet)
    return mask(plain) if redact else plain


def report(findings: DataFrame, rules: DataFrame, redact: bool = True) -> DataFrame:
    """One row a finding with everything a reader needs; secrets are masked, lines are whole."""
    rows = with_everything(findings, rules)
    return rows.select(
        "repo",
        "path",
        "seq",
        "line",
        severity_rank(F.col("severity")).alias("severity_rank"),
        _label(F.col("severity")).alias("badge"),
        "rule_name",
        F.concat(base_name(F.col("path")), F.lit(":"), F.col("line")).alias("location"),
        _shown(F.col("snippet"), redact).alias("snippet"),
        "why",
        "fix",
    )


def report_lines(findings: DataFrame, rules: DataFrame, redact: bool = True) -> DataFrame:
    """The plain text report of the findings, one row a line of text.

    Order by path components, ``seq`` and ``part`` to print it.
    """
    rows = with_everything(findings, rules)
    head = F.format_string(
        "✗  %-22s %s:%-4d %s",
        F.col("rule_name"),
        base_name(F.col("path")),
        F.col("line"),
        _shown(F.col("snippet"), redact),
    )
    texts = F.array(
        head,
        F.when(F.col("why") != "", F.concat(F.lit("   "), "why")),
        F.when(F.col("fix") != "", F.concat(F.lit("   → "), "fix")),
        F.lit(""),
    )
    return (
        rows.select("repo", "path", "seq", F.posexplode(texts).alias("part", "text"))
        .where(F.col("text").isNotNull())
    )


def issue_lines(syntax_issues: DataFrame) -> DataFrame:
    """The plain text report of syntax issues, one row a line of text."""
    place = F.when(F.col("line") != 0, F.concat("path", F.lit(":"), "line")).otherwise(F.col("path"))
    return syntax_issues.select("repo", "path", F.concat(F.lit("⚠ syntax error  "), place, F.lit("  "), "message").alias("text"))


def verdict_lines(counts: DataFrame) -> DataFrame:
    """The closing line of a report, from ``gate`` or ``scan_counts``."""
    n = F.col("fail_count") if "fail_count" in counts.columns else F.col("n_findings")
    blocked = F.format_string("Deployment BLOCKED — %d violation(s)", n)
    return counts.select(
        *([F.col("repo")] if "repo" in counts.columns else []),
        F.when(F.col("deployable"), "🚀 Deployment Approved").otherwise(blocked).alias("text"),
        F.when(F.col("n_files") == 0, "No supported source files found").alias("notice"),
    )


def _violations(redact: bool, custom_rules=()) -> Column:
    told = {rule.rule_id: rule.description for rule in fixed_rules.RULES}
    told |= {rule[0]: rule[4] for rule in custom_rules if len(rule) > 4}
    descriptions = F.create_map(*(F.lit(x) for pair in told.items() for x in pair))
    return F.transform(
        F.col("findings").cast(FINDINGS.replace("pass:int", "pass:int,seq:int")),
        lambda f: F.struct(
            f["rule_id"].alias("rule_id"),
            f["rule_id"].alias("rule_name"),
            F.col("path").alias("file"),
            f["line"].alias("line"),
            f["col"].alias("col"),
            (mask(f["snippet"]) if redact else f["snippet"]).alias("code_snippet"),
            F.try_element_at(descriptions, f["rule_id"]).alias("explanation"),
        ),
    )


def _issues() -> Column:
    return F.transform(
        "syntax_issues",
        lambda i: F.struct(F.col("path").alias("file"), i["message"].alias("message"), i["line"].alias("line"), i["col"].alias("col")),
    )


def _deployable() -> Column:
    return (F.size("findings") == 0) & (F.size("syntax_issues") == 0)


def scan_json(scanned: DataFrame, redact: bool = False, custom_rules=()) -> DataFrame:
    """One JSON document a file: its findings, syntax issues and verdict.

    ``pass_count`` is the number of rules without a finding. Secrets appear as
    they are in the code unless ``redact`` is set.
    """
    rules = F.array(*(F.lit(name) for name in dict.fromkeys((*RULE_IDS, *(rule[0] for rule in custom_rules)))))
    broken = F.transform("findings", lambda f: f["rule_id"])
    document = F.struct(
        F.col("path").alias("file"),
        _violations(redact, custom_rules).alias("violations"),
        F.size(F.array_except(rules, broken)).alias("pass_count"),
        F.size("findings").alias("fail_count"),
        _deployable().alias("deployable"),
        _issues().alias("syntax_errors"),
    )
    return scanned.select("repo", "path", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def patch_json(after: DataFrame, diffs: DataFrame, explanations: DataFrame, redact: bool = False) -> DataFrame:
    """One JSON document a file with a candidate: what was changed and why, and what remains.

    ``after`` comes from ``rescan``, ``diffs`` from ``delta_text``. Only the patch that was applied is explained.
    """
    texts = ("rule_id", "rule_name", "line", "title", "summary", "guidance", "reference")
    applied = F.col("status") == "patched"
    told = explanations.select(
        "repo", "path", F.col("rule_id").alias("_rule"), F.col("line").alias("_line"), F.struct(F.col("path").alias("file"), *texts).alias("_told")
    )
    rows = after.withColumns({"_rule": canonical_rule_id(F.col("rule_id")), "_line": F.col("line")})
    rows = rows.join(told, ["repo", "path", "_rule", "_line"], "left").join(diffs, ["repo", "path"], "left")
    document = F.struct(
        F.when(applied, F.array("path")).otherwise(F.array().cast("array<string>")).alias("patched_files"),
        F.when(applied & F.col("diff").isNotNull(), F.create_map("path", "diff")).alias("diffs"),
        F.array_compact(F.array(F.when(applied, F.col("_told")))).alias("patch_explanations"),
        _violations(redact).alias("remaining_violations"),
        _deployable().alias("deployable"),
        F.col("tool").alias("ai_used"),
        F.array("path").alias("scanned_files"),
        _issues().alias("syntax_errors"),
    )
    return rows.select("repo", "path", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def patch_lines(diffs: DataFrame) -> DataFrame:
    """Lines of a table of diff texts (``path``, ``diff``) without file headers."""
    lines = diffs.select("repo", "path", F.posexplode(F.split("diff", "\n")).alias("at", "text"))
    return lines.where(~F.col("text").startswith("--- ") & ~F.col("text").startswith("+++ ") & (F.col("text") != ""))


def explanation_lines(explanations: DataFrame) -> DataFrame:
    """Two lines of text for each patch explanation."""
    place = F.when(F.col("line") != 0, F.concat(base_name(F.col("path")), F.lit(":"), F.col("line"))).otherwise(
        base_name(F.col("path"))
    )
    texts = F.array(
        F.concat(F.lit("• "), "rule_name", F.lit("  "), place, F.lit(" — "), "title"),
        F.concat(F.lit("  "), "summary"),
    )
    return explanations.select("repo", "path", "line", "rule_id", F.posexplode(texts).alias("part", "text"))


def remaining_lines(findings: DataFrame, redact: bool = False) -> DataFrame:
    """One line of text for each finding that remains; secrets stay as they are unless ``redact`` is set."""
    text = F.format_string(
        "✗  %-22s %s:%-4d %s", F.col("rule_id"), base_name(F.col("path")), F.col("line"), _shown(F.col("snippet"), redact)
    )
    return findings.select("repo", "path", "line", "seq", text.alias("text"))


def progress_lines(verified: DataFrame) -> DataFrame:
    """One line of text for each candidate: applied, without effect or rejected."""
    finding = F.format_string("%s  %s:%d", F.col("rule_id"), base_name(F.col("path")), F.col("line"))
    text = (
        F.when(F.col("status") == "patched", F.concat(F.lit("✓ "), finding))
        .when(F.col("status") == "unchanged", F.concat(F.lit("↷  "), finding, F.lit("  (no change)")))
        .otherwise(F.concat(F.lit("✗  "), finding, F.lit("  "), F.coalesce("reason", F.lit(""))))
    )
    return verified.select("repo", "path", "line", text.alias("text"))


def patch_report(
    verified: DataFrame,
    explanations: DataFrame,
    diffs: DataFrame | None = None,
    remaining: DataFrame | None = None,
    redact: bool = False,
    issues: DataFrame | None = None,
    verdict: DataFrame | None = None,
) -> DataFrame:
    """Lines of the patch report: patched files, diffs, explanations, syntax issues, verdict, remaining findings.

    Only applied patches are listed and explained. ``verdict`` is the row of
    ``final_gate``; its line belongs to no file. Order by ``section``, path
    components, ``line`` and ``part`` to print it.
    """
    patched = verified.where(F.col("status") == "patched")
    applied = patched.select("repo", "path", canonical_rule_id(F.col("rule_id")).alias("rule_id"), "line")
    explanations = explanations.join(applied, ["repo", "path", "rule_id", "line"], "left_semi")

    def section(number: int, lines: DataFrame, line, part) -> DataFrame:
        return lines.select(
            "repo", "path", F.lit(number).alias("section"), line.cast("int").alias("line"), part.cast("int").alias("part"), "text"
        )

    status = F.format_string("✓  %s patched", base_name(F.col("path")))
    report = section(0, patched.withColumn("text", status), F.lit(0), F.lit(0))
    if diffs is not None:
        indented = patch_lines(diffs).withColumn("text", F.concat(F.lit("    "), "text"))
        report = report.unionByName(section(1, indented, F.col("at"), F.lit(0)))
    report = report.unionByName(section(2, explanation_lines(explanations), F.col("line"), F.col("part")))
    if issues is not None:
        report = report.unionByName(section(3, issue_lines(issues), F.lit(0), F.lit(0)))
    if verdict is not None:
        closing = F.when(F.col("deployable"), "🚀 Deployment Approved").otherwise("Remaining violations:")
        of_no_file = F.lit(None).cast("string")
        closed = verdict.select(of_no_file.alias("repo"), of_no_file.alias("path"), closing.alias("text"))
        report = report.unionByName(section(4, closed, F.lit(0), F.lit(0)))
    if remaining is not None:
        report = report.unionByName(section(5, remaining_lines(remaining, redact), F.col("line"), F.col("seq")))
    return report
