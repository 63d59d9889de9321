"""The data side of patching: requests, candidates, checks, before and after.

An external tool writes the new texts; it is not part of this package. A round
is: ``patch_requests`` → (tool) → ``candidates`` → ``validate_candidates`` →
``verify_patches`` → ``apply_patches``.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from scanloom.functions import fixed, fixed_rules
from scanloom.functions.syntax import problem_column
from scanloom.functions.text import canonical_rule_id, detect_language, extract_code, lines_of, redact, universal_newlines, with_value
from scanloom.operators.gate import verdicts
from scanloom.operators.rules import default_rules
from scanloom.operators.scan import findings as findings_of
from scanloom.operators.scan import scan_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE = ["repo", "path"]


# Which finding comes next


def first_pending(scanned: DataFrame) -> DataFrame:
    """The first finding of every file that has one: a narrow operation."""
    first = F.get("findings", F.lit(0))
    return scanned.where(F.size("findings") > 0).select("repo", "path", first.alias("f")).select("repo", "path", "f.*")


ATTEMPT = [*FILE, "rule_id", "line", "snippet"]


def _spent(attempts: DataFrame, most: int) -> DataFrame:
    return attempts.groupBy(*FILE).agg(F.count("*").alias("n_attempts")).where(F.col("n_attempts") >= most)


def pending(findings: DataFrame, attempts: DataFrame, most: int | None = fixed.MAX_ATTEMPTS_PER_FILE) -> DataFrame:
    """Findings not attempted yet, in files that have attempts left.

    ``attempts`` has one row an attempt: ``repo``, ``path``, ``rule_id``,
    ``line``, ``snippet``. A file gets at most ``most`` attempts, or any number
    with None; ``spent_files`` tells which files have none left.
    """
    open_ = findings.join(attempts.select(*ATTEMPT), ATTEMPT, "left_anti")
    if most is not None:
        open_ = open_.join(_spent(attempts, most), FILE, "left_anti")
    return open_.select(*findings.columns)


def spent_files(findings: DataFrame, attempts: DataFrame, most: int = fixed.MAX_ATTEMPTS_PER_FILE) -> DataFrame:
    """Files that still have findings not attempted but no attempts left."""
    open_ = findings.join(attempts.select(*ATTEMPT), ATTEMPT, "left_anti")
    left = open_.groupBy(*FILE).agg(F.count("*").alias("n_open"))
    return left.join(_spent(attempts, most), FILE).select(*FILE, "n_attempts", "n_open", F.lit("spent").alias("status"))


def record_attempts(requests: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Attempts so far and those that a round of requests makes: the input of the next round."""
    made = requests.select(*ATTEMPT)
    return made if attempts is None else attempts.select(*ATTEMPT).unionByName(made)


def next_pending(findings: DataFrame, attempts: DataFrame, most: int | None = fixed.MAX_ATTEMPTS_PER_FILE) -> DataFrame:
    """The first finding of every file that was not attempted yet.

    A minimum of structs combines before the shuffle; no file is sorted.
    """
    rest = [c for c in findings.columns if c not in (*FILE, "pass", "seq")]
    first = F.min(F.struct("pass", "seq", *rest)).alias("f")
    return pending(findings, attempts, most).groupBy(*FILE).agg(first).select(*FILE, "f.*").select(*findings.columns)


def first_findings(findings: DataFrame, n: int | None = None) -> DataFrame:
    """Findings with their turn in scan order; with ``n``, at most so many a file (the attempt limit)."""
    order = Window.partitionBy(*FILE).orderBy("pass", "seq")
    ranked = findings.withColumn("turn", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("turn") <= n)


def prompt_rules(findings: DataFrame) -> DataFrame:
    """Each rule of a file once: placed where it first occurs, told as it last occurs."""
    return findings.groupBy(*FILE, "rule_id").agg(
        F.min("seq").alias("first_seq"),
        F.max(F.struct("seq", "line", "snippet")).alias("last"),
    ).select(*FILE, "rule_id", "first_seq", F.col("last.line").alias("line"), F.col("last.snippet").alias("snippet"))


# Requests


def _request_text(language: Column, path: Column, finding: Column, guidance: Column, text: Column) -> Column:
    return F.concat(
        F.format_string("Repair one finding in this %s file and return the whole new file, without fences.\n", language),
        F.lit("Change only what the finding needs; keep names, comments and layout as they are.\n\n"),
        F.format_string("File: %s\nFinding: %s\n\n", path, finding),
        F.format_string("Guidance:\n- %s\n", guidance),
        F.lit("- Values masked here are secrets: read them from the environment, do not restore them.\n"),
        F.lit("- Prefer the smallest change that removes the finding.\n\n"),
        F.lit("Code:\n"),
        text,
    )


def _guidance_of(rule_id: Column) -> Column:
    pairs = [F.lit(x) for r in fixed_rules.RULES for x in (r.rule_id, r.guidance)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule_id), F.lit(fixed_rules.OTHER_GUIDANCE))


def patch_requests(scanned: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """One request for every file with a pending finding.

    Without attempts the finding and the text are in the same row and nothing
    moves. With attempts the pending findings, which are small, are joined to
    the files.
    """
    if attempts is None:
        rows = scanned.where(F.size("findings") > 0).withColumn("f", F.get("findings", F.lit(0)))
    else:
        f = next_pending(findings_of(scanned), attempts)
        one = f.select(*FILE, F.struct("rule_id", "line", "col", "snippet").alias("f"))
        rows = scanned.select(*FILE, "language", "text").join(one, FILE)
    finding = F.to_json(
        F.struct(
            F.col("f.rule_id").alias("rule_id"),
            F.col("f.line").alias("line"),
            redact(F.col("f.snippet")).alias("code_snippet"),
        )
    )
    prompt = _request_text(
        F.col("language"),
        F.col("path"),
        finding,
        F.concat(F.col("f.rule_id"), F.lit(": "), _guidance_of(F.col("f.rule_id"))),
        redact(F.col("text")),
    )
    return rows.select(
        *FILE,
        "language",
        F.col("f.rule_id").alias("rule_id"),
        F.col("f.line").alias("line"),
        F.col("f.snippet").alias("snippet"),
        prompt.alias("prompt"),
    )


def patch_explanations(findings: DataFrame) -> DataFrame:
    """What a patch for a finding does, in words; one row a (file, rule, line)."""
    rules = default_rules(findings.sparkSession).select(
        F.col("rule_id").alias("canonical"), "patch_title", "patch_summary", F.col("guidance").alias("rule_guidance")
    )
    once = findings.groupBy(*FILE, "rule_id", "line").agg(F.min("seq").alias("seq"))
    rows = once.withColumn("canonical", canonical_rule_id(F.col("rule_id"))).join(rules, "canonical", "left")
    return rows.select(
        *FILE,
        F.col("canonical").alias("rule_id"),
        F.col("canonical").alias("rule_name"),
        "line",
        "seq",
        F.coalesce("patch_title", F.lit(fixed_rules.OTHER_PATCH_TITLE)).alias("title"),
        F.coalesce("patch_summary", F.lit(fixed_rules.OTHER_PATCH_SUMMARY)).alias("summary"),
        F.coalesce("rule_guidance", F.lit(fixed_rules.OTHER_PATCH_GUIDANCE)).alias("guidance"),
        F.concat(F.lit(fixed_rules.REFERENCE), F.col("canonical")).alias("reference"),
    )


# Candidates


def candidates(responses: DataFrame) -> DataFrame:
    """Code of each response: its longest fenced block, or all of it. A ``round`` is kept where there is one."""
    round_ = [c for c in ("round",) if c in responses.columns]
    return responses.select(*FILE, "rule_id", "line", "tool", *round_, extract_code(F.col("response")).alias("text"))


def validate_candidates(proposed: DataFrame) -> DataFrame:
    """Candidates with ``accepted`` and, where rejected, a ``reason``.

    Only Python is parsed; other languages are judged by the scan that follows.
    """
    is_python = detect_language(F.col("path")) == "python"
    checked = proposed.withColumn("_problem", problem_column(F.when(is_python, F.col("text"))))
    return checked.select(
        *proposed.columns,
        F.col("_problem").isNull().alias("accepted"),
        F.concat(
            F.lit("Python syntax validation failed: "), F.col("_problem.message"), F.lit(" (line "), F.col("_problem.line"), F.lit(")")
        ).alias("reason"),
    )


def _before_and_after(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """Files with a candidate: old text, new text (the old one if rejected) and status."""
    new = latest_candidates(validated).withColumnRenamed("text", "new_text")
    joined = source_files.join(new, FILE)
    status = (
        F.when(~F.col("accepted"), "error")
        .when(universal_newlines(F.col("text")).eqNullSafe(universal_newlines(F.col("new_text"))), "unchanged")
        .otherwise("patched")
    )
    return joined.withColumn("status", status).withColumn(
        "new_text", F.when(F.col("status") == "patched", F.col("new_text")).otherwise(F.col("text"))
    )


def candidate_status(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """What became of each file's candidate: patched, unchanged or error. Nothing is scanned for it."""
    return _before_and_after(source_files, validated).select(*FILE, "rule_id", "line", "tool", "status", "reason")


def text_pairs(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """Old and new text of files that a candidate changes, from one join."""
    pairs = _before_and_after(source_files, validated).where(F.col("status") == "patched")
    return pairs.select(
        *FILE, universal_newlines(F.col("text")).alias("old_text"), universal_newlines(F.col("new_text")).alias("new_text")
    )


def rescan(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """Scan the new texts. Only files with a candidate are scanned."""
    pairs = _before_and_after(source_files, validated)
    return scan_files(pairs.withColumn("text", F.col("new_text")).drop("new_text"))


_SIDED = [*FILE, "rule_id", "snippet", "pass", "seq", "line"]


def finding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two scans as ``fixed``, ``remaining`` or ``introduced``.

    Where both scans are of texts before and after a patch, ``sided_findings``
    with ``changes`` gives the same from one pass over the files.
    """
    old, new = (x.select(*_SIDED, F.lit(side).alias("side")) for x, side in ((before, "before"), (after, "after")))
    return changes(old.unionByName(new))


def changes(sided: DataFrame) -> DataFrame:
    """Findings with a ``side`` (``before``, ``after``), paired across sides.

    Line numbers shift between scans, so findings are paired by file, rule,
    snippet and occurrence. Both sides are laid out once by file, rule and
    snippet; numbering and pairing use that same layout. Such a group lies
    within one file, so its size is bounded by that file.
    """
    cols = [*FILE, "rule_id", "snippet"]
    order = Window.partitionBy(*cols, "side").orderBy("pass", "seq")
    numbered = sided.repartition(*cols).withColumn("occurrence", F.row_number().over(order))
    old, new = (F.max(F.when(F.col("side") == s, F.col("line"))) for s in ("before", "after"))
    return numbered.groupBy(*cols, "occurrence").agg(old.alias("line_before"), new.alias("line_after")).select(
        "*",
        F.when(F.col("line_after").isNull(), "fixed")
        .when(F.col("line_before").isNull(), "introduced")
        .otherwise("remaining")
        .alias("change"),
    )


def bag_changes(sided: DataFrame) -> DataFrame:
    """The same as bags: a row for each fixed, introduced or remaining finding, without lines.

    Only counts are summed, before the one shuffle.
    """
    old, new = (F.count_if(F.col("side") == s) for s in ("before", "after"))
    counts = sided.groupBy(*FILE, "rule_id", "snippet").agg(old.alias("old"), new.alias("new"))
    kinds = (("fixed", F.col("old") - F.col("new")), ("introduced", F.col("new") - F.col("old")), ("remaining", F.least("old", "new")))
    each = F.flatten(F.array(*(F.array_repeat(F.lit(kind), F.greatest(n, F.lit(0)).cast("int")) for kind, n in kinds)))
    return counts.select(*FILE, "rule_id", "snippet", F.explode(each).alias("change"))


def finding_difference(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixed, introduced and common findings as bags, without numbering."""
    cols = [*FILE, "rule_id", "snippet"]
    b, a = before.select(*cols), after.select(*cols)
    return b.exceptAll(a), a.exceptAll(b), b.intersectAll(a)


def _both_scans(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """Files with a candidate, with the findings of the old and of the new text in one row."""
    old = scan_files(_before_and_after(source_files, validated)).withColumnsRenamed(
        {"findings": "old_findings", "syntax_issues": "old_issues"}
    )
    return scan_files(old.withColumn("text", F.col("new_text")).drop("new_text", "old_issues"))


def sided_findings(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """One row a finding before and after, of files with a candidate; ``side`` tells which. One join, one pass."""

    def sided(findings: str, side: str) -> Column:
        return F.transform(findings, lambda f: f.withField("side", F.lit(side)))

    both = F.concat(sided("old_findings", "before"), sided("findings", "after"))
    return _both_scans(source_files, validated).select(*FILE, F.inline(both)).select(*_SIDED, "side")


def _shared(old: Column, new: Column) -> Column:
    """How many findings two arrays share, as bags of rule and snippet.

    Both are sorted together, so that equal findings of either side stand next
    to each other as two runs; what they share is the shorter run. After the
    sort the work is linear in the findings of the row.
    """

    def sided(array: Column, side: int) -> Column:
        return F.transform(
            array, lambda f: F.struct(f["rule_id"].alias("rule"), f["snippet"].alias("snippet"), F.lit(side).alias("side"))
        )

    def runs(f: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(f) - 1), lambda i: (i == 0) | ~F.get(f, i).eqNullSafe(F.get(f, i - 1)))
        return with_value(
            starts,
            lambda at: F.transform(
                at, lambda i, k: F.struct(F.get(f, i).alias("f"), (F.coalesce(F.get(at, k + 1), F.size(f)) - i).alias("n"))
            ),
        )

    def in_both(run: Column) -> Column:
        def shorter(one: Column, k: Column) -> Column:
            other = F.get(run, k + 1)
            same = one["f"]["rule"].eqNullSafe(other["f"]["rule"]) & one["f"]["snippet"].eqNullSafe(other["f"]["snippet"])
            return F.when(other.isNotNull() & same, F.least(one["n"], other["n"])).otherwise(0)

        return F.aggregate(F.transform(run, shorter), F.lit(0), lambda total, n: total + n)

    both = F.sort_array(F.concat(sided(old, 0), sided(new, 1)))
    some = (F.size(old) > 0) & (F.size(new) > 0)
    return F.when(some, with_value(both, lambda f: with_value(runs(f), in_both))).otherwise(0).cast("long")


def verify_patches(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """One row a file with a candidate (its latest): status, findings before and after, verdict.

    Files are first reduced to those with a candidate; old and new text are
    then scanned and compared side by side in one row, so that findings are
    not shuffled.
    """
    after = _both_scans(source_files, validated)
    n_before, n_after, n_syntax = F.size("old_findings"), F.size("findings"), F.size("syntax_issues")
    return after.select(
        *[*FILE, "rule_id", "line", "tool"],
        "status",
        "reason",
        n_before.alias("n_before"),
        n_after.alias("n_after"),
        n_syntax.alias("n_syntax"),
        ((n_after == 0) & (n_syntax == 0)).alias("deployable"),
        _shared(F.col("old_findings"), F.col("findings")).alias("n_remaining"),
    ).withColumns({"n_fixed": F.col("n_before") - F.col("n_remaining"), "n_introduced": F.col("n_after") - F.col("n_remaining")})


def provenance(verified: DataFrame) -> DataFrame:
    """Which tool answered which finding, and what came of it; no source text."""
    return verified.select(*FILE, "rule_id", "line", "tool", "status", "reason", "deployable")


def latest_candidates(validated: DataFrame) -> DataFrame:
    """One candidate a file: the latest accepted one, or the latest of those rejected."""
    kept = [c for c in ("rule_id", "line", "tool", "accepted", "reason", "text") if c in validated.columns]
    order = [c for c in ("accepted", "round", "tool", "text") if c in validated.columns]
    last = F.max_by(F.struct(*kept), F.struct(*order)).alias("last")
    return validated.groupBy(*FILE).agg(last).select(*FILE, "last.*")


def latest_accepted(validated: DataFrame) -> DataFrame:
    """One accepted candidate a file: of the latest ``round`` where there is that column, then by tool and text."""
    order = [c for c in ("round", "tool", "text") if c in validated.columns]
    last = F.max_by("text", F.struct(*order)).alias("new_text")
    return validated.where("accepted").groupBy(*FILE).agg(last)


def apply_patches(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """A new version of the files, with accepted candidates in place of old texts.

    Write it to a new table. Every file keeps one row: of several accepted
    candidates the latest counts. One left join; the texts of the corpus are
    not shuffled while the accepted candidates are few enough to be broadcast.
    """
    rows = source_files.join(latest_accepted(validated), FILE, "left")
    return rows.withColumn("text", F.coalesce("new_text", "text")).select(*source_files.columns)


def scan_versions(source_files: DataFrame, validated: DataFrame) -> DataFrame:
    """The new version of the files, scanned, with the findings of the old one as ``old_findings``.

    As ``scan_files`` of ``apply_patches``, but of files without an accepted
    candidate the text is scanned once, not once a version. One row a file and
    one pass; write it to a table where several results come from it.
    """
    old = scan_files(source_files.join(latest_accepted(validated), FILE, "left"))
    old = old.withColumnsRenamed({"findings": "old_findings", "syntax_issues": "old_issues", "text": "old_text"})
    # A null text has no findings and is not parsed.
    new = scan_files(old.withColumn("text", F.col("new_text")))
    kept = F.col("new_text").isNull()
    return new.withColumns(
        {
            "text": F.coalesce("new_text", "old_text"),
            "findings": F.when(kept, F.col("old_findings")).otherwise(F.col("findings")),
            "syntax_issues": F.when(kept, F.col("old_issues")).otherwise(F.col("syntax_issues")),
        }
    ).select(*source_files.columns, "old_findings", "findings", "syntax_issues")


def final_gate(file_gate: DataFrame, verified: DataFrame, grain: str = "corpus") -> DataFrame:
    """The gate after patching: untouched files as scanned before, others as verified.

    ``file_gate`` is the gate at file grain before patching. Counts of both are
    put together by file, so no file is scanned again and texts stay where
    they are. ``patch_exit_code`` is 1 only if findings remain; syntax issues
    alone block deployment but leave it 0.
    """
    counts = ["n_findings", "n_syntax"]
    old = file_gate.select(*FILE, F.struct(F.lit(0).alias("round"), *counts).alias("state"))
    new = verified.select(
        *FILE,
        F.struct(
            F.lit(1).alias("round"), F.col("n_after").cast("long").alias("n_findings"), F.col("n_syntax").cast("long").alias("n_syntax")
        ).alias("state"),
    )
    latest = old.unionByName(new).groupBy(*FILE).agg(F.max("state").alias("state")).select(*FILE, "state.*")
    return verdicts(latest, grain).withColumn("patch_exit_code", F.when(F.col("n_findings") > 0, 1).otherwise(0))


def _tools_used() -> Column:
    return F.when(F.count("*") == 0, "none").otherwise(F.array_join(F.array_sort(F.collect_set("tool")), ","))


def patch_result(file_gate: DataFrame, verified: DataFrame) -> DataFrame:
    """One row on the whole round, with the names of the tools that answered; ``none`` without candidates."""
    done = verified.agg(
        F.count_if(F.col("status") == "patched").alias("n_patched"), _tools_used().alias("ai_used")
    )
    parts = done.unionByName(final_gate(file_gate, verified), allowMissingColumns=True)
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))


# Differences of texts


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose text differs between two versions, with both texts."""
    old = before.select(*FILE, universal_newlines(F.col("text")).alias("old_text"))
    new = after.select(*FILE, universal_newlines(F.col("text")).alias("new_text"))
    return old.join(new, FILE).where(~F.col("old_text").eqNullSafe(F.col("new_text")))


def line_delta(changed: DataFrame) -> DataFrame:
    """Removed and added lines of changed files, with multiplicity and line number.

    ``changed`` comes from ``changed_files`` or ``text_pairs``.

    Equal lines are paired by occurrence within their file; what has no
    partner was removed or added. Lines of a file are grouped by (path, line),
    which is within one file.
    """

    def lines(text: str, side: str):
        return F.transform(
            F.when(F.length(text) > 0, lines_of(F.col(text))).otherwise(F.array().cast("array<string>")),
            lambda line, i: F.struct(F.lit(side).alias("side"), (i + 1).alias("line_no"), line.alias("line")),
        )

    both = changed.select(
        *FILE, F.inline(F.concat(lines("old_text", "-"), lines("new_text", "+")))
    )
    cols = [*FILE, "line"]
    order = Window.partitionBy(*cols, "side").orderBy("line_no")
    numbered = both.repartition(*cols).withColumn("occurrence", F.row_number().over(order))
    paired = numbered.groupBy(*cols, "occurrence").agg(
        F.count("*").alias("n"), F.min("side").alias("side"), F.min("line_no").alias("line_no")
    )
    return paired.where(F.col("n") == 1).select(*FILE, "side", "line_no", "line")


def delta_text(delta: DataFrame) -> DataFrame:
    """The delta of each file as one text, in line order, removed before added.

    It holds changed lines of one file only, so it is no longer than its two texts.
    """
    row = F.struct("line_no", (F.col("side") == "+").alias("added"), F.concat("side", "line").alias("text"))
    ordered = F.array_sort(F.collect_list(row))
    return delta.groupBy(*FILE).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("diff"))


# Suppression


#: What may follow the marker: a rule id of any case with digits, and a reason up to the next comment.
_IGNORED = r"\b{marker}:\s*ignore\s+([A-Za-z0-9_]+)(?:\s+((?:(?!\b{marker}:\s*ignore\s).)*))?"


def suppress(findings: DataFrame, marker: str = "scan") -> tuple[DataFrame, DataFrame]:
    """Split findings into those kept and those ignored by a comment on their line.

    The comment reads ``scan: ignore RULE_ID reason``; a line may have several.
    The snippet is the line, so no join is needed. A finding without a snippet
    is kept. The second table keeps the reason for audits.
    """
    pattern = F.lit(_IGNORED.format(marker=marker))
    rules = F.regexp_extract_all("snippet", pattern, F.lit(1))
    reasons = F.regexp_extract_all("snippet", pattern, F.lit(2))
    comments = F.arrays_zip(rules.alias("rule"), reasons.alias("reason"))
    own = F.filter(comments, lambda c: canonical_rule_id(c["rule"]) == F.col("rule_id"))
    ignored = F.coalesce(F.size(own) > 0, F.lit(False))
    reason = F.trim(F.regexp_replace(F.get(own, F.lit(0))["reason"], r"[\s#/;,]+$", ""))
    audit = findings.where(ignored).withColumn("reason", reason)
    return findings.where(~ignored), audit
