"""The registered queries: each runs operators of this package on the given tables.

Most run on the corpus derived from ``part`` (one file a row); ``documents``,
``pages``, ``conversations`` and ``orders`` serve where their shape fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.fixed_rules import IMPORTANCE, RULE_IDS
from scanloom.functions.syntax import register_py_fact_rows, register_py_facts
from scanloom.functions.text import extract_code, lines_of, redact
from scanloom.operators import content, delta, evaluate, gate, owners, patch, ranking, report, rule_index, rules, scan, suppressions
from scanloom.plans import corpus as made
from scanloom.plans.labels import attempts, manifest, safe_candidates
from scanloom.sources.tables import from_table, shared_folder, stored
from scanloom.sources.tree import read_tree, stream_tree, write_tree
from scanloom.streaming import state, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    return made.corpus(made.spread(table(spark, folder, "part"), "p_partkey", "p_brand"), "p_partkey", F.col("p_brand"))


def scanned_parts(spark: SparkSession, folder: str) -> DataFrame:
    return scan.scan_files(part_files(spark, folder))


def part_findings(spark: SparkSession, folder: str) -> DataFrame:
    return scan.findings(scanned_parts(spark, folder))


#: Own rules: id, language, pattern, severity, description. The last one has no hits.
OWN_RULES = (
    ("IMPORTS_RANDOM", "python", r"^import random$", "low", "imports the module random"),
    ("NO_VAR_LET", "typescript", r"\blet\s", "high", "declares by let"),
    ("USES_CONST", "javascript", r"^const\s"),
    ("NO_GOTO", "python", r"\bgoto\s", "critical", "jumps"),
)
ALL_RULE_IDS = (*RULE_IDS, *(rule[0] for rule in OWN_RULES))
NOT_PLAIN = r"[\x00-\x09\x0B-\x1F\x22\x2A\x5C\x7F-\x{10FFFF}]"

SECRETS = ("NO_HARDCODED_SECRETS",)


def secrets_alone(files: DataFrame) -> DataFrame:
    return scan.scan_files(files, rule_ids=SECRETS, issues=False)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as Python text: only whole lines that assign a secret count."""
    return from_table(table(spark, folder, "documents"), "doc_id", "text", language="python", repo="lang")


# Texts


@query
def documents_secrets_by_lang(spark, folder):
    scanned = secrets_alone(document_files(spark, folder))
    secrets = F.col("findings")
    return scanned.groupBy(F.col("repo").alias("lang")).agg(
        F.count("*").alias("n_files"),
        F.sum(F.size(secrets)).alias("n_secrets"),
        F.count_if(F.size(secrets) > 0).alias("n_files_with_secrets"),
    )


@query
def documents_secret_lines(spark, folder):
    found = scan.findings(secrets_alone(document_files(spark, folder)))
    return found.select(
        F.col("path").cast("long").alias("doc_id"), "line", "snippet"
    )


@query
def documents_redacted(spark, folder):
    return table(spark, folder, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


@query
def pages_script_lines(spark, folder):
    scripts = table(spark, folder, "pages").select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1))).alias("at", "code"),
    )
    path = F.concat(F.lit("page/"), F.col("page_id"), F.lit("/"), F.col("at"), F.lit(".js"))
    return scan.split_lines(from_table(scripts, path, "code")).select("path", "language", "line_no", "line")


@query
def pages_secret_lines(spark, folder):
    pages = table(spark, folder, "pages").withColumn("text", F.replace("html", F.lit("&quot;"), F.lit('"')))
    found = scan.findings(secrets_alone(from_table(pages, "page_id", "text", language="python", repo="url")))
    return found.groupBy(F.col("path").cast("long").alias("page_id")).agg(F.count("*").alias("n_secrets"))


@query
def conversations_code(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", extract_code(F.col("text")).alias("code"))


@query
def conversations_fenced_code(spark, folder):
    """Each turn's own text as the longer of two fenced blocks of a response."""
    turns = table(spark, folder, "conversations")
    fence = F.lit("```")
    own = F.replace(F.coalesce("text", F.lit("")), fence, F.lit("''"))
    text = F.concat(F.lit("see\n"), fence, F.lit("py\n"), fence, F.lit("\nor\n"), fence, F.lit("\n"), own, F.lit("\n"), fence, F.lit("\n"))
    return turns.select("conv_id", "turn", extract_code(text).alias("code"))


@query
def corpus_lines(spark, folder):
    return scan.split_lines(part_files(spark, folder)).select("path", "line_no", "line")


@query
def corpus_language_counts(spark, folder):
    return part_files(spark, folder).groupBy("language").agg(
        F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars")
    )


# Rules


def _rule_query(name: str, rule_id: str, languages: tuple[str, ...]) -> None:
    def run(spark, folder):
        found = scan.rule_findings(part_files(spark, folder), rule_id, *languages)
        return found.select("path", "line", "snippet")

    run.__name__ = name
    query(run)


RULE_QUERIES = {
    "secrets": "NO_HARDCODED_SECRETS",
    "network": "NO_NETWORK",
    "exec": "NO_EXEC",
    "sql": "SQL_PARAM_BINDING",
    "debug": "NO_DEBUG_MODE",
    "random": "NO_WEAK_RANDOM",
}
for _short, _rule in RULE_QUERIES.items():
    _rule_query(f"js_{_short}", _rule, ("javascript", "typescript"))
    _rule_query(f"py_{_short}", _rule, ("python",))
_rule_query("js_empty_catch", "NO_BARE_EXCEPT", ("javascript", "typescript"))
_rule_query("py_except", "NO_BARE_EXCEPT", ("python",))


@query
def py_syntax(spark, folder):
    return scan.syntax_issues(scanned_parts(spark, folder)).select("path", "line")


@query
def py_fact_handlers(spark, folder):
    """Exception handlers by the SQL function."""
    register_py_facts(spark)
    files = part_files(spark, folder).where(F.col("language") == "python")
    facts = spark.sql(
        "SELECT files.path, f.lineno AS line, f.kind FROM {files} AS files, LATERAL inline(py_facts(files.text)) AS f",
        files=files,
    )
    return facts.where(F.col("kind") == "handler").select("path", "line")


@query
def py_fact_assignments(spark, folder):
    facts = scan.py_facts(part_files(spark, folder))
    return facts.where(F.col("kind") == "assign").select("path", F.col("lineno").alias("line"), F.array_join("names", ",").alias("names"))


@query
def provider_keys(spark, folder):
    """Provider tokens, put together from keys so that none stands in this file."""
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    kind = F.col("p_partkey") % 6
    token = (
        F.when(kind == 0, F.concat(F.lit("sk-"), F.repeat(F.lit("a1"), 8), key))
        .when(kind == 1, F.concat(F.lit("ghp_"), F.repeat(F.lit("b2"), 15), key))
        .when(kind == 2, F.concat(F.lit("AKIA"), F.repeat(F.lit("C"), 10), key))
        .when(kind == 3, F.concat(F.lit("eyJ"), key, F.lit("abcd."), key, F.lit("efgh."), key, F.lit("ijkl")))
        .when(kind == 4, F.concat(F.lit("sk-"), F.repeat(F.lit("sample"), 4), key))
        .otherwise(F.concat(F.lit("-----BEGIN RSA PRIV"), F.lit("ATE KEY-----")))
    )
    ending = F.when(F.col("p_partkey") % 4 < 2, ".py").otherwise(".ts")
    files = from_table(
        table(spark, folder, "part"),
        F.concat(F.lit("keys/"), F.col("p_partkey"), ending),
        F.concat(F.lit("x = '"), token, F.lit("'\n")),
        repo="p_brand",
    )
    return scan.findings(secrets_alone(files)).select("path", "rule_id", "line")


@query
def custom_rule_hits(spark, folder):
    found = scan.findings(scan.scan_files(part_files(spark, folder), OWN_RULES))
    return found.where(F.col("pass") == scan.CUSTOM_PASS).select("path", "rule_id", "line", "snippet")


@query
def custom_rule_report(spark, folder):
    """Findings of own rules with the severity and description given with the rule."""
    found = scan.findings(scan.scan_files(part_files(spark, folder), OWN_RULES)).where(F.col("pass") == scan.CUSTOM_PASS)
    told = rules.with_rules(found, rules.rules_with_own(spark, OWN_RULES))
    return told.groupBy("rule_id", "severity", "explanation").agg(F.count("*").alias("n_findings"))


def documents_inside(spark: SparkSession, folder: str, before: str, after: str, ending: str) -> DataFrame:
    """Whole documents inside source files. Characters that would end a literal or a line become underscores."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), NOT_PLAIN, "_")
    text = F.concat(F.lit(before), plain, F.lit(after))
    return from_table(table(spark, folder, "documents").withColumn("text", text), F.concat("doc_id", F.lit(ending)), "text", repo="lang")


@query
def documents_as_python(spark, folder):
    files = documents_inside(spark, folder, made.PY_BEFORE, made.PY_AFTER, ".py")
    return scan.findings(scan.scan_files(files)).select("path", "rule_id", "line", "snippet")


@query
def documents_as_scripts(spark, folder):
    files = documents_inside(spark, folder, made.JS_BEFORE, made.JS_AFTER, ".js")
    return scan.findings(scan.scan_files(files, languages=("javascript",), issues=False)).select("path", "rule_id", "line", "snippet")


@query
def documents_decoded(spark, folder):
    """Texts given as bytes, with one byte at the end that is no UTF-8."""
    raw = table(spark, folder, "documents").withColumn("raw", F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    return from_table(raw, "doc_id", "raw").select(F.col("path").cast("long").alias("doc_id"), "text")


@query
def unreadable_files(spark, folder):
    """Every fifth file cannot be read: an issue of its own, in place of what it holds."""
    gone = F.col("key") % 5 == 0
    files = part_files(spark, folder).withColumns(
        {"text": F.when(~gone, F.col("text")), "error": F.when(gone, "no permission")}
    )
    scanned = scan.scan_files(files)
    issues = scanned.select("path", F.size("findings").alias("n_findings"), F.inline("syntax_issues"))
    return issues.select("path", "n_findings", "line", F.when(F.col("line") == 0, F.col("message")).alias("message"))


# Findings, gate, summaries


@query
def findings_all(spark, folder):
    return part_findings(spark, folder).select("repo", "path", "rule_id", "line", "col", "snippet", "pass", "seq")


@query
def findings_with_rule(spark, folder):
    rows = rules.with_rules(part_findings(spark, folder), rules.default_rules(spark))
    return rows.select("path", "seq", "line", "rule_name", "severity", "explanation")


@query
def findings_with_guidance(spark, folder):
    rows = rules.with_guidance(part_findings(spark, folder), rules.default_rules(spark))
    return rows.select("path", "seq", "guidance", "why", "fix")


@query
def findings_by_alias(spark, folder):
    """Findings named by an alias are counted under the rule it stands for."""
    found = part_findings(spark, folder)
    aliased = found.withColumn(
        "rule_id",
        F.when(F.col("rule_id") == "NO_EXEC", "COMMAND_INJECTION")
        .when(F.col("rule_id") == "SQL_PARAM_BINDING", "SQL_INJECTION")
        .otherwise(F.col("rule_id")),
    )
    return rules.with_canonical_rule(aliased).groupBy("rule_id").agg(F.count("*").alias("n_findings"))


@query
def gate_by_file(spark, folder):
    return gate.gate(scanned_parts(spark, folder), "file")


@query
def gate_by_repo(spark, folder):
    return gate.gate(scanned_parts(spark, folder), "repo")


@query
def gate_from_tables(spark, folder):
    """The same from the tables of files, findings and syntax issues."""
    files = part_files(spark, folder)
    scanned = scan.scan_files(files)
    return gate.gate_from_tables(files, scan.findings(scanned), scan.syntax_issues(scanned), grain="repo")


@query
def gate_corpus(spark, folder):
    return gate.gate(scanned_parts(spark, folder))


@query
def scan_counts(spark, folder):
    """The gate of the whole corpus, with the number of rules it keeps: own ones among them."""
    return gate.scan_counts(scan.scan_files(part_files(spark, folder), OWN_RULES), ALL_RULE_IDS)


@query
def orders_gate_by_repo(spark, folder):
    """A larger corpus, with one file an order."""
    orders = made.spread(table(spark, folder, "orders"), "o_orderkey", "o_orderpriority")
    files = made.corpus(orders, "o_orderkey", F.col("o_orderpriority"))
    return gate.gate(scan.scan_files(files), "repo")


@query
def summary_rollup(spark, folder):
    counted = gate.summary(part_findings(spark, folder), rules.default_rules(spark))
    return counted.select(
        F.coalesce("severity", F.lit("all")).alias("severity"),
        F.coalesce("rule_id", F.lit("all")).alias("rule_id"),
        "n_findings",
        F.when(F.col("severity").isNull(), 0).otherwise(gate.severity_rank(F.col("severity"))).alias("severity_rank"),
    )


@query
def summary_by_language(spark, folder):
    return gate.summary_by_language(part_findings(spark, folder))


@query
def files_with_findings(spark, folder):
    return gate.files_with_findings(scanned_parts(spark, folder)).select("repo", "path", "language")


@query
def findings_by_file(spark, folder):
    listed = F.transform("findings", lambda f: F.concat(f["rule_id"], F.lit(":"), f["line"]))
    return gate.by_file(scanned_parts(spark, folder)).select(
        "path", "n_findings", F.array_join(listed, " ").alias("listed")
    )


@query
def failed_rules(spark, folder):
    return rules.failed_rules(part_findings(spark, folder))


@query
def clean_rules(spark, folder):
    """Rules, own ones among them, that no file breaks."""
    found = scan.findings(scan.scan_files(part_files(spark, folder), OWN_RULES))
    return rules.clean_rules(rules.rules_with_own(spark, OWN_RULES), found).select("rule_id", "severity")


# Reports


@query
def report_lines(spark, folder):
    return report.report_lines(part_findings(spark, folder), rules.default_rules(spark))


@query
def report_rows(spark, folder):
    return report.report(part_findings(spark, folder), rules.default_rules(spark)).select(
        "path", "seq", "severity_rank", "badge", "rule_name", "location", "snippet"
    )


@query
def report_verdicts(spark, folder):
    lines = report.verdict_lines(gate.gate(scanned_parts(spark, folder), "repo"))
    return lines.select("repo", "text")


@query
def report_issues(spark, folder):
    lines = report.issue_lines(scan.syntax_issues(scanned_parts(spark, folder)))
    return lines.select("path", F.regexp_extract("text", r"^⚠ syntax error  \S+", 0).alias("text"))


@query
def report_json(spark, folder):
    docs = report.scan_json(scanned_parts(spark, folder), redact=True)

    def field(name):
        return F.get_json_object("json", f"$.{name}")

    return docs.select(
        field("file").alias("file"),
        field("deployable").alias("deployable"),
        field("fail_count").cast("int").alias("fail_count"),
        field("violations[0].rule_name").alias("first_rule"),
        field("violations[0].code_snippet").alias("first_snippet"),
        field("syntax_errors[0].line").cast("string").alias("syntax_line"),
    )


# Evaluation: every file lies in two repositories under the same path


def scanned_twice(spark: SparkSession, folder: str) -> DataFrame:
    return scan.scan_files(made.mirrored(part_files(spark, folder)))


def findings_twice(spark: SparkSession, folder: str) -> DataFrame:
    return scan.findings(scanned_twice(spark, folder))


@query
def published_counts(spark, folder):
    """Findings of generated files as they would be published, counted a file."""
    shown = F.transform("findings", lambda f: F.struct(f["rule_id"].alias("rule"), f["line"].alias("line"), f["snippet"].alias("snippet")))
    limits = F.transform("syntax_issues", lambda i: F.struct(F.lit("NO_EXEC").alias("rule"), i["line"].alias("line"), i["message"].alias("reason")))
    results = scanned_parts(spark, folder).select(
        F.col("path").alias("file"), "language", F.size(lines_of(F.col("text"))).alias("total_lines"),
        shown.alias("violations_detected"), limits.alias("known_limitations"),
    )
    return evaluate.ai_result_counts(results)


@query
def evaluate_file(spark, folder):
    return evaluate.evaluate_files(gate.gate(scanned_twice(spark, folder), "file"), manifest(spark, folder))


@query
def evaluate_case(spark, folder):
    return evaluate.evaluate_cases(findings_twice(spark, folder), manifest(spark, folder))


@query
def evaluate_lines(spark, folder):
    lines = evaluate.match_lines(findings_twice(spark, folder), manifest(spark, folder))
    return lines.groupBy("rule_id", "outcome").agg(F.count("*").alias("n_lines"), F.sum("n_found").alias("n_found"))


@query
def rule_quality(spark, folder):
    rows = evaluate.rule_quality(findings_twice(spark, folder), manifest(spark, folder))
    return rows.select("rule_id", "tp", "fn", "fp", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


@query
def blind_spots(spark, folder):
    return evaluate.blind_spots(findings_twice(spark, folder), manifest(spark, folder))


@query
def sources_by_rule(spark, folder):
    return evaluate.sources_by_rule(manifest(spark, folder))


@query
def counterparts(spark, folder):
    return evaluate.counterparts(gate.gate(scanned_twice(spark, folder), "file"), manifest(spark, folder))


# Frequency and priority


@query
def rule_frequency(spark, folder):
    return ranking.rule_frequency(scanned_parts(spark, folder))


@query
def rule_priority(spark, folder):
    """Rules by importance and by how often they are broken in the corpus."""
    scores = rules.local_table(
        spark,
        [dict(zip(("rule_id", "importance", "freq_estimate", "excluded"), row)) for row in IMPORTANCE],
        made.SCORE_COLUMNS,
    )
    seen = ranking.rule_frequency(scanned_parts(spark, folder)).select("rule_id", F.col("n_findings").alias("n_found"))
    ranked = ranking.rule_priority(scores.join(seen, "rule_id", "left"))
    return ranking.chosen_rules(ranked).where("excluded IS NULL").select(
        "rule_id",
        F.round("frequency", 3).alias("frequency"),
        F.round("priority", 3).alias("priority"),
        "rank",
        "chosen",
    )


# Patching


@query
def first_pending(spark, folder):
    return patch.first_pending(scanned_parts(spark, folder)).select("path", "rule_id", "line", "snippet")


@query
def pending_after_attempts(spark, folder):
    rest = patch.next_pending(part_findings(spark, folder), attempts(spark, folder))
    return rest.select("path", "rule_id", "line", "snippet")


@query
def first_findings(spark, folder):
    """All findings with their turn in the file."""
    return patch.first_findings(part_findings(spark, folder)).select("path", "rule_id", "line", "turn")


@query
def prompt_rules(spark, folder):
    return patch.prompt_rules(part_findings(spark, folder)).select("path", "rule_id", "first_seq", "line")


@query
def patch_requests(spark, folder):
    return patch.patch_requests(scanned_parts(spark, folder)).select("path", "rule_id", "line", "prompt")


@query
def patch_requests_next_round(spark, folder):
    again = patch.patch_requests(scanned_parts(spark, folder), attempts(spark, folder))
    return again.select("path", "rule_id", "line", "prompt")


@query
def spent_files(spark, folder):
    return patch.spent_files(part_findings(spark, folder), attempts(spark, folder)).drop("repo")


@query
def second_round(spark, folder):
    """What is asked for after a first round: requests recorded, patches applied, changed files scanned again."""
    both = stored(patch.scan_versions(part_files(spark, folder), _validated(spark, folder)), "versions")
    before = both.drop("findings").withColumnRenamed("old_findings", "findings")
    tried = patch.record_attempts(patch.patch_requests(before))
    return patch.patch_requests(both.drop("old_findings"), tried).select("path", "rule_id", "line", "snippet")


@query
def patch_explanations(spark, folder):
    return patch.patch_explanations(part_findings(spark, folder)).select(
        "path", "rule_id", "line", "title", "summary", "guidance", "reference"
    )


def _validated(spark: SparkSession, folder: str) -> DataFrame:
    return patch.validate_candidates(patch.candidates(safe_candidates(spark, folder)))


@query
def validate_candidates(spark, folder):
    return _validated(spark, folder).select("path", "rule_id", "line", "accepted")


@query
def verify_patches(spark, folder):
    return patch.verify_patches(part_files(spark, folder), _validated(spark, folder)).drop("reason")


@query
def provenance(spark, folder):
    verified = patch.verify_patches(part_files(spark, folder), _validated(spark, folder))
    return patch.provenance(verified).groupBy("tool", "rule_id", "status", "deployable").agg(F.count("*").alias("n"))


def _sided(spark: SparkSession, folder: str) -> DataFrame:
    return patch.sided_findings(part_files(spark, folder), _validated(spark, folder))


@query
def finding_changes(spark, folder):
    changes = patch.changes(_sided(spark, folder))
    return changes.select("path", "rule_id", "occurrence", "change", F.coalesce("line_before", "line_after").alias("line"))


@query
def findings_fixed(spark, folder):
    return patch.bag_changes(_sided(spark, folder)).where("change = 'fixed'").select("path", "rule_id", "snippet")


@query
def findings_introduced_or_common(spark, folder):
    return patch.bag_changes(_sided(spark, folder)).where("change <> 'fixed'").select("path", "rule_id", "snippet", "change")


@query
def applied_files(spark, folder):
    return patch.apply_patches(part_files(spark, folder), _validated(spark, folder)).select("repo", "path", "text")


@query
def final_gate(spark, folder):
    files = part_files(spark, folder)
    verified = patch.verify_patches(files, _validated(spark, folder))
    return patch.final_gate(gate.gate(scan.scan_files(files), "file"), verified)


@query
def patch_result(spark, folder):
    files = part_files(spark, folder)
    verified = patch.verify_patches(files, _validated(spark, folder))
    return patch.patch_result(gate.gate(scan.scan_files(files), "file"), verified)


@query
def patch_result_clean(spark, folder):
    """The same for files without findings: no candidate is looked at, no tool was used."""
    verdicts = gate.gate(scanned_parts(spark, folder), "file").where("n_findings = 0")
    files = part_files(spark, folder).join(verdicts.select("repo", "path"), ["repo", "path"], "left_semi")
    return patch.patch_result(verdicts, patch.verify_patches(files, _validated(spark, folder)))


@query
def patch_progress(spark, folder):
    verified = patch.verify_patches(part_files(spark, folder), _validated(spark, folder))
    return report.progress_lines(verified.withColumn("reason", F.lit("rejected"))).select("path", "line", "text")


@query
def patch_json(spark, folder):
    files, checked = part_files(spark, folder), _validated(spark, folder)
    diffs = patch.delta_text(patch.line_delta(patch.text_pairs(files, checked)))
    docs = report.patch_json(patch.rescan(files, checked), diffs, patch.patch_explanations(part_findings(spark, folder)))

    def field(name):
        return F.get_json_object("json", f"$.{name}")

    return docs.select(
        "path",
        field("patched_files[0]").alias("patched"),
        F.get(F.map_values(F.from_json(field("diffs"), "map<string,string>")), F.lit(0)).alias("diff"),
        field("patch_explanations[0].title").alias("title"),
        field("remaining_violations[0].rule_name").alias("remains"),
        field("deployable").alias("deployable"),
        field("ai_used").alias("ai_used"),
    )


@query
def line_delta(spark, folder):
    pairs = patch.text_pairs(part_files(spark, folder), _validated(spark, folder))
    return patch.line_delta(pairs).select("path", "side", "line_no", "line")


@query
def line_delta_of_versions(spark, folder):
    """The same from two whole versions of the corpus."""
    files = part_files(spark, folder)
    pairs = patch.changed_files(files, patch.apply_patches(files, _validated(spark, folder)))
    return patch.line_delta(pairs).select("path", "side", "line_no", "line")


@query
def delta_text(spark, folder):
    pairs = patch.text_pairs(part_files(spark, folder), _validated(spark, folder))
    return patch.delta_text(patch.line_delta(pairs)).select("path", "diff")


@query
def patch_report(spark, folder):
    """The report of a round; findings and issues of the new version of the corpus remain. The corpus is scanned once."""
    files, checked = part_files(spark, folder), _validated(spark, folder)
    both = stored(patch.scan_versions(files, checked).drop("text"), "versions")
    before = both.drop("findings").withColumnRenamed("old_findings", "findings")
    lines = report.patch_report(
        patch.candidate_status(files, checked),
        patch.patch_explanations(scan.findings(before)),
        remaining=scan.findings(both),
        issues=scan.syntax_issues(both).withColumn("message", F.lit("cannot be parsed")),
        verdict=gate.gate(both),
    )
    return lines.select("path", "section", "line", "part", "text")


@query
def suppressed(spark, folder):
    """Debug switches with an ignore comment, kept apart with the reason given."""
    files = part_files(spark, folder).withColumn(
        "text", F.regexp_replace("text", r"(DEBUG = True  )# (\d+)", "$1# scan: ignore NO_EXEC other # scan: ignore NO_DEBUG_MODE ticket $2")
    )
    _, audit = patch.suppress(scan.findings(scan.scan_files(files)))
    return audit.select("path", "rule_id", "line", "reason")


@query
def kept_findings(spark, folder):
    files = part_files(spark, folder).withColumn(
        "text", F.regexp_replace("text", r"(DEBUG = True  )# (\d+)", "$1# scan: ignore NO_EXEC other # scan: ignore NO_DEBUG_MODE ticket $2")
    )
    kept, _ = patch.suppress(scan.findings(scan.scan_files(files)))
    return kept.groupBy("rule_id").agg(F.count("*").alias("n_findings"))


# Streams


def _order_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a stream of source files that arrive at their order date."""
    return made.corpus(_orders_stream(spark, folder), "o_orderkey", F.col("o_orderpriority"), F.col("arrived"))


def _orders_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of orders as they arrive, spread by hash before texts are made from them, as in ``corpus.spread``."""
    schema = table(spark, folder, "orders").schema
    # A pattern with this one name serves a single file and a folder of part files.
    orders = spark.readStream.schema(schema).parquet(f"{folder}/orders.parque[t]")
    # Order dates carry no time zone: they are taken as UTC.
    arrived = F.concat(F.col("o_orderdate").cast("string"), F.lit("Z")).cast("timestamp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return orders.select("o_orderkey", "o_orderpriority", arrived.alias("arrived")).repartition(tasks, "o_orderkey")


@query
def stream_findings(spark, folder):
    found = scan.findings(stream.scan_stream(_order_stream(spark, folder), issues=False))
    return stream.run_to_table(found, "stream-findings").select("path", "rule_id", "line")


@query
def stream_gate(spark, folder):
    gates = stream.run_gate(stream.scan_stream(_order_stream(spark, folder)), "stream-gate", "repo")
    return gates.groupBy("repo").agg(
        F.sum("n_files").alias("n_files"), F.sum("n_findings").alias("n_findings"), F.sum("n_syntax").alias("n_syntax"),
        F.bool_and("deployable").alias("deployable"), F.max("exit_code").alias("exit_code"),
    )


@query
def stream_windows(spark, folder):
    windows = stream.windowed_findings(_order_stream(spark, folder), "30 days", "10 days")
    return stream.run_windows(windows, "stream-windows").select(
        F.floor(F.unix_seconds("window_start") / 86400).cast("int").alias("window_day"), "rule_id", "n_findings"
    )


@query
def stream_dedup(spark, folder):
    """Every file arrives twice, in different tasks; one is kept."""
    twice = _order_stream(spark, folder).unionByName(_order_stream(spark, folder))
    arrived = stream.run_to_table(stream.new_arrivals(twice, "10 days"), "stream-dedup")
    return arrived.groupBy("language").agg(F.count("*").alias("n_files"))


@query
def stream_gate_latest(spark, folder):
    """Every order's file arrives, then all but a third again: as it was, emptied, or broken. The latest version counts."""
    orders = _orders_stream(spark, folder)
    first = made.corpus(orders, "o_orderkey", F.col("o_orderpriority"), F.col("arrived"))
    again = made.corpus(orders, "o_orderkey", F.col("o_orderpriority"), F.col("arrived") + F.expr("INTERVAL 1 DAY"))
    text = F.when(F.col("key") % 4 == 1, "").when(F.col("key") % 4 == 2, "x = (\n").otherwise(F.col("text"))
    arrived = first.unionByName(again.where(F.col("key") % 4 > 0).withColumn("text", text))
    return state.run_latest_counts(state.latest_counts(arrived), "stream-gate-latest", "repo")


# Trees


def _mounted(folder: str) -> str:
    """A shared folder as a path that every machine has mounted, which trees need."""
    return folder.removeprefix("file://").removeprefix("file:")


def _written_documents(spark: SparkSession, folder: str) -> str:
    root = _mounted(shared_folder(spark, "tree"))
    write_tree(documents_inside(spark, folder, made.PY_BEFORE, made.PY_AFTER, ".py"), root)
    return root


def _by_name(found: DataFrame) -> DataFrame:
    return found.select(F.substring_index("path", "/", -1).alias("path"), "rule_id", "line", "snippet")


@query
def tree_round_trip(spark, folder):
    """Whole documents written as a tree of files, read back and scanned."""
    return _by_name(scan.findings(scan.scan_files(read_tree(spark, _written_documents(spark, folder)), issues=False)))


@query
def stream_tree_findings(spark, folder):
    """The same tree as a stream."""
    files = stream_tree(spark, _written_documents(spark, folder), settle=0)
    return _by_name(stream.run_to_table(scan.findings(scan.scan_files(files, issues=False)), "stream-tree"))


# Many own rules


def part_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for each part, made from the words of its name, and two that no literal can be taken from."""
    key, word = F.col("p_partkey"), lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    pattern = (
        F.when(key == 1, r"^[0-9]+$")
        .when(key == 2, r"[0-9]{5}")
        .when(key % 4 == 0, F.concat(F.substring(word(1), 1, 4), F.lit("[a-z]* ")))
        .when(key % 4 == 1, F.concat(F.lit("(?i)"), word(2)))
        .when(key % 4 == 2, F.concat(word(1), F.lit(".*"), key % 10, F.lit("$")))
        .otherwise(F.concat(F.substring(word(2), 1, 3), F.lit("[a-z]*, ")))
    )
    language = F.when(key % 7 == 0, "javascript").otherwise("python")
    return table(spark, folder, "part").select(F.concat(F.lit("PART_"), key).alias("rule_id"), language.alias("language"), pattern.alias("pattern"))


@query
def many_own_rules(spark, folder):
    """As many own rules as there are parts, on the lines of documents."""
    return rule_index.indexed_rule_totals(document_files(spark, folder), part_rules(spark, folder))


# Syntax facts as a table function

#: Groups of files that the table function is called for; each comes to it in batches.
FACT_GROUPS = 4096


@query
def py_fact_rows(spark, folder):
    register_py_fact_rows(spark)
    files = part_files(spark, folder).where(F.col("language") == "python")
    # Files by hash: a group for each file would be a call and a batch for each, and Spark would join the small tasks.
    dealt = files.withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(FACT_GROUPS)))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "deal")
    facts = spark.sql("SELECT * FROM py_fact_rows(TABLE(SELECT repo, path, text, deal FROM {files}) PARTITION BY deal)", files=dealt)
    return facts.where("kind IN ('handler', 'assign')").select("path", "kind", F.col("lineno").alias("line"))


# Contents


def _scanned_again(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Documents scanned by content, and again when a tenth of them has a line more."""
    files = documents_inside(spark, folder, made.PY_BEFORE, made.PY_AFTER, ".py")
    store = shared_folder(spark, "store")
    content.scan_contents(files, store, "1", "first")
    tenth = F.split_part("path", F.lit("."), F.lit(1)).cast("long") % 10 == 0
    changed = files.withColumn("text", F.when(tenth, F.concat("text", F.lit("DEBUG = True\n"))).otherwise(F.col("text")))
    return content.scan_contents(changed, store, "1", "second"), store


@query
def content_scan(spark, folder):
    return scan.findings(_scanned_again(spark, folder)[0]).select("path", "rule_id", "line", "snippet")


@query
def content_scan_runs(spark, folder):
    """How many contents each of the two scans had to parse."""
    return content.scanned_by_run(spark, _scanned_again(spark, folder)[1]).select("run", "n_scanned")


# Ordered deltas

HUNK_LINES = 12


def _edited_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A text of numbered lines for each part, and the same with a line edited, moved, repeated, or both ends edited."""
    key = F.col("p_partkey")
    old = F.transform(F.sequence(F.lit(1), F.lit(HUNK_LINES)), lambda i: F.concat(F.lit("line "), i, F.lit(" of "), key))
    some = lambda low, high: F.slice("old", low, high - low + 1)
    other = F.array(F.concat(F.lit("edited "), key))
    new = (
        F.when(key % 4 == 0, F.concat(some(1, 5), other, some(7, 12)))
        .when(key % 4 == 1, F.concat(some(1, 1), some(3, 10), some(2, 2), some(11, 12)))
        .when(key % 4 == 2, F.concat(some(1, 4), some(4, 12)))
        .otherwise(F.concat(other, some(2, 11), other))
    )
    parts = made.spread(table(spark, folder, "part"), "p_partkey", "p_brand").withColumn("old", old)
    return parts.select(
        F.col("p_brand").alias("repo"), key.cast("string").alias("path"), F.array_join("old", "\n").alias("old_text"), F.array_join(new, "\n").alias("new_text")
    )


@query
def line_hunks(spark, folder):
    shown = delta.hunks(delta.line_script(_edited_parts(spark, folder)))
    return shown.select("path", "hunk", "mark", "old_no", "new_no", "line")


@query
def line_hunk_headers(spark, folder):
    shown = delta.hunks(delta.line_script(_edited_parts(spark, folder)))
    return delta.hunk_headers(shown).select("path", "hunk", "header")


@query
def line_script_texts(spark, folder):
    """Whole documents with a line moved to the end and one put in front: both texts from the script alone."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = table(spark, folder, "documents").select(F.lit("").alias("repo"), F.col("doc_id").cast("string").alias("path"), lines.alias("lines"))
    n = F.pmod(F.col("path").cast("int"), F.size("lines")) + 1
    new = F.concat(F.array(F.lit("first")), F.slice("lines", 1, n - 1), F.slice("lines", n + 1, F.size("lines")), F.slice("lines", n, 1))
    end = lambda lines: F.concat(F.array_join(lines, "\n"), F.lit("\nend"))
    changed = docs.select("repo", "path", F.replace(end(F.col("lines")), F.lit("\r"), F.lit("")).alias("old_text"), F.replace(end(new), F.lit("\r"), F.lit("")).alias("new_text"))
    text = lambda mark: F.sha2(delta.script_text(F.col("script"), mark), 256)
    return delta.line_scripts(changed).select(F.col("path").cast("long").alias("doc_id"), text("-").alias("old_sha256"), text("+").alias("new_sha256"))


# Mergeable frequencies


@query
def frequency_estimates(spark, folder):
    """Sketches made by source and language, merged, against exact counts: close where within 5 in a hundred."""
    scanned = scanned_parts(spark, folder)
    sketches = ranking.frequency_sketches(scanned.withColumn("source", F.col("key") % 3), "source", "language")
    merged = ranking.estimated_frequency(ranking.merged_sketches(ranking.merged_sketches(sketches, "source")))
    both = ranking.rule_frequency(scanned).alias("e").join(merged.alias("m"), "rule_id", "left")

    def close(name: str):
        exact, guess = F.col(f"e.{name}"), F.coalesce(f"m.{name}", F.lit(0))
        return (F.abs(guess - exact) <= F.lit(0.05) * exact + F.lit(0.5)).alias(f"{name}_close")

    return both.select(
        "rule_id", F.coalesce("m.n_findings", F.lit(0)).alias("n_findings"), F.col("e.n_files").alias("n_files"),
        F.col("e.n_repos_hit").alias("n_repos_hit"), close("n_files"), close("n_repos_hit"),
    )


@query
def rule_importance(spark, folder):
    """The weighted sum of five scores, one row a part."""
    score = lambda n: (F.col("p_partkey") % n % 5 + 1).cast("double")
    scores = table(spark, folder, "part").select("p_partkey", *(score(n).alias(name) for name, n in {"a": 7, "d": 11, "s": 13, "e": 17, "m": 19}.items()))
    return scores.select("p_partkey", F.round(ranking.importance("a", "d", "s", "e", "m"), 6).alias("importance"))


# Owners and suppressions


@query
def file_owners(spark, folder):
    """Roots from folders, brands and some files; the deepest owns a path."""
    files = part_files(spark, folder).withColumn("t", F.col("key") % made.N_TEMPLATES)
    none = F.lit(None).cast("string")
    root = lambda path, owner, repo=none: files.select(path.alias("root"), owner.alias("owner"), repo.alias("repo"))
    place = F.concat(F.lit("src/t"), F.col("t"))
    roots = root(F.lit("src/"), F.lit("platform")).unionByName(root(F.lit("src/t"), F.lit("nobody")))
    roots = roots.unionByName(root(place, F.concat(F.lit("team "), F.col("t") % 5)).where("t < 20"))
    roots = roots.unionByName(root(place, F.col("repo"), F.col("repo")).where("t = 3"))
    roots = roots.unionByName(root(F.col("path"), F.lit("file")).where("key % 10 = 0")).distinct()
    return owners.owned(files, roots).select("path", "root", "owner")


@query
def suppression_table(spark, folder):
    """Findings of dated files against entries for a year, until a day, and for some of the files without end."""
    orders = table(spark, folder, "orders")
    when = F.concat(F.col("o_orderdate").cast("string"), F.lit("Z")).cast("timestamp")
    dated = orders.select("o_orderkey", "o_orderpriority", when.alias("at")).repartition("o_orderkey")
    files = made.corpus(dated, "o_orderkey", F.col("o_orderpriority"), F.col("at"))
    scanned = scan.scan_files(files)
    found = scanned.select("repo", "path", "mtime", F.inline("findings"))
    t = F.col("o_orderkey") % made.N_TEMPLATES
    day = lambda d: F.lit(d and f"{d} 00:00:00Z").cast("timestamp")

    def entry(name, rule, ending, low, high):
        return orders.select(
            F.concat(F.lit(f"{name}-"), t).alias("entry_id"), F.lit(rule).alias("rule_id"), F.concat(F.lit("src/t"), t, F.lit(ending)).alias("path_pattern"),
            day(low).alias("valid_from"), day(high).alias("valid_to"), F.lit(name).alias("reason"),
        ).distinct()

    entries = entry("year", "*", "/", "1995-01-01", "1996-01-01").unionByName(entry("until", "NO_EXEC", "/f*", None, "1994-07-01"))
    entries = entries.unionByName(entry("fives", "NO_DEBUG_MODE", "/f*5.**", "1993-01-01", None))
    rows = suppressions.judged(found, entries)
    return rows.select("path", "rule_id", "line", "status", "entry_id", "reason")
