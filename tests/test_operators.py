import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanloom.operators import evaluate, gate, patch, ranking, report, rules, scan
from scanloom.functions.fixed_rules import IMPORTANCE, RULE_IDS
from scanloom.plans.corpus import SCORE_COLUMNS
from scanloom.sources import tables

SECRET = 'token = "abcd99"\n'


@pytest.fixture(scope="module")
def scanned(files):
    one = files({"a.py": SECRET + "DEBUG = True\n", "b.py": "x = 1\n", "c.py": "if x ==:\n"}, "one")
    two = files({"d.js": "exec('x')\nexec('y')\n", "e.ts": "let a;\n"}, "two")
    return scan.scan_files(one.unionByName(two))


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_gate_at_every_grain(scanned):
    assert rows(gate.gate(scanned, "file").drop("exit_code"), "path") == [
        ("one", "a.py", 2, 0, False), ("one", "b.py", 0, 0, True), ("one", "c.py", 0, 1, False),
        ("two", "d.js", 2, 0, False), ("two", "e.ts", 0, 0, True),
    ]
    assert rows(gate.gate(scanned, "repo"), "repo") == [("one", 3, 2, 1, False, 1), ("two", 2, 2, 0, False, 1)]
    assert rows(gate.gate(scanned), "n_files") == [(5, 4, 1, False, 1)]
    with pytest.raises(ValueError):
        gate.gate(scanned, "folder")


def test_empty_corpus_is_deployable(scanned):
    nothing = scanned.where(F.lit(False))
    assert rows(gate.gate(nothing), "n_files") == [(0, 0, 0, True, 0)]
    assert rows(gate.scan_counts(nothing), "n_files") == [(0, 0, 7, 0, True, 0)]
    assert report.verdict_lines(gate.gate(nothing)).first().notice == "No supported source files found"


def test_counts_lists_and_summaries(spark, scanned):
    found, default = scan.findings(scanned), rules.default_rules(spark)
    assert rows(gate.scan_counts(scanned), "n_files") == [(5, 4, 4, 1, False, 1)]
    assert gate.scan_counts(scanned, ("NO_EXEC", "OWN")).first().pass_count == 1
    assert rows(rules.failed_rules(found), "rule_id") == [("NO_DEBUG_MODE", 1), ("NO_EXEC", 2), ("NO_HARDCODED_SECRETS", 1)]
    assert rules.clean_rules(default, found).count() == 4
    assert [r.n_findings for r in gate.by_file(scanned).orderBy("path").collect()] == [2, 2]
    assert [r.path for r in gate.files_with_findings(scanned).orderBy("path").collect()] == ["a.py", "d.js"]
    total = gate.summary(found, default).where("severity IS NULL").first()
    assert total.n_findings == 4
    assert [r.rule_id for r in default.collect()] == list(RULE_IDS)
    assert rules.rule_aliases(spark).count() == 6


def test_report_masks_secrets_and_json_does_not(spark, scanned):
    found = scan.findings(scanned)
    lines = [r.text for r in report.report_lines(found, rules.default_rules(spark)).orderBy("path", "seq", "part").collect()]
    assert lines[0] == '✗  NO_HARDCODED_SECRETS   a.py:1    token = "***REDACTED***"'
    assert lines[1].startswith("   Putting a password") and lines[2].startswith("   → Use os.environ") and lines[3] == ""
    first = report.report(found, rules.default_rules(spark)).where("path = 'a.py' AND seq = 0").first()
    assert (first.badge, first.location) == ("● CRITICAL", "a.py:1")
    document = json.loads(report.scan_json(scanned).where("path = 'a.py'").first().json)
    assert document["violations"][0]["code_snippet"] == SECRET.strip() and document["deployable"] is False
    masked = json.loads(report.scan_json(scanned, redact=True).where("path = 'a.py'").first().json)
    assert "abcd99" not in json.dumps(masked)
    issue = report.issue_lines(scan.syntax_issues(scanned)).first().text
    assert issue.startswith("⚠ syntax error  c.py:1  ")


def test_unknown_rules_get_defaults(spark, files):
    found = scan.findings(scan.scan_files(files({"a.py": "print(1)\n"}), (("OWN", "python", "print"),)))
    default = rules.default_rules(spark)
    assert rules.with_rules(found, default).first().severity == "medium"
    assert rules.with_guidance(found, default).first().guidance == "Replace the violation with a safe alternative."
    told = patch.patch_explanations(found).first()
    assert (told.rule_id, told.title) == ("OWN", "Replaced security violation with a safe implementation")


def test_priorities_are_the_published_ones(spark):
    counts = {"NO_HARDCODED_SECRETS": 1552, "NO_EXEC": 913, "SQL_PARAM_BINDING": 1564, "NO_NETWORK": 125, "NO_DEBUG_MODE": 168,
              "NO_WEAK_RANDOM": 133, "INSECURE_DESERIALIZATION": 31, "CORS_WILDCARD": 167, "INSECURE_COOKIE": 186}
    table = [dict(zip(("rule_id", "importance", "freq_estimate", "excluded"), r)) for r in IMPORTANCE]
    seen = spark.createDataFrame(list(counts.items()), "rule_id string, n_found long")
    ranked = ranking.rule_priority(rules.local_table(spark, table, SCORE_COLUMNS).join(seen, "rule_id", "left"))
    got = {r.rule_id: round(r.priority, 2) for r in ranked.collect()}
    assert got == {"NO_HARDCODED_SECRETS": 5.00, "NO_EXEC": 4.67, "SQL_PARAM_BINDING": 4.52, "NO_NETWORK": 3.53, "NO_DEBUG_MODE": 3.52,
                   "NO_WEAK_RANDOM": 3.46, "NO_BARE_EXCEPT": 3.00, "INSECURE_DESERIALIZATION": 3.45, "CORS_WILDCARD": 3.16,
                   "INSECURE_COOKIE": 2.98}
    ranks = ranking.chosen_rules(ranked).orderBy("rank").collect()
    assert len(ranks) == len(got) and all(r.chosen == (r.rank is not None and r.rank <= 7) for r in ranks)
    chosen = [r.rule_id for r in ranks if r.chosen]
    assert chosen == ["NO_HARDCODED_SECRETS", "NO_EXEC", "SQL_PARAM_BINDING", "NO_NETWORK", "NO_DEBUG_MODE", "NO_WEAK_RANDOM", "NO_BARE_EXCEPT"]
    scores = spark.createDataFrame([(5, 4, 3, 2, 1)], "a int, b int, c int, d int, e int")
    assert scores.select(ranking.importance("a", "b", "c", "d", "e")).first()[0] == pytest.approx(3.3)


def test_frequency_counts_files_and_repositories_once(scanned):
    got = {r.rule_id: tuple(r)[1:] for r in ranking.rule_frequency(scanned).collect()}
    assert got["NO_EXEC"] == (2, 1, 1, 50.0)
    assert got["NO_NETWORK"] == (0, 0, 0, 0.0)


def test_repositories_that_share_paths_are_kept_apart(spark, files):
    made = files({"a.js": "exec(1)\n"}, "one").unionByName(files({"a.js": "x\n", "f.js": "y\n"}, "two"))
    scanned = scan.scan_files(made)
    cases = [("one", "1", "vulnerable", "a.js", [1], 1, None), ("two", "2", "false_positive", "a.js", [], 0, "f.js")]
    expected = spark.createDataFrame(
        [(r, c, k, "javascript", "NO_EXEC", f, lines, n, fixed) for r, c, k, f, lines, n, fixed in cases],
        "repo string, case_id string, category string, language string, rule string, file string, expected_lines array<int>, expected_count int, fixed_file string",
    )
    found, verdicts = scan.findings(scanned), gate.gate(scanned, "file")
    by_case = {r.case_id: (r.repo, r.n_hit, r.n_found, r.count_agrees) for r in evaluate.evaluate_cases(found, expected).collect()}
    assert by_case == {"1": ("one", 1, 1, True), "2": ("two", 0, 0, True)}
    by_category = {r.category: (r.n_files, r.n_right) for r in evaluate.evaluate_files(verdicts, expected).collect()}
    assert by_category == {"vulnerable": (1, 1), "false_positive": (1, 1), "fixed": (1, 1)}
    assert [r.outcome for r in evaluate.match_lines(found, expected).collect()] == ["hit"]
    assert [(r.repo, r.file, r.fixed_deployable) for r in evaluate.counterparts(verdicts, expected).collect()] == [("two", "a.js", True)]


def test_manifest_and_evaluation(spark, files, tmp_path):
    cases = [
        {"case_id": "1", "category": "vulnerable", "rule": "NO_EXEC", "file": "v.js", "expected_lines": [1, 3], "expected_count": 2,
         "language": "javascript", "source_datasets": ["A", "B"], "fixed_file": "f.js"},
        {"case_id": "2", "category": "blind_spot", "rule": "NO_EXEC", "file": "b.js", "expected_lines": [1], "expected_count": 1,
         "language": "javascript", "source_datasets": ["A"], "blind_spot_reason": "why"},
        {"case_id": "3", "category": "false_positive", "rule": "NO_EXEC", "file": "p.js", "expected_lines": [], "expected_count": 0,
         "language": "javascript", "source_datasets": []},
        {"case_id": "4", "category": "vulnerable", "rule": "NO_EXEC", "file": "absent.js", "expected_lines": [1], "expected_count": 1,
         "language": "javascript", "source_datasets": ["B"]},
    ]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, cases)))
    expected = tables.read_manifest(spark, path)
    scanned = scan.scan_files(files({"v.js": "exec(1)\nexec(2)\n", "f.js": "x\n", "b.js": "a.exec(1)\n", "p.js": "execFile(1)\n"}))
    found, verdicts = scan.findings(scanned), gate.gate(scanned, "file")
    assert rows(evaluate.evaluate_files(verdicts, expected), "category") == [
        ("blind_spot", 1, 0, 1, 1), ("false_positive", 1, 0, 1, 1), ("fixed", 1, 0, 1, 1), ("vulnerable", 1, 1, 0, 1),
    ]
    by_case = {r.case_id: (r.n_hit, r.n_missed, r.n_found, r.count_agrees) for r in evaluate.evaluate_cases(found, expected).collect()}
    assert by_case == {"1": (1, 1, 2, True), "2": (0, 1, 0, False), "3": (0, 0, 0, True), "4": (0, 1, 0, False)}
    assert rows(evaluate.rule_quality(found, expected), "rule_id") == [("NO_EXEC", 1, 2, 1, 0.5, pytest.approx(1 / 3))]
    assert evaluate.blind_spots(found, expected).first().still_blind
    assert rows(evaluate.sources_by_rule(expected), "source_dataset") == [("NO_EXEC", "A", 2), ("NO_EXEC", "B", 2)]
    assert rows(evaluate.counterparts(verdicts, expected), "file") == [("v.js", "f.js", False, True)]


def test_published_results_of_generated_files(spark, tmp_path):
    path = tmp_path / "results.json"
    path.write_text(json.dumps([
        {"file": "a.py", "language": "python", "source": "s", "total_lines": 9,
         "violations_detected": [{"rule": "NO_EXEC", "line": 3, "snippet": "x"}], "known_limitations": []},
        {"file": "b.ts", "language": "typescript", "source": "s", "total_lines": 4, "violations_detected": [], "known_limitations": []},
    ], indent=1))
    results = tables.read_ai_results(spark, path)
    assert rows(evaluate.ai_result_counts(results), "file") == [("a.py", "python", 9, 1, 0), ("b.ts", "typescript", 4, 0, 0)]
    assert rows(evaluate.ai_result_lines(results), "file") == [("a.py", "NO_EXEC", 3, "x")]


def answers(spark, texts, tool="beta"):
    data = [("r", path, "NO_EXEC", 1, tool, text) for path, text in texts.items()]
    return spark.createDataFrame(data, "repo string, path string, rule_id string, line int, tool string, response string")


def test_a_round_of_patching(spark, files):
    before = files({
        "a.py": "import os\nos.system('a')\nos.system('a')\nDEBUG = True\n", "b.py": "os.system('b')\n", "c.js": "exec('c')\n", "d.py": "x = 1\n",
    })
    responses = answers(spark, {
        "a.py": "```python\nimport os\nos.system('a')\nDEBUG = False\nos.popen('z')\n```", "b.py": "```\nif x ==:\n```", "c.js": "exec('c')",
    })
    checked = patch.validate_candidates(patch.candidates(responses)).cache()
    assert {r.path: r.accepted for r in checked.collect()} == {"a.py": True, "b.py": False, "c.js": True}
    assert checked.where("path = 'b.py'").first().reason.startswith("Python syntax validation failed: ")

    verified = {r.path: r for r in patch.verify_patches(before, checked).collect()}
    a = verified["a.py"]
    assert (a.status, a.n_before, a.n_after, a.n_fixed, a.n_remaining, a.n_introduced) == ("patched", 3, 2, 2, 1, 1)
    assert (verified["b.py"].status, verified["b.py"].n_remaining) == ("error", 1)
    assert (verified["c.js"].status, verified["c.js"].deployable) == ("unchanged", False)
    assert patch.provenance(patch.verify_patches(before, checked)).count() == 3

    after = patch.rescan(before, checked)
    old = scan.findings(scan.scan_files(before))
    changes = patch.finding_changes(old.where("path = 'a.py'"), scan.findings(after).where("path = 'a.py'"))
    assert sorted((r.change, r.line_before, r.line_after) for r in changes.collect() if r.change != "fixed") == [
        ("introduced", None, 4), ("remaining", 2, 2),
    ]
    sided = patch.sided_findings(before, checked).where("path = 'a.py'")
    assert sorted(map(str, patch.changes(sided).collect())) == sorted(map(str, changes.collect()))
    assert Counter(r.change for r in patch.bag_changes(sided).collect()) == {"fixed": 2, "introduced": 1, "remaining": 1}
    fixed, introduced, common = patch.finding_difference(old.where("path = 'a.py'"), scan.findings(after).where("path = 'a.py'"))
    assert (fixed.count(), introduced.count(), common.count()) == (2, 1, 1)

    new = patch.apply_patches(before, checked)
    texts = {r.path: r.text for r in new.collect()}
    assert texts["b.py"] == "os.system('b')\n" and texts["d.py"] == "x = 1\n" and texts["a.py"].endswith("os.popen('z')\n")
    delta = patch.line_delta(patch.changed_files(before, new))
    assert delta.exceptAll(patch.line_delta(patch.text_pairs(before, checked))).count() == 0
    assert sorted(tuple(r) for r in delta.select("line_no", "side", "line").collect()) == [
        (3, "+", "DEBUG = False"), (3, "-", "os.system('a')"), (4, "+", "os.popen('z')"), (4, "-", "DEBUG = True"),
    ]
    assert patch.delta_text(delta).first().diff == "-os.system('a')\n+DEBUG = False\n-DEBUG = True\n+os.popen('z')"
    verdicts, checks = gate.gate(scan.scan_files(before), "file"), patch.verify_patches(before, checked)
    final = patch.final_gate(verdicts, checks).first()
    assert (final.n_files, final.n_findings, final.patch_exit_code) == (4, 4, 1)
    whole = patch.patch_result(verdicts, checks).first()
    assert (whole.n_patched, whole.ai_used) == (1, "beta")


def test_shared_findings_are_a_bag_intersection(spark):
    rnd = random.Random(4)
    pool = [(rule, snippet) for rule in "AB" for snippet in ("x", "y", "", None)]
    sides = [[[rnd.choice(pool) for _ in range(rnd.choice((0, 1, 3, 9, 40)))] for _ in "on"] for _ in range(80)]
    kind = "id int, o array<struct<rule_id:string,snippet:string>>, n array<struct<rule_id:string,snippet:string>>"
    table = spark.createDataFrame([(i, *pair) for i, pair in enumerate(sides)], kind)
    got = {r.id: r.shared for r in table.select("id", patch._shared(F.col("o"), F.col("n")).alias("shared")).collect()}
    assert got == {i: sum((Counter(old) & Counter(new)).values()) for i, (old, new) in enumerate(sides)}


def test_verifying_shuffles_no_findings(spark, files):
    checked = patch.validate_candidates(patch.candidates(answers(spark, {"a.py": "x = 1\n"})))
    plan = patch.verify_patches(files({"a.py": "exec('a')\n"}), checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Repartition" not in plan


def test_clean_corpus_needs_no_patch(spark, files):
    clean = scan.scan_files(files({"a.py": "x = 1\n"}))
    assert patch.patch_requests(clean).count() == 0
    empty = answers(spark, {"zz.py": "x"}).where("false")
    checked = patch.validate_candidates(patch.candidates(empty))
    files_ = files({"a.py": "x = 1\n"})
    result = patch.patch_result(gate.gate(clean, "file"), patch.verify_patches(files_, checked)).first()
    assert (result.ai_used, result.n_patched, result.deployable, result.n_files) == ("none", 0, True, 1)


def test_syntax_issues_alone_block_but_patching_exits_with_zero(spark, files):
    made = files({"a.py": "if x ==:\n"})
    nothing = patch.verify_patches(made, patch.validate_candidates(patch.candidates(answers(spark, {"a.py": "x"}).where("false"))))
    verdict = patch.final_gate(gate.gate(scan.scan_files(made), "file"), nothing).first()
    assert (verdict.deployable, verdict.exit_code, verdict.patch_exit_code) == (False, 1, 0)


def test_attempts_move_on_and_end(spark, files):
    scanned = scan.scan_files(files({"a.py": SECRET + "DEBUG = True\n", "b.py": "DEBUG = True\n"}))
    found = scan.findings(scanned)
    tried = found.where("path = 'a.py' AND seq = 0").select("repo", "path", "rule_id", "line", "snippet")
    spent = spark.range(20).select(
        F.lit("r").alias("repo"), F.lit("b.py").alias("path"), F.lit("X").alias("rule_id"), F.col("id").cast("int").alias("line"), F.lit("").alias("snippet")
    )
    assert rows(patch.first_pending(scanned).select("path", "rule_id"), "path") == [("a.py", "NO_HARDCODED_SECRETS"), ("b.py", "NO_DEBUG_MODE")]
    assert rows(patch.next_pending(found, tried.unionByName(spent)).select("path", "rule_id"), "path") == [("a.py", "NO_DEBUG_MODE")]
    requests = patch.patch_requests(scanned, tried.unionByName(spent)).collect()
    assert [(r.path, r.rule_id) for r in requests] == [("a.py", "NO_DEBUG_MODE")]
    assert "abcd99" not in requests[0].prompt and "***REDACTED***" in requests[0].prompt
    many = scan.findings(scan.scan_files(files({"m.py": "DEBUG = True\n" * 30})))
    assert patch.first_findings(many).count() == 30 and patch.first_findings(many, 20).count() == 20


def test_each_rule_is_told_once_where_first_seen_as_last_seen(files):
    found = scan.findings(scan.scan_files(files({"a.js": "exec(1)\ndebug = true\nexec(2)\n"})))
    got = rows(patch.prompt_rules(found).select("rule_id", "first_seq", "line", "snippet"), "first_seq")
    assert got == [("NO_EXEC", 0, 3, "exec(2)"), ("NO_DEBUG_MODE", 1, 2, "debug = true")]


def test_explanations_are_given_once_a_line(files):
    found = scan.findings(scan.scan_files(files({"a.py": "session = [random.random(), random.random()]\n"})))
    assert found.count() == 2
    told = patch.patch_explanations(found).collect()
    assert [(r.rule_id, r.line) for r in told] == [("NO_WEAK_RANDOM", 1)] and told[0].reference.endswith("#NO_WEAK_RANDOM")
    lines = [r.text for r in report.explanation_lines(patch.patch_explanations(found)).orderBy("part").collect()]
    assert lines[0].startswith("• NO_WEAK_RANDOM  a.py:1 — ")


def test_suppression_is_by_rule_and_keeps_the_reason(files):
    found = scan.findings(scan.scan_files(files({
        "a.py": "DEBUG = True  # scan: ignore NO_DEBUG_MODE local only\n", "b.py": "DEBUG = True  # scan: ignore NO_EXEC\n",
        "c.py": "DEBUG = True  # scan: ignore DEBUG_MODE_ON\n",
    })))
    kept, audit = patch.suppress(found)
    assert [r.path for r in kept.collect()] == ["b.py"]
    assert rows(audit.select("path", "reason"), "path") == [("a.py", "local only"), ("c.py", "")]


def test_suppression_keeps_null_snippets_and_reads_every_comment(spark):
    rows_ = [("r", "a", "NO_EXEC", None), ("r", "b", "OWN2_x", "x()  # scan: ignore OWN2_x why not"),
             ("r", "c", "NO_EXEC", "y()  # scan: ignore NO_NETWORK one # scan: ignore NO_EXEC two")]
    found = spark.createDataFrame(rows_, "repo string, path string, rule_id string, snippet string")
    kept, audit = patch.suppress(found)
    assert [r.path for r in kept.collect()] == ["a"]
    assert rows(audit.select("path", "reason"), "path") == [("b", "why not"), ("c", "two")]


def test_one_candidate_a_file_is_checked(spark, files):
    before = files({"a.py": "os.system('a')\n", "b.py": "os.system('b')\n"})
    several = spark.createDataFrame(
        [("r", "a.py", "NO_EXEC", 1, "x", "os.system('z')\n", 1, True, None), ("r", "a.py", "NO_EXEC", 1, "x", "y = 1\n", 2, True, None),
         ("r", "a.py", "NO_EXEC", 1, "x", "if x ==:\n", 3, False, "bad"), ("r", "b.py", "NO_EXEC", 1, "x", "if x ==:\n", 1, False, "bad")],
        "repo string, path string, rule_id string, line int, tool string, text string, round int, accepted boolean, reason string",
    )
    verified = rows(patch.verify_patches(before, several).select("path", "status", "n_after", "n_introduced"), "path")
    assert verified == [("a.py", "patched", 0, 0), ("b.py", "error", 1, 0)]
    assert [r.text for r in report.progress_lines(patch.verify_patches(before, several)).orderBy("path").collect()] == [
        "✓ NO_EXEC  a.py:1", "✗  NO_EXEC  b.py:1  bad",
    ]


def test_spent_files_are_told_and_the_limit_can_be_lifted(spark, files):
    scanned = scan.scan_files(files({"b.py": "DEBUG = True\n"}))
    tried = [("r", "b.py", "X", i, "") for i in range(3)]
    attempts = spark.createDataFrame(tried, "repo string, path string, rule_id string, line int, snippet string")
    found = scan.findings(scanned)
    assert patch.pending(found, attempts, 3).count() == 0 and patch.pending(found, attempts, None).count() == 1
    assert rows(patch.spent_files(found, attempts, 3).select("path", "n_attempts", "n_open", "status"), "path") == [("b.py", 3, 1, "spent")]
    again = patch.record_attempts(patch.patch_requests(scanned), attempts)
    assert again.count() == 4 and patch.pending(found, again, None).count() == 0


def test_one_candidate_a_file_is_applied(spark, files):
    before = files({"a.py": "x = 1\n", "b.py": "y = 1\n"})
    several = spark.createDataFrame(
        [("r", "a.py", "late\n", 2, True), ("r", "a.py", "early\n", 1, True), ("r", "b.py", "no\n", 1, False)],
        "repo string, path string, text string, round int, accepted boolean",
    )
    assert rows(patch.apply_patches(before, several).select("path", "text"), "path") == [("a.py", "late\n"), ("b.py", "y = 1\n")]


def test_repeated_keywords_count_if_any_is_true(files):
    made = files({"a.py": "import subprocess\nsubprocess.run('x', shell=True, shell=False)\napp.run(debug=True, debug=False)\n"})
    found = rows(scan.findings(scan.scan_files(made)).select("rule_id", "line"), "line")
    assert found == [("NO_EXEC", 2), ("NO_DEBUG_MODE", 3)]


def test_line_rules_alone_start_no_python(files):
    made = files({"a.py": SECRET})
    for frame in (scan.rule_findings(made, "NO_HARDCODED_SECRETS"), scan.scan_files(made, rule_ids=("NO_HARDCODED_SECRETS",), issues=False)):
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame.count() == 1
    assert "Python" in scan.scan_files(made)._jdf.queryExecution().executedPlan().toString()


def test_single_rules_agree_with_the_whole_scan(files):
    made = files({"a.js": 'const dbToken = "abcd99"; exec(1)\nexec(2)\ntry {} catch (e) {}\n', "b.py": SECRET + "os.system(1)\n"})
    whole = scan.findings(scan.scan_files(made))
    for rule in ("NO_EXEC", "NO_HARDCODED_SECRETS", "NO_BARE_EXCEPT"):
        alone = scan.rule_findings(made, rule).drop("seq")
        assert rows(alone, "path", "line") == rows(whole.where(F.col("rule_id") == rule).drop("seq"), "path", "line")
    scripts = scan.rule_findings(made, "NO_EXEC", "javascript")
    assert "ArrowEvalPython" not in scripts._jdf.queryExecution().executedPlan().toString()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scan_runs_once_and_without_shuffle(files):
    scanned = scan.scan_files(files({"a.py": "x = 1\n"}))
    for frame in (scanned.where(F.size("findings") > 0), gate.gate(scanned, "file"), scan.findings(scanned).where("rule_id = 'NO_EXEC'"),
                  patch.first_pending(scanned), patch.patch_requests(scanned), gate.by_file(scanned), report.scan_json(scanned)):
        plan = plan_of(frame)
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and plan.count("inline(array(struct") == 1


def test_filters_reach_the_source(spark, files, tmp_path):
    files({"a.py": "x = 1\n"}).write.parquet(str(tmp_path / "f"))
    scanned = scan.scan_files(spark.read.parquet(str(tmp_path / "f")))
    plan = plan_of(gate.gate(scanned.where("repo = 'r' AND size(findings) > 0"), "file"))
    assert "EqualTo(repo,r)" in plan


def test_numbering_and_pairing_share_one_layout(files):
    found = scan.findings(scan.scan_files(files({"a.py": "DEBUG = True\n"})))
    assert plan_of(patch.finding_changes(found, found)).count("Exchange") == 1


def test_bucketed_tables_are_joined_without_shuffle(spark, files):
    tables.save_bucketed(files({"a.py": "x = 1\n", "b.py": "y\n"}), "t_files", 4)
    tables.save_bucketed(files({"a.py": "x = 2\n"}).select("repo", "path", F.lit("X").alias("rule_id"), F.lit(1).alias("line"),
                         F.lit("t").alias("tool"), "text", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")), "t_new", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = patch.text_pairs(spark.table("t_files"), spark.table("t_new"))
        assert "Exchange" not in plan_of(pairs)
        assert [(r.path, r.new_text) for r in pairs.collect()] == [("a.py", "x = 2\n")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE t_files")
        spark.sql("DROP TABLE t_new")


def test_both_versions_from_one_pass(spark, files):
    texts = {"a.py": "os.system('a')\n" + SECRET, "b.py": SECRET, "c.py": "if x ==:\n", "d.ts": "eval(x)\n", "e.py": "x = 1\n", "f.py": SECRET}
    before = files(texts).withColumn("error", F.when(F.col("path") == "f.py", "unreadable")).withColumn("text", F.when(F.col("path") != "f.py", F.col("text")))
    checked = patch.validate_candidates(patch.candidates(answers(spark, {"a.py": "x = 1\n" + SECRET, "b.py": "if ==:\n", "c.py": "y = 2\n", "e.py": SECRET})))
    both = patch.scan_versions(before, checked).cache()
    after = scan.scan_files(patch.apply_patches(before, checked))
    assert both.drop("old_findings").columns == after.columns
    assert sorted(both.drop("old_findings").collect(), key=str) == sorted(after.collect(), key=str)
    told = ["repo", "path", "rule_id", "line", "tool", "status", "reason"]
    verified = patch.verify_patches(before, checked).select(told).collect()
    assert sorted(patch.candidate_status(before, checked).select(told).collect(), key=str) == sorted(verified, key=str)
    old = both.select("path", F.col("old_findings").alias("findings")).collect()
    assert sorted(old, key=str) == sorted(scan.scan_files(before).select("path", "findings").collect(), key=str)


def test_whole_patch_report(spark, files):
    before = files({"a.py": "os.system('a')\n" + SECRET})
    checked = patch.validate_candidates(patch.candidates(answers(spark, {"a.py": "x = 1\n" + SECRET})))
    remaining = scan.findings(patch.rescan(before, checked))
    told = patch.patch_explanations(scan.findings(scan.scan_files(before)).where("rule_id = 'NO_EXEC'"))
    diffs = patch.delta_text(patch.line_delta(patch.text_pairs(before, checked)))
    lines = report.patch_report(patch.verify_patches(before, checked), told, diffs, remaining)
    texts = [r.text for r in lines.orderBy("section", "line", "part").collect()]
    assert texts[0] == "✓  a.py patched" and "    +x = 1" in texts
    assert texts[-1] == '✗  NO_HARDCODED_SECRETS   a.py:2    token = "abcd99"'


def test_deltas_and_changes_agree_with_counting(spark, files):
    """Random texts with many equal lines against plain counters."""
    import random
    from collections import Counter

    rng = random.Random(3)
    lines = ["DEBUG = True", "x = 1", "os.system('a')", "", "app.run(debug=True)"]

    def text():
        return "".join(rng.choice(lines) + "\n" for _ in range(rng.randint(0, 12)))

    old = {f"f{i}.py": text() for i in range(25)}
    new = {path: text() if rng.random() < 0.8 else t for path, t in old.items()}
    before, after = files(old), files(new)
    delta = patch.line_delta(patch.changed_files(before, after)).collect()
    for path in old:
        was, now = Counter(old[path].splitlines()), Counter(new[path].splitlines())
        assert Counter(r.line for r in delta if r.path == path and r.side == "-") == was - now
        assert Counter(r.line for r in delta if r.path == path and r.side == "+") == now - was
        for r in delta:
            if r.path == path:
                assert (old if r.side == "-" else new)[path].splitlines()[r.line_no - 1] == r.line

    found = {"before": scan.findings(scan.scan_files(before)), "after": scan.findings(scan.scan_files(after))}
    counts = {s: Counter((r.path, r.rule_id, r.snippet) for r in f.collect()) for s, f in found.items()}
    changes = Counter((r.change, (r.path, r.rule_id, r.snippet)) for r in patch.finding_changes(found["before"], found["after"]).collect())
    for name, want in (
        ("fixed", counts["before"] - counts["after"]), ("introduced", counts["after"] - counts["before"]), ("remaining", counts["before"] & counts["after"]),
    ):
        assert Counter({k: n for (c, k), n in changes.items() if c == name}) == want
    fixed, introduced, common = patch.finding_difference(found["before"], found["after"])
    assert fixed.count() == sum((counts["before"] - counts["after"]).values())


def test_gate_from_tables_counts_clean_files(files):
    made = files({"a.py": SECRET, "b.py": "x = 1\n", "c.py": "if x ==:\n"})
    scanned = scan.scan_files(made)
    from_tables = gate.gate_from_tables(made, scan.findings(scanned), scan.syntax_issues(scanned), grain="file")
    assert rows(from_tables, "path") == rows(gate.gate(scan.scan_files(made), "file"), "path")
