"""Scanning: source files in, findings and syntax issues out.

``scan_files`` works inside each row: the findings of a file are an array next
to the file, so nothing is shuffled, and everything at file grain (gate, first
finding, patch request) stays a narrow operation. ``findings`` and
``syntax_issues`` unfold those arrays into tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import line_rules, syntax
from scanloom.functions.fixed_rules import RULE_IDS
from scanloom.functions.syntax_rules import PY_SYNTAX_RULES
from scanloom.functions.text import lines_of, raw_lines, snippet, strip_right, universal_newlines, with_value

FINDING = "struct<rule_id:string,line:int,col:int,snippet:string,pass:int>"
FINDINGS = f"array<{FINDING}>"
ISSUES = "array<struct<message:string,line:int,col:int>>"
LINE_PASS, SYNTAX_PASS, CUSTOM_PASS = 1, 2, 3
_MARK = "\ue000"


def _finding(rule_id: str, line_no: Column, text: Column, pass_no: int) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        line_no.cast("int").alias("line"),
        F.lit(0).alias("col"),
        text.alias("snippet"),
        F.lit(pass_no).alias("pass"),
    )


def _nothing() -> Column:
    return F.array().cast(FINDINGS)


def _compact(*findings: Column) -> Column:
    return F.array_compact(F.array(*findings))


def _over_lines(lines: Column, per_line) -> Column:
    return F.flatten(F.transform(lines, lambda line, i: per_line(line, i + 1)))


def python_line_findings(text: Column) -> Column:
    """Secrets in a Python text, at most one a line."""

    def per_line(line, line_no):
        hit = _finding("NO_HARDCODED_SECRETS", line_no, strip_right(line), LINE_PASS)
        return F.when(line_rules.py_secret(line), F.array(hit)).otherwise(_nothing())

    return _over_lines(raw_lines(text), per_line)


def python_syntax_findings(facts: Column, rule_ids=RULE_IDS) -> Column:
    """Findings from the syntax facts of a Python text, in the order of facts and rules."""

    def per_fact(fact):
        return _compact(
            *(
                F.when(test(fact), _finding(rule, fact["lineno"], fact["line"], SYNTAX_PASS))
                for rule, test in PY_SYNTAX_RULES
                if rule in rule_ids
            )
        )

    return F.flatten(F.transform(facts, per_fact))


def script_line_findings(text: Column, rule_ids=RULE_IDS) -> Column:
    """Line rules of JavaScript and TypeScript, in the order of lines and rules."""
    tests = [(rule, test) for rule, test in line_rules.JS_LINE_RULES if rule in rule_ids]
    if not tests:
        return _nothing()

    def per_line(line, line_no):
        shown = strip_right(line)
        secret = _finding("NO_HARDCODED_SECRETS", line_no, shown, LINE_PASS)
        others = _compact(
            *(
                F.when(test(line), _finding(rule, line_no, shown, LINE_PASS))
                for rule, test in tests
            )
        )
        # A secret assignment ends the work on its line whether or not it is asked for.
        first = F.array(secret) if "NO_HARDCODED_SECRETS" in rule_ids else _nothing()
        return F.when(line_rules.js_secret_assigned(line), first).otherwise(others)

    return _over_lines(raw_lines(text), per_line)


def empty_catch_findings(text: Column) -> Column:
    """Empty ``catch`` blocks, which may span lines: one finding a match.

    A mark is put before every match; the marks on a line count its matches.
    (A mark already in the text is first made an ordinary letter, which cannot
    be part of a match either.) Lines are counted by ``\\n`` alone here.
    """
    plain = universal_newlines(text)
    marked = F.regexp_replace(F.translate(plain, _MARK, "x"), line_rules.EMPTY_CATCH, f"{_MARK}$0")

    def per_line(lines):
        def found(part, i):
            times = F.size(F.split(part, _MARK, -1)) - 1
            hit = _finding("NO_BARE_EXCEPT", i + 1, snippet(lines, i + 1), SYNTAX_PASS)
            return F.when(F.contains(part, F.lit(_MARK)), F.array_repeat(hit, times)).otherwise(_nothing())

        return F.flatten(F.transform(F.split(marked, "\n", -1), found))

    has_catch = F.contains(text, F.lit("catch")) & text.rlike(line_rules.EMPTY_CATCH)
    return F.when(has_catch, with_value(raw_lines(plain), per_line)).otherwise(_nothing())


def custom_findings(text: Column, language: Column, custom_rules) -> Column:
    """Findings of user rules, given as (rule_id, language, regex).

    Patterns are literals of the plan, so each is compiled once a task.
    """

    def per_line(line, line_no):
        return _compact(
            *(
                F.when((language == wanted) & line.rlike(regex), _finding(rule, line_no, strip_right(line), CUSTOM_PASS))
                for rule, wanted, regex, *_ in custom_rules
            )
        )

    return _over_lines(raw_lines(text), per_line)


ALL_LANGUAGES = ("python", "javascript", "typescript")


def _python_findings(text: Column, facts: Column, rule_ids) -> Column:
    parts = [python_line_findings(text)] if "NO_HARDCODED_SECRETS" in rule_ids else []
    if any(rule in rule_ids for rule, _ in PY_SYNTAX_RULES):
        parts.append(python_syntax_findings(facts, rule_ids))
    return F.concat(*parts) if parts else _nothing()


def _script_findings(text: Column, rule_ids) -> Column:
    lines = script_line_findings(text, rule_ids)
    return F.concat(lines, empty_catch_findings(text)) if "NO_BARE_EXCEPT" in rule_ids else lines


@cache
def _scan_column(application: str, custom_rules: tuple, languages: tuple, rule_ids: tuple, with_issues: bool) -> Column:
    """Findings and syntax issues of a row. Building it takes long, so each application keeps it.

    Files are parsed only for syntax rules or issues: without either, no text leaves the JVM.
    """
    text, language = F.col("text"), F.col("language")
    is_python = language == "python"
    scripts = [name for name in languages if name != "python"]
    found = F.when(text.isNull(), _nothing())
    issues = F.when(
        F.col("error").isNotNull(),
        F.array(F.struct(F.col("error").alias("message"), F.lit(0).alias("line"), F.lit(0).alias("col"))),
    )
    if "python" in languages:
        parsed = with_issues or any(rule in rule_ids for rule, _ in PY_SYNTAX_RULES)
        facts = syntax.facts_column(F.when(is_python, text), problems=with_issues) if parsed else None
        found = found.when(is_python, _python_findings(text, facts, rule_ids).cast(FINDINGS))
        if with_issues:
            problems = F.transform(
                F.filter(facts, lambda f: f["kind"] == "syntax_error"),
                lambda f: F.struct(f["message"].alias("message"), f["lineno"].alias("line"), f["col"].alias("col")),
            )
            issues = issues.when(is_python & text.isNotNull(), problems)
    if scripts:
        found = found.when(language.isin(*scripts), _script_findings(text, rule_ids).cast(FINDINGS))
    found = found.otherwise(_nothing())
    if custom_rules:
        own = F.when(text.isNull(), _nothing()).otherwise(custom_findings(text, language, custom_rules))
        found = F.concat(found.cast(FINDINGS), own.cast(FINDINGS))
    numbered = F.transform(found.cast(FINDINGS), lambda f, i: f.withField("seq", i))
    both = F.struct(
        numbered.alias("findings"), issues.otherwise(F.array().cast(ISSUES)).cast(ISSUES).alias("syntax_issues")
    )
    return F.inline(F.array(both))


def scan_files(source_files: DataFrame, custom_rules=(), languages=ALL_LANGUAGES, rule_ids=RULE_IDS, issues: bool = True) -> DataFrame:
    """Source files with two more columns, ``findings`` and ``syntax_issues``.

    Both arrays are computed behind one ``inline``, so that filters on them
    are not pushed below and the rules never run twice for a row; filters on
    other columns still reach the source. Where ``languages`` leaves out
    Python, no Python worker is started. ``rule_ids`` other than all seven
    means that only those rules are computed; ``issues`` false leaves out what
    cannot be parsed, and with it the parser where no syntax rule needs it or
    can apply to a text.
    """
    application = source_files.sparkSession.conf.get("spark.app.id")
    rules = tuple(tuple(rule) for rule in custom_rules)
    return source_files.select("*", _scan_column(application, rules, tuple(languages), tuple(rule_ids), issues))


def rule_findings(source_files: DataFrame, rule_id: str, *languages: str) -> DataFrame:
    """Findings of one rule in some languages; nothing else is computed."""
    languages = languages or ALL_LANGUAGES
    chosen = source_files.where(F.col("language").isin(*languages))
    return findings(scan_files(chosen, (), languages, (rule_id,), issues=False))


def findings(scanned: DataFrame) -> DataFrame:
    """One row a finding."""
    return scanned.select("repo", "path", F.inline("findings"))


def syntax_issues(scanned: DataFrame) -> DataFrame:
    """One row a file that cannot be parsed or read."""
    return scanned.select("repo", "path", F.inline("syntax_issues"))


def in_scan_order(found: DataFrame) -> DataFrame:
    """Findings ordered by path components, pass and position."""
    return found.orderBy("repo", F.split("path", "/"), "pass", "seq")


def split_lines(source_files: DataFrame) -> DataFrame:
    """One row a line, numbered from 1."""
    return source_files.where(F.length("text") > 0).select(
        "repo", "path", "language", F.posexplode(lines_of(F.col("text"))).alias("at", "line")
    ).select("repo", "path", "language", (F.col("at") + 1).alias("line_no"), "line")


def py_facts(source_files: DataFrame, focus: bool = False) -> DataFrame:
    """Syntax facts of the Python files, one row a fact."""
    python = source_files.where((F.col("language") == "python") & F.col("text").isNotNull())
    return python.select("repo", "path", F.inline(syntax.facts_column(F.col("text"), focus)))
