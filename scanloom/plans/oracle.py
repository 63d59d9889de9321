"""SQL twins of the registered queries, for an engine with RE2 patterns.

Rules that are line patterns are applied again to the same texts. Rules that
need syntax are checked against what is known of each template.
"""

from __future__ import annotations

from scanloom.functions import fixed
from scanloom.functions.fixed_rules import IMPORTANCE, OTHER_GUIDANCE, REFERENCE, RULES
from scanloom.plans.corpus import N_TEMPLATES, templates
from scanloom.plans.labels import AGAIN, BLIND, SAFE, SOURCES, SPENT, TOOLS, TRIED, case_of


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def rows(name: str, columns: str, values) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)
    return f"{name}({columns}) AS (VALUES {body})"


TEMPLATES = rows(
    "templates",
    "t, ext, language, txt, syntax",
    [(x.number, x.ending, fixed.LANGUAGES[x.ending], x.text, x.syntax_line) for x in templates()],
)
EXPECTED = rows(
    "expected",
    "t, seq, rule_id, line",
    [(x.number, i, rule, line) for x in templates() for i, (rule, line) in enumerate(x.expected)],
)
RULE_ROWS = rows(
    "rules",
    "nr, rule_id, severity, description, guidance, why, fix, title, summary",
    [
        (i, r.rule_id, r.severity, r.description, r.guidance, r.why.split("\n")[0], r.fix, r.patch_title, r.patch_summary)
        for i, r in enumerate(RULES)
    ],
)
CASES = rows(
    "cases",
    "t, category, rule, line, expected_count, reason",
    [
        (x.number, c[0], c[1], c[2][0] if c[2] else None, c[3], BLIND.get(x.number, (None,))[-1])
        for x in templates()
        for c in [case_of(x)]
    ],
)
SAFE_ROWS = rows("safe", "t, safe_t", SAFE.items())

NL, CR = "chr(10)", "chr(13)"


def corpus_of(table: str, key: str, repo: str, extra: str = "") -> str:
    return f"""corpus AS (
  SELECT s.{key} AS key, t, s.{repo} AS repo, 'src/t' || t || '/f' || s.{key} || ext AS path,
         language, replace(txt, '<k>', s.{key}::VARCHAR) AS text, syntax {extra}
  FROM {table} s JOIN templates ON s.{key} % {N_TEMPLATES} = t)"""


PART = corpus_of("part", "p_partkey", "p_brand")
# The same in two repositories, under the same paths.
TWICE = PART.replace("corpus AS", "once AS", 1) + """,
corpus AS (SELECT * FROM once UNION ALL SELECT * REPLACE ('mirror' AS repo) FROM once)"""
ORDERS = corpus_of("orders", "o_orderkey", "o_orderpriority", ", s.o_orderdate AS mtime")


def lines_of(source: str, keys: str, text: str = "text") -> str:
    return f"""(SELECT {keys}, line_no, line FROM (
      SELECT {keys}, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
      FROM (SELECT {keys}, string_split(replace({text}, {CR} || {NL}, {NL}), {NL}) AS ls FROM {source}))
      WHERE NOT (line = '' AND line_no = n))"""


LINES = f"lines AS {lines_of('corpus', 'key, t, repo, path, language')}"
# Findings as known: one row each, with the text of its line.
FOUND = """found AS (
  SELECT c.key, c.t, c.repo, c.path, c.language, e.seq, e.rule_id, e.line, rtrim(l.line) AS snippet,
         CASE WHEN e.rule_id = 'NO_HARDCODED_SECRETS' THEN 1 WHEN c.language = 'python' THEN 2
              WHEN e.rule_id = 'NO_BARE_EXCEPT' THEN 2 ELSE 1 END AS pass
  FROM corpus c JOIN expected e USING (t) JOIN lines l ON l.key = c.key AND l.repo = c.repo AND l.line_no = e.line)"""
GATED = """gated AS (
  SELECT c.key, c.t, c.repo, c.path, c.language, count(e.rule_id) AS n_findings,
         max(CASE WHEN c.syntax > 0 THEN 1 ELSE 0 END) AS n_syntax
  FROM corpus c LEFT JOIN expected e USING (t) GROUP BY ALL)"""


def known(select: str, *more: str, corpus: str = PART) -> str:
    parts = [TEMPLATES, EXPECTED, RULE_ROWS, CASES, SAFE_ROWS, corpus, LINES, FOUND, GATED, *more]
    return "WITH " + ",\n".join(parts) + "\n" + select


def any_of(words) -> str:
    return "|".join(w.replace(".", "\\.").replace("$", "\\$").replace("{", "\\{") for w in words)


PLACEHOLDER = any_of(fixed.PLACEHOLDER_WORDS)
SECURITY = any_of(fixed.SECURITY_WORDS)
QUOTED = r"""\s*=\s*("[^"']{4,}"|'[^"']{4,}')"""
NO_WORD = r"(?:^|[^\p{L}\p{N}_])"
PY_ASSIGN = rf"(?i){NO_WORD}(?:{fixed.PY_SECRET_NAMES}){QUOTED}"
JS_ASSIGN = rf"(?i)[A-Za-z_$][\w$]*(?:{fixed.JS_SECRET_NAMES})[\w$]*{QUOTED}"
SHAPES = (fixed.GHP_TOKEN, fixed.AKIA_TOKEN, fixed.PEM_HEADER)
PY_SHAPES = (fixed.SK_TOKEN_PY, *SHAPES, fixed.JWT_TOKEN)
JS_SHAPES = (fixed.SK_TOKEN_JS, *SHAPES)


def real(line: str, pattern: str, group: int) -> str:
    value = f"regexp_extract({line}, {lit(pattern)}, {group})"
    return f"({value} <> '' AND NOT regexp_matches(lower({value}), {lit(PLACEHOLDER)}))"


def secret(line: str, assign: str, shapes) -> str:
    return "(" + " OR ".join([real(line, assign, 1), *(real(line, s, 0) for s in shapes)]) + ")"


PY_SECRET = secret("line", PY_ASSIGN, PY_SHAPES)
JS_SECRET = secret("line", JS_ASSIGN, JS_SHAPES)
JS_SKIP = real("line", JS_ASSIGN, 1)
SQL_WORDS = "|".join(fixed.JS_SQL_WORDS)
NETWORK = r"\b(fetch|axios\.(?:get|post|put|delete|patch)|http\.(?:get|request)|https\.(?:get|request))\s*\(([^),]*)"
JS_TESTS = {
    "network": f"regexp_matches(regexp_extract(line, {lit(NETWORK)}, 2), {lit(any_of(fixed.JS_REQUEST_MARKERS))})",
    "exec": "regexp_matches(line, '(child_process\\.(exec|execSync|spawnSync)|(^|[^.\\w])(execSync|spawnSync|exec))\\s*\\(')",
    "sql": f"(regexp_matches(line, '(?i)`[^`]*\\b({SQL_WORDS})\\b[^`]*\\$\\{{')"
    f" OR regexp_matches(line, '(?i)\\b({SQL_WORDS})\\b.*(\\+|concat\\()'))",
    "debug": "regexp_matches(line, '(?i)\\bdebug\\s*[:=]\\s*true\\b')",
    "random": f"(regexp_matches(line, 'Math\\.random\\s*\\(') AND regexp_matches(lower(line), {lit(SECURITY)}))",
}
CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"

REDACT_NAME = rf"""({NO_WORD}(?:{fixed.PY_SECRET_NAMES})\s*=\s*["'])"""
REDACT_LONG = rf"""(?i){REDACT_NAME}([^"']{{4}})[^"']+([^"']{{4}})(["'])"""
REDACT_SHORT = rf"""(?i){REDACT_NAME}[^"']{{4,8}}(["'])"""
TOKEN_MASKS = (
    r"(sk-[A-Za-z0-9])[A-Za-z0-9]{15,}([A-Za-z0-9]{4})",
    r"(ghp_)[A-Za-z0-9]{32}([A-Za-z0-9]{4})",
    r"(AKIA)[0-9A-Z]{12}([0-9A-Z]{4})",
)


def redacted(text: str) -> str:
    out = f"regexp_replace({text}, {lit(REDACT_LONG)}, '\\1\\2...\\3\\4', 'g')"
    out = f"regexp_replace({out}, {lit(REDACT_SHORT)}, '\\1***REDACTED***\\2', 'g')"
    for mask in TOKEN_MASKS:
        out = f"regexp_replace({out}, {lit(mask)}, '\\1...\\2', 'g')"
    return out


DOC_LINES = f"doc_lines AS {lines_of('documents', 'doc_id, lang')}"
BASENAME = "regexp_extract(path, '[^/]+$')"
VERDICT = "n_findings = 0 AND n_syntax = 0 AS deployable, CASE WHEN n_findings = 0 AND n_syntax = 0 THEN 0 ELSE 1 END AS exit_code"
LABELS = {"critical": "● CRITICAL", "high": "▲ HIGH", "medium": "■ MEDIUM"}
RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 0 END"
BADGE = "CASE severity " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LABELS.items()) + " END"
SCRIPT = "language IN ('javascript', 'typescript')"


def pick(names, key: str) -> str:
    return f"[{', '.join(lit(n) for n in names)}][1 + {key} % {len(names)}]"


MANIFEST = f"""labelled AS (
  SELECT c.repo, 'case-' || c.key || '-' || c.repo AS case_id, category, c.language, rule, c.path, cases.line, expected_count, reason, c.key,
         CASE WHEN c.t = 1 THEN 'src/t0/f' || (c.key - 1) || '.py' END AS fixed_file
  FROM corpus c JOIN cases USING (t))"""
MATCHED = """matched AS (
  SELECT coalesce(m.repo, f.repo) AS repo, m.case_id, m.category, coalesce(m.path, f.path) AS path, coalesce(m.rule, f.rule_id) AS rule_id,
         coalesce(m.line, f.line) AS line, coalesce(n, 0) AS n_found,
         CASE WHEN m.case_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missed' ELSE 'hit' END AS outcome
  FROM (SELECT * FROM labelled WHERE line IS NOT NULL) m
  FULL JOIN (SELECT repo, path, rule_id, line, count(*) AS n FROM found GROUP BY ALL) f
    ON m.repo = f.repo AND m.path = f.path AND m.rule = f.rule_id AND m.line = f.line)"""
BY_CASE = """by_case AS (
  SELECT l.repo, l.case_id, l.category, l.language, l.rule AS rule_id, l.path, reason,
         CASE WHEN l.line IS NOT NULL AND m.outcome = 'hit' THEN 1 ELSE 0 END AS n_hit,
         CASE WHEN l.line IS NOT NULL AND m.outcome = 'missed' THEN 1 ELSE 0 END AS n_missed,
         coalesce(f.n, 0) AS n_found, coalesce(f.n, 0) = expected_count AS count_agrees
  FROM labelled l LEFT JOIN matched m USING (case_id)
  LEFT JOIN (SELECT repo, path, rule_id, count(*) AS n FROM found GROUP BY ALL) f ON f.repo = l.repo AND f.path = l.path AND f.rule_id = l.rule)"""
ATTEMPTED = f"""open_findings AS (
  SELECT f.* FROM found f
  WHERE f.t NOT IN {SPENT}
    AND NOT (f.t IN {TRIED} AND EXISTS (SELECT 1 FROM found g WHERE g.key = f.key AND g.seq = 0
             AND g.rule_id = f.rule_id AND g.line = f.line AND g.snippet = f.snippet))),
next_finding AS (SELECT * FROM open_findings QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) = 1)"""
# What becomes of each file with a candidate: template 13 is rejected, 14 unchanged.
PATCHED = f"""patched AS (
  SELECT c.*, e.rule_id, e.line, {pick(TOOLS, 'c.key')} AS tool,
         CASE WHEN c.t = 13 THEN 'error' WHEN c.t = 14 THEN 'unchanged' ELSE 'patched' END AS status,
         CASE WHEN c.t = 13 THEN 13 ELSE safe_t END AS new_t
  FROM corpus c JOIN safe USING (t) JOIN expected e ON e.t = c.t AND e.seq = 0),
after_found AS (
  SELECT p.path, e.rule_id, e.line, e.seq, rtrim(string_split(replace(txt, '<k>', p.key::VARCHAR), {NL})[e.line]) AS snippet
  FROM patched p JOIN expected e ON e.t = p.new_t JOIN templates x ON x.t = p.new_t),
changes AS (
  SELECT coalesce(b.path, a.path) AS path, coalesce(b.rule_id, a.rule_id) AS rule_id,
         coalesce(b.snippet, a.snippet) AS snippet, coalesce(b.occ, a.occ) AS occurrence,
         coalesce(b.line, a.line) AS line,
         CASE WHEN a.path IS NULL THEN 'fixed' WHEN b.path IS NULL THEN 'introduced' ELSE 'remaining' END AS change
  FROM (SELECT path, rule_id, snippet, line, row_number() OVER (PARTITION BY path, rule_id, snippet ORDER BY seq) AS occ
        FROM found WHERE path IN (SELECT path FROM patched)) b
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY path, rule_id, snippet ORDER BY seq) AS occ FROM after_found) a
    ON a.path = b.path AND a.rule_id = b.rule_id AND a.snippet = b.snippet AND a.occ = b.occ),
verified AS (
  SELECT p.repo, p.path, p.rule_id, p.line, p.tool, p.status,
         count_if(change <> 'introduced') AS n_before, count_if(change <> 'fixed') AS n_after, 0 AS n_syntax,
         count_if(change <> 'fixed') = 0 AS deployable, count_if(change = 'fixed') AS n_fixed,
         count_if(change = 'remaining') AS n_remaining, count_if(change = 'introduced') AS n_introduced
  FROM patched p JOIN changes USING (path) GROUP BY ALL),
applied AS (
  SELECT c.key, c.repo, c.path, coalesce(replace(x.txt, '<k>', c.key::VARCHAR), c.text) AS text
  FROM corpus c LEFT JOIN patched p USING (path) LEFT JOIN templates x ON x.t = p.new_t AND p.status <> 'error'),
final AS (
  SELECT count(*) AS n_files, sum(coalesce(v.n_after, g.n_findings)) AS n_findings, sum(g.n_syntax) AS n_syntax
  FROM gated g LEFT JOIN verified v USING (path)),
old_lines AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY line_no) AS occ
              FROM {lines_of('corpus', 'path')}),
new_lines AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY line_no) AS occ
              FROM {lines_of('applied', 'path')}),
delta AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN '-' ELSE '+' END AS side,
         coalesce(o.line_no, n.line_no) AS line_no, coalesce(o.line, n.line) AS line
  FROM old_lines o FULL JOIN new_lines n ON o.path = n.path AND o.line = n.line AND o.occ = n.occ
  WHERE o.path IS NULL OR n.path IS NULL)"""
FINAL = (
    "n_files, n_findings, n_syntax, n_findings = 0 AND n_syntax = 0 AS deployable, "
    "CASE WHEN n_findings = 0 AND n_syntax = 0 THEN 0 ELSE 1 END AS exit_code, "
    "CASE WHEN n_findings > 0 THEN 1 ELSE 0 END AS patch_exit_code"
)
FREQUENCY = """frequency AS (
  SELECT r.rule_id, count(f.path) AS n_findings, count(DISTINCT f.path) AS n_files,
         count(DISTINCT f.repo) AS n_repos_hit,
         round(count(DISTINCT f.repo) * 100.0 / (SELECT count(DISTINCT repo) FROM corpus), 4)::DOUBLE AS repo_share
  FROM rules r LEFT JOIN found f USING (rule_id) GROUP BY r.rule_id)"""
CANONICAL_EXPLANATION = f"""SELECT DISTINCT path, rule_id, line, title, summary, guidance, {lit(REFERENCE)} || rule_id AS reference
  FROM found JOIN rules USING (rule_id)"""

JSON_SNIPPET = f"replace({redacted('snippet')}, '\"', '\\\"')"
PROMPT = f"""'Repair one finding in this ' || language || ' file and return the whole new file, without fences.' || {NL}
 || 'Change only what the finding needs; keep names, comments and layout as they are.' || {NL} || {NL}
 || 'File: ' || path || {NL} || 'Finding: {{"rule_id":"' || rule_id || '","line":' || line || ',"code_snippet":"' || {JSON_SNIPPET} || '"}}' || {NL} || {NL}
 || 'Guidance:' || {NL} || '- ' || rule_id || ': ' || coalesce(guidance, {lit(OTHER_GUIDANCE)}) || {NL}
 || '- Values masked here are secrets: read them from the environment, do not restore them.' || {NL}
 || '- Prefer the smallest change that removes the finding.' || {NL} || {NL} || 'Code:' || {NL} || {redacted('text')}"""
KEY6 = "lpad(p_partkey::VARCHAR, 6, '0')"
KEY_TEXTS = f"""key_lines AS (
  SELECT 'keys/' || p_partkey || CASE WHEN p_partkey % 4 < 2 THEN '.py' ELSE '.ts' END AS path, p_partkey % 4 < 2 AS is_py,
         'x = ''' || CASE p_partkey % 6
           WHEN 0 THEN 'sk-' || repeat('a1', 8) || {KEY6}
           WHEN 1 THEN 'ghp_' || repeat('b2', 15) || {KEY6}
           WHEN 2 THEN 'AKIA' || repeat('C', 10) || {KEY6}
           WHEN 3 THEN 'eyJ' || {KEY6} || 'abcd.' || {KEY6} || 'efgh.' || {KEY6} || 'ijkl'
           WHEN 4 THEN 'sk-' || repeat('sample', 4) || {KEY6}
           ELSE '-----BEGIN RSA PRIV' || 'ATE KEY-----' END || '''' AS line
  FROM part)"""
STRIPPED = f"trim(text, ' ' || {NL} || {CR} || chr(9))"
PAGE_LINES = f"""page_text AS (SELECT page_id, replace(html, '&quot;', '"') AS text FROM pages),
page_lines AS {lines_of('page_text', 'page_id')}"""
SCRIPTS = f"""scripts AS (
  SELECT 'page/' || page_id || '/' || (generate_subscripts(codes, 1) - 1) || '.js' AS path, unnest(codes) AS text
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS codes FROM pages)),
script_lines AS {lines_of('scripts', 'path')}"""
# Findings in a stream's windows, open ones included.
WINDOWS = """windows AS (
  SELECT floor(epoch(c.mtime) / 86400 / 30)::BIGINT * 30 AS day, e.rule_id, count(*) AS n_findings
  FROM corpus c JOIN expected e USING (t) GROUP BY ALL)"""

OWN = r"""own(rule_id, wanted, re, severity, description) AS (VALUES
  ('IMPORTS_RANDOM', 'python', '^import random$', 'low', 'imports the module random'),
  ('NO_VAR_LET', 'typescript', '\blet\s', 'high', 'declares by let'), ('USES_CONST', 'javascript', '^const\s', NULL, NULL),
  ('NO_GOTO', 'python', '\bgoto\s', 'critical', 'jumps')),
own_found AS (SELECT path, rule_id, severity, description, line_no AS line, rtrim(lines.line) AS snippet
  FROM lines JOIN own ON language = wanted AND regexp_matches(lines.line, re))"""


def doc_files(before: str, after: str) -> str:
    plain = r"regexp_replace(coalesce(text, ''), '[^\x20\x21\x23-\x29\x2B-\x5B\x5D-\x7E\n]', '_', 'g')"
    return f"doc_files AS (SELECT doc_id, {lit(before)} || {plain} || {lit(after)} AS text FROM documents)"


DOC_FILES = doc_files('NOTE = """\n', '\n"""\nDEBUG = True\n')
DOC_SCRIPTS = doc_files("/*\n", "\n*/\nexec(1);\n")

ORACLE: dict[str, str] = {
    "documents_secrets_by_lang": f"""WITH {DOC_LINES},
hits AS (SELECT doc_id, count(*) AS n FROM doc_lines WHERE {PY_SECRET} GROUP BY ALL)
SELECT lang, count(*) AS n_files, sum(coalesce(n, 0)) AS n_secrets, count(n) AS n_files_with_secrets
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY lang""",
    "documents_secret_lines": f"""WITH {DOC_LINES}
SELECT doc_id, line_no AS line, rtrim(line) AS snippet FROM doc_lines WHERE {PY_SECRET}""",
    "documents_redacted": f"SELECT doc_id, {redacted('text')} AS redacted FROM documents",
    "pages_script_lines": f"""WITH {SCRIPTS}
SELECT path, 'javascript' AS language, line_no, line FROM script_lines""",
    "pages_secret_lines": f"""WITH {PAGE_LINES}
SELECT page_id, count(*) AS n_secrets FROM page_lines WHERE {PY_SECRET} GROUP BY page_id""",
    "conversations_code": f"""SELECT conv_id, turn, CASE WHEN {STRIPPED} = '' THEN '' ELSE {STRIPPED} || {NL} END AS code
FROM conversations""",
    "conversations_fenced_code": f"""SELECT conv_id, turn, {STRIPPED} || {NL} AS code
FROM (SELECT conv_id, turn, replace(coalesce(text, ''), repeat('`', 3), repeat(chr(39), 2)) AS text FROM conversations)""",
    "corpus_lines": known("SELECT path, line_no, line FROM lines"),
    "corpus_language_counts": known(
        "SELECT language, count(*) AS n_files, sum(length(text)) AS n_chars FROM corpus GROUP BY language"
    ),
    "js_secrets": known(f"SELECT path, line_no AS line, rtrim(line) AS snippet FROM lines WHERE {SCRIPT} AND {JS_SECRET}"),
    "py_secrets": known(
        f"SELECT path, line_no AS line, rtrim(line) AS snippet FROM lines WHERE language = 'python' AND {PY_SECRET}"
    ),
    "js_empty_catch": known(f"""SELECT path, line_no AS line, rtrim(line) AS snippet FROM (
  SELECT path, len(string_split(string_split_regex(text, {lit(CATCH)})[1], {NL})) AS first_line
  FROM corpus WHERE {SCRIPT} AND regexp_matches(text, {lit(CATCH)})) JOIN lines USING (path) WHERE line_no = first_line"""),
    "py_syntax": known("SELECT path, syntax AS line FROM corpus WHERE syntax > 0"),
    "py_fact_handlers": known(
        "SELECT l.path, line_no AS line FROM lines l JOIN corpus c USING (path) "
        "WHERE c.language = 'python' AND syntax = 0 AND regexp_matches(line, '^\\s*except\\b')"
    ),
    "py_fact_assignments": known(
        "SELECT l.path, line_no AS line, regexp_extract(line, '^(\\w+) = ', 1) AS names FROM lines l JOIN corpus c USING (path) "
        "WHERE c.language = 'python' AND syntax = 0 AND regexp_matches(line, '^\\w+ = ')"
    ),
    "provider_keys": f"""WITH {KEY_TEXTS}
SELECT path, 'NO_HARDCODED_SECRETS' AS rule_id, 1 AS line FROM key_lines
WHERE CASE WHEN is_py THEN {PY_SECRET} ELSE {JS_SECRET} END""",
    "custom_rule_hits": known("SELECT path, rule_id, line, snippet FROM own_found", OWN),
    "findings_all": known("SELECT repo, path, rule_id, line, 0 AS col, snippet, pass, seq FROM found"),
    "findings_with_rule": known(
        "SELECT path, seq, line, rule_id AS rule_name, severity, description AS explanation FROM found JOIN rules USING (rule_id)"
    ),
    "findings_with_guidance": known("SELECT path, seq, guidance, why, fix FROM found JOIN rules USING (rule_id)"),
    "findings_by_alias": known("SELECT rule_id, count(*) AS n_findings FROM found GROUP BY rule_id"),
    "gate_by_file": known(f"SELECT repo, path, n_findings, n_syntax, {VERDICT} FROM gated"),
    "gate_by_repo": known(f"""SELECT *, {VERDICT} FROM (
  SELECT repo, count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated GROUP BY repo)"""),
    "gate_from_tables": known(f"""SELECT *, {VERDICT} FROM (
  SELECT repo, count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated GROUP BY repo)"""),
    "gate_corpus": known(f"""SELECT *, {VERDICT} FROM (
  SELECT count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated)"""),
    "scan_counts": known("""SELECT n_files, fail_count, pass_count, n_syntax, fail_count = 0 AND n_syntax = 0 AS deployable,
  CASE WHEN fail_count = 0 AND n_syntax = 0 THEN 0 ELSE 1 END AS exit_code FROM (
  SELECT count(*) AS n_files, sum(n_findings) + (SELECT count(*) FROM own_found) AS fail_count, sum(n_syntax) AS n_syntax,
    7 + 4 - (SELECT count(DISTINCT rule_id) FROM (SELECT rule_id FROM found UNION ALL SELECT rule_id FROM own_found)) AS pass_count
  FROM gated)""", OWN),
    "orders_gate_by_repo": known(
        f"""SELECT *, {VERDICT} FROM (
  SELECT repo, count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated GROUP BY repo)""",
        corpus=ORDERS,
    ),
    "summary_rollup": known(f"""SELECT coalesce(severity, 'all') AS severity, coalesce(rule_id, 'all') AS rule_id,
  n_findings, {RANK} AS severity_rank FROM (
  SELECT severity, rule_id, count(*) AS n_findings FROM found JOIN rules USING (rule_id) GROUP BY ROLLUP (severity, rule_id))"""),
    "summary_by_language": known("SELECT language, rule_id, count(*) AS n_findings FROM found GROUP BY ALL"),
    "files_with_findings": known("SELECT repo, path, language FROM gated WHERE n_findings > 0"),
    "findings_by_file": known(
        "SELECT path, count(*) AS n_findings, string_agg(rule_id || ':' || line, ' ' ORDER BY seq) AS listed FROM found GROUP BY path"
    ),
    "failed_rules": known("SELECT rule_id, count(*) AS n_findings FROM found GROUP BY rule_id"),
    "clean_rules": known(
        """SELECT rule_id, severity FROM (SELECT rule_id, severity FROM rules UNION ALL SELECT rule_id, severity FROM own)
WHERE rule_id NOT IN (SELECT rule_id FROM found) AND rule_id NOT IN (SELECT rule_id FROM own_found)""",
        OWN,
    ),
    "custom_rule_report": known(
        """SELECT rule_id, coalesce(severity, 'medium') AS severity, description AS explanation, count(*) AS n_findings
FROM own_found GROUP BY ALL""",
        OWN,
    ),
    "documents_as_python": f"""WITH {DOC_FILES}, file_lines AS {lines_of('doc_files', 'doc_id')}
SELECT doc_id || '.py' AS path, 'NO_HARDCODED_SECRETS' AS rule_id, line_no AS line, rtrim(line) AS snippet
FROM file_lines WHERE {PY_SECRET}
UNION ALL SELECT doc_id || '.py', 'NO_DEBUG_MODE', max(line_no), 'DEBUG = True' FROM file_lines GROUP BY doc_id""",
    "documents_as_scripts": f"""WITH {DOC_SCRIPTS}, file_lines AS {lines_of('doc_files', 'doc_id')}
SELECT doc_id || '.js' AS path, rule_id, line_no AS line, rtrim(line) AS snippet FROM (
  SELECT *, 'NO_HARDCODED_SECRETS' AS rule_id FROM file_lines WHERE {JS_SECRET}
  UNION ALL SELECT *, 'NO_NETWORK' FROM file_lines WHERE NOT {JS_SKIP} AND {JS_TESTS['network']}
  UNION ALL SELECT *, 'NO_EXEC' FROM file_lines WHERE NOT {JS_SKIP} AND {JS_TESTS['exec']}
  UNION ALL SELECT *, 'SQL_PARAM_BINDING' FROM file_lines WHERE NOT {JS_SKIP} AND {JS_TESTS['sql']}
  UNION ALL SELECT *, 'NO_DEBUG_MODE' FROM file_lines WHERE NOT {JS_SKIP} AND {JS_TESTS['debug']}
  UNION ALL SELECT *, 'NO_WEAK_RANDOM' FROM file_lines WHERE NOT {JS_SKIP} AND {JS_TESTS['random']})""",
    "documents_decoded": "SELECT doc_id, text || chr(65533) AS text FROM documents",
    "unreadable_files": known("""SELECT path, count(e.rule_id) FILTER (key % 5 <> 0)::INTEGER AS n_findings,
  CASE WHEN key % 5 = 0 THEN 0 ELSE syntax END AS line, CASE WHEN key % 5 = 0 THEN 'no permission' END AS message
FROM corpus c LEFT JOIN expected e USING (t) WHERE key % 5 = 0 OR syntax > 0 GROUP BY path, key, syntax"""),
    "published_counts": known("""SELECT g.path AS file, g.language, n_lines::INTEGER AS total_lines, n_findings::INTEGER AS n_findings,
  n_syntax::INTEGER AS n_limitations FROM gated g JOIN (SELECT path, count(*) AS n_lines FROM lines GROUP BY path) USING (path)"""),
    "report_lines": known(f"""SELECT repo, path, seq, part, text FROM (
  SELECT repo, path, seq, 0 AS part, '✗  ' || rpad(rule_id, 22, ' ') || ' ' || {BASENAME} || ':' || rpad(line::VARCHAR, 4, ' ')
    || ' ' || trim({redacted('snippet')}) AS text FROM found
  UNION ALL SELECT repo, path, seq, 1, '   ' || why FROM found JOIN rules USING (rule_id)
  UNION ALL SELECT repo, path, seq, 2, '   → ' || fix FROM found JOIN rules USING (rule_id)
  UNION ALL SELECT repo, path, seq, 3, '' FROM found)"""),
    "report_rows": known(f"""SELECT path, seq, {RANK} AS severity_rank, {BADGE} AS badge, rule_id AS rule_name,
  {BASENAME} || ':' || line AS location, trim({redacted('snippet')}) AS snippet FROM found JOIN rules USING (rule_id)"""),
    "report_verdicts": known("""SELECT repo, CASE WHEN n = 0 AND s = 0 THEN '🚀 Deployment Approved'
  ELSE 'Deployment BLOCKED — ' || n || ' violation(s)' END AS text
FROM (SELECT repo, sum(n_findings)::BIGINT AS n, sum(n_syntax) AS s FROM gated GROUP BY repo)"""),
    "report_issues": known("SELECT path, '⚠ syntax error  ' || path || ':' || syntax AS text FROM corpus WHERE syntax > 0"),
    "report_json": known(f"""SELECT g.path AS file, CASE WHEN n_findings = 0 AND n_syntax = 0 THEN 'true' ELSE 'false' END AS deployable,
  n_findings::INTEGER AS fail_count, f.rule_id AS first_rule, {redacted('f.snippet')} AS first_snippet,
  CASE WHEN n_syntax > 0 THEN syntax::VARCHAR END AS syntax_line
FROM gated g JOIN corpus c USING (path) LEFT JOIN found f ON f.path = g.path AND f.seq = 0"""),
    "evaluate_file": known(
        """SELECT category, count(*) AS n_files, count_if(n > 0) AS n_blocked, count_if(n = 0) AS n_approved,
  count_if((n = 0) = (category <> 'vulnerable')) AS n_right
FROM (SELECT repo, category, path FROM labelled UNION SELECT repo, 'fixed', fixed_file FROM labelled WHERE fixed_file IS NOT NULL)
JOIN (SELECT repo, path, n_findings + n_syntax AS n FROM gated) USING (repo, path) GROUP BY category""",
        MANIFEST, corpus=TWICE,
    ),
    "evaluate_case": known(
        "SELECT repo, case_id, category, language, rule_id, path, n_hit, n_missed, n_found, count_agrees FROM by_case",
        MANIFEST, MATCHED, BY_CASE, corpus=TWICE,
    ),
    "evaluate_lines": known(
        "SELECT rule_id, outcome, count(*) AS n_lines, sum(n_found) AS n_found FROM matched GROUP BY ALL", MANIFEST, MATCHED, corpus=TWICE
    ),
    "rule_quality": known(
        """SELECT rule_id, tp, fn, fp, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM (
  SELECT rule_id, count_if(outcome = 'hit') AS tp, count_if(outcome = 'missed') AS fn, count_if(outcome = 'unexpected') AS fp
  FROM matched WHERE category IS NULL OR category <> 'blind_spot' GROUP BY rule_id)""",
        MANIFEST, MATCHED, corpus=TWICE,
    ),
    "blind_spots": known(
        """SELECT case_id, rule_id, path, n_hit, n_missed, n_hit = 0 AS still_blind, reason AS blind_spot_reason
FROM by_case WHERE category = 'blind_spot'""",
        MANIFEST, MATCHED, BY_CASE, corpus=TWICE,
    ),
    "sources_by_rule": known(
        f"""SELECT rule, source_dataset, count(*) AS n_cases FROM (
  SELECT rule, unnest([{pick(SOURCES, 'key')}, 'set zero']) AS source_dataset FROM labelled) GROUP BY ALL""",
        MANIFEST, corpus=TWICE,
    ),
    "counterparts": known(
        """SELECT l.repo, l.path AS file, fixed_file, a.n_findings + a.n_syntax = 0 AS deployable,
  b.n_findings + b.n_syntax = 0 AS fixed_deployable
FROM labelled l LEFT JOIN gated a ON a.repo = l.repo AND a.path = l.path
LEFT JOIN gated b ON b.repo = l.repo AND b.path = l.fixed_file WHERE fixed_file IS NOT NULL""",
        MANIFEST, corpus=TWICE,
    ),
    "rule_frequency": known("SELECT * FROM frequency", FREQUENCY),
    "rule_priority": known(
        """SELECT rule_id, round(f, 3) AS frequency, round(importance * 0.6 + f * 0.4, 3) AS priority,
  row_number() OVER (ORDER BY importance * 0.6 + f * 0.4 DESC, rule_id) AS rank,
  row_number() OVER (ORDER BY importance * 0.6 + f * 0.4 DESC, rule_id) <= 7 AS chosen FROM (
  SELECT rule_id, importance, coalesce(CASE WHEN n_findings > 0 THEN log10(n_findings)
    / log10((SELECT max(n_findings) FROM frequency)) * 5 END, freq_estimate, 0.0) AS f
  FROM scores LEFT JOIN frequency USING (rule_id) WHERE excluded IS NULL)""",
        FREQUENCY,
        rows("scores", "rule_id, importance, freq_estimate, excluded", IMPORTANCE),
    ),
    "first_pending": known("SELECT path, rule_id, line, snippet FROM found WHERE seq = 0"),
    "pending_after_attempts": known("SELECT path, rule_id, line, snippet FROM next_finding", ATTEMPTED),
    "first_findings": known("SELECT path, rule_id, line, row_number() OVER (PARTITION BY path ORDER BY seq) AS turn FROM found"),
    "prompt_rules": known("SELECT path, rule_id, min(seq) AS first_seq, max_by(line, seq) AS line FROM found GROUP BY path, rule_id"),
    "patch_requests": known(f"""SELECT path, rule_id, line, prompt FROM (SELECT f.*, guidance, text, {PROMPT.replace("path", "f.path").replace("language", "f.language")} AS prompt
  FROM found f JOIN rules USING (rule_id) JOIN corpus c ON c.key = f.key WHERE seq = 0)"""),
    "patch_requests_next_round": known(
        f"""SELECT path, rule_id, line, prompt FROM (SELECT f.*, guidance, text, {PROMPT.replace("path", "f.path").replace("language", "f.language")} AS prompt
  FROM next_finding f JOIN rules USING (rule_id) JOIN corpus c ON c.key = f.key)""",
        ATTEMPTED,
    ),
    "spent_files": known(f"""SELECT path, 20 AS n_attempts, count(*) AS n_open, 'spent' AS status
FROM found WHERE t IN {SPENT} GROUP BY path"""),
    "second_round": known(
        """SELECT path, rule_id, line, snippet FROM (
  SELECT path, rule_id, line, snippet, seq FROM after_found
  UNION ALL SELECT path, rule_id, line, snippet, seq FROM found WHERE path NOT IN (SELECT path FROM patched)) s
WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.path = s.path AND g.seq = 0
  AND g.rule_id = s.rule_id AND g.line = s.line AND g.snippet = s.snippet)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) = 1""",
        PATCHED,
    ),
    "findings_introduced_or_common": known(
        "SELECT path, rule_id, snippet, change FROM changes WHERE change <> 'fixed'", PATCHED
    ),
    "patch_result_clean": known("""SELECT 0 AS n_patched, 'none' AS ai_used, n_files, n_findings, n_syntax,
  n_syntax = 0 AS deployable, CASE WHEN n_syntax = 0 THEN 0 ELSE 1 END AS exit_code, 0 AS patch_exit_code FROM (
  SELECT count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated WHERE n_findings = 0)"""),
    "patch_progress": known(
        f"""SELECT path, line, CASE status WHEN 'patched' THEN '✓ ' || shown WHEN 'unchanged' THEN '↷  ' || shown || '  (no change)'
  ELSE '✗  ' || shown || '  rejected' END AS text
FROM (SELECT *, rule_id || '  ' || {BASENAME} || ':' || line AS shown FROM verified)""",
        PATCHED,
    ),
    "patch_json": known(
        f"""SELECT v.path, CASE WHEN status = 'patched' THEN v.path END AS patched, d.diff,
  CASE WHEN status = 'patched' THEN r.title END AS title, a.rule_id AS remains,
  CASE WHEN deployable THEN 'true' ELSE 'false' END AS deployable, tool AS ai_used
FROM verified v LEFT JOIN rules r USING (rule_id) LEFT JOIN after_found a ON a.path = v.path AND a.seq = 0
LEFT JOIN (SELECT path, string_agg(side || line, {NL} ORDER BY line_no, side = '+') AS diff FROM delta GROUP BY path) d ON d.path = v.path""",
        PATCHED,
    ),
    "patch_explanations": known(CANONICAL_EXPLANATION),
    "validate_candidates": known(
        f"""SELECT path, rule_id, line, status <> 'error' AS accepted FROM patched
UNION ALL SELECT path, rule_id, line, true FROM patched WHERE t IN {AGAIN}""",
        PATCHED,
    ),
    "verify_patches": known("SELECT * FROM verified", PATCHED),
    "provenance": known("SELECT tool, rule_id, status, deployable, count(*) AS n FROM verified GROUP BY ALL", PATCHED),
    "finding_changes": known("SELECT path, rule_id, occurrence, change, line FROM changes", PATCHED),
    "findings_fixed": known("SELECT path, rule_id, snippet FROM changes WHERE change = 'fixed'", PATCHED),
    "applied_files": known("SELECT repo, path, text FROM applied", PATCHED),
    "final_gate": known(f"SELECT {FINAL} FROM final", PATCHED),
    "patch_result": known(
        f"""SELECT (SELECT count(*) FROM verified WHERE status = 'patched') AS n_patched,
  (SELECT string_agg(DISTINCT tool, ',' ORDER BY tool) FROM verified) AS ai_used, {FINAL} FROM final""",
        PATCHED,
    ),
    "line_delta": known("SELECT path, side, line_no, line FROM delta", PATCHED),
    "line_delta_of_versions": known("SELECT path, side, line_no, line FROM delta", PATCHED),
    "delta_text": known(
        f"SELECT path, string_agg(side || line, {NL} ORDER BY line_no, side = '+') AS diff FROM delta GROUP BY path", PATCHED
    ),
    "patch_report": known(
        f"""SELECT path, 0 AS section, 0 AS line, 0 AS part, '✓  ' || {BASENAME} || ' patched' AS text FROM verified WHERE status = 'patched'
UNION ALL SELECT path, 2, line, 0, '• ' || rule_id || '  ' || {BASENAME} || ':' || line || ' — ' || title FROM applied_told
UNION ALL SELECT path, 2, line, 1, '  ' || summary FROM applied_told
UNION ALL SELECT path, 3, 0, 0, '⚠ syntax error  ' || path || ':' || syntax || '  cannot be parsed' FROM corpus WHERE syntax > 0
UNION ALL SELECT NULL, 4, 0, 0, CASE WHEN n_findings = 0 AND n_syntax = 0 THEN '🚀 Deployment Approved' ELSE 'Remaining violations:' END FROM final
UNION ALL SELECT path, 5, line, seq, '✗  ' || rpad(rule_id, 22, ' ') || ' ' || {BASENAME} || ':' || rpad(line::VARCHAR, 4, ' ')
  || ' ' || trim(snippet) FROM after_found
UNION ALL SELECT path, 5, line, seq, '✗  ' || rpad(rule_id, 22, ' ') || ' ' || {BASENAME} || ':' || rpad(line::VARCHAR, 4, ' ')
  || ' ' || trim(snippet) FROM found WHERE path NOT IN (SELECT path FROM patched)""",
        PATCHED,
        f"told AS ({CANONICAL_EXPLANATION})",
        "applied_told AS (SELECT told.* FROM told JOIN verified USING (path, rule_id, line) WHERE status = 'patched')",
    ),
    "suppressed": known("SELECT path, rule_id, line, 'ticket ' || key AS reason FROM found WHERE t = 13"),
    "kept_findings": known("SELECT rule_id, count(*) AS n_findings FROM found WHERE t <> 13 GROUP BY rule_id"),
    "stream_findings": known("SELECT path, rule_id, line FROM found", corpus=ORDERS),
    "stream_gate": known(
        f"""SELECT *, {VERDICT} FROM (
  SELECT repo, count(*) AS n_files, sum(n_findings) AS n_findings, sum(n_syntax) AS n_syntax FROM gated GROUP BY repo)""",
        corpus=ORDERS,
    ),
    "stream_windows": known(
        "SELECT day::INTEGER AS window_day, rule_id, n_findings FROM windows",
        WINDOWS,
        corpus=ORDERS,
    ),
    "stream_dedup": known("SELECT language, count(*) AS n_files FROM corpus GROUP BY language", corpus=ORDERS),
}
for _short, _test in JS_TESTS.items():
    ORACLE[f"js_{_short}"] = known(
        f"SELECT path, line_no AS line, rtrim(line) AS snippet FROM lines WHERE {SCRIPT} AND NOT {JS_SKIP} AND {_test}"
    )
for _short, _rule in {
    "network": "NO_NETWORK", "exec": "NO_EXEC", "sql": "SQL_PARAM_BINDING", "debug": "NO_DEBUG_MODE",
    "random": "NO_WEAK_RANDOM", "except": "NO_BARE_EXCEPT",
}.items():
    ORACLE[f"py_{_short}"] = known(
        f"SELECT path, line, snippet FROM found WHERE language = 'python' AND rule_id = {lit(_rule)}"
    )

#: What each kind of edit of ``catalog._edited_parts`` gives: hunk, mark, old line, new line.
_HUNKS = {
    0: [(1, " ", 3, 3), (1, " ", 4, 4), (1, " ", 5, 5), (1, "-", 6, None), (1, "+", None, 6), (1, " ", 7, 7), (1, " ", 8, 8), (1, " ", 9, 9)],
    1: [(1, " ", 1, 1), (1, "-", 2, None), (1, " ", 3, 2), (1, " ", 4, 3), (1, " ", 5, 4),
        (2, " ", 8, 7), (2, " ", 9, 8), (2, " ", 10, 9), (2, "+", None, 10), (2, " ", 11, 11), (2, " ", 12, 12)],
    2: [(1, " ", 2, 2), (1, " ", 3, 3), (1, " ", 4, 4), (1, "+", None, 5), (1, " ", 5, 6), (1, " ", 6, 7), (1, " ", 7, 8)],
    3: [(1, "-", 1, None), (1, "+", None, 1), (1, " ", 2, 2), (1, " ", 3, 3), (1, " ", 4, 4),
        (2, " ", 9, 9), (2, " ", 10, 10), (2, " ", 11, 11), (2, "-", 12, None), (2, "+", None, 12)],
}
_HEADERS = [(0, 1, "@@ -3,7 +3,7 @@"), (1, 1, "@@ -1,5 +1,4 @@"), (1, 2, "@@ -8,5 +7,6 @@"), (2, 1, "@@ -2,6 +2,7 @@"), (3, 1, "@@ -1,4 +1,4 @@"), (3, 2, "@@ -9,4 +9,4 @@")]
_AS_PYTHON = f"""SELECT doc_id || '.py' AS path, 'NO_HARDCODED_SECRETS' AS rule_id, line_no AS line, rtrim(line) AS snippet
FROM file_lines WHERE {PY_SECRET}
UNION ALL SELECT doc_id || '.py', 'NO_DEBUG_MODE', line_no, 'DEBUG = True' FROM file_lines WHERE line_no >= (
  SELECT max(line_no) FROM file_lines f WHERE f.doc_id = file_lines.doc_id) - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END"""
_OLD = "string_split(coalesce(text, ''), chr(10))"

ORACLE |= {
    "stream_gate_latest": known(
        f"""SELECT *, {VERDICT} FROM (
  SELECT g.repo, count(*) AS n_files, CAST(sum(CASE WHEN c.key % 4 IN (1, 2) THEN 0 ELSE n_findings END) AS BIGINT) AS n_findings,
         CAST(sum(CASE c.key % 4 WHEN 1 THEN 0 WHEN 2 THEN (c.language = 'python')::INTEGER ELSE n_syntax END) AS BIGINT) AS n_syntax
  FROM gated g JOIN corpus c USING (path) GROUP BY g.repo)""",
        corpus=ORDERS,
    ),
    "tree_round_trip": ORACLE["documents_as_python"],
    "stream_tree_findings": ORACLE["documents_as_python"],
    "many_own_rules": f"""WITH {DOC_LINES},
r AS (
  SELECT 'PART_' || p_partkey AS rule_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey AS k FROM part WHERE p_partkey % 7 <> 0),
p AS (
  SELECT rule_id, CASE WHEN k <= 2 THEN '' WHEN k % 4 = 0 THEN substr(a, 1, 4) WHEN k % 4 = 1 THEN b WHEN k % 4 = 2 THEN a ELSE substr(b, 1, 3) END AS held,
    CASE WHEN k = 1 THEN '^[0-9]+$' WHEN k = 2 THEN '[0-9]{{5}}' WHEN k % 4 = 0 THEN substr(a, 1, 4) || '[a-z]* ' WHEN k % 4 = 1 THEN '(?i)' || b
         WHEN k % 4 = 2 THEN a || '.*' || (k % 10) || '$' ELSE substr(b, 1, 3) || '[a-z]*, ' END AS pattern
  FROM r),
d AS MATERIALIZED (SELECT DISTINCT held FROM p),
near AS MATERIALIZED (SELECT doc_id, line, held FROM doc_lines JOIN d ON contains(lower(line), held)),
c AS (SELECT DISTINCT held, pattern FROM p),
hits AS MATERIALIZED (SELECT doc_id, pattern FROM near JOIN c USING (held) WHERE regexp_matches(line, pattern))
SELECT rule_id, count(*) AS n_findings, count(DISTINCT doc_id) AS n_files FROM p JOIN hits USING (pattern) GROUP BY rule_id""",
    "py_fact_rows": known(
        """SELECT l.path, 'handler' AS kind, line_no AS line FROM lines l JOIN corpus c USING (path)
WHERE c.language = 'python' AND syntax = 0 AND regexp_matches(line, '^\\s*except\\b')
UNION ALL SELECT l.path, 'assign', line_no FROM lines l JOIN corpus c USING (path)
WHERE c.language = 'python' AND syntax = 0 AND regexp_matches(line, '^\\w+ = ')"""
    ),
    "content_scan": f"""WITH {DOC_FILES.replace('doc_files AS', 'once AS', 1)},
doc_files AS (SELECT doc_id, text || CASE WHEN doc_id % 10 = 0 THEN 'DEBUG = True' || {NL} ELSE '' END AS text FROM once),
file_lines AS {lines_of('doc_files', 'doc_id')} {_AS_PYTHON}""",
    "content_scan_runs": f"""WITH {DOC_FILES},
again AS (SELECT text || CASE WHEN doc_id % 10 = 0 THEN 'DEBUG = True' || {NL} ELSE '' END AS text FROM doc_files)
SELECT 'first' AS run, count(DISTINCT text) AS n_scanned FROM doc_files
UNION ALL SELECT 'second', count(DISTINCT text) FROM again WHERE text NOT IN (SELECT text FROM doc_files)""",
    "line_hunks": f"""WITH {rows('e', 'kind, hunk, mark, old_no, new_no', [(kind, *row) for kind, some in _HUNKS.items() for row in some])}
SELECT p_partkey::VARCHAR AS path, hunk, mark, old_no, new_no, CASE WHEN mark = '+' AND p_partkey % 4 IN (0, 3) THEN 'edited ' || p_partkey
  ELSE 'line ' || coalesce(old_no, CASE WHEN p_partkey % 4 = 1 THEN 2 ELSE 4 END) || ' of ' || p_partkey END AS line
FROM part JOIN e ON p_partkey % 4 = kind""",
    "line_hunk_headers": f"""WITH {rows('e', 'kind, hunk, header', _HEADERS)}
SELECT p_partkey::VARCHAR AS path, hunk, header FROM part JOIN e ON p_partkey % 4 = kind""",
    "line_script_texts": f"""WITH d AS (SELECT doc_id, {_OLD} AS ls FROM documents),
n AS (SELECT *, doc_id % len(ls) + 1 AS n FROM d),
t AS (SELECT doc_id, list_concat(ls, ['end']) AS old, list_concat(list_concat(list_concat(['first'], ls[:n - 1]), ls[n + 1:]), [ls[n], 'end']) AS new FROM n)
SELECT doc_id, sha256(replace(array_to_string(old, {NL}), {CR}, '')) AS old_sha256, sha256(replace(array_to_string(new, {NL}), {CR}, '')) AS new_sha256 FROM t""",
    "frequency_estimates": known("SELECT rule_id, n_findings, n_files, n_repos_hit, true AS n_files_close, true AS n_repos_hit_close FROM frequency", FREQUENCY),
    "rule_importance": """SELECT p_partkey, round(0.25 * (p_partkey % 7 % 5 + 1) + 0.25 * (p_partkey % 11 % 5 + 1) + 0.2 * (p_partkey % 13 % 5 + 1)
  + 0.15 * (p_partkey % 17 % 5 + 1) + 0.15 * (p_partkey % 19 % 5 + 1), 6)::DOUBLE AS importance FROM part""",
    "file_owners": known("""SELECT path, CASE WHEN key % 10 = 0 THEN path WHEN t < 20 THEN 'src/t' || t ELSE 'src/' END AS root,
  CASE WHEN key % 10 = 0 THEN 'file' WHEN t = 3 THEN repo WHEN t < 20 THEN 'team ' || (t % 5) ELSE 'platform' END AS owner FROM corpus"""),
    "suppression_table": known(
        """SELECT path, rule_id, line, CASE WHEN hit IS NOT NULL THEN 'suppressed' WHEN past IS NOT NULL THEN 'expired' ELSE 'kept' END AS status,
  coalesce(hit, past) || '-' || t AS entry_id, coalesce(hit, past) AS reason FROM (
  SELECT f.path, f.rule_id, f.line, c.t,
    CASE WHEN f.rule_id = 'NO_DEBUG_MODE' AND regexp_matches(f.path, '/f[^/]*5\\.') AND mtime >= DATE '1993-01-01' THEN 'fives'
         WHEN f.rule_id = 'NO_EXEC' AND mtime < DATE '1994-07-01' THEN 'until'
         WHEN mtime >= DATE '1995-01-01' AND mtime < DATE '1996-01-01' THEN 'year' END AS hit,
    CASE WHEN mtime >= DATE '1996-01-01' THEN 'year' WHEN f.rule_id = 'NO_EXEC' AND mtime >= DATE '1994-07-01' THEN 'until' END AS past
  FROM found f JOIN corpus c USING (path))""",
        corpus=ORDERS,
    ),
}
