import json
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scanloom.functions import fixed, line_rules, syntax
from scanloom.functions.syntax import FACT, extract_facts, register_py_facts
from scanloom.operators import scan
from scanloom.plans.corpus import templates

EDGE_CASES = Path(__file__).with_name("python_edge_cases.jsonl")


def test_templates_give_exactly_what_is_known(spark, files):
    texts = {f"t{t.number}{t.ending}": t.text.replace("<k>", "7") for t in templates()}
    rows = scan.scan_files(files(texts)).collect()
    for t in templates():
        row = next(r for r in rows if r.path == f"t{t.number}{t.ending}")
        assert [(f.rule_id, f.line) for f in row.findings] == list(t.expected), t
        assert [i.line for i in row.syntax_issues] == ([t.syntax_line] if t.syntax_line else []), t
        assert [f.seq for f in row.findings] == list(range(len(row.findings)))


def test_python_edge_cases(found):
    cases = [json.loads(line) for line in EDGE_CASES.read_text().splitlines()]
    got = found({f"e{c['e']}.py": c["text"] for c in cases})
    for c in cases:
        assert got[f"e{c['e']}.py"] == [tuple(x) for x in c["expect"]], c


def test_all_seven_rules_in_one_file_of_each_language(found):
    got = found(
        {
            "app.py": "import random, requests, subprocess\n"
            'API_KEY = "live-value-991"\nDEBUG = True\n'
            'def proxy(u):\n    return requests.get(f"https://h/{u}")\n'
            "def search(c, q):\n    c.execute(f\"SELECT * FROM t WHERE n = '{q}'\")\n"
            'def run(n):\n    return subprocess.run(f"x {n}", shell=True)\n'
            'def reset_token():\n    return "".join(random.choice("ab") for _ in range(9))\n'
            "try:\n    pass\nexcept:\n    pass\n",
            "app.js": 'const MY_API_KEY = "live-value-991";\nconst debug = true;\nfetch(`${req.query.url}`);\n'
            "const sql = `SELECT * FROM t WHERE n = '${n}'`;\nexec(`x ${n}`);\n"
            "const sessionToken = Math.random().toString(16);\ntry {\n} catch (e) {\n\n}\n",
        }
    )
    # Breadth first: statements of the module come before those inside functions.
    assert got["app.py"] == [
        ("NO_HARDCODED_SECRETS", 2), ("NO_DEBUG_MODE", 3), ("NO_BARE_EXCEPT", 14), ("NO_NETWORK", 5),
        ("SQL_PARAM_BINDING", 7), ("NO_EXEC", 9), ("NO_WEAK_RANDOM", 11),
    ]
    assert got["app.js"] == [
        ("NO_HARDCODED_SECRETS", 1), ("NO_DEBUG_MODE", 2), ("NO_NETWORK", 3), ("SQL_PARAM_BINDING", 4), ("NO_EXEC", 5),
        ("NO_WEAK_RANDOM", 6), ("NO_BARE_EXCEPT", 8),
    ]


def test_secret_assignment_ends_a_script_line_but_not_a_python_one(found):
    sk = "sk-" + "a1" * 12
    got = found(
        {
            "a.js": 'const dbToken = "abcd99"; exec("ls"); debug = true\n',
            "b.js": f"exec('{sk}'); debug = true\n",
            "a.py": f'token = "abcd99"; k = "{sk}"\nDEBUG = True; token = "abcd99"\n',
        }
    )
    assert got["a.js"] == [("NO_HARDCODED_SECRETS", 1)]
    assert got["b.js"] == [("NO_HARDCODED_SECRETS", 1), ("NO_EXEC", 1), ("NO_DEBUG_MODE", 1)]
    assert got["a.py"] == [("NO_HARDCODED_SECRETS", 1), ("NO_HARDCODED_SECRETS", 2), ("NO_DEBUG_MODE", 2)]


def test_empty_catches_are_counted_by_match(found):
    mark = "\ue000"
    got = found(
        {
            "a.ts": "try {} catch (a) {} try {} catch (b) { }\n\ncatch\n(\ne) {\n}\ncatch (x) { log(x) }\n",
            "b.ts": f"// {mark}\ncat{mark}ch (e) {{}}\n{mark}catch (e) {{}}\n",
            "c.ts": "a\r\nb\rcatch (e) {\r\n}\r\n",
            "d.ts": "x\x0by\ncatch (e) {}\n",
        }
    )
    assert got["a.ts"] == [("NO_BARE_EXCEPT", 1), ("NO_BARE_EXCEPT", 1), ("NO_BARE_EXCEPT", 3)]
    assert got["b.ts"] == [("NO_BARE_EXCEPT", 3)]
    assert got["c.ts"] == [("NO_BARE_EXCEPT", 3)]
    assert got["d.ts"] == [("NO_BARE_EXCEPT", 2)]


def test_unreadable_unknown_and_broken_files(spark, files):
    made = files({"a.py": "def nope(:\n    pass\n", "b.txt": "DEBUG = True\n", "c.py": None, "d.py": "x = '\0'\n", "e.py": "(" * 500})
    made = made.withColumn("error", F.when(F.col("path") == "c.py", "no such file"))
    rows = {r.path: r for r in scan.scan_files(made).collect()}
    assert rows["a.py"].syntax_issues[0].line == 1
    assert rows["b.txt"].findings == [] and rows["b.txt"].syntax_issues == []
    assert rows["c.py"].syntax_issues[0].message == "no such file" and rows["c.py"].findings == []
    assert len(rows["d.py"].syntax_issues) == 1 and len(rows["e.py"].syntax_issues) == 1


PIECES = [
    "password", "db", "Token", "api_key", "apiKey", "$", "_", "9", "é", " ", "=", '"', "'", "abcd", "example", "const ", "fetch", "axios.get",
    "https.request", "(", ")", ",", "req.", "${", "`", "SELECT ", "drop", "+", "concat(", "exec", "child_process.", ".", "execSync",
    "debug", "DEBUG", ":", "true", "Math.random(", "auth", " ", "\t", "x", "sk-", "A1b2C3d4E5f6G7h8I9j0", "eyJ", "-", "ſ", "K",
]


def python_tests():
    """The line rules with Python's own patterns."""
    def assigned(pattern):
        pattern = re.compile(pattern, re.I)

        def test(line):
            m = pattern.search(line)
            return bool(m) and not placeholder(m["value"])

        return test

    def placeholder(value):
        return any(w in value.lower() for w in fixed.PLACEHOLDER_WORDS)

    def provider(*shapes):
        return lambda line: any((m := re.search(s, line)) and not placeholder(m[0]) for s in shapes)

    quoted = r"\s*=\s*([\"'])(?P<value>[^\"']{4,})\1"
    network = re.compile(r"\b(?:fetch|axios\.(?:get|post|put|delete|patch)|https?\.(?:get|request))\s*\(")

    def js_network(line):
        m = network.search(line)
        argument = line[m.end():].split(")", 1)[0].split(",", 1)[0] if m else ""
        return any(marker in argument for marker in fixed.JS_REQUEST_MARKERS)

    words = "|".join(fixed.JS_SQL_WORDS)
    return {
        "py_secret_assigned": assigned(rf"\b(?:{fixed.PY_SECRET_NAMES})\b{quoted}"),
        "js_secret_assigned": assigned(rf"[A-Za-z_$][\w$]*(?:{fixed.JS_SECRET_NAMES})[\w$]*{quoted}"),
        "py_provider_secret": provider(fixed.SK_TOKEN_PY, fixed.GHP_TOKEN, fixed.AKIA_TOKEN, fixed.PEM_HEADER, fixed.JWT_TOKEN),
        "js_provider_secret": provider(fixed.SK_TOKEN_JS, fixed.GHP_TOKEN, fixed.AKIA_TOKEN, fixed.PEM_HEADER),
        "js_network": js_network,
        "js_exec": lambda s: bool(re.search(r"(?:child_process\.(?:exec|execSync|spawnSync)|(?<![.\w])(?:execSync|spawnSync|exec))\s*\(", s)),
        "js_sql": lambda s: bool(re.search(rf"`[^`]*\b({words})\b[^`]*\$\{{", s, re.I) or re.search(rf"\b({words})\b.*(?:\+|concat\()", s, re.I)),
        "js_debug": lambda s: bool(re.search(r"\bdebug\s*[:=]\s*true\b", s, re.I)),
        "js_weak_random": lambda s: bool(re.search(r"Math\.random\s*\(", s)) and any(w in s.lower() for w in fixed.SECURITY_WORDS),
    }


def likely_lines(rng: random.Random, n: int) -> list[str]:
    """Random lines that come close to what the rules look for."""
    starts = [
        '{a}password{b}= "{c}"', "{a}token{b}='{c}'", '{a}{b}api_key = "{c}\'', "{a}fetch ({b}req.{c})", "{a}`{b}select {c}${{x}}`",
        "{a}DROP{b}+{c}", "{a}exec{b}({c}", "{a}debug{b}:{c}true", "{a}Math.random{b}({c}auth", "{a}{b}{c}",
    ]

    def some(most):
        return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, most)))

    return [rng.choice(starts).format(a=some(4), b=some(2), c=some(5)) for _ in range(n)]


def test_line_rules_agree_with_python_patterns(spark):
    lines = [line for line in likely_lines(random.Random(5), 6000) if len(line.splitlines()) == 1]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    tests = python_tests()
    rows = frame.select("i", *(getattr(line_rules, n)(F.col("line")).alias(n) for n in tests)).collect()
    hits = dict.fromkeys(tests, 0)
    for row in rows:
        for name, test in tests.items():
            assert bool(row[name]) == test(lines[row.i]), (name, lines[row.i])
            hits[name] += bool(row[name])
    assert all(n > 0 for n in hits.values()), hits


def test_facts_carry_what_surrounds_a_call():
    facts = extract_facts("async def Reset():\n    Pin = a.b = C = f(random.random(), y=[g().h()])\n")
    calls = {f["dotted"]: f for f in facts if f["kind"] == "call"}
    assert calls["random.random"]["encl_fn"] == "reset"
    assert calls["random.random"]["targets"] == ("pin", "c")
    assert calls["h"]["attr"] == "h"
    assert [f["names"] for f in facts if f["kind"] == "assign"] == [["Pin", "C"]]


def test_focus_only_leaves_out_what_no_rule_uses(spark, files):
    texts = {f"t{t.number}.py": t.text.replace("<k>", "7") for t in templates() if t.ending == ".py"}
    made = files(texts)
    full = made.select("path", scan.python_syntax_findings(scan.syntax.facts_column(F.col("text"), False)).alias("f"))
    focused = made.select("path", scan.python_syntax_findings(scan.syntax.facts_column(F.col("text"), True)).alias("f"))
    assert sorted(map(str, full.collect())) == sorted(map(str, focused.collect()))


def test_facts_as_table_and_table_function(spark, files):
    made = files({"a.py": "try:\n    f(1)\nexcept (A, B):\n    pass\n", "b.js": "x"})
    assert sorted(r.kind for r in scan.py_facts(made).collect()) == ["call", "handler"]
    register_py_facts(spark)
    rows = spark.sql("SELECT f.* FROM {t} t, LATERAL inline(py_facts(t.text)) f", t=made.where("language = 'python'"))
    assert rows.schema.names == FACT.names
    assert sorted(r.kind for r in rows.collect()) == ["call", "handler"]


def test_custom_rules_are_added_after_the_others(files):
    own = (("NO_PRINT", "python", r"\bprint\("), ("NO_ALERT", "javascript", r"alert\("))
    rows = scan.findings(scan.scan_files(files({"a.py": "print(1)\nDEBUG = True\n", "b.js": "alert(1)\n"}), own))
    got = sorted((r.path, r.seq, r.rule_id, r.line) for r in rows.collect())
    assert got == [("a.py", 0, "NO_DEBUG_MODE", 2), ("a.py", 1, "NO_PRINT", 1), ("b.js", 0, "NO_ALERT", 1)]


def test_order_is_by_path_components(files):
    texts = {p: "DEBUG = True\ntoken = 'abcd99'\n" for p in ("a-b/x.py", "a/x.py", "a.py")}
    rows = scan.in_scan_order(scan.findings(scan.scan_files(files(texts)))).collect()
    assert [(r.path, r.rule_id) for r in rows][::2] == [(p, "NO_HARDCODED_SECRETS") for p in ("a/x.py", "a-b/x.py", "a.py")]


def test_minified_lines_are_scanned_in_reasonable_time(found):
    long = "a" * 200_000
    text = f"var q={long}; select select {'select ' * 2000} x; token{'eyJ' * 3000}; exec\n"
    got = found({"m.js": text, "m.py": "# " + text})
    assert got == {"m.js": [], "m.py": []}


def test_texts_without_a_name_that_rules_look_for_are_not_parsed(monkeypatch):
    monkeypatch.setattr(syntax, "_parse", lambda text: pytest.fail(f"parsed: {text}"))
    assert syntax.extract_facts("x = (\n", focus=True, problems=False) == []
    monkeypatch.undo()
    assert [f["kind"] for f in syntax.extract_facts("x = (\n", focus=True)] == ["syntax_error"]
    assert syntax.extract_facts("DEBUG = (\n", focus=True, problems=False) == []
    assert [f["kind"] for f in syntax.extract_facts("DEBUG = True\n", focus=True, problems=False)] == ["assign"]


APPLIES = (
    "try:\n    f()\nexcept \\\n :\n    pass\n", "try:\n    f()\nexcept\t:\n    pass\n", "try:\n    f()\nexcept\\\r\n:\n    pass\r\n",
    "try:\n    f()\nexcept Exception:\n    pass\n", "c.execute(rf'SELECT {x}')\n", "c.execute(Rf'SELECT {x}')\n", "c.execute('a' FR\"{x}\")\n",
    "c.executemany('SELECT %s' % x)\n", "c.execute('DROP ' + x)\n", "c.execute('DELETE {}'.format(x))\n", "os . system(x)\n", "os.\\\nexecvp(x)\n",
    "subprocess.call(x, shell = True)\n", "DEBUG = y = True\n", "f(debug=True)\n", "ＤＥＢＵＧ = True\n", "SeSSion = random.choice(x)\n",
    "def Otp():\n    random . randint(1, 2)\n", "httpx.get(a[0])\n", "urllib.request.urlopen(x + y)\n", "boto3.client(f'{x}')\n", "socket.socket.connect(form.x)\n",
)
NEAR = (
    "subprocess.run(['ls'], shell=False)\n", "c.execute('SELECT 1', (x,))\n", "random.randint(1, 6)\n", "try:\n    f()\nexcept ValueError:\n    pass\n",
    "DEBUG = 1\n", "os.path.join(x)\n", "x = True\n",
)


def test_texts_are_parsed_where_a_rule_may_apply_and_only_there(spark, files, monkeypatch):
    texts = {f"t{t.number}.py": t.text.replace("<k>", "7") for t in templates() if t.ending == ".py"}
    made = files(texts | {f"a{i}.py": text for i, text in enumerate(APPLIES)} | {f"n{i}.py": text for i, text in enumerate(NEAR)})
    found = lambda *args: made.select("path", scan.python_syntax_findings(syntax.facts_column(F.col("text"), *args)).alias("f"))
    full, focused = ({r.path: r.f for r in found(*args).collect()} for args in [(False,), (True, False)])
    assert full == focused and all(full[f"a{i}.py"] for i in range(len(APPLIES)))
    monkeypatch.setattr(syntax, "_parse", lambda text: pytest.fail(f"parsed: {text}"))
    assert [syntax.extract_facts(text, focus=True, problems=False) for text in NEAR] == [[]] * len(NEAR)


def test_workers_need_no_copy_of_this_package(tmp_path):
    (tmp_path / "facts").write_bytes(cloudpickle.dumps(syntax.extract_facts))
    code = "import pickle, sys; f = pickle.load(open('facts', 'rb')); print([len(f(t, True, False)) for t in eval(sys.argv[1])])"
    out = subprocess.run([sys.executable, "-c", code, repr(APPLIES + NEAR)], cwd=tmp_path, env={}, capture_output=True, text=True)
    assert out.stdout.strip() == repr([1] * len(APPLIES) + [0] * len(NEAR)), out.stderr
