"""Many own rules by an inverted index, against the same rules as literals and against Python's patterns."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.operators.rule_index import gram_counts, indexed_rule_findings, indexed_rule_totals, pattern_hits, required_literal, rule_keys
from scanloom.operators.scan import findings, scan_files

PATTERNS = {
    r"import random": "import random",
    r"^\s*eval\(": "eval(",
    r"abc?defg": "defg",
    r"abcd*efg": "abc",
    r"abcd+efg": "abcd",
    r"ab{0,2}xyz": "xyz",
    r"ab{2}xyz": "xyz",
    r"(foo|bar)\.baz": ".baz",
    r"[a-z]+_key\s*=": "_key",
    r"(?i)Secret": "secret",
    r"TODO: (?:fix|do) later": "todo: ",
    r"foo|barbar": None,
    r"ab": None,
    r"(?x) abc def": None,
    r"\x41bcdef": None,
    r"\Qabcdef\E": None,
    r"(?:abcdef)": None,
    r"(?iu)kiosks": None,
    r"(?iu)password": "word",
    r"naïveté": "vet",
    r"[]abcd]+wxyz": None,
    r"[^]abcd]+wxyz": None,
    r"[a[bc]d]wxyz": "wxyz",
    r"a(?i)bcdef": None,
    r"abc(?=defgh)": "abc",
    r"\.\.\.\$\{": "...${",
    r"(?<!x)print\(": "print(",
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_literals(pattern):
    assert required_literal(pattern) == PATTERNS[pattern]


def test_no_pattern_has_no_literal():
    assert required_literal(None) is None and required_literal("") is None


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_a_match_holds_the_literal(data):
    pieces = data.draw(st.lists(st.sampled_from([r"abc", r"x?", r"\d+", r"[q-t]{1,2}", r"(?:uv|w)", r"\.", "yz*", "long", "=", r"\w", "K{2}", "."]), min_size=1, max_size=6))
    pattern = data.draw(st.sampled_from(["", "(?i)"])) + "".join(pieces)
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=False))
    literal = required_literal(pattern)
    assert literal is None or literal in text.lower()


def rules_table(spark, rules):
    return spark.createDataFrame(rules, "rule_id string, language string, pattern string")


def both_ways(spark, files, rules):
    plain = findings(scan_files(files, rules, (), (), issues=False))
    got = indexed_rule_findings(files, rules_table(spark, rules))
    key = lambda rows: sorted(tuple(r) for r in rows.select("repo", "path", "rule_id", "line", "col", "snippet", "pass").collect())
    return key(got), key(plain)


def test_same_findings_as_literal_rules(spark, files):
    draw = random.Random(5)
    words = ["eval(", "import random", "x = 1", "Secret", "SECRET_KEY = 'a'", "naïve", "\t", "foo.bar", "ABCDEFG", "abcdeeefg", "K", "…", "\x0b"]
    texts = {f"a/{i}.{draw.choice(['py', 'js', 'ts', 'txt'])}": draw.choice(["\n", "\r\n"]).join(" ".join(draw.choices(words, k=draw.randint(0, 4))) for _ in range(12)) for i in range(40)}
    texts |= {"a/empty.py": "", "a/null.py": None, "a/long.js": "xy z " * 9000 + "eval(" + "foo.bar " * 900}
    rules = [(f"R{i}_{language}", language, pattern) for i, pattern in enumerate(PATTERNS) for language in [("python", "javascript")[i % 2]]]
    rules += [("ANY", "python", "[0-9]"), ("TWICE", "typescript", "eval"), ("TWICE", "typescript", "Secret")]
    got, want = both_ways(spark, files(texts), rules)
    assert got == want and len(got) > 100


def test_no_rule_no_file_and_repeated_rules(spark, files):
    some = files({"a.py": "eval(1)\neval(2)"})
    assert both_ways(spark, some, [("A", "python", "nowhere")])[0] == []
    rows = rules_table(spark, [("A", "python", "eval")] * 3 + [("B", "python", None), ("C", None, "eval")])
    assert sorted(r.line for r in indexed_rule_findings(some, rows).collect()) == [1, 2]
    assert indexed_rule_findings(some, rules_table(spark, [])).collect() == []
    assert indexed_rule_findings(some.where("false"), rows).collect() == []


def test_keys_are_the_rarest_grams(spark, files):
    some = files({"a.py": "abcd\nabce\nbcd\nxyz"})
    rules = rules_table(spark, [("A", "python", "abcd"), ("B", "python", "wxyz")])
    counts = gram_counts(some, rules)
    assert {(r.gram, r.n_lines) for r in counts.collect()} == {("abc", 2), ("bcd", 2), ("xyz", 1)}
    assert [(r.rule_id, r.gram) for r in rule_keys(rules, counts).collect()] == [("A", "abc")]


def test_rules_meet_lines_by_an_equi_join(spark, files):
    rules = rules_table(spark, [(f"R{i}", "python", f"word{i}") for i in range(3000)])
    found = indexed_rule_findings(files({"a.py": "x = word17 + word2999"}), rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.rule_id for r in found.collect()) == ["R1", "R17", "R2", "R29", "R299", "R2999"]


def test_rules_that_share_patterns_are_searched_once(spark, files):
    patterns = [r"red.*[0-9]$", r"(?i)RING", r"bolt[a-z]* ", "nowhere", "[0-9]{3}"]
    rules = rules_table(spark, [(f"R{i}", ["python", "javascript"][i % 7 == 0], patterns[i % 5]) for i in range(2000)])
    rules = rules.unionByName(rules_table(spark, [("BOTH", "python", "ring"), ("BOTH", "python", "red"), ("BOTH", "python", "red")]))
    some = files({f"a/{i}.py": "red ring 7\nbolts \nred 123\n" for i in range(30)} | {"a/x.js": "ring", "a/null.py": None})
    some = some.unionByName(files({"a/1.py": "red"}, repo=None))
    found = indexed_rule_findings(some, rules)
    want = {}
    for r in found.select("rule_id", "repo", "path").collect():
        want.setdefault(r.rule_id, []).append((r.repo, r.path))
    got = {r.rule_id: (r.n_findings, r.n_files) for r in indexed_rule_totals(some, rules).collect()}
    assert got == {rule: (len(at), len(set(at))) for rule, at in want.items()}
    assert got["BOTH"] == (30 * 3 + 1, 31) and got["R1"] == (30, 30)
    # Lines times distinct patterns, not times rules.
    assert pattern_hits(some, rules).count() == 30 * (1 + 1 + 1 + 1 + 1 + 1 + 2) + 1 + 1
