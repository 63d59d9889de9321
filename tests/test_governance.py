"""Owners of paths, suppressions as a table, contents scanned once, sketches that merge, and the facts as a table function."""

import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from scanloom.functions.syntax import register_py_fact_rows
from scanloom.operators import content, ranking
from scanloom.operators.owners import ancestors, owned
from scanloom.operators.scan import findings, py_facts, scan_files
from scanloom.operators.suppressions import judged, pattern_regex, pattern_root

FINDING = "repo string, path string, rule_id string, pass int, seq int, mtime timestamp"
ENTRY = "entry_id string, rule_id string, path_pattern string, valid_from timestamp, valid_to timestamp, reason string"


def day(n):
    return None if n is None else datetime(2024, 1, 1, tzinfo=timezone.utc).replace(year=2024 + n // 360, month=n % 360 // 30 + 1, day=n % 30 + 1)


def plain_owner(path, repo, roots):
    below = [p for p in path.split("/") if p]
    best = None
    for root, owner, of_repo in roots:
        parts = [p for p in root.split("/") if p]
        if root.startswith("/") == path.startswith("/") and below[: len(parts)] == parts and of_repo in (None, repo):
            best = min(best or (1, True, "~", "~"), (-len(parts), of_repo is None, owner, root))
    return best and (best[3], best[2])


@pytest.mark.parametrize("salts", [1, 16])
def test_deepest_root_owns(spark, salts):
    draw = random.Random(1)
    names = ["a", "b", "ab", "a.py"]
    path = lambda: draw.choice(["", "/"]) + "/".join(draw.choices(names, k=draw.randint(1, 5)))
    files = sorted({(draw.choice(["r", "s"]), path()) for _ in range(200)})
    roots = [(path() + draw.choice(["", "/"]), draw.choice("xyz"), draw.choice([None, "r"])) for _ in range(40)] + [("a", "w", None), ("a/", "v", "r")]
    frame = spark.createDataFrame([(*f, 1) for f in files], "repo string, path string, owner int")
    got = {(r.repo, r.path): r.root and (r.root, r.owner) for r in owned(frame, spark.createDataFrame(roots, "root string, owner string, repo string"), salts).collect()}
    assert got == {(r, p): plain_owner(p, r, roots) for r, p in files}


def test_no_root_and_root_of_all(spark):
    frame = spark.createDataFrame([("r", "a/b.py"), ("r", "/x/y.py"), (None, "a/c.py")], "repo string, path string")
    assert all(r.owner is None for r in owned(frame, spark.createDataFrame([], "root string, owner string")).collect())
    every = owned(frame, spark.createDataFrame([("", "all"), (None, "none")], "root string, owner string"))
    assert sorted((r.path, r.owner) for r in every.collect()) == [("/x/y.py", None), ("a/b.py", "all"), ("a/c.py", "all")]
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = spark.range(1).select(ancestors(F.lit("/a//b/")).alias("a")).first().a
    assert [(x.depth, x.ancestor) for x in one] == [(0, "/"), (1, "/a"), (2, "/a/b")]


GLOBS = {
    "src/*.py": ("src", ["src/a.py"], ["src/x/a.py", "src/a.pyc"]),
    "src/": ("src", ["src/a.py", "src/x/y"], ["src", "srcs/a"]),
    "src/**/t?.js": ("src", ["src/t1.js", "src/a/b/t2.js"], ["src/a/t12.js"]),
    "a+b/(c).py": ("a+b/(c).py", ["a+b/(c).py"], ["aab/(c).py"]),
    "**": ("", ["a", "a/b\nc"], []),
    "*.py": ("", ["a.py"], ["x/a.py"]),
    "/abs/**": ("/abs", ["/abs/x"], ["abs/x"]),
    "/*.py": ("/", ["/a.py"], ["/x/a.py"]),
}


def test_patterns(spark):
    frame = spark.createDataFrame([(p,) for p in GLOBS], "p string").select("p", pattern_regex(F.col("p")).alias("regex"), pattern_root(F.col("p")).alias("root"))
    for r in frame.collect():
        root, yes, no = GLOBS[r.p]
        assert r.root == root
        assert all(re.search(r.regex, x) for x in yes) and not any(re.search(r.regex, x) for x in no), r.p


def test_status_of_findings(spark):
    found = [
        ("r", "src/a.py", "NO_EXEC", 1, 0, day(10)), ("r", "src/a.py", "NO_EXEC", 1, 1, day(40)), ("r", "src/a.py", "NO_NETWORK", 1, 2, day(10)),
        ("r", "lib/a.py", "NO_EXEC", 1, 0, day(10)), (None, "src/x/b.py", "NO_EXEC", 1, 0, day(10)), ("r", "src/n.py", "NO_EXEC", 1, 0, None),
        ("r", "old/a.py", "NO_EXEC", 1, 0, day(5000)),
    ]
    entries = [
        ("wide", "*", "src/", day(0), day(30), "all of it"), ("narrow", "NO_EXEC", "src/*.py", day(0), day(20), "one rule"),
        ("alias", "COMMAND_INJECTION", "src/x/*.py", day(0), None, "by alias"), ("never", "*", "lib/**", day(20), day(10), "upside down"),
        ("long", "NO_EXEC", "old/**", day(0), day(7000), "long"), ("none", None, "src/", None, None, "no rule"), ("empty", "*", None, None, None, "no pattern"),
    ]
    rows = judged(spark.createDataFrame(found, FINDING), spark.createDataFrame(entries, ENTRY))
    got = {(r.path, r.rule_id, r.seq): (r.status, r.entry_id) for r in rows.collect()}
    assert rows.count() == len(found)
    assert got == {
        ("src/a.py", "NO_EXEC", 0): ("suppressed", "narrow"),
        ("src/a.py", "NO_EXEC", 1): ("expired", "wide"),
        ("src/a.py", "NO_NETWORK", 2): ("suppressed", "wide"),
        ("lib/a.py", "NO_EXEC", 0): ("kept", None),
        ("src/x/b.py", "NO_EXEC", 0): ("suppressed", "alias"),
        ("src/n.py", "NO_EXEC", 0): ("kept", None),
        ("old/a.py", "NO_EXEC", 0): ("suppressed", "long"),
    }
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.status for r in judged(spark.createDataFrame(found, FINDING), spark.createDataFrame([], ENTRY)).collect()} == {"kept"}


def same_scan(got, want):
    key = lambda rows: sorted((r.repo, r.path, str(r.findings), str(r.syntax_issues)) for r in rows.collect())
    assert key(got) == key(want)


def test_contents_are_scanned_once(spark, files, tmp_path):
    store = str(tmp_path / "store")
    texts = {f"c{i}.py": "DEBUG = True\n" for i in range(60)} | {f"o{i}.py": f"x = {i}\nDEBUG = True" for i in range(20)}
    texts |= {"a.js": "DEBUG = True\n", "bad.py": "x = (", "null.py": None, "empty.py": ""}
    first = files(texts)
    same_scan(content.scan_contents(first, store, "1", "one"), scan_files(first))
    assert {r.run: r.n_scanned for r in content.scanned_by_run(spark, store).collect()} == {"one": 24}
    changed = files(texts | {"o1.py": "DEBUG = True  # new", "c5.py": "x = 7\nDEBUG = True"})
    same_scan(content.scan_contents(changed, store, "1", "two"), scan_files(changed))
    assert {r.run: r.n_scanned for r in content.scanned_by_run(spark, store).collect()} == {"one": 24, "two": 1}
    rule = [("OWN", "python", "^x")]
    same_scan(content.scan_contents(changed, store, "2", "three", rule), scan_files(changed, rule))
    assert {(r.version, r.run): r.n_scanned for r in content.scanned_by_run(spark, store).collect()}[("2", "three")] == 24
    # Added twice, as by two scans at once: files still come back once.
    content.stored(spark, store).where("version = '1'").write.mode("append").partitionBy("version").parquet(store)
    same_scan(content.scan_contents(changed, store, "1", "four"), scan_files(changed))


def test_no_file_at_all(spark, files, tmp_path):
    assert content.scan_contents(files({"a.py": "x"}).where("false"), str(tmp_path / "s"), "1", "r").count() == 0


def test_sketches_merge(spark, files):
    draw = random.Random(7)
    scanned = scan_files(files({f"f{i}.py": "DEBUG = True\n" * draw.randint(0, 2) for i in range(3000)})).withColumn("day", F.hash("path") % 4)
    # Days overlap: a file scanned twice counts once.
    daily = ranking.frequency_sketches(scanned, "day").unionByName(ranking.frequency_sketches(scanned.where("day = 1"), "day"))
    merged = ranking.estimated_frequency(ranking.merged_sketches(daily)).first()
    exact = ranking.rule_frequency(scanned).where("rule_id = 'NO_DEBUG_MODE'").first()
    twice = scanned.where("day = 1").select(F.explode("findings")).count()
    assert merged.n_findings == exact.n_findings + twice and merged.n_repos_hit == 1
    assert abs(merged.n_files - exact.n_files) <= 0.05 * exact.n_files
    assert ranking.merged_sketches(ranking.frequency_sketches(scanned.where("false"))).count() == 0


def test_facts_as_a_table_function(spark, files):
    some = files({"a.py": "x = 1\ntry:\n    f(x)\nexcept:\n    pass", "b.py": "y = (", "c.js": "z = 1", "n.py": None, "e.py": ""})
    register_py_fact_rows(spark)
    python = some.where("language = 'python'")
    got = spark.sql("SELECT * FROM py_fact_rows(TABLE(SELECT path, text, repo FROM {files}) PARTITION BY path)", files=python)
    want = py_facts(some)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    without = spark.sql("SELECT * FROM py_fact_rows(TABLE(SELECT path, text FROM {files}) PARTITION BY path)", files=python)
    assert {r.repo for r in without.collect()} == {None}
    assert findings(scan_files(some)).count() > 0


def test_findings_are_neither_broadcast_nor_read_twice(spark):
    found = [("r", f"src/{i}.py", "NO_EXEC", 0, 0, day(5)) for i in range(4)] + [(None, None, "NO_EXEC", 0, 0, None), ("r", "src/0.py", "NO_EXEC", 0, 0, day(5))]
    entries = [(f"e{i}", "NO_EXEC", f"src/0.p{'y' if i else '*'}", None, day(i + 1), "why") for i in range(3)]
    frame = spark.createDataFrame(found, FINDING).repartition(2, "path")
    rows = judged(frame, spark.createDataFrame(entries, ENTRY))
    got = sorted((str(r.path), r.status, r.entry_id) for r in rows.collect())
    assert got == [("None", "kept", None)] + [("src/0.py", "expired", "e2")] * 2 + [(f"src/{i}.py", "kept", None) for i in (1, 2, 3)]
    plan = judged(frame, spark.createDataFrame(entries, ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_a_computed_text_is_computed_once_for_its_digest(spark, files):
    computed = files({"a.py": "x", "b.py": None}).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[a-c]", "_"))
    plan = content.contents(computed)._jdf.queryExecution().executedPlan().toString()
    assert sum(line.count("regexp_replace(") for line in plan.splitlines() if "FileScan" not in line) == 1
    assert content.contents(computed).count() == 2


def test_documents_keep_the_same_characters(spark):
    from scanloom.plans.catalog import NOT_PLAIN

    codes = [c for c in [*range(0x3100), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    text = "".join(map(chr, codes))
    row = spark.createDataFrame([(text,)], "text string").select(F.regexp_replace("text", NOT_PLAIN, "_").alias("text")).first()
    assert row.text == re.sub(r"[^\x20\x21\x23-\x29\x2B-\x5B\x5D-\x7E\n]", "_", text)
    # The listed characters themselves: a negated union is tested twenty times slower.
    assert not NOT_PLAIN.startswith("[^")


def test_facts_as_rows_come_by_groups_of_files_in_as_many_tasks_as_asked(spark):
    from scanloom.plans.catalog import QUERIES

    plan = QUERIES["py_fact_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # An exchange of Spark's own may be joined to a few tasks, as paths and short texts are small beside the work on them.
    assert any("hashpartitioning(deal" in line for line in exchanges) and all("REPARTITION_BY_NUM" in line for line in exchanges)


@pytest.mark.parametrize("name", ["file_owners", "counterparts"])
def test_tables_of_all_files_are_not_broadcast(spark, name):
    from scanloom.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") >= 2
