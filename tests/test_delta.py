"""Ordered deltas: both texts come back from the script, and moved, repeated and edited lines are seen."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators.delta import hunk_headers, hunks, line_script, rising, unified_text

NUMBERS = [str(i) for i in range(1, 13)]


def pairs(spark, texts):
    rows = [("r", str(i), "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(texts)]
    return spark.createDataFrame(rows, "repo string, path string, old_text string, new_text string")


def scripts(frame):
    out = {}
    for r in sorted(line_script(frame).collect(), key=lambda r: (r.path, r["at"])):
        out.setdefault(int(r.path), []).append((r.mark, r.old_no, r.new_no, r.line))
    return out


def longest_rising(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


def test_longest_rising_run(spark):
    draw = random.Random(2)
    lists = [draw.sample(range(100), draw.randint(0, 30)) for _ in range(60)] + [list(range(20)), list(range(20, 0, -1))]
    rows = [(i, [(k, v) for k, v in enumerate(values)]) for i, values in enumerate(lists)]
    frame = spark.createDataFrame(rows, "id int, pairs array<struct<old_no:int,new_no:int>>")
    for r in frame.select("id", rising(F.col("pairs")).alias("run")).collect():
        news = [p.new_no for p in r.run]
        assert news == sorted(news) and [p.old_no for p in r.run] == sorted(p.old_no for p in r.run)
        assert {(p.old_no, p.new_no) for p in r.run} <= set(rows[r.id][1]) and len(news) == longest_rising(lists[r.id])


def test_both_texts_come_back(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(60):
        old = draw.choices(["{", "}", "", *NUMBERS], k=draw.randint(1, 25))
        new = [x for x in old if draw.random() > 0.15]
        for _ in range(draw.randint(0, 4)):
            new.insert(draw.randint(0, len(new)), draw.choice([*old, "new", "}"]))
        texts.append((old, new or ["only"]))
    # A last line that is empty is no line.
    texts = [([*a, "end"], [*b, "end"]) for a, b in texts]
    got = scripts(pairs(spark, texts))
    for i, (old, new) in enumerate(texts):
        assert [r[3] for r in got[i] if r[0] != "+"] == old
        assert [r[3] for r in got[i] if r[0] != "-"] == new
        assert [r[1] for r in got[i] if r[1]] == list(range(1, len(old) + 1))
        assert [r[2] for r in got[i] if r[2]] == list(range(1, len(new) + 1))


EDITED = [*NUMBERS[:5], "x", *NUMBERS[6:]]
MOVED = ["1", *NUMBERS[2:10], "2", "11", "12"]
REPEATED = [*NUMBERS[:4], "4", *NUMBERS[4:]]
ENDS = ["a", *NUMBERS[1:11], "z"]
TWICE = (["h", "x", "A", "x", "t"], ["h", "x", "B", "x", "t"])


def test_moved_repeated_and_edited_lines(spark):
    got = scripts(pairs(spark, [(NUMBERS, n) for n in (EDITED, MOVED, REPEATED, ENDS)] + [TWICE]))
    changes = {i: [(m, o if m == "-" else n, x) for m, o, n, x in rows if m != " "] for i, rows in got.items()}
    assert changes == {
        0: [("-", 6, "6"), ("+", 6, "x")],
        1: [("-", 2, "2"), ("+", 10, "2")],
        2: [("+", 5, "4")],
        3: [("-", 1, "1"), ("+", 1, "a"), ("-", 12, "12"), ("+", 12, "z")],
        4: [("-", 3, "A"), ("+", 3, "B")],
    }


def test_hunks_and_text(spark):
    frame = pairs(spark, [(NUMBERS, EDITED), (NUMBERS, MOVED), (NUMBERS, ENDS), (["a"], []), ([], ["a"])])
    shown = hunks(line_script(frame))
    heads = sorted((r.path, r.hunk, r.header) for r in hunk_headers(shown).collect())
    assert heads == [
        ("0", 1, "@@ -3,7 +3,7 @@"),
        ("1", 1, "@@ -1,5 +1,4 @@"),
        ("1", 2, "@@ -8,5 +7,6 @@"),
        ("2", 1, "@@ -1,4 +1,4 @@"),
        ("2", 2, "@@ -9,4 +9,4 @@"),
        ("3", 1, "@@ -1,1 +0,0 @@"),
        ("4", 1, "@@ -0,0 +1,1 @@"),
    ]
    texts = {r.path: r.diff for r in unified_text(shown).collect()}
    assert texts["1"].split("\n") == ["@@ -1,5 +1,4 @@", " 1", "-2", " 3", " 4", " 5", "@@ -8,5 +7,6 @@", " 8", " 9", " 10", "+2", " 11", " 12"]
    assert [r.mark for r in hunks(line_script(frame), 0).where("path = '0'").orderBy("at").collect()] == ["-", "+"]


@pytest.mark.parametrize("texts", [[], [([], [])], [(["same"], ["same"])]])
def test_nothing_changed(spark, texts):
    script = line_script(pairs(spark, texts))
    assert script.where("mark <> ' '").count() == 0 and hunks(script).count() == 0


def test_nothing_is_joined_all_with_all(spark):
    plan = line_script(pairs(spark, [(NUMBERS, MOVED)]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_script_needs_no_shuffle_and_no_join(spark):
    plan = line_script(pairs(spark, [(NUMBERS, MOVED)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_whole_texts_from_a_script_take_one_shuffle(spark):
    script = line_script(pairs(spark, [(NUMBERS, MOVED)]))
    texts = script.groupBy("path").agg(F.collect_list("line"))
    assert texts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_texts_come_from_the_script_in_the_row(spark):
    from scanloom.operators.delta import line_scripts, script_text

    texts = [(NUMBERS, MOVED), ([], ["a", "b"]), (["a", "", "b"], []), ([], []), (["x", "x", "y"], ["y", "x", "x", "", "z"])]
    got = line_scripts(pairs(spark, texts)).select(F.col("path").cast("int").alias("i"), script_text(F.col("script"), "-").alias("old"), script_text(F.col("script"), "+").alias("new"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert {r.i: (r.old, r.new) for r in got.collect()} == {i: ("\n".join(old), "\n".join(new)) for i, (old, new) in enumerate(texts)}
