"""Mixing against its SQL, against numeric integration, and on edge cases."""

import duckdb
import pytest
from check import database, differences

from pyspark.sql import functions as F

from scanloom.llm.common import range_sums
from scanloom.llm.mixing import ORACLE, SCHEDULES, mixed_documents, op1_mixing, time_at, training_order, words_in


def rows_of(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op1_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken", "copies", "position").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(f"SELECT doc_id, size, source_size, target, taken, copies, position FROM ({ORACLE['op1_mixing']})").fetchall()
    assert got == sorted(map(tuple, sql), key=str)
    return got


def test_whole_table(spark):
    assert differences(spark, database("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "op1_mixing") is None


def test_targets_are_met(spark):
    rows = op1_mixing(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
        taken, most, target = by.get(r.source_size, (0, 0, 0))
        by[r.source_size] = (taken + r.taken, max(most, r.size), r.target)
    assert all(abs(taken - target) <= most / 2 + 1 for taken, most, target in by.values())
    assert abs(sum(t for _, _, t in by.values()) - sum(r.size for r in rows)) < 1


def test_edge_cases(spark, tmp_path):
    long = "w " * 50_000
    rows = [(1, "a b c", None, "x", 0), (1, "a b c", None, "x", 0), (2, None, None, "x", 0), (3, "", None, "y", 0), (4, long, None, None, 0),
            (None, "d e", None, "é", 0), (None, "d e", None, "é", 0), (7, "one", None, "", 0), (8, " \t x  y", None, "z", 0)]
    got = rows_of(spark, tmp_path, rows)
    assert len(got) == len(rows)
    assert {r[2] for r in got if r[0] == 4} == {50_000}


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, []) == []


def test_order_of_training(spark, documents):
    frame = documents([(i, "w " * (i % 7)) for i in range(60)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4)).selectExpr("*", "1 as size", "2 as place", "3 as copies")
    mixed = mixed_documents(frame.withColumn("size", words_in(F.col("text"))).withColumn("tie", F.lit(0)).drop("place", "copies"))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    out = training_order(frame.drop("size", "place", "copies"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in out.collect()]
    assert {i: ids.count(i) for i in copies} == copies


@pytest.mark.parametrize("knots", SCHEDULES + (((0.0, 0.0), (0.25, 2.0), (0.75, 0.5), (1.0, 0.0)),))
def test_inverse_of_the_integral(spark, knots):
    def density(t):
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if t <= b:
                return x + (y - x) * (t - a) / (b - a)
        return 0

    steps = 20_000
    sums, total = [], 0.0
    for i in range(steps):
        total += density((i + 0.5) / steps)
        sums.append(total)
    shares = [i / 50 for i in range(51)]
    times = spark.createDataFrame([(s,) for s in shares], "s double").select("s", time_at(F.col("s"), knots).alias("t")).collect()
    for r in times:
        at = min(steps, max(0, round(r.t * steps)))
        assert abs((sums[at - 1] / total if at else 0) - r.s) < 1e-3


def test_rows_without_an_id_are_split(spark, tmp_path):
    rows = [(None, "w " * (i % 9), None, "x", 0) for i in range(1500)] + [(None, "same text", None, "x", 0)] * 1500
    rows += [(i, "a b", None, None, 0) for i in range(300)]
    assert len(rows_of(spark, tmp_path, rows)) == len(rows)


def test_ranges_stay_even(spark):
    rows = spark.range(4000).selectExpr("id as row", "cast(null as string) as g", "1L as size", "0 as tie")
    line, sums = range_sums(rows, "g", ["tie", "row"], "size")
    assert sorted(r.before for r in line.collect()) == list(range(4000))
    sizes = [r["__size"] for r in sums.collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1000
