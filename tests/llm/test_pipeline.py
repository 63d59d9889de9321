"""The pipeline against plain versions of its stages, and each stage on edge cases."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from test_decontamination import by_hand as leaks_by_hand
from test_jaccard_join import by_hand as groups_by_hand

import corpus_pipeline
from scanloom.llm.language import ACCEPTED_SHARE, LEAST_GAIN, fitted, learned
from scanloom.llm.mixing import ORACLE

SF = "/root/testdata/sf0.001"


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = learned(spark.read.parquet(f"{SF}/documents.parquet"))
    langs, scores, _, fits = fitted([r[1] for r in rows], model)
    rows = [r for r, lang, score, fit in zip(rows, langs, scores, fits) if lang != "und" and score >= ACCEPTED_SHARE and fit >= LEAST_GAIN]
    kept = {d for d, _, c in groups_by_hand([r[:2] for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {t for t, _ in leaks_by_hand([r[1] for r in rows], items)}
    rows = [r for i, r in enumerate(rows) if i not in leaked]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({ORACLE['op1_mixing']})").fetchall())
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and Counter(r.doc_id for r in got) == {d: n for d, n in copies.items() if n}
    texts = {r[0]: r[1] for r in rows}
    homes, slots = {}, {}
    for r in got:
        assert r.text == texts[r.doc_id] and r["size"] == len(r.text.encode()) + 8
        homes.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_edge_cases_of_stages(spark, tmp_path, documents, name, stage):
    bench = spark.createDataFrame([(1, "word after word of a passage that the benchmark has in it, long enough to be found"), (None, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    base = [(1, "the cat and the dog went out to see the sea " * 3, "en", "a", 3), (1, "the cat and the dog went out to see the sea " * 3, "en", "a", 3),
            (2, None, None, None, None), (3, "", "de", "", 0), (None, "der hund und die katze gehen an das meer", "de", None, None),
            (5, "der Mond und die Sonne " * 40_000, "de", "b", 9), (6, "12 34 !!", None, "b", 1)]
    extra = ["1 as size", "2 as before", "3 as copies", "4 as score", "5 as sig", "6 as place", "'x' as target", "7 as component_id", "8 as __count"]
    frame = documents(base).selectExpr("*", *extra)
    got = stage(spark, frame, str(tmp_path))
    if name != "sharding":
        assert got.columns == frame.columns
    rows = got.collect()
    ids = Counter(r.doc_id for r in rows)
    assert {r.before for r in rows} == {2} and {r.copies for r in rows} == {3}
    if name == "language_id":
        assert ids == {1: 2, None: 1, 5: 1}
    elif name == "near_copies":
        assert ids == {1: 1, 2: 1, 3: 1, None: 1, 5: 1, 6: 1}
    elif name == "decontamination":
        assert ids == Counter(r[0] for r in base)
    elif name == "sharding":
        assert ids == Counter(r[0] for r in base) and all(r.shard is not None for r in rows)
    assert stage(spark, documents([]), str(tmp_path)).collect() == []
