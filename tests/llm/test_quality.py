"""Held-out accuracy and calibration, tokens, and edge cases."""

import zlib

import numpy as np
import pyarrow as pa

from scanloom.llm.quality import SIZE, Network, context_sums, corpus_contexts, fitted, learned, op5_quality, pooled, scored, tokens, word_vectors


def rows_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0].tolist()


def test_marks_of_words():
    assert rows_of("The the") == [*rows_of("the"), *rows_of("the"), rows_of("x x")[-1]]
    assert rows_of("ab***") == [*rows_of("ab"), *rows_of("***")]
    assert rows_of("AB") == [*rows_of("ab"), rows_of("XYZ")[-1]]
    assert rows_of("") == rows_of(" \n") == []


def test_held_out(spark):
    rows = {r.doc_id: r for r in op5_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(rows) == 10_000
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    pairs = [(rows[x.doc_id].score, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(pairs) > 500
    score, label = (np.array(c) for c in zip(*pairs))
    assert ((score >= 0.7) == label).mean() > 0.97
    good, bad = score[label == 1], score[label == 0]
    assert (good[:, None] > bad).mean() > 0.98
    assert abs(score.mean() - label.mean()) < 0.03


def test_edge_cases(spark, documents):
    docs = documents([(i, f"word{i} other{i % 3} text" if i % 3 else "BAD!! BAD!! BAD!!") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    vectors, network = learned(docs, labels)
    rows = [(1, None), (2, ""), (2, ""), (None, "BAD!! BAD!! BAD!!"), (4, "word9 other1 text"), (5, "z " * 60_000)]
    frame = documents(rows).selectExpr("*", "'s' as score", "1 as x", "2 as chunk")
    got = scored(frame, vectors, network).collect()
    assert len(got) == len(rows) and len({r.score for r in got if not r.text}) == 1
    by = {r.text: r.score for r in got}
    assert by["word9 other1 text"] > 0.7 > 0.3 > by["BAD!! BAD!! BAD!!"]
    vectors, network = learned(documents([]), labels)
    assert [r.score for r in scored(documents([(1, "a")]), vectors, network).collect()] == [0.5]
    assert scored(documents([]), vectors, network).collect() == []


def test_contexts_by_hand():
    from scanloom.llm.quality import index_vectors

    places, signs = index_vectors()
    words = rows_of("aa bb cc dd")
    want = np.zeros((1 << 14, SIZE))
    for i, w in enumerate(words):
        for j in range(max(0, i - 2), min(len(words), i + 3)):
            if j != i:
                np.add.at(want[w], places[words[j]], signs[words[j]])
    assert np.allclose(context_sums(pa.array(["aa bb", "", "aa bb cc dd"])) - context_sums(pa.array(["aa bb"])), want)


def test_network_learns_a_curve_and_its_temperature():
    rnd = np.random.default_rng(2)
    x = (rnd.normal(0, 1, (4000, SIZE)) * (np.arange(SIZE) < 4)).astype(np.float32)
    y = (rnd.random(4000) < np.where(x[:, 0] * x[:, 1] > 0, 0.9, 0.1)).astype(int)
    net = fitted(x, y)
    assert isinstance(net, Network) and net.temperature > 1
    assert ((net.scores(x[4::5]) > 0.5) == y[4::5]).mean() > 0.75
    assert pooled(pa.array([None, "a"]), np.ones((1 << 14, SIZE), np.float32)).sum(axis=1).tolist() == [0, SIZE]


def test_contexts_come_from_all_documents(spark, documents):
    rows = [(i, f"alpha beta w{i % 7} gamma") for i in range(50)] + [(None, "alpha delta"), (60, None), (61, "")]
    whole = context_sums(pa.array([t for _, t in rows]))
    assert (corpus_contexts(documents(rows).repartition(5)) == whole).all() and whole.any()
    # A word that no labelled text holds has its surroundings too.
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    vectors, _ = learned(documents(rows), labels)
    assert (vectors == word_vectors(whole)).all()
    assert not corpus_contexts(documents([])).any()


def test_a_score_at_the_cut_counts_as_good(spark):
    from scanloom.llm.quality import CUT

    frame = spark.createDataFrame([(CUT,), (float(np.nextafter(CUT, 0)),)], "score double")
    assert [r.p for r in frame.selectExpr(f"int(score >= {CUT}D) p").collect()] == [1, 0]
