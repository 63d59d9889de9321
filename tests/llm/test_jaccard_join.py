"""The parity-sketch join against all pairs."""

import random
import re
from pathlib import Path

from scanloom.llm.jaccard_join import bands, cells, first_of_each_group, most_apart, near_copies
import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)] + ["the", "Ünï", "of"] * 40
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for size in (3, 5, 6, 9, 20, 33, 40, 64, 70, 130, 260, 500):
        for _ in range(3):
            base = [rnd.choice(words) for _ in range(size)]
            if rnd.random() < 0.5:
                at = rnd.randrange(len(base))
                base[at:at] = passage
            rows.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rnd.choice((0, 1, 1, 2, 3, max(1, size // 25)))):
                    at = rnd.randrange(max(1, len(copy)))
                    copy[at : at + rnd.choice((0, 1, 1, 3))] = [rnd.choice(words)] * rnd.choice((0, 1))
                if rnd.random() < 0.3:
                    copy = copy[: int(len(copy) * rnd.uniform(0.7, 1))]
                rows.append((" \n" if rnd.random() < 0.2 else " ").join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


def result(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def test_like_all_pairs(spark, documents):
    rows = corpus(5) + corpus(6)[:80]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert result(near_copies(documents(rows))) == by_hand(rows)


def test_edge_cases(spark, documents):
    long = " ".join(f"x{i % 7000}" for i in range(90_000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a"), (9, "A"), (None, "a"), (11, "a b c d"), (12, "a b c d e"), (13, "a b c d e"), (13, "a b c d e"),
            (14, long), (15, long + " end"), (None, "only here and nowhere else at all")]
    assert result(near_copies(documents(rows))) == by_hand(rows)
    assert result(near_copies(documents([]))) == []


def test_rows_without_an_id_are_not_joined_all_with_all(spark, documents, monkeypatch):
    from scanloom.llm import jaccard_join

    sent = []
    whole = jaccard_join.wanted_texts
    monkeypatch.setattr(jaccard_join, "wanted_texts", lambda *a: sent.append(whole(*a).cache()) or sent[-1])
    rows = [(None, f"a b c d e f g h i j k l m n o p q r s t u v w x y z end{i}") for i in range(300)]
    rows += [(None, rows[0][1])] * 100 + [(7, f"other words that stand {'again ' * 30} and again {i % 2}") for i in range(50)]
    assert result(near_copies(documents(rows))) == by_hand(rows)
    # A text a set and task; equal rows at most once for each task that read them.
    assert sent[0].select("sig", "text").distinct().count() >= 300
    assert sent[0].count() <= 302 * 8 and sent[0].where("text like '%end5'").count() == 1


def test_a_hub_is_dealt_out(spark):
    from scanloom.llm.common import components

    hub = spark.range(1, 4001).selectExpr("cast(id as long) a", "cast(0 as long) b").unionByName(spark.range(5000, 5010).selectExpr("id a", "id + 1 b"))
    roots = {r.node: r.root for r in components(hub).collect()}
    assert roots == {i: 0 for i in range(4001)} | {i: 5000 for i in range(5000, 5011)}


def test_extra_columns_and_one_of_each(spark, documents):
    frame = documents([(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, None), (None, "a b c d e f")])
    frame = frame.selectExpr("*", "1 as sig", "2 as key", "3 as a", "4 as part")
    kept = first_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, None), (2, "a b c d e f"), (None, "a b c d e f")]


def test_bound_and_key_numbers():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 31, 32, 63, 64, 500, 3000):
        members = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        for band, most in bands(n, 75):
            assert len(cells(members, band)) >= most
    for a in range(1, 60):
        for b in range(a, 60):
            links = [i for i in range(a + 1) if 100 * i >= 75 * (a + b - i)]
            if links:
                assert a + b - 2 * min(links) <= most_apart(a + b, 75)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    from scanloom.llm.jaccard_join import op9_ngram_jaccard_join

    assert Path(folder).exists()
    assert result(op9_ngram_jaccard_join(spark, folder)) == by_hand(rows)
