"""Held-out accuracy, mixtures of known proportions, and EM against a grid."""

import itertools
import zlib

import numpy as np

from scanloom.llm.language import PENALTY, accepted, identify, learned, letters_of, mixture, ngram_bins, op6_language_id, proportions, with_language


def test_held_out_accuracy(spark):
    rows = op6_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 150
    right = sum(r.lang_pred == langs[r.doc_id][0] for r in held)
    assert right >= 0.98 * len(held), [(r, langs[r.doc_id][1][:80]) for r in held if r.lang_pred != langs[r.doc_id][0]]


def test_known_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learned(docs)
    texts = {}
    for r in docs.where("length(text) between 2000 and 6000").collect():
        texts.setdefault(r.lang, r.text)
    for share in (0.25, 0.5, 0.75):
        n = int(2000 * share)
        _, scores, mixes = identify([texts["de"][:n] + " " + texts["fr"][: 2000 - n]], model)
        found = dict((k, float(v)) for k, v in (x.split(":") for x in mixes[0].split(",")))
        assert set(found) == {"de", "fr"} and abs(found["de"] - share) < 0.12


def test_em_is_the_best_of_a_grid():
    rnd = np.random.default_rng(3)
    chances = rnd.dirichlet(np.ones(40) * 0.3, 2).T + 1e-4
    counts = rnd.multinomial(500, 0.3 * chances[:, 0] / chances[:, 0].sum() + 0.7 * chances[:, 1] / chances[:, 1].sum()).astype(float)
    some = counts > 0
    found = mixture(chances[some], counts[some])
    grid = max(np.linspace(0.001, 0.999, 999), key=lambda a: counts[some] @ np.log(chances[some] @ [a, 1 - a]))
    assert abs(found[0] - grid) < 0.02


def test_ngrams_stay_inside_a_text():
    one = [sorted(ngram_bins(*letters_of([t]))[0].tolist()) for t in ("Ab c", "é-x", "", "..", "𐐀b")]
    bins, owner = ngram_bins(*letters_of(["Ab c", "é-x", "", "..", "𐐀b"]))
    assert [sorted(bins[owner == i].tolist()) for i in range(5)] == one
    assert one[2] == one[3] == [] and len(one[4]) == 3


def test_edge_cases(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learned(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (3, "123 !!"), (None, "der und die das"), (5, "the of and " * 40_000), (6, "x")]
    frame = documents(rows).selectExpr("*", "'q' as lang_pred", "1 as score", "2 as bin")
    got = {(r.doc_id, (r.text or "")[:9]): (r.lang_pred, r.score) for r in with_language(frame, model).collect()}
    assert got[(1, "")] == got[(2, "")] == got[(3, "123 !!")] == ("und", 0.0)
    assert got[(None, "der und d")][0] == "de" and got[(5, "the of an")][0] == "en"
    kept = accepted(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {None, 5} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    nothing = learned(documents([(1, "a"), (2, None)]))
    assert [r.lang_pred for r in with_language(documents([(1, "a")]), nothing).collect()] == ["und"]
    assert with_language(documents([]), model).collect() == []


def test_unlearned_and_scrambled_texts_go(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 300 and 3000")
    model = learned(docs)
    clean = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью",
    ]
    rnd = np.random.default_rng(1)
    scrambled = ["".join(rnd.permutation(list(t))) for t in clean[:10]]
    kept = accepted(documents(list(enumerate(clean + foreign + scrambled))), model).collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(clean)))


def test_chosen_set_is_the_best_of_all(spark):
    """The penalised likelihood of the languages found, against every set of languages."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 1500 and 5000")
    model = learned(docs)
    texts = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text)
    langs = sorted(texts)
    mixed = [texts[a][i][:700] + " " + texts[b][i][: 700 * (i + 1) // 3] for i in range(3) for a, b in itertools.combinations(langs, 2)]
    mixed += [" ".join(texts[a][5][:500] for a in langs[:3]), *(texts[a][6] for a in langs)]
    for text in mixed:
        seen = np.bincount(ngram_bins(*letters_of([text]))[0], minlength=len(model.chances))
        own = np.flatnonzero(seen)
        chances, counts = model.chances[own], seen[own].astype(float)
        price = PENALTY * np.log(counts.sum() + 1)

        def worth(chosen):
            start = np.full(len(chosen), 1 / len(chosen))
            return proportions(chances[:, list(chosen)], counts, start)[1] - price * (len(chosen) - 1)

        every = [c for n in range(1, len(langs) + 1) for c in itertools.combinations(range(len(langs)), n)]
        assert tuple(sorted(mixture(chances, counts))) == max(every, key=worth)


def test_equal_languages_give_the_first():
    chances = np.repeat(np.array([[0.2], [0.8]]), 3, axis=1)
    assert mixture(chances, np.array([3.0, 5.0])) == {0: 1.0}
