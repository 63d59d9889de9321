"""Scores against counting by hand."""

import math
import random
import re
from collections import Counter

import pytest

from scanloom.llm.lm_scores import op2_lm_scores, route, scored


def by_hand(rows, order, backoff=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [count(w) for w in words]
    total = sum(own, Counter())
    every = sum(map(len, words))
    out = []
    for (doc, _), w, mine in zip(rows, words, own):
        score, backed = 0.0, 0
        others = max(1, every - len(w))
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                c = total[gram] - mine[gram]
                if c:
                    base = total[gram[:-1]] - mine[gram[:-1]] if n > 1 else others
                    score += math.log(c / base) + (most - n) * math.log(backoff)
                    backed += n < most
                    break
            else:
                score += most * math.log(backoff) - math.log(others)
                backed += 1
        out.append((doc, len(w), round(score, 6), backed))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.backed_off) for r in frame.collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_like_counting(spark, documents, order):
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice(("a", "B", "b", "c", "dé", "e", "the")) for _ in range(rnd.randrange(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a b c"), (203, "once only"), (204, "a b c"), (204, "a b c"), (205, "the a " * 20_000)]
    assert result(scored(documents(rows).selectExpr("*", "1 as part", "2 as range"), order)) == by_hand(rows, order)


def test_one_text_and_none(spark, documents):
    assert result(scored(documents([(1, "a b")]))) == by_hand([(1, "a b")], 2)
    assert scored(documents([])).collect() == []


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert result(op2_lm_scores(spark, "/root/testdata/sf0.001")) == by_hand(rows, 2)


def test_query_scores_trigrams(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op2_lm_scores(spark, "/root/testdata/sf0.001").selectExpr("doc_id", "n_words", "log_score_3 as log_score", "backed_off_3 as backed_off")
    assert result(got) == by_hand(rows, 3)


@pytest.mark.parametrize("fan, steps", [(2, 3), (3, 2), (8, 1)])
def test_any_number_of_steps(spark, documents, fan, steps):
    rnd = random.Random(fan)
    rows = [(i, " ".join(rnd.choice(("a", "b", "c", "dé", "e", "the", f"x{i % 5}")) for _ in range(rnd.randrange(0, 30)))) for i in range(150)]
    rows += [(None, "a b c"), (None, "a b c"), (300, None), (301, "alone here")]
    assert route(8, 8, fan).steps == steps
    got = scored(documents(rows), 3, fan=fan)
    assert result(got) == by_hand(rows, 3)
    # Blocks of a step are shuffled once, though they are read on both ways.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= steps


def test_routes():
    rnd = random.Random(5)
    for _ in range(300):
        parts, ranges, fan = rnd.randrange(1, 400), rnd.randrange(1, 400), rnd.randrange(2, 40)
        way = route(parts, ranges, fan)
        assert way.fan <= fan or way.steps == 1
        nodes = {(p, 0) for p in range(parts)}
        for step in range(way.steps):
            sent = [((way.group(step + 1, g), r), g) for g, run in nodes for r in way.narrower(step, run)]
            heard = Counter(node for node, _ in sent)
            assert max(heard.values()) <= way.fan and len(sent) <= way.fan * len(nodes)
            # All ranges are reached, and a node of the next step lies in one run of this one.
            assert {r for (_, r), _ in sent} == set(range(way.runs(step + 1)))
            nodes = set(heard)
        assert nodes == {(0, r) for r in range(ranges)}
