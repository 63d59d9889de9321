import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from check import database, differences
from pyspark.sql import functions as F

from scanloom.llm.importance import _of_batch, bucket_gains, drawn, gain_planes, gumbel, plane_weights, resampled

SF = "/root/testdata/sf0.001"


def features(text, run=1):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)], len(words)


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, percent, buckets, run=1, seed=2024, least=20):
    """doc_id, n_features, weight, score, rank, by dictionaries."""
    s = Counter(bucket(f, buckets) for _, t in docs for f in features(t, run)[0])
    t = Counter(bucket(f, buckets) for x in target for f in features(x, run)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        mine, words = features(text, run)
        weight = sum(gain[bucket(f, buckets)] for f in mine)
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def run(docs, target, **more):
    rows = resampled(docs, target, **more).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=repr)


def texts(n, seed):
    draw = random.Random(seed)
    words = ["The", "the", "naïve", "x" * 90, "a1", "Ünï", "end", "_", "日本", "\x00b", "q" * 64, "r" * 65]
    return [draw.choice([" ", "\n", "-"]).join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(n)] + [None, "", "...", "the " * 9000]


@pytest.mark.parametrize("width", [1, 3])
def test_agrees_with_dictionaries(spark, documents, width):
    docs = list(enumerate(texts(60, width)))
    target = texts(5, 9)
    got = run(documents(docs), spark.createDataFrame([(t,) for t in target], "text string"), run=width, buckets=101, percent=30)
    assert got == plain(docs, target, 30, 101, width)


def test_planes_give_exact_weights():
    draw = np.random.default_rng(3)
    gains = draw.integers(-9000, 9000, 997)
    owner = np.sort(draw.integers(0, 150, 40_000))
    found = draw.integers(0, 997, 40_000)
    found[:9000] = 5
    want = np.zeros(150, np.int64)
    np.add.at(want, owner, gains[found])
    assert (plane_weights(found, owner, 150, gain_planes(gains), 997) == want).all()
    assert plane_weights(found[:0], owner[:0], 2, gain_planes(gains * 0), 997).tolist() == [0, 0]


def test_buckets_are_crc_of_whole_features():
    some = texts(50, 4)
    for low, high, found, owner, words in _of_batch(pa.array(some), 2, 10_000):
        for i in range(low, high):
            want, n = features(some[i], 2)
            assert sorted(found[owner == i - low].tolist()) == sorted(bucket(f, 10_000) for f in want)
            assert words[i - low] == n


def test_ties_and_repeated_rows(spark):
    rows = [(7, 30, 5), (3, 30, 5), (None, 30, 5), (3, 30, 5), (1, 19, 99), (2, 30, 6)] * 2
    out = drawn(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), percent=70, least_words=20).collect()
    ranked = sorted((r["rank"], r.doc_id) for r in out if r["rank"])
    assert ranked == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 3), (6, 3), (7, 7)]
    assert sum(r["rank"] is None for r in out) == 5


def test_empty_tables_and_other_columns(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert run(documents([]), none) == []
    docs = spark.createDataFrame([(1, "a b " * 20, 9, 9)], "doc_id long, text string, weight int, score int")
    assert run(docs, none, percent=100) == plain([(1, "a b " * 20)], [], 100, 10_000)
    assert len(bucket_gains(docs, none)) == 10_000


def test_null_id_draws_as_empty(spark):
    row = spark.createDataFrame([(None,), (5,)], "doc_id long").select(gumbel(F.col("doc_id"))).collect()
    want = []
    for name in ("2024:", "2024:5"):
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        want.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    assert [r[0] for r in row] == want


def test_query(spark):
    assert differences(spark, database(SF), SF, "op12_importance") is None
