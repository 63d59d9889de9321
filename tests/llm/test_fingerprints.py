"""Consistent weighted sampling against exact similarity, and neighbours against a plain sort."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from scanloom.llm.fingerprints import SAMPLES, _in_blocks, compared_with_next, fingerprints, likeness, op7_fingerprints, variables, weighted_words


def weights(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return Counter({w: n * len(w.encode()) for w, n in Counter(words).items()})


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_estimate_similarity():
    rnd = random.Random(4)
    words = [f"{'x' * rnd.randrange(1, 9)}{i}" for i in range(400)]
    errors, pairs = [], 0
    for share in (0, 10, 30, 60, 90, 100):
        for _ in range(25):
            a = [rnd.choice(words) for _ in range(rnd.randrange(20, 400))]
            keep = len(a) * share // 100
            b = a[:keep] + [rnd.choice(words) for _ in range(len(a) - keep)]
            x, y = fingerprints(pa.array([" ".join(a), " ".join(b)]))
            errors.append(likeness(x, y) - jaccard(" ".join(a), " ".join(b)))
            pairs += 1
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.07


def test_distribution_of_variables():
    rate, log_size, shift = variables(np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64))
    assert abs(rate.mean() - 2) < 0.01 and abs(rate.var() - 2) < 0.05
    assert abs(np.exp(log_size).mean() - 2) < 0.01 and abs(shift.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(rate.ravel(), shift.ravel())[0, 1]) < 0.01


def test_blocks_agree():
    rnd = random.Random(2)
    words = np.array([rnd.getrandbits(64) for _ in range(3000)], np.uint64)
    one, weight = weighted_words(words, np.array([rnd.randrange(1, 9) for _ in words]))
    from scanloom.llm.fingerprints import _draws

    assert (_draws(*variables(one), weight, one) == _in_blocks(one, weight, 700)).all()


def test_long_words_weigh_all_their_bytes():
    rnd = random.Random(8)
    found, want = [], []
    for i in range(60):
        long = [chr(97 + rnd.randrange(26)) * rnd.choice((255, 256, 1000, 4000)) + str(k) for k in range(3)]
        short = [f"w{rnd.randrange(900)}" for _ in range(300)]
        a, b = " ".join([*long, *short]), " ".join([*long[: i % 4], *short[:200], *(f"v{k}" for k in range(100))])
        x, y = fingerprints(pa.array([a, b]))
        found.append(likeness(x, y))
        want.append(jaccard(a, b))
    errors = np.array(found) - np.array(want)
    assert abs(errors.mean()) < 0.03 and max(abs(np.mean(errors[i::4])) for i in range(4)) < 0.05


def plain(rows, spark):
    names = {t: spark.sql("SELECT xxhash64(:t)", {"t": t}).first()[0] for t in {r[1] or "" for r in rows if sum(x[0] == r[0] for x in rows) > 1}}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), names.get(r[1] or "", 0)))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = fingerprints(pa.array([text, edit, after]))
        out.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def compare(frame, rows):
    got = frame.collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256 if "edited_sha256" in r else bytes(r.sha).hex(), *([r.fingerprint, r.edited_fingerprint] if "fingerprint" in r else [bytes(r.own).hex(), bytes(r.edit).hex()]), r.near_edited, r.near_next) for r in got]
    assert sorted(got, key=str) == plain(rows, frame.sparkSession)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    compare(op7_fingerprints(spark, "/root/testdata/sf0.001"), rows)


def test_edge_cases(spark, documents):
    long = " ".join(f"ü{i}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (4, "b"), (None, "x y"), (None, None), (9, long), (-5, "ab cd")]
    compare(compared_with_next(documents(rows).selectExpr("*", "1 as kind", "2 as place", "3 as own")), rows)
    compare(compared_with_next(documents([(7, "one two three")])), [(7, "one two three")])
    assert compared_with_next(documents([])).collect() == []
    assert len(fingerprints(pa.array(["a"]))[0]) == 2 * SAMPLES
