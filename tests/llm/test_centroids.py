import hashlib
import random

import pytest
from check import database, differences

from scanloom.llm.centroids import MOST, blocks_of, clustered, labels_of, moved, numbers, packed_numbers, first_centroids

import numpy as np

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain(rows, clusters, rounds, dimensions, seed=3):
    """Lloyd's rounds over lists of Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and abs(x) < INF for x in v):
            kept.append((vec_id, [max(-MOST, min(MOST, int(x * 1024 // 1))) for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), label in zip(kept, labels, strict=True) if label == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centres


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def run(frame, **more):
    rows, centres = clustered(frame, **more)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in rows.collect()), key=repr), centres.tolist()


@pytest.mark.parametrize("width", [2, 3, 7])
def test_agrees_with_plain_rounds(spark, width):
    draw = random.Random(width)
    rows = [(i, [draw.gauss(i % 4, 1) for _ in range(7)]) for i in range(300)]
    rows += [(None, [0.0] * 7)] * 3 + [(5, [1.0] * 7), (5, [1.0] * 7)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 6), (1003, [NAN] * 7), (1004, [1.0] * 6 + [None]), (1005, [INF] + [0.0] * 6)]
    more = {"clusters": 5, "rounds": 4, "dimensions": 7}
    assert run(vectors(spark, rows), width=width, **more) == plain(rows, **more)


def test_ties_empty_clusters_and_bounds(spark):
    same = [(i, [0.5, -0.5]) for i in range(20)]
    more = {"clusters": 3, "rounds": 2, "dimensions": 2}
    # Three equal centroids: the first takes all, the others stay where they are.
    got, centres = run(vectors(spark, same), **more)
    assert {c for _, c, _ in got} == {0} and centres == [[512, -512]] * 3
    far = [(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [0.0, 0.0])]
    assert run(vectors(spark, far), **more) == plain(far, **more)
    few = [(1, [0.1, 0.2])]
    assert run(vectors(spark, few), **more) == plain(few, **more)


def test_nothing_usable_and_other_columns(spark):
    assert run(vectors(spark, [(1, None)]), dimensions=2) == ([], [])
    assert run(vectors(spark, []), dimensions=2) == ([], [])
    frame = spark.createDataFrame([(1, [0.5], 3, 4)], "vec_id long, embedding array<float>, cluster int, chunk int")
    assert run(frame, dimensions=1) == ([(1, 0, 0)], [[512]])


def test_numbers_come_back():
    for values in ([], [1, -1], [40_000, -5], [1 << 40, -(1 << 62)]):
        assert numbers(packed_numbers(np.array(values, np.int64))).tolist() == values


def test_blocks_are_not_shuffled_for_the_update(spark):
    draw = random.Random(1)
    frame = vectors(spark, [(i, [draw.random() for _ in range(4)]) for i in range(50)])
    blocks = blocks_of(frame, 4, 2)
    centres = first_centroids(frame, 2, 3, 4)
    sent = labels_of(blocks, centres)
    joined = blocks.vectors.hint("merge").join(sent.select("chunk", "labels").crossJoin(spark.range(2).selectExpr("cast(id as int) slice")).hint("merge"), ["chunk", "slice"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("SortMergeJoin") :]
    scan = left[: left.index("FileScan")]
    assert "Exchange" not in scan.split("SortMergeJoin")[1]
    assert moved(blocks, sent, centres).shape == (2, 4)
    blocks.dropped()


def test_query(spark):
    assert differences(spark, database(SF), SF, "op13_centroids") is None
