"""Centroid clusters against plain rounds in whole numbers, and what kd-trees prune."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimfold.llm import centroids


def plain_clusters(rows, k, rounds, width):
    """rows: (id, floats). The (id, cluster, distance) of every kept row and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(now)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], now


@pytest.mark.parametrize(("block", "leaf"), [(16_384, 64), (37, 3)])
def test_clusters(spark, block, leaf):
    rng = np.random.default_rng(8)
    data = [(i, [float(np.float32(x)) for x in rng.normal(i % 7, 0.2, 5)]) for i in range(500)]
    data += [(1000 + i, data[3][1]) for i in range(200)]  # a hot vector
    data += [(2000, None), (2001, [0.1, None, 0.2, 0.3, 0.4]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (2004, [1.0]), (2005, []), (None, [0.5] * 5), data[9], data[9], (77, [3.0] * 5)]
    table = spark.createDataFrame([(*d, 1, "c") for d in data], "vec_id long, embedding array<float>, cluster int, x string").repartition(3)
    found, now = centroids.cluster(centroids.integers(table, width=5), k=12, block=block, leaf=leaf)
    want, plain = plain_clusters(data, 12, 5, 5)
    assert now.tolist() == plain
    assert sorted(map(repr, ((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()))) == sorted(map(repr, want))


def test_few_no_and_extreme_rows(spark):
    make = lambda rows: centroids.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), width=2)
    found, now = centroids.cluster(make([(1, [0.0, 0.0]), (2, [1e30, -1e30]), (3, [0.0, 0.0])]), k=5)
    assert len(now) == 3 and {r["vec_id"]: r["distance"] for r in found.collect()} == {1: 0, 2: 0, 3: 0}
    assert np.abs(now).max() == centroids.LIMIT
    assert centroids.cluster(make([]), k=5)[0].count() == 0
    assert centroids.cluster(make([(None, [1.0, 1.0])]), k=5)[0].count() == 0


def test_trees_hold_counts_sums_and_boxes_and_prune():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, (300, 2)) for c in ((0, 0), (500, 0), (0, 500), (500, 500))]).astype(np.int64)
    tree = centroids.build(x, 8)
    for n in range(len(tree.start)):
        own = x[tree.order[tree.start[n] : tree.stop[n]]]
        assert (tree.lo[n] == own.min(0)).all() and (tree.hi[n] == own.max(0)).all() and (tree.total[n] == own.sum(0)).all()
    now = np.array([[0, 0], [500, 0], [0, 500], [500, 500], [-9000, 0]])
    places, _, whole = centroids.nearest(tree, x, now)
    assert len(places) < 40 and sum(int(tree.stop[n] - tree.start[n]) for n, _ in whole) + len(places) == len(x)  # nearly all by whole nodes


def test_ties_stay_with_the_smaller_number_and_sums_are_exact():
    x, now = np.array([[0, 0]] * 50 + [[2, 0]] * 3), np.array([[1, 5], [1, -5], [1, 5]])
    counts, sums = centroids.gathered(centroids.build(x, 4), x, now)
    assert counts.tolist() == [53, 0, 0] and sums[0].tolist() == [6, 0]
    big = np.array([[1 << 26, -(1 << 26)], [-(1 << 26), 1 << 26], [3, 4]])
    assert centroids.squares(big, big).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in big] for p in big]


def test_query_columns(spark):
    df = centroids.op12_centroid_clusters(spark, "/root/testdata/sf0.001")
    assert df.count() == 500 and df.select("inertia").distinct().count() == 1
    assert df.agg(F.sum("distance")).first()[0] == df.first()["inertia"]
