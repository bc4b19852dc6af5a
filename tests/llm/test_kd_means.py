import hashlib
import random

import numpy as np
import pytest

from traceloom.llm import kd_means

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k, rounds, dim, scale, seed):
    """Every vector against every centroid, in Python's integers."""
    from math import floor, isfinite

    kept = [(i, [floor(scale * x) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dim and all(x is not None and isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cents)), key=lambda z: (d(v, cents[z]), z))
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[near(v)].append(v)
        cents = [[sum(c) // len(o) for c in zip(*o)] if o else cents[z] for z, o in enumerate(own)]
    last = [(i, near(v), v) for i, v in kept]
    dist = [d(v, cents[z]) for _, z, v in last]
    by = {z: sum(x for x, r in zip(dist, last) if r[1] == z) for z in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, z, x, by[z], sum(dist), sha[z]) for (i, z, _), x in zip(last, dist)), key=str)


def test_equals_brute_force_with_ties_repeats_and_odd_rows(spark):
    r = random.Random(4)
    # Few distinct values: many equal distances and many equal vectors.
    rows = [(i % 350, [r.choice([-1.5, -0.25, 0.0, 0.25, 1.0]) for _ in range(3)], "x", None) for i in range(400)]
    rows += [(900, None, "", ""), (901, [1.0, None, 2.0], "", ""), (902, [1.0, float("nan"), 2.0], "", ""), (903, [float("inf"), 0.0, 0.0], "", ""), (904, [1.0], "", ""), (905, [], "", ""), (None, [0.5, 0.5, 0.5], "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = kd_means.cluster(df, k=6, rounds=5, dim=3, tree_rows=50, leaf=4)
    got = sorted((tuple(x) for x in kd_means.digest(found).collect()), key=str)
    assert got == brute(rows, 6, 5, 3, 1024, 3)


def test_nodes_are_assigned_whole_and_large_values_stay_exact(spark):
    r = random.Random(5)
    middles = [[r.uniform(-60_000, 60_000) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 1) for m in middles[i % 5]], "", "") for i in range(1500)]
    found = kd_means.cluster(spark.createDataFrame(rows, SCHEMA), k=5, rounds=4, dim=4, tree_rows=400, leaf=16)
    assert sorted((tuple(x) for x in kd_means.digest(found).collect()), key=str) == brute(rows, 5, 4, 4, 1024, 3)
    assert found.resolved[-1] < 750  # at least half of the vectors never met a centroid


def test_strict_dominance_only():
    points = np.array([[0, 0], [0, 2], [2, 0], [2, 2]], np.int64)
    tree = kd_means.Tree.build(points, 1)
    parts = list(kd_means.walk(tree, points, np.array([[3, 1], [-1, 1], [1, 9]], np.int64)))
    own = {}
    for z, rows, nodes in parts:
        for n in nodes:
            own.update(dict.fromkeys(tree.order[tree.start[n] : tree.end[n]].tolist(), z))
        own.update(dict.fromkeys([] if rows is None else rows.tolist(), z))
    assert own == {0: 1, 1: 1, 2: 0, 3: 0}
    # A point as far from both goes to the smaller number.
    assert [p[0] for p in kd_means.walk(kd_means.Tree.build(points[:1], 1), points[:1], np.array([[1, 0], [-1, 0]], np.int64))] == [0]


def test_few_and_no_vectors_and_too_large(spark):
    few = [(1, [0.5, 0.25], "", ""), (2, [0.0, 0.0], "", "")]
    assert sorted((tuple(x) for x in kd_means.digest(kd_means.cluster(spark.createDataFrame(few, SCHEMA), dim=2)).collect()), key=str) == brute(few, 8, 10, 2, 1024, 3)
    none = kd_means.digest(kd_means.cluster(spark.createDataFrame([], SCHEMA)))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        kd_means.cluster(spark.createDataFrame([(1, [1e30, 0.0], "", "")], SCHEMA), dim=2)
