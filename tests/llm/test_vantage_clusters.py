"""Clusters against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from spatialframes.llm import vantage_clusters as vc


def brute_nearest(points, centroids):
    out = []
    for p in points:
        apart = [sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids]
        out.append((apart.index(min(apart)), min(apart)))
    return out


def brute(rows, k, rounds, dims, scale):
    """Rows (id, cluster, distance) and the centroids."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), [str(x) for x in r[1]]))[:k]]
    if not kept:
        return [], []
    for _ in range(rounds):
        own = brute_nearest([v for _, v in kept], centroids)
        for c in range(len(centroids)):
            members = [v for (_, v), (number, _) in zip(kept, own, strict=True) if number == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = brute_nearest([v for _, v in kept], centroids)
    return sorted(((i, *o) for (i, _), o in zip(kept, own, strict=True)), key=str), centroids


@pytest.mark.parametrize("k", [1, 2, 3, 8, 40])
@pytest.mark.parametrize("size", [2, 1000, 10**9, 10**30])
def test_tree(k, size):
    rng = random.Random(k)
    centroids = [[rng.randint(-size, size) for _ in range(5)] for _ in range(k)]
    centroids[-1] = list(centroids[0])
    points = [[rng.randint(-size, size) for _ in range(5)] for _ in range(400)] + centroids
    tree = vc.Tree(centroids)
    # as doubles, the way they come out of a table
    doubles = np.array([[float(x) for x in p] for p in points])
    found, best = tree.nearest(doubles)
    exact = [[int(x) for x in row] for row in doubles.tolist()]
    assert [(int(a), int(b)) for a, b in zip(found, best, strict=True)] == brute_nearest(exact, centroids)


def test_a_far_node_is_not_opened():
    centroids = [[1000 * i, 0] for i in range(64)]
    tree, opened = vc.Tree(centroids), []
    plain = vc.squared
    try:
        vc.squared = lambda points, centre: opened.append(len(points)) or plain(points, centre)
        tree.nearest(np.array([[31_010.0, 3.0]] * 10))
    finally:
        vc.squared = plain
    assert sum(opened) < 10 * 20


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(parts)


def clustered(spark, rows, **more):
    assigned, centroids = vc.cluster(frame(spark, rows), **more)
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=str), centroids, assigned


def test_rounds_with_ties_and_bad_vectors(spark):
    rng = random.Random(5)
    grid = lambda: [float(rng.randint(-2, 2)) / 4 for _ in range(6)]
    rows = [(i, grid()) for i in range(300)] + [(7, grid()), (7, grid()), (None, grid())]
    rows += [(1000 + i, [0.25] * 6) for i in range(150)]  # one vector a third of all
    bad = [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [0.0] * 5, [-float("inf")] * 6]
    rows += [(2000 + i, b) for i, b in enumerate(bad)]
    got, centroids, assigned = clustered(spark, rows, k=8, rounds=4, dims=6, scale=16)
    want, want_centroids = brute(rows, 8, 4, 6, 16)
    assert centroids == want_centroids
    assert got == want
    report = vc.report(assigned, centroids).collect()
    assert {r["inertia"] for r in report} == {sum(w[2] for w in want)}
    for r in report:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_components_beyond_floating_point(spark):
    rows = [(i, [1e6 * i, -3e5, float(i)]) for i in range(30)] + [(50, [3e38, 1.0, 1.0]), (51, [-3e38, 0.5, 1.0]), (52, [1e20, 0.0, 0.0])]
    got, centroids, assigned = clustered(spark, rows, k=4, rounds=3, dims=3, scale=1024)
    exact = [(i, np.array(v, dtype="float32").astype(float).tolist()) for i, v in rows]
    want, want_centroids = brute(exact, 4, 3, 3, 1024)
    assert centroids == want_centroids
    assert got == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=str)
    assert {r["inertia"] for r in vc.report(assigned, centroids).collect()} == {None}


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 1.0])]
    got, centroids, _ = clustered(spark, rows, k=8, rounds=2, dims=2)
    assert (got, centroids) == brute(rows, 8, 2, 2, 1024)


def test_empty_table(spark):
    got, centroids, assigned = clustered(spark, [], dims=2)
    assert (got, centroids, vc.report(assigned, centroids).count()) == ([], [], 0)
    assert clustered(spark, [(1, None), (2, [1.0])], dims=2)[0] == []
