"""Centroid clustering against plain k-means in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from fleetgrade.llm import clusters

SCHEMA = "vec_id long, embedding array<float>"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(items, k, rounds, columns, scale=1024):
    ok = [(i, [max(-clusters.LARGEST, min(clusters.LARGEST, math.floor(scale * float(np.float32(c))))) for c in v]) for i, v in items if v is not None and len(v) == columns and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in ok]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(ok, of, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in ok]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sum(x for _, x, o in found if o == j), sum(x for _, x, _ in found), names[j]) for i, d, j in found), key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 4096])
def test_clusters_are_those_of_plain_k_means(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(block)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    items = [(i, [c + rng.gauss(0, 0.4) for c in middles[i % 4]]) for i in range(300)]
    scans = []
    got = clusters.centroid_clusters(spark.createDataFrame(items, SCHEMA), 4, 8, 5, scans=scans)
    assert rows(got) == brute(items, 4, 8, 5)
    # Bounds do their work: everything is measured once, then only what expired.
    assert scans[0] == 300 and len(scans) == 9 and sum(scans[1:]) < 8 * 300 / 2


def test_ties_repeats_and_unusable_vectors(spark):
    items = [(i, [float(i % 3), 0.0]) for i in range(20)] + [(5, [2.0, 0.0]), (5, [0.5, 0.5]), (None, [1.0, 0.0]), (None, [0.5, 0.5])]
    items += [(30, None), (31, []), (32, [1.0]), (33, [1.0, None]), (34, [math.nan, 1.0]), (35, [math.inf, 0.0]), (36, [1.0, 2.0, 3.0]), (37, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in items], SCHEMA + ", cluster string, x int").withColumnRenamed("x", "heaps")
    for k, rounds in ((3, 4), (1, 2), (60, 1), (8, 0)):
        assert rows(clusters.centroid_clusters(df, k, rounds, 2)) == brute(items, k, rounds, 2)


def test_large_components_and_empty_clusters(spark):
    items = [(0, [1e30, -1e30]), (1, [1e5, 0.0]), (2, [-1e5, 3.0]), (3, [-1e30, 1.0]), (4, [0.25, 0.25]), (5, [0.25, 0.25])]
    assert rows(clusters.centroid_clusters(spark.createDataFrame(items, SCHEMA), 6, 3, 2)) == brute(items, 6, 3, 2)


def test_empty_table(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None)], SCHEMA)):
        got = clusters.centroid_clusters(df)
        assert got.columns == COLUMNS and got.collect() == []


def test_heaps_survive_writing():
    rng = np.random.default_rng(2)
    x, centroids = rng.integers(-2000, 2000, (50, 3)), rng.integers(-2000, 2000, (4, 3))
    state = clusters.Heaps.read(None, 4, 50)
    assert state.advance(x, centroids, np.zeros(4), True)[1] == 50
    again = clusters.Heaps.read(state.write(), 4, 50)
    assert again.heaps == state.heaps and (again.clusters() == clusters.squared(x, centroids).argmin(1)).all()
    assert again.advance(x, centroids, np.zeros(4), False)[1] <= 2
    assert (clusters.unpacked(clusters.packed(x), 3) == x).all()
