"""Whitening against a dense eigendecomposition of the exact covariance."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from fractions import Fraction

from fleetgrade.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def integers(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def check(spark, items, extra="", most=16):
    """Compare with numpy; returns the number of components."""
    got = whitening.whiten(spark.createDataFrame(items, SCHEMA + extra), most).collect()
    ok = [(r[0], integers(r[1])) for r in items if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    fit = np.array(sorted({tuple(v) for _, v in ok}))
    n, sums = len(fit), fit.sum(0)
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == k * len(ok)
    away = sorted(((i, int(((n * np.array(v) - sums) ** 2).sum())) for i, v in ok), key=repr)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=repr) == away
    white = {}
    for r in got:
        assert r.n == n and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-8 and r.identity_error < 1e-8
        white.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for c in range(1, k + 1):
        gap = min(abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1) / values[0]
        if gap < 1e-6:
            continue
        mine = np.array([sorted(white[i, d][c])[0] for i, d in away])
        theirs = np.array([sorted(x)[0] for x in [[float((np.array(v) - mean) @ axes[:, c - 1] / math.sqrt(values[c - 1]))] for _, v in sorted(ok, key=lambda r: repr((r[0], int(((n * np.array(r[1]) - sums) ** 2).sum()))))]])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8 / gap
    return k


@pytest.mark.parametrize("block", [16, 4096])
def test_whitening_is_that_of_the_covariance(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = rng.normal(size=(200, 24)) * np.linspace(3, 0.2, 24) + rng.normal(size=24)
    assert check(spark, [(i, v.tolist()) for i, v in enumerate(x)]) == 16


def test_early_end_on_a_falling_spectrum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 40)) * 0.5 ** np.arange(40) * 500
    assert check(spark, [(i, v.tolist()) for i, v in enumerate(x)], most=3) == 3


def test_repeated_eigenvalues_and_low_rank(spark):
    corners = [(i, [8.0 * (i == j) for j in range(6)]) for i in range(6)]
    assert check(spark, corners) == 5
    assert check(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]) == 1
    assert check(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])]) == 1


def test_unusable_and_repeated_rows(spark):
    rng = random.Random(1)
    items = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(30)]
    items += [(7, items[7][1]), (7, items[3][1]), (None, items[2][1]), (40, None), (41, []), (42, [1.0, None, 1.0, 1.0]), (43, [math.nan] * 4), (44, [math.inf, 0.0, 0.0, 0.0])]
    assert check(spark, [(*r, "clash", 1) for r in items], ", component string, x int") == 4


def test_no_variance_lengths_and_large_entries(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    both = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [5.0]), (5, [9.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in both) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 7.0])], SCHEMA)).collect()
    assert max(r.deviation for r in huge) == whitening.MOST and all(math.isfinite(r.whitened) for r in huge)


def test_bidiagonal_on_a_plain_matrix():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 10))
    found = whitening.Bidiagonal(10, (x ** 2).sum(), lambda p: (x.T @ (x @ p), (x @ p) @ (x @ p)))
    while len(found.alpha) < 10:
        found.step()
    u, v = x @ np.array(found.w).T, np.array(found.v[:10])
    assert np.abs(u.T @ u - np.eye(10)).max() < 1e-10 and np.abs(v @ v.T - np.eye(10)).max() < 1e-12
    assert np.allclose(found.triples()[0], np.linalg.svd(x)[1], rtol=1e-12)
