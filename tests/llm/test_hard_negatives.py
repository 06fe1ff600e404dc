"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, score int, rank int, qid string"


def brute(rows):
    v = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in e):
            continue
        v.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)))
    clamp = lambda s: max(hn.LONG_MIN, min(hn.LONG_MAX, s))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, q in {x for x in v if x[0] is not None and x[0] % 100 == 0}:
        scored = [(clamp(sum(a * b for a, b in zip(q, r, strict=True))), j, m) for j, m, r in v if len(r) == len(q)]
        for p, j, _ in sorted((s for s in scored if s[2] == label and s[1] != i), key=order)[:5]:
            fit = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p]
            out += [(i, j, k, s[1], p, s[0]) for k, s in enumerate(sorted(fit, key=order)[:10], 1)]
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    u = hn.usable(df)
    u = u.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return [tuple(r) for r in hn.mine(u, F.col("id") % 100 == 0).collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    near = lambda: [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]
    rows = [(k * 25, near(), rng.randint(0, 3)) for k in range(120)]
    rows += [(10_000 + k, [0.5, -0.25, 0.0, 0.5, 1.0, 0.0], k % 3) for k in range(60)]  # ties
    rows += [(20_000, near()[:4], 1), (20_001, near()[:4], 2), (20_002, near()[:4], 1), (30_000, None, 1), (30_100, near(), None), (30_200, [None] + near()[1:], 1), (30_300, [math.inf] * 6, 1), (30_400, [math.nan] * 6, 1), (30_500, [], 1), (30_501, [], 2), (30_502, [], 1), (30_600, [1e306] * 6, 1), (None, near(), 1), (None, near(), 2)]
    rows += rows[:8] + [(0, near(), 2), (100, rows[4][1], 5)]
    expected = brute(rows)
    assert len(expected) > 1000
    assert sorted(mined(spark, rows), key=key) == sorted(expected, key=key)


def test_scores_beyond_doubles(spark):
    rows = [(100, [1e7, 1e7 + 1], 1), (201, [2e7, 1e7 + 3], 1), (302, [1e7, 1e6 + 7], 2), (403, [1e13, 1e13], 2), (501, [1e12, -3e11], 1), (602, [3e11, 1e3], 3)]
    got = mined(spark, rows)
    assert got and sorted(got) == sorted(brute(rows))


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (200, [1.0], 1)]) == []


@pytest.mark.parametrize("same", [True, False])
def test_nodes_are_pruned_by_both_bounds(same):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    points = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(8000, 16)) * 5)
    labels, ids = np.repeat(np.arange(40) % 3, 200), np.arange(8000)
    tree = hn.BallTree(points, ids, np.zeros(8000, bool), labels, None)
    anchors = points[::500]
    s = anchors @ points.T
    top = s.max(axis=1).astype(np.int64)
    low, high = (np.full((16, 1), hn.LONG_MIN), np.full((16, 1), hn.LONG_MAX)) if same else (top[:, None] * 3 // 10, top[:, None] * 4 // 10)
    best = hn.Best(low, high, 10)
    computed = hn.search(tree, anchors, labels[::500], ids[::500], same, best)
    assert computed < (0.3 if same else 0.6) * s.size
    anchor, score, _, found = best.found[0][0]
    for a in range(16):
        ok = ((labels == labels[a * 500]) == same) & (s[a] >= low[a]) & (s[a] <= high[a]) & ((ids != a * 500) | (not same))
        expected = sorted((-int(x), int(i)) for x, i in zip(s[a][ok], ids[ok], strict=True))[:10]
        assert [(-int(x), int(i)) for x, i in zip(score[anchor == a], found[anchor == a], strict=True)] == expected
