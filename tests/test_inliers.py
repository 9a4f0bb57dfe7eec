"""Projective maps from matches with outliers."""

import numpy as np
from pyspark.sql import functions as F

from swathline.operators import tiepoints

MATCH = "pair bigint, a bigint, b bigint, x1 double, y1 double, x2 double, y2 double"
MAP = np.array([[1.1, -0.2, 30.0], [0.15, 0.9, -12.0], [2e-4, -1e-4, 1.0]])


def planted(pair, n, share, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 1000, (n, 2))
    moved = np.c_[at, np.ones(n)] @ MAP.T
    to = moved[:, :2] / moved[:, 2:] + rng.normal(0, 0.3, (n, 2))
    wrong = rng.random(n) > share
    to[wrong] = rng.uniform(2000, 3000, (wrong.sum(), 2))
    return [(pair, k, k, *map(float, (*at[k], *to[k]))) for k in range(n)], {k for k in range(n) if not wrong[k]}


def test_planted_map_is_found_in_each_pair(spark):
    first, good = planted(1, 300, 0.6)
    second, also = planted(2, 120, 0.7, 5)
    few = [(3, k, k, float(k), float(k * k), float(k), float(k * k)) for k in range(3)]
    got = tiepoints.filter_inliers(spark.createDataFrame(first + second + few, MATCH), 600, 20.0).collect()
    assert {r.a for r in got if r.pair == 1} == good and {r.a for r in got if r.pair == 2} == also
    assert not [r for r in got if r.pair == 3]


def test_affine_maps_cannot_explain_it(spark):
    """The planted map bends: an affine one leaves true matches beyond the threshold."""
    rows, good = planted(1, 300, 1.0)
    src = np.c_[[r[3:5] for r in rows], np.ones(300)]
    dst = np.array([r[5:7] for r in rows])
    left = np.linalg.norm(src @ np.linalg.lstsq(src, dst, rcond=None)[0] - dst, axis=1)
    assert (left > 20).sum() > 10
    assert tiepoints.filter_inliers(spark.createDataFrame(rows, MATCH), 300, 20.0).count() == len(good)


def test_a_large_pair_is_split_and_every_match_votes(spark):
    n = 1_000_000
    k = F.col("id")
    x, y = k % 1000, F.floor(k / 1000)
    w = 1 + 2e-4 * x - 1e-4 * y
    far = F.when(k % 3 == 0, 5000).otherwise(0)
    rows = spark.range(n, numPartitions=8).select(
        F.lit(7).cast("bigint").alias("pair"), k.alias("a"), k.alias("b"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        ((1.1 * x - 0.2 * y + 30) / w + far).alias("x2"), ((0.15 * x + 0.9 * y - 12) / w).alias("y2"))
    best = tiepoints.best_maps(rows, 40, 1.0).first()
    assert best.votes == n - (n + 2) // 3
    assert np.allclose(np.reshape(best.map, (3, 3)), MAP, atol=1e-6)


def test_degenerate_matches_have_no_map(spark):
    line = [(1, k, k, float(k), float(2 * k), float(k), float(k)) for k in range(50)]
    same = [(2, k, k, 1.0, 1.0, 2.0, 2.0) for k in range(10)]
    assert tiepoints.filter_inliers(spark.createDataFrame(line + same, MATCH), 100).count() == 0
    assert tiepoints.filter_inliers(spark.createDataFrame([], MATCH), 100).count() == 0
