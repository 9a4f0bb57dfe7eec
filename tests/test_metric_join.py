"""Nearest descriptors through pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import tiepoints

SCHEMA = "pair bigint, id bigint, desc array<double>"


def points(spark, pair, desc, start=0):
    return spark.createDataFrame([(pair, start + k, [float(v) for v in d]) for k, d in enumerate(desc)], SCHEMA)


def clustered(rng, n, dims=6):
    centres = rng.normal(0, 10, (12, dims))
    return centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, dims))


def nearest(x, y):
    gaps = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # summed as the operator does
        gaps += (x[:, k, None] - y[None, :, k]) ** 2
    return gaps


@pytest.mark.parametrize("grid", [False, True])
def test_nearest_equals_all_pairs(spark, grid):
    rng = np.random.default_rng(3)
    x, y = clustered(rng, 300), clustered(rng, 400)
    if grid:  # many ties and repeated descriptors
        x, y = np.round(x / 4), np.round(y / 4)
    got = {r.a: (r.b, r.dist) for r in tiepoints.nearest_descriptors(points(spark, 1, x), points(spark, 1, y)).collect()}
    gaps = nearest(x, y)
    assert got == {a: (int(gaps[a].argmin()), float(gaps[a].min())) for a in range(len(x))}


def test_mutual_matches(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 200)
    y = x[::-1] + rng.normal(0, 0.01, x.shape)
    got = {(r.a, r.b) for r in tiepoints.match_corners(points(spark, 1, x), points(spark, 1, y)).collect()}
    gaps = nearest(x, y)
    assert got == {(a, int(gaps[a].argmin())) for a in range(200) if gaps[:, gaps[a].argmin()].argmin() == a} and len(got) > 190


def test_few_of_all_pairs_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = clustered(rng, 3000, 3)
    y = x + rng.normal(0, 0.02, x.shape)
    met, plain = [], tiepoints._compared

    def counted(joined):
        met.append(joined)
        return plain(joined)

    monkeypatch.setattr(tiepoints, "_compared", counted)
    assert tiepoints.nearest_descriptors(points(spark, 1, x), points(spark, 1, y)).count() == 3000
    to_pivots = 2 * 3000 * int(np.ceil(np.sqrt(3000)))
    assert len(met) == 2 and to_pivots + sum(m.count() for m in met) < 3000 * 3000 / 10


def test_sides_without_points(spark):
    some, none = points(spark, 1, np.eye(3)), points(spark, 2, np.eye(3))
    assert tiepoints.match_corners(some, none).count() == 0
    gone = some.withColumn("desc", F.lit(None).cast("array<double>"))
    assert tiepoints.match_corners(some, gone).count() == 0
    same = tiepoints.match_corners(some, some.withColumn("id", F.col("id") + 7)).collect()
    assert {(r.a, r.b, r.dist) for r in same} == {(k, k + 7, 0.0) for k in range(3)}


def lowest_cost(gaps, reach):
    """By trying every right corner for the first left one, and so on."""
    def rest(a, free):
        if a == len(gaps):
            return 0.0
        best = reach + rest(a + 1, free)
        for b in free:
            if gaps[a, b] <= reach:
                best = min(best, gaps[a, b] + rest(a + 1, free - {b}))
        return best

    return rest(0, frozenset(range(gaps.shape[1])))


def test_assignment_costs_what_the_best_one_does(spark):
    rng = np.random.default_rng(6)
    reach, step = 3.0, 0.01
    cases = {p: (rng.normal(0, 1, (n, 2)), rng.normal(0, 1, (m, 2))) for p, (n, m) in enumerate([(6, 6), (6, 3), (2, 6), (5, 5)])}
    cases[9] = (np.array([[0.0], [0.1]]), np.array([[0.05], [1.0]]))  # both want the same one
    left = points(spark, 0, cases[0][0])
    right = points(spark, 0, cases[0][1])
    for p in list(cases)[1:]:
        left, right = left.unionByName(points(spark, p, cases[p][0])), right.unionByName(points(spark, p, cases[p][1]))
    got = tiepoints.assign_corners(left, right, reach, step).collect()
    for p, (x, y) in cases.items():
        mine = [r for r in got if r.pair == p]
        assert len({r.a for r in mine}) == len({r.b for r in mine}) == len(mine)
        gaps = nearest(x, y)
        assert all(r.dist == gaps[r.a, r.b] for r in mine)
        cost = sum(r.dist for r in mine) + reach * (len(x) - len(mine))
        assert cost <= lowest_cost(gaps, reach) + step * len(x) + 1e-9
    assert {(r.a, r.b) for r in got if r.pair == 9} == {(0, 0), (1, 1)}


def test_within_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    x, y = np.round(clustered(rng, 200, 3)), np.round(clustered(rng, 250, 3))
    got = {(r.a, r.b) for r in tiepoints.descriptors_within(points(spark, 1, x), points(spark, 1, y), 5.0).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(nearest(x, y) <= 5.0)), strict=True)) and got
