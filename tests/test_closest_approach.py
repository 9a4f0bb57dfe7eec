"""Closest approach of rays to landmarks by descending a hierarchy of poses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import tiepoints

POSE = ["r_0", "r_1", "r_2", "p_0", "p_1", "p_2"]


def flight(spark, n, turns):
    """A track of n poses that looks down, with a slowly moving attitude."""
    k = F.col("id")
    angle = [F.sin(k / turns) * 0.05, F.cos(k / (turns * 1.7)) * 0.04, F.sin(k / (turns * 0.6)) * 0.03]
    at = [k * 0.5, F.sin(k / 900) * 30, 400 + F.cos(k / 700) * 10]
    return spark.range(n).select(F.lit(0).cast("bigint").alias("seq"), k.cast("double").alias("t"), *[c.alias(name) for c, name in zip([*angle, *at], POSE, strict=True)])


def observations(spark, n, count, samples):
    rng = np.random.default_rng(1)
    rows = [(0, i, float(rng.uniform(0, samples - 1)), 0.0, float(rng.uniform(0, n * 0.5)), float(rng.uniform(-150, 150)), float(rng.uniform(-5, 5))) for i in range(count)]
    return spark.createDataFrame(rows, "seq bigint, obs_id bigint, x double, y double, l_0 double, l_1 double, l_2 double")


def look(s):
    return [F.lit(0.0), (s - 15.5) / 40, F.lit(-1.0)]


def rotation(r):
    angle = np.linalg.norm(r, axis=1)[:, None, None]
    x, y, z = r.T
    zero = np.zeros(len(r))
    cross = np.stack([np.stack([zero, -z, y], 1), np.stack([z, zero, -x], 1), np.stack([-y, x, zero], 1)], 1)
    return np.eye(3) + np.sinc(angle / np.pi) * cross + 0.5 * np.sinc(angle / 2 / np.pi) ** 2 * (cross @ cross)


@pytest.mark.parametrize("block, fan", [(64, 16), (8, 3), (5000, 4)])
def test_equals_a_search_of_all_poses(spark, block, fan):
    n = 3000
    poses, obs = flight(spark, n, 200.0), observations(spark, n, 25, 32)
    got = {r.obs_id: (r.t, r.dist) for r in tiepoints.closest_approach_time(obs, poses, 32, look, block, fan).collect()}
    table = poses.orderBy("t").toPandas()
    turn, origin = rotation(table[["r_0", "r_1", "r_2"]].to_numpy()), table[["p_0", "p_1", "p_2"]].to_numpy()
    for o in obs.collect():
        g = turn @ np.array([0.0, (o.x - 15.5) / 40, -1.0])
        e = np.array([o.l_0, o.l_1, o.l_2]) - origin
        dist = np.linalg.norm(e - g * ((g * e).sum(1) / (g * g).sum(1))[:, None], axis=1)
        assert got[o.obs_id][1] == pytest.approx(dist.min(), abs=1e-6) and dist[int(got[o.obs_id][0])] == pytest.approx(dist.min(), abs=1e-6)


def test_few_nodes_are_opened_on_a_long_flight(spark, monkeypatch):
    sizes = []
    whole = tiepoints.cut_lineage

    def counted(df):
        out = whole(df)
        if "bound" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(tiepoints, "cut_lineage", counted)
    opened = {}
    for n in (5_000, 100_000):
        sizes.clear()
        assert tiepoints.closest_approach_time(observations(spark, n, 20, 32), flight(spark, n, 4000.0), 32, look).count() == 20
        opened[n] = sum(sizes) / 20
    assert opened[100_000] < 60 and opened[100_000] < 4 * opened[5_000]  # of 1,563 blocks
