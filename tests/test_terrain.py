"""Rays and the tiles they are sent to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import projection

RAY = "line bigint, sample bigint, o_0 double, o_1 double, o_2 double, d_0 double, d_1 double, d_2 double"


def terrain(spark, heights):
    rows = [(i, j, float(heights[i, j])) for i in range(heights.shape[0]) for j in range(heights.shape[1])]
    return spark.createDataFrame(rows, "i bigint, j bigint, z double")


def ray_table(spark, o, d):
    return spark.createDataFrame([(k // 16, k % 16, *map(float, o[k]), *map(float, d[k])) for k in range(len(o))], RAY)


def test_level_rays_visit_tiles_along_their_length(spark):
    """Rays at the height of a rough plain: the product of the ranges of rows and columns would be the square of this."""
    rng = np.random.default_rng(5)
    table = ray_table(spark, [(0.5, 0.5 + k / 10, 0.5) for k in range(16)], [(1.0, 0.9, 0.0)] * 16)
    most = {}
    for n in (64, 128, 256):
        heights = rng.uniform(0, 0.4, (n, n))
        heights[0, 0] = 1.0
        heights[1:, n - 1] = 1.0  # a wall at the far side, so that every tile row is within the heights of the raster
        crossed = projection.tiles_crossed(table, terrain(spark, np.maximum(heights, 0.6 * (rng.uniform(size=(n, n)) < 0.02))), tile=4, fan=4)
        most[n] = crossed.groupBy("sample").count().agg(F.max("count")).first()[0]
    assert most[256] <= 2 * 256 // 4 + 2 and most[256] < 3 * most[128] < 9 * most[64]


def test_a_ray_above_flat_land_is_sent_nowhere_else(spark):
    heights = np.zeros((200, 200))
    heights[190:, :] = 30.0
    table = ray_table(spark, [(1.0, 10.0, 20.0)], [(1.0, 0.0, 0.0)])
    crossed = {(r.ti, r.tj) for r in projection.tiles_crossed(table, terrain(spark, heights), tile=8, fan=2).collect()}
    assert crossed == {(23, 1)}  # rows 184 to 192 hold the step
    hit = projection.project_to_terrain(table, terrain(spark, heights), ["line", "sample"], tile=8).first()
    assert (hit.pi, hit.z) == (pytest.approx(189 + 2 / 3), 20.0)


@pytest.mark.parametrize("tile, fan", [(4, 2), (8, 8), (16, 3)])
def test_tiles_give_the_hits_of_one_large_tile(spark, monkeypatch, tile, fan):
    rng = np.random.default_rng(tile)
    heights = 8 * np.sin(np.arange(60)[:, None] / 5) + 6 * np.cos(np.arange(50)[None, :] / 4) + rng.uniform(0, 1, (60, 50))
    dtm = terrain(spark, heights).where("(i * 50 + j) % 83 <> 0")
    o = np.column_stack([rng.uniform(-10, 70, 300), rng.uniform(-10, 60, 300), rng.uniform(-5, 40, 300)])
    d = rng.normal(size=(300, 3))
    d[:60, 2], d[60:80, 0], d[80:100, 1] = 0, 0, 0
    table = ray_table(spark, o, d)
    whole = projection.project_to_terrain(table, dtm, ["line", "sample"], tile=4096).collect()
    monkeypatch.setattr(projection.tiles_crossed, "__defaults__", (tile, fan))
    parts = projection.project_to_terrain(table, dtm, ["line", "sample"], tile=tile, block=5).collect()
    want = {(r.line, r.sample): r for r in whole}
    assert sum(r.pi is not None for r in whole) > 30
    for r in parts:
        w = want[r.line, r.sample]
        assert (r.pi is None) == (w.pi is None) and (r.pi is None or np.allclose([r.pi, r.pj, r.z], [w.pi, w.pj, w.z], atol=1e-6)), (r, w)


def test_no_terrain_no_hits(spark):
    table = ray_table(spark, [(1.0, 1.0, 5.0)], [(0.0, 0.0, -1.0)])
    empty = spark.createDataFrame([], "i bigint, j bigint, z double")
    assert projection.project_to_terrain(table, empty, ["line", "sample"]).first().pi is None
    invalid = spark.createDataFrame([(i, j, -1e11 if i else 0.0) for i in range(3) for j in range(3)], "i bigint, j bigint, z double")
    assert projection.project_to_terrain(table, invalid, ["line", "sample"]).first().pi is None
