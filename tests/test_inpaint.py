import random

import pytest
from pyspark.sql import functions as F

from swathline.operators import ortho

SCHEMA = "tile_i bigint, tile_j bigint, i bigint, j bigint, v array<double>"


def painted(cells, radius, height, width):
    """Cell -> source by definition, for one tile."""
    inside = [(i, j) for i in range(height) for j in range(width)]
    wide = {(i, j) for i, j in inside if any(abs(i - a) <= 2 * radius and abs(j - b) <= 2 * radius for a, b in cells)}
    s = 2 * radius + 1
    out = {}
    for i, j in inside:
        near = [((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in cells if abs(i - a) <= radius and abs(j - b) <= radius]
        around = [(a, b) for a in range(max(i - s, 0), min(i + s, height - 1) + 1) for b in range(max(j - s, 0), min(j + s, width - 1) + 1)]
        if (i, j) not in cells and near and all(c in wide for c in around):
            out[i, j] = min(near)[1:]
    return out


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_equals_the_definition(spark, radius):
    rng = random.Random(radius)
    tiles = {(a, b): (9 + 5 * a, 12 + 4 * b, share) for a, b, share in ((0, 0, 0.05), (0, 1, 0.3), (1, 0, 0.9), (1, 1, 0.02))}
    cells = {t: {(i, j) for i in range(h) for j in range(w) if rng.random() < share} | {(h - 1, 0)} for t, (h, w, share) in tiles.items()}
    rows = [(*t, i, j, [float(1000 * i + j)]) for t, own in cells.items() for i, j in own]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ortho.inpaint_nearest(df, "v", radius, 9 + 5 * F.col("tile_i"), 12 + 4 * F.col("tile_j")).collect()
    assert len(got) == len({r[:4] for r in got})
    for t, (h, w, _) in tiles.items():
        mine = [r for r in got if r[:2] == t]
        assert {(r.i, r.j) for r in mine if not r.painted} == cells[t]
        want = {c: 1000.0 * a + b for c, (a, b) in painted(cells[t], radius, h, w).items()}
        assert {(r.i, r.j): r.v[0] for r in mine if r.painted} == want


def test_empty_and_full_tiles(spark):
    assert ortho.inpaint_nearest(spark.createDataFrame([], SCHEMA), "v", 2, 5, 5).count() == 0
    full = spark.createDataFrame([(0, 0, i, j, [0.0]) for i in range(5) for j in range(5)], SCHEMA)
    assert ortho.inpaint_nearest(full, "v", 2, 5, 5).where("painted").count() == 0


def test_full_areas_send_no_copies(spark):
    """Cells sent in a full tile with one hole don't grow with the radius."""
    cells = [(0, 0, i, j, [0.0]) for i in range(40) for j in range(40) if (i, j) != (20, 20)]
    df, keys = spark.createDataFrame(cells, SCHEMA), ["tile_i", "tile_j", "i", "j"]
    side = F.lit(40)
    assert [ortho._widened(df, keys, "i", by, side).count() for by in (2, 16)] == [1600, 1600]
    assert ortho._nearest_cells(df.select(*keys), keys, 8, side, side).collect()[0][4:] == (19, 20)
