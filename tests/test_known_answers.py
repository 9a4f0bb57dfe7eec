"""Small inputs whose result is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.functions import geo, vec
from swathline.operators import motion, projection, radiometry, raster, shifts, tiepoints
from swathline.plans import ordered

SHIFTS = [0, -1, -1, 0, 1, 1, 0]


def frame(spark, offsets):
    rows = []
    for line, s in enumerate(offsets):
        for sample in range(5):
            at = sample + s
            value = [1.0, 0.0, 0.0] if at == 2 else [0.0, 1.0, 1.0] if at == 4 else [0.0, 0.0, 1.0]
            rows.append((0, line, sample, value))
    return spark.createDataFrame(rows, "seq bigint, line bigint, sample bigint, v array<double>")


@pytest.mark.parametrize("offsets", [[0] * 7, SHIFTS])
def test_likely_shift_of_shift_frame(spark, offsets):
    costs = shifts.shift_likelihood(frame(spark, offsets), "v", 5, 5, 0.01, 1.0)
    got = {r.line: r.dx for r in shifts.likely_shift(costs).collect()}
    for k in range(6):
        assert abs(got[k] - (offsets[k] - offsets[k + 1])) < (0.1 if any(offsets) else 1e-5)


def test_whole_pixel_correlation(spark):
    products = shifts.line_pair_products(frame(spark, SHIFTS), "v", 5, -1, 1, line_block=2, sample_block=2)
    assert products.count() == 18
    flat = shifts.line_pair_products(frame(spark, [0] * 7), "v", 5, -1, 1)
    assert {r.d for r in shifts.best_shift(flat).collect()} == {0}


def test_accumulate_shifts_crosses_slots(spark, monkeypatch):
    rng = np.random.default_rng(1)
    dx = np.round(rng.normal(size=50), 2)
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(dx)], "seq bigint, line bigint, dx double")
    monkeypatch.setattr(shifts, "SLOT_LINES", 7)
    got = [r.acc for r in shifts.accumulate_shifts(df).orderBy("line").collect()]
    run = np.concatenate([[0], np.cumsum(-dx)])
    assert np.allclose(got, run - np.floor(min(0, run.min())))


def test_smooth_shifts_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60) * np.where(rng.random(60) < 0.3, 20, 0.2)
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(x)], "seq bigint, line bigint, dx double")
    want = x.copy()
    for k in range(1, 59):
        mean = (want[k - 1] + want[k + 1]) / 2
        if abs(want[k] - mean) > 4 * max(abs(want[k - 1]), abs(want[k + 1])):
            want[k] = mean
    got = [r.dx for r in shifts.smooth_shifts(df, block=8).orderBy("line").collect()]
    assert np.allclose(got, want)


def greedy(costs, n):
    """Edges by rising cost, kept when both ends are free and on different paths; then paths by lowest line."""
    degree, parent, kept = [0] * n, list(range(n)), []

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for cost, u, v in sorted((c, i, i + k + 1) for (i, k), c in costs.items()):
        if degree[u] < 2 and degree[v] < 2 and root(u) != root(v):
            kept.append((u, v))
            parent[root(u)] = root(v)
            degree[u] += 1
            degree[v] += 1
    return {frozenset(e) for e in kept}


def test_reorder_takes_the_greedy_edges(spark):
    rng = np.random.default_rng(42)
    n, reach = 30, 8
    place = np.arange(n) / 4 + np.sin(4 * np.pi * np.arange(n) / n)
    place = place[np.argsort(np.arange(n) + rng.uniform(0, 4, n))]
    costs = {(i, c): abs(place[i] - place[i + c + 1]) for i in range(n) for c in range(reach) if i + c + 1 < n}
    df = spark.createDataFrame([(0, i, c, float(v)) for (i, c), v in costs.items()], "seq bigint, i bigint, c bigint, cost double")
    lines = spark.createDataFrame([(0, i) for i in range(n)], "seq bigint, line bigint")
    order = [r.line for r in shifts.reorder_lines(df, lines).orderBy("order_idx").collect()]
    assert sorted(order) == list(range(n))
    want = greedy(costs, n)
    joined = {frozenset(p) for p in zip(order, order[1:])}
    assert want <= joined


def test_reorder_recovers_a_permuted_ramp(spark):
    ramp = [0, 2, 1, 3, 5, 4, 6]
    px = spark.createDataFrame([(0, k, 0, [v / 6.0]) for k, v in enumerate(ramp)], "seq bigint, line bigint, sample bigint, v array<double>")
    costs = shifts.line_costs(px, "v", 1, 3)
    order = [r.line for r in shifts.reorder_lines(costs, px.select("seq", "line")).orderBy("order_idx").collect()]
    assert order in ([0, 2, 1, 3, 5, 4, 6], [6, 4, 5, 3, 1, 2, 0])


@pytest.mark.parametrize("kind, signs", [("enu", (0, 1, 1)), ("nwu", (1, 0, 1)), ("ned", (1, 0, -1))])
def test_local_axes_at_45_degrees(spark, kind, signs):
    """z components of the local axes in ECEF."""
    row = vec.keep(spark.range(1), m=geo.frame_axes(kind, F.lit(45.0), F.lit(10.0))).first()
    for axis, sign in enumerate(signs):
        value = row[f"m_{3 * axis + 2}"]
        assert abs(value) < 1e-9 if sign == 0 else value * sign > 0


def camera(spark, height):
    """100 pixels, focal length 100, looking 135 degrees away about z over a flat 100 x 100 grid."""
    dtm = spark.range(10000).select(F.floor(F.col("id") / 100).alias("i"), (F.col("id") % 100).alias("j"), F.lit(0.0).alias("z"))
    c, s = np.cos(3 * np.pi / 4), np.sin(3 * np.pi / 4)
    down = -1.0 if height > 0 else 1.0
    lines = spark.createDataFrame([(0, k) for k in range(100)], "line bigint, sample bigint")
    x = (F.col("sample") - 49.5) / 100 * 2
    rays = vec.keep(lines, o=vec.const(49.5, 49.5, height), d=[x * c, x * s * -1 * -1, F.lit(down)])
    return rays, dtm


def test_footprint_covers_the_anti_diagonal(spark):
    rays, dtm = camera(spark, 50.0)
    hits = projection.project_to_terrain(rays, dtm, ["line", "sample"], tile=32)
    cells = {(r.i, r.j) for r in projection.line_footprint(hits, ["line"], 100).collect()}
    # the ray fan reaches 0.7 of the half width on either side
    assert {(k, 99 - k) for k in range(16, 84)} <= cells


def test_camera_below_the_terrain_sees_nothing(spark):
    rays, dtm = camera(spark, -50.0)
    hits = projection.project_to_terrain(rays, dtm, ["line", "sample"])
    assert hits.where("pi is not null").count() == 0


def test_terrain_hits_lie_on_the_surface(spark):
    rng = np.random.default_rng(3)
    grid = [(i, j, float(5 * np.sin(i / 3) + 4 * np.cos(j / 4))) for i in range(40) for j in range(40)]
    dtm = spark.createDataFrame(grid, "i bigint, j bigint, z double")
    rays = [(k // 10, k % 10, *[float(v) for v in (rng.uniform(5, 35), rng.uniform(5, 35), 60)], *[float(v) for v in (rng.normal() * 0.3, rng.normal() * 0.3, -1)]) for k in range(200)]
    table = spark.createDataFrame(rays, "line bigint, sample bigint, o_0 double, o_1 double, o_2 double, d_0 double, d_1 double, d_2 double")
    hits = projection.project_to_terrain(table, dtm, ["line", "sample"], tile=8, block=4).where("pi is not null")
    sampled = raster.bilinear_sample(hits.withColumnRenamed("z", "hit_z"), dtm, ["line", "sample"]).collect()
    assert len(sampled) > 60
    heights = np.array([g[2] for g in grid]).reshape(40, 40)
    for r in sampled:
        assert abs(r.z - r.hit_z) < 1e-6
        # no earlier crossing: the ray is above the surface on the way
        o, d = np.array([r.o_0, r.o_1, r.o_2]), np.array([r.d_0, r.d_1, r.d_2])
        for s in np.linspace(0, (r.pi - o[0]) / d[0] - 1e-3, 200):
            x, y, z = o + s * d
            if 0 <= x < 39 and 0 <= y < 39:
                a, b = int(x), int(y)
                u, v = x - a, y - b
                h = (1 - u) * (1 - v) * heights[a, b] + u * (1 - v) * heights[a + 1, b] + (1 - u) * v * heights[a, b + 1] + u * v * heights[a + 1, b + 1]
                assert z > h - 1e-6


def test_perfect_correspondences_have_no_residual(spark):
    k = F.col("id")
    df = spark.range(5).withColumns({"v": F.lit(0.0), "width": F.lit(1201.0)})
    df = vec.keep(df, r=[k * 0.01, F.lit(0.02), F.lit(-0.01)], p=[F.lit(0.0), k * 25.0 - 50, F.lit(0.0)], mr=vec.const(0.01, -0.05, 0.02), mt=vec.const(0, 0, 0))
    df = vec.with_rodrigues(vec.with_rodrigues(df, "a", vec.ref("r")), "b", vec.ref("mr"))
    sensor = [F.lit(0.0), (k * 10.0 - 20), F.lit(100.0) + k]
    df = vec.keep(df, w=vec.matvec(vec.transpose(vec.ref("b", 9)), sensor))
    df = vec.keep(df, l=vec.add(vec.matvec(vec.ref("a", 9), vec.ref("w")), vec.ref("p")))
    df = df.withColumn("u", (k * 10.0 - 20) / (100.0 + k) * 35 + 600)
    out = tiepoints.reprojection_residual(df, 35.0, 600.0, 1201.0, [0.0] * 6, [0.0] * 6).collect()
    assert all(abs(r.res_u) < 1e-6 and abs(r.res_v) < 1e-6 for r in out)


def test_bootstrap_finds_the_mounting(spark):
    rng = np.random.default_rng(5)
    boresight = tiepoints._exp(np.array([0.02, -0.03, 0.05]))
    rows = []
    for k in range(300):
        rel, t = tiepoints._exp(rng.normal(size=3) * 0.4), rng.normal(size=3) * 30
        p1 = np.array([rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(60, 100)])
        p2 = rel @ p1 + t
        v1, v2 = boresight.T @ p1, boresight.T @ p2
        rows.append((k, *map(float, v1 / np.linalg.norm(v1)), *map(float, v2 / np.linalg.norm(v2)), *map(float, rel.ravel()), *map(float, t)))
    names = ["match_id"] + [f"v{n}_{k}" for n in (1, 2) for k in range(3)] + [f"r_{k}" for k in range(9)] + [f"t_{k}" for k in range(3)]
    out = tiepoints.bootstrap_boresight(spark.createDataFrame(rows, names), repeats=5, max_obs=100).first()
    assert out.n_ok == 5
    assert np.allclose(np.radians([out.axis_0, out.axis_1, out.axis_2]), [0.02, -0.03, 0.05], atol=1e-4)


def test_asof_across_slots_and_ties(spark):
    poses = spark.createDataFrame([(1, float(t), t * 10) for t in (0, 5, 5, 40, 90)], "k bigint, t double, v bigint")
    asked = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 5.0, 60.0, 90.0, 99.0)], "k bigint, t double")
    got = {r.t: (r.lower and r.lower.v, r.upper and r.upper.v) for r in ordered.asof_bracket(poses, asked, ["k"], "t", ["v"], width=7.0).collect()}
    assert got == {-1.0: (None, 0), 0.0: (0, 0), 5.0: (50, 50), 60.0: (400, 900), 90.0: (900, 900), 99.0: (900, None)}


def test_percentiles_with_an_outlier(spark):
    values = [float(v) for v in range(999)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", F.lit(0))
    row = radiometry.percentile_levels(df, ["b"], "v").first()
    assert (row.black, row.white) == (50.0, 950.0)


def test_line_selection_matches_the_walk(spark):
    rng = np.random.default_rng(9)
    signal = rng.uniform(0, 10, 200)
    df = spark.createDataFrame([(0, k + 1, float(v)) for k, v in enumerate(signal)], "seq bigint, line bigint, intensity double")
    got = sorted(r.line for r in motion.select_lines_by_inflexion(df, "seq", 5.0, 4, slot=5).collect())
    peak = lambda i: 0 < i < 199 and signal[i] > 5 and signal[i] > signal[i - 1] and signal[i] > signal[i + 1]
    want, i = [0], 0
    while i < 200:
        want.append(i + 1)
        if peak(i):
            d1 = next((k for k in range(2, 5) if peak(i + k)), 0)
            d2 = next((k for k in range(2, 5) if peak(i + d1 + k)), 0)
            if d1 and d2:
                i += d1 + d2
        i += 1
    assert got == sorted(want + [201])
