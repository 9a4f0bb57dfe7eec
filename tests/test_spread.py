"""Work that is dealt to more tasks, or to fuller groups, as inputs grow."""

import numpy as np
from pyspark.sql import functions as F

from swathline.operators import projection, radiometry, tiepoints
from swathline.plans import inputs


def test_lines_of_a_big_cube_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    k = F.col("id")
    rows = spark.range(3000).select(
        F.floor(k / 5).alias("l_orderkey"), (k % 5 + 1).cast("int").alias("l_linenumber"), (k % 50).cast("double").alias("l_quantity"),
        (k / 4).alias("l_extendedprice"), (k % 10 / 100).alias("l_discount"), (k % 8 / 100).alias("l_tax"))
    rows.unionByName(rows.limit(20)).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 100)
    px = inputs.pixels_big(spark, str(tmp_path))
    assert px.rdd.getNumPartitions() == 31
    mean = radiometry.average_frame(inputs.to_long(px, "dns", "dn"), ["line", "band"], "dn")
    assert mean._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.line, r.band): r["mean"] for r in mean.collect()}
    assert len(got) == 600 * 4 and all(got[n, 0] == sum((5 * n + s) % 50 for s in range(5)) // 5 for n in range(600))


def test_rays_are_spread_and_share_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heights = spark.createDataFrame([(i, j, float(rng.uniform(0, 3))) for i in range(20) for j in range(20)], "i bigint, j bigint, z double")
    rays = [(n, 0, float(rng.uniform(1, 18)), float(rng.uniform(1, 18)), 9.0, *map(float, rng.normal(size=2) / 3), -1.0) for n in range(600)]
    table = spark.createDataFrame(rays, "line bigint, sample bigint, o_0 double, o_1 double, o_2 double, d_0 double, d_1 double, d_2 double").coalesce(1)
    whole, tasks, groups = projection.tiles_crossed, [], []

    def crossed(ray_table, *rest):
        tasks.append(ray_table.rdd.getNumPartitions())
        return whole(ray_table, *rest)

    monkeypatch.setattr(projection, "tiles_crossed", crossed)
    found = []
    for size in (1 << 14, 40):
        monkeypatch.setattr(projection, "RAYS", size)
        hits = projection.project_to_terrain(table, heights, ["line", "sample"], tile=64, block=2)
        found.append({r.line: (r.pi, r.pj, r.z) for r in hits.collect()})
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
    assert len(found[0]) == 600 and sum(v[0] is not None for v in found[0].values()) > 400 and found[0] == found[1]


def test_sequences_without_observations_are_left_out(spark, monkeypatch):
    k = F.col("id")
    names = [*[f"r_{n}" for n in range(3)], *[f"p_{n}" for n in range(3)]]
    values = [F.sin(k / 30) * 0.05, F.lit(0.01), F.lit(0.0), k * 0.5, F.lit(0.0), F.lit(400.0)]
    poses = spark.range(4000).select((k % 40).alias("seq"), k.cast("double").alias("t"), *[v.alias(n) for v, n in zip(values, names, strict=True)])
    obs = spark.createDataFrame([(3, 1, 7.0, 0.0, 900.0, 4.0, 0.0)], "seq bigint, obs_id bigint, x double, y double, l_0 double, l_1 double, l_2 double")
    written, whole = [], tiepoints.cut_lineage

    def counted(df):
        out = whole(df)
        if "k" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(tiepoints, "cut_lineage", counted)
    out = tiepoints.closest_approach_time(obs, poses, 32, lambda s: [F.lit(0.0), (s - 15.5) / 40, F.lit(-1.0)], block=4, fan=3)
    assert [r.obs_id for r in out.collect()] == [1] and written == [100]
