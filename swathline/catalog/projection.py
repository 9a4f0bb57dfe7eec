"""Rays, planes and terrain (P*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog import sqlvec as sv
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.catalog.geodesy import GT, rounded
from swathline.functions import vec
from swathline.operators import projection as op
from swathline.operators import raster
from swathline.operators.geodesy import poses_to_ecef
from swathline.plans import inputs as inp

S = inp.SAMPLES
FOV = 35.0
F_C = f"(19 / (2 * tan(radians({FOV}::DOUBLE) / 2)))"   # focal length over S-1 intervals
F_S = f"(20 / (2 * tan(radians({FOV}::DOUBLE) / 2)))"   # over S pixels
COEF_A = [0.1, -0.2, 0.03, 0.004, -0.0005, 0.0006]
COEF_B = [0.01, 0.02, -0.003, 0.0004, 0.00005, -0.00006]


def poly(c, s):
    return "(" + " + ".join(f"{v}::DOUBLE * pow({s}, {k})" for k, v in enumerate(c)) + ")"


@query("P1_view_directions", sql(f"SELECT line, sample, {s6('y')}, {s6('z')}, {s6('fy')}, {s6('fz')}, {s6('px', 'px')}, {s6('py')} FROM (SELECT line, sample, sample - 9.5::DOUBLE AS y, {F_C} AS z, (9.5::DOUBLE - sample) / sqrt(pow(sample - 9.5::DOUBLE, 2) + pow({F_C}, 2)) AS fy, {F_C} / sqrt(pow(sample - 9.5::DOUBLE, 2) + pow({F_C}, 2)) AS fz, {poly(COEF_B, 'sample / 20')} / 30 AS px, (sample + {poly(COEF_A, 'sample / 20')} - 9.7::DOUBLE) / 30 AS py FROM grid)"))
def _(spark, sf):
    s = F.col("sample")
    a, b = op.fov_direction(s, S, FOV), op.fov_direction(s, S, FOV, flipped=True)
    p = op.pinhole_direction(s, 20.0, 30.0, 9.7, COEF_A, COEF_B)
    return inp.pixels(spark, sf).select("line", "sample", r6(a[1], "y"), r6(a[2], "z"), r6(b[1], "fy"), r6(b[2], "fz"), r6(p[0], "px"), r6(p[1], "py"))


RAYS = {"lm": f"SELECT *, {sv.cols('m', sv.rod(sv.n('r')))} FROM lp",
        "ls": "SELECT *, unnest(range(20)) AS sample FROM lm"}


@query("P2_rays", sql(f"SELECT line, sample, {sv.rnd('p', 'o')}, {sv.rnd('d', 'd')} FROM (SELECT line, sample, p0, p1, p2, {sv.cols('d', sv.mv(sv.n('m', 9), ['0', '(sample - 9.5::DOUBLE)', F_C]))} FROM ls)", **RAYS))
def _(spark, sf):
    lines = inp.line_poses(inp.pixels(spark, sf))
    out = op.rays(lines, S, lambda s: op.fov_direction(s, S, FOV), ["line"])
    return out.select("line", "sample", *rounded("o"), *rounded("d"))


PLANE = {
    "lm": f"SELECT *, {sv.cols('m', sv.rod(sv.n('r')))} FROM lp",
    "rf": "SELECT file_id, line AS ref_line, " + ", ".join([f"m{k} AS n{k}" for k in range(9)] + [f"p{k} AS q{k}" for k in range(3)]) + " FROM lm WHERE line % 10 = 5",
    "pr": f"SELECT lm.file_id, line, ref_line, {sv.cols('c', sv.mm(sv.tr(sv.n('n', 9)), sv.n('m', 9)))}, {sv.cols('t', sv.mv(sv.tr(sv.n('n', 9)), [f'(p{k} - q{k})' for k in range(3)]))} FROM lm JOIN rf USING (file_id)",
    "ps": "SELECT *, unnest(range(20)) AS sample FROM pr",
    "pd": f"SELECT *, {sv.cols('d', sv.mv(sv.n('c', 9), ['(sample - 10)', '0', F_S]))} FROM ps",
    "pl": f"SELECT file_id, line, ref_line, sample, (t0 + (400 - t2) / d2 * d0) / (400 / {F_S}) AS x, (t1 + (400 - t2) / d2 * d1) / (400 / {F_S}) AS y FROM pd",
}


@query("P3_project_to_plane", sql(f"SELECT file_id, line, sample, {s6('x', 'x', 5)}, {s6('y', 'y', 5)} FROM pl", **PLANE))
def _(spark, sf):
    lines = inp.line_poses(inp.pixels(spark, sf))
    out = op.project_to_plane(lines, lines.where("line % 10 = 5"), "file_id", S, FOV, 400.0)
    return out.select("file_id", "line", "sample", r6("x", digits=5), r6("y", digits=5))


@query("P5_project_point_to_line", sql(f"SELECT lm_id, {s6('x / z * 35 + 600', 'u')}, {s6('y / z', 'v_error')} FROM lms"))
def _(spark, sf):
    return op.project_point_to_line(inp.landmarks(spark, sf), 35.0, 600.0).select("lm_id", r6("u"), r6("v_error"))


@query("P10_patch_band", sql(f"SELECT file_id, y, x, {s6('w', 'w', 5)}, band, {s6('v', 'v', 3)} FROM (SELECT file_id, y, x, band, sum(w) AS w, sum(w * dn) / nullif(sum(w), 0) AS v FROM sp JOIN px USING (file_id, line, sample) GROUP BY 1, 2, 3, 4) WHERE w > 1e-9", **PLANE,
       rp="SELECT file_id, line, sample, ref_line, round(x + 10, 9) AS x, round(y, 9) AS y FROM pl WHERE abs(line - ref_line) <= 4",
       sp="""SELECT file_id, line, sample, x, y + 6 AS y, wx * wy AS w FROM (SELECT file_id, line, sample, floor(x)::BIGINT + a AS x, floor(y)::BIGINT + b AS y,
           CASE a WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS wx, CASE b WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS wy
           FROM rp, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)) WHERE wx > 0 AND wy > 0 AND x >= 0 AND x < 20 AND abs(y) <= 6"""))
def _(spark, sf):
    px = inp.pixels(spark, sf)
    lines = inp.line_poses(px)
    out = op.patch_band(px, "dns", lines, lines.where("line % 10 = 5"), "file_id", S, FOV, 400.0, 4, 6)
    return inp.to_long(out.where("w > 1e-9"), "patch" if "patch" in out.columns else "dns", "v").select("file_id", "y", "x", r6("w", digits=5), "band", r6("v", digits=3))


def terrain_rays(spark, sf):
    """Rays that look down from the line poses, f = 40 pixels."""
    lines = inp.line_poses(inp.pixels(spark, sf))
    return op.rays(lines, S, lambda s: [F.lit(0.0), s - 9.5, F.lit(-40.0)], ["line"])


FLAT = {**RAYS,
        "rd": f"SELECT line, sample, p0, p1, p2, {sv.cols('d', sv.mv(sv.n('m', 9), ['0', '(sample - 9.5::DOUBLE)', '(-40::DOUBLE)']))} FROM ls",
        "sz": "SELECT max(i) AS h, max(j) AS w FROM dtm",
        "fl": "SELECT line, sample, p0 + (100 - p2) / d2 * d0 AS pi, p1 + (100 - p2) / d2 * d1 AS pj FROM rd",
        "ft": """SELECT line, sample, CASE WHEN k THEN pi END AS pi, CASE WHEN k THEN pj END AS pj, CASE WHEN k THEN 100::DOUBLE END AS z FROM
              (SELECT line, sample, pi, pj, pi >= 0 AND pj >= 0 AND pi <= h AND pj <= w AS k FROM fl, sz)"""}


@query("P4_project_to_terrain_flat", sql(f"SELECT line, sample, {s6('pi')}, {s6('pj')}, {s6('z')} FROM ft", **FLAT))
def _(spark, sf):
    hits = op.project_to_terrain(terrain_rays(spark, sf), inp.flat_dtm(spark, sf), ["line", "sample"], tile=16, block=8)
    return hits.select("line", "sample", r6("pi"), r6("pj"), r6("z"))


RISING = {
    "ce": "SELECT p_partkey // 50 AS i, p_partkey % 50 AS j FROM part",
    "ra": "SELECT p_partkey AS line, 0.5 + p_partkey % 7 * 0.1::DOUBLE AS a, p_partkey % 40 + 0.25::DOUBLE AS b, p_partkey % 11 * 3 + 2.055::DOUBLE AS c, p_partkey % 4 * 0.5::DOUBLE AS r FROM part",
    "hi": "SELECT line, a + (c - 3 * a) / (3 - r) AS pi, b AS pj FROM ra WHERE c >= 3 * a",
    "ok": "SELECT line, pi, pj FROM hi JOIN ce ON i IN (floor(pi), floor(pi) + 1) AND j IN (floor(pj), floor(pj) + 1) GROUP BY ALL HAVING count(*) = 4",
}


@query("P4_project_to_terrain_rising", sql(f"SELECT ra.line, {s6('pi')}, {s6('pj')}, {s6('3 * pi', 'z')} FROM ra LEFT JOIN ok ON ra.line = ok.line", **RISING))
def _(spark, sf):
    """Level and rising rays towards an inclined plane, some from below it."""
    k = F.col("p_partkey")
    part = inp.table(spark, sf, "part")
    plane = part.select(F.floor(k / 50).alias("i"), (k % 50).alias("j"), (F.floor(k / 50) * 3.0).alias("z"))
    start = [0.5 + k % 7 * 0.1, k % 40 + 0.25, k % 11 * 3 + 2.055]
    ray = part.select(k.alias("line"), F.lit(0).alias("sample"), *[c.alias(f"o_{n}") for n, c in enumerate(start)],
                      F.lit(1.0).alias("d_0"), F.lit(0.0).alias("d_1"), (k % 4 * 0.5).alias("d_2"))
    hits = op.project_to_terrain(ray, plane, ["line", "sample"], tile=16)
    return hits.select("line", r6("pi"), r6("pj"), r6("z"))


SLOPED = {
    **{k: FLAT[k] for k in FLAT if k not in ("sz", "fl", "ft")},
    "ry": "SELECT line, sample, p0, p1, (SELECT min(z) FROM dtm) + 1000 - p2 AS p2, d0, d1, d2 FROM rd",
    "ce": """SELECT a.i, a.j, a.z AS h, b.z - a.z AS hu, c.z - a.z AS hv, d.z - b.z - c.z + a.z AS huv FROM dtm a JOIN dtm b ON b.i = a.i + 1 AND b.j = a.j
             JOIN dtm c ON c.i = a.i AND c.j = a.j + 1 JOIN dtm d ON d.i = a.i + 1 AND d.j = a.j + 1 WHERE a.z + b.z + c.z + d.z IS NOT NULL""",
    "iv": """SELECT *, greatest(least((i - p0) / nullif(d0, 0), (i + 1 - p0) / nullif(d0, 0)), least((j - p1) / nullif(d1, 0), (j + 1 - p1) / nullif(d1, 0)), 0) AS lo,
             least(greatest((i - p0) / nullif(d0, 0), (i + 1 - p0) / nullif(d0, 0)), greatest((j - p1) / nullif(d1, 0), (j + 1 - p1) / nullif(d1, 0))) AS hi
             FROM ry, ce WHERE (d0 <> 0 OR p0 BETWEEN i AND i + 1) AND (d1 <> 0 OR p1 BETWEEN j AND j + 1)""",
    "qd": """SELECT line, sample, p0, p1, p2, d0, d1, d2, lo, hi, -huv * d0 * d1 AS c2, d2 - hu * d0 - hv * d1 - huv * ((p0 - i) * d1 + (p1 - j) * d0) AS c1,
             p2 - h - hu * (p0 - i) - hv * (p1 - j) - huv * (p0 - i) * (p1 - j) AS c0 FROM iv WHERE lo <= hi""",
    "rt": """SELECT *, unnest(CASE WHEN c2 = 0 THEN [-c0 / c1] ELSE [q / c2, c0 / nullif(q, 0)] END) AS s FROM
             (SELECT *, -0.5 * (c1 + CASE WHEN c1 >= 0 THEN 1 ELSE -1 END * sqrt(c1 * c1 - 4 * c2 * c0)) AS q FROM qd WHERE c1 * c1 - 4 * c2 * c0 >= 0)""",
    "ht": "SELECT line, sample, min(s) AS s FROM rt WHERE s BETWEEN lo - 1e-9 * greatest(1, abs(hi)) AND hi + 1e-9 * greatest(1, abs(hi)) GROUP BY 1, 2",
}


@query("P4_project_to_terrain", sql(f"SELECT ry.line, ry.sample, {s6('p0 + s * d0', 'pi')}, {s6('p1 + s * d1', 'pj')}, {s6('p2 + s * d2', 'z')} FROM ry LEFT JOIN ht ON ht.line = ry.line AND ht.sample = ry.sample", **SLOPED))
def _(spark, sf):
    """Sloped terrain with voids, seen from a flight 1000 above its lowest point."""
    low = inp.dtm(spark, sf).agg(F.min("z")).scalar()
    ray = terrain_rays(spark, sf).withColumn("o_2", low + 1000 - F.col("o_2"))
    hits = op.project_to_terrain(ray, inp.dtm(spark, sf), ["line", "sample"])
    return hits.select("line", "sample", r6("pi"), r6("pj"), r6("z"))


GEOM = dict(
    cn="SELECT line, sample, pi, pj, floor(pi) + a AS ci, floor(pj) + b AS cj, (CASE a WHEN 1 THEN pi - floor(pi) ELSE 1 - (pi - floor(pi)) END) * (CASE b WHEN 1 THEN pj - floor(pj) ELSE 1 - (pj - floor(pj)) END) AS w FROM proj, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b) WHERE pi IS NOT NULL",
    bz="SELECT line, sample, pi, pj, CASE WHEN count(*) = count(z) THEN sum(w * z) END AS z FROM cn LEFT JOIN dtm ON dtm.i = ci AND dtm.j = cj WHERE w > 0 GROUP BY 1, 2, 3, 4",
    gm="SELECT line, sample, pj * 0.0001::DOUBLE + 6.0::DOUBLE AS x, pi * (-0.0001::DOUBLE) + 46.0::DOUBLE AS y, z FROM bz")


def geometry(spark, sf):
    return raster.image_geometry(inp.projected(inp.pixels(spark, sf)), inp.dtm(spark, sf), ["line", "sample"], GT)


@query("P6_image_geometry", sql(f"SELECT line, sample, {s6('x', 'x', 9)}, {s6('y', 'y', 9)}, {s6('z')} FROM gm", **GEOM))
def _(spark, sf):
    return geometry(spark, sf).select("line", "sample", r6("x", digits=9), r6("y", digits=9), r6("z"))


@query("P7_view_angles", sql("SELECT flight, t, sample, round(degrees(acos(cs)) * 100)::BIGINT AS zenith, round(degrees(CASE WHEN hd < 0 THEN hd + 2 * pi() ELSE hd END) * 10)::BIGINT AS heading, round(height - 100.123::DOUBLE - sample)::BIGINT AS height FROM v6",
       **sv.ecef_poses(),
       v1=f"SELECT ep.*, lat, lon, height, {sv.cols('m', sv.rod(['ep.r0', 'ep.r1', 'ep.r2']))}, {sv.cols('n', sv.ecef('(lat + 1 / 3600)', 'lon', 'height'))}, {sv.cols('u', sv.frame('ned', 'lat', 'lon')[6:])} FROM ep JOIN poses USING (flight, t)",
       v2=f"SELECT flight, t, height, sample, {sv.cols('v', sv.mv(sv.n('m', 9), ['0', '(sample - 9.5::DOUBLE)', F_C]))}, {sv.cols('n', [f'n{k} - p{k}' for k in range(3)])}, u0, u1, u2 FROM (SELECT *, unnest(range(20)) AS sample FROM v1)",
       v3="SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS vl, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS nl FROM v2",
       v4="SELECT flight, t, height, sample, v0 / vl AS v0, v1 / vl AS v1, v2 / vl AS v2, n0 / nl AS n0, n1 / nl AS n1, n2 / nl AS n2, u0, u1, u2, (v0 * u0 + v1 * u1 + v2 * u2) / vl AS cs FROM v3",
       v5="SELECT *, v0 - cs * u0 AS f0, v1 - cs * u1 AS f1, v2 - cs * u2 AS f2 FROM v4",
       v6="SELECT flight, t, height, sample, cs, atan2(-((f1 * n2 - f2 * n1) * u0 + (f2 * n0 - f0 * n2) * u1 + (f0 * n1 - f1 * n0) * u2), f0 * n0 + f1 * n1 + f2 * n2) AS hd FROM v5"))
def _(spark, sf):
    poses = poses_to_ecef(inp.poses_raw(spark, sf))
    return op.view_angles(poses, S, lambda s: op.fov_direction(s, S, FOV), ["flight", "t"], 100.123 + F.col("sample"))


FOOT = dict(
    en="SELECT line, max(CASE WHEN sample = 0 THEN pi END) AS ai, max(CASE WHEN sample = 0 THEN pj END) AS aj, max(CASE WHEN sample = 19 THEN pi END) AS bi, max(CASE WHEN sample = 19 THEN pj END) AS bj FROM ft GROUP BY 1",
    sg="SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, greatest(ceil(greatest(abs(bi - ai), abs(bj - aj))), 1)::BIGINT AS n FROM en WHERE ai IS NOT NULL AND bi IS NOT NULL)",
    fp="SELECT DISTINCT line, floor(ai + k / n * (bi - ai) + 0.5::DOUBLE)::BIGINT AS i, floor(aj + k / n * (bj - aj) + 0.5::DOUBLE)::BIGINT AS j FROM sg")


def footprints(spark, sf):
    """Narrow rays, so that both ends hit also the smallest raster's width."""
    hits = op.project_to_terrain(terrain_rays(spark, sf), inp.flat_dtm(spark, sf), ["line", "sample"], tile=16, block=8)
    return op.line_footprint(hits, ["line"], S)


@query("P8_line_footprint", sql("SELECT * FROM fp", **FLAT, **FOOT))
def _(spark, sf):
    return footprints(spark, sf)


@query("P9_coverage_mask", sql("SELECT i, j, EXISTS (SELECT 1 FROM fp WHERE fp.i = dtm.i AND fp.j = dtm.j) AS covered FROM dtm", **FLAT, **FOOT))
def _(spark, sf):
    return op.coverage_mask(inp.flat_dtm(spark, sf), footprints(spark, sf))


@query("P9_nadir_cover", sql("SELECT i, j, EXISTS (SELECT 1 FROM lp WHERE floor(p0 + 0.5::DOUBLE) = i AND floor(p1 + 0.5::DOUBLE) = j) AS covered FROM dtm"))
def _(spark, sf):
    lines = inp.line_poses(inp.pixels(spark, sf))
    cells = lines.select(F.floor(F.col("p_0") + 0.5).alias("i"), F.floor(F.col("p_1") + 0.5).alias("j"))
    return op.coverage_mask(inp.flat_dtm(spark, sf), cells)
