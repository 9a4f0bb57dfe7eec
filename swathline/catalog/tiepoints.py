"""Tie points, landmarks and calibration tables (L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog import sqlvec as sv
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.catalog.geodesy import GT, rounded
from swathline.catalog.trajectory import MOUNT, ecef, mounting
from swathline.functions import vec
from swathline.operators import tiepoints as op
from swathline.plans import inputs as inp

S = inp.SAMPLES
CAM = dict(focal=35.0, pp=600.0, width=1201.0, a=[0.1, -0.2, 0.03, 0.0, 0.0, 0.01], b=[0.01, 0.02, -0.003, 0.0, 0.0, 0.001])


def lines(spark, sf):
    return inp.scan_lines(spark, sf).withColumnRenamed("flight", "seq")


def seq_poses(spark, sf):
    return ecef(spark, sf).withColumnRenamed("flight", "seq")


def seq_mounting(spark, sf):
    return mounting(spark, sf).withColumnRenamed("flight", "seq")


@query("L1_group_observations", sql("SELECT lm_id, seq, obs_id FROM obs WHERE lm_id IN (SELECT lm_id FROM obs GROUP BY 1 HAVING count(*) >= 2) AND lm_id NOT IN (SELECT lm_id FROM lms WHERE NOT is_set)"))
def _(spark, sf):
    return op.group_observations(inp.landmark_obs(spark, sf), inp.landmarks(spark, sf).where("not is_set"))


@query("L2_attached_landmarks", sql("SELECT DISTINCT seq, lm_id FROM obs WHERE lm_id IN (SELECT lm_id FROM lms WHERE is_set)"))
def _(spark, sf):
    return op.attached_landmarks(inp.landmark_obs(spark, sf), inp.landmarks(spark, sf).where("is_set"))


@query("L2_attached_landmarks_raster", sql("SELECT seq, lm_id FROM obs WHERE lm_id IN (SELECT lm_id FROM lms WHERE is_set)"))
def _(spark, sf):
    return op.attached_landmarks(inp.landmark_obs(spark, sf), inp.landmarks(spark, sf).where("is_set"), distinct=False)


def _count(col):
    return sql(f"SELECT seq, count(DISTINCT {col}) AS n FROM obs WHERE lm_id IN (SELECT lm_id FROM lms) AND {col} NOT IN (SELECT lm_id FROM lms WHERE NOT is_set) GROUP BY 1")


@query("L3_count_referred", _count("lm_id"))
def _(spark, sf):
    lm = inp.landmarks(spark, sf)
    return op.count_referred(inp.landmark_obs(spark, sf), lm, lm.where("not is_set").select(F.col("lm_id").alias("id")))


@query("L3_count_referred_compat", _count("obs_id"))
def _(spark, sf):
    lm = inp.landmarks(spark, sf)
    return op.count_referred(inp.landmark_obs(spark, sf), lm, lm.where("not is_set").select(F.col("lm_id").alias("id")), compat=True)


@query("L4_nearest_observation", sql(f"""SELECT q_id, m.o AS obs_id, {s6('m.d', 'dist')} FROM (SELECT lm_id AS q_id, lm_id % 8 AS seq, x * 2 + 0.013::DOUBLE AS x, y * 2.5::DOUBLE + 0.007::DOUBLE AS y FROM lms) q
       LEFT JOIN (SELECT q2.q_id, min({{'d': greatest(abs(q2.x - o.x), abs(q2.y - o.y)), 'o': o.obs_id}}) AS m FROM (SELECT lm_id AS q_id, lm_id % 8 AS seq, x * 2 + 0.013::DOUBLE AS x, y * 2.5::DOUBLE + 0.007::DOUBLE AS y FROM lms) q2
       JOIN obs o ON o.seq = q2.seq AND abs(q2.x - o.x) < 3 AND abs(q2.y - o.y) < 3 GROUP BY 1) USING (q_id)"""))
def _(spark, sf):
    lm = inp.landmarks(spark, sf)
    asked = lm.select(F.col("lm_id").alias("q_id"), (F.col("lm_id") % 8).alias("seq"), (F.col("x") * 2 + 0.013).alias("x"), (F.col("y") * 2.5 + 0.007).alias("y"))
    return op.nearest_observation(inp.landmark_obs(spark, sf), asked).select("q_id", "obs_id", r6("dist"))


TIMED = "SELECT o.*, o.seq AS flight, (l.line + 1 - y) * l.t + (y - l.line) * u.t AS t FROM obs o LEFT JOIN scan l ON l.flight = o.seq AND l.line = floor(o.y) LEFT JOIN scan u ON u.flight = o.seq AND u.line = floor(o.y) + 1"
RAYS = {**sv.ecef_poses(), "tm": TIMED, "qq": "SELECT flight, t FROM tm WHERE t IS NOT NULL", "br": sv.bracket("qq"), "mount": MOUNT,
        "r1": f"SELECT flight, t, w, {sv.cols('r', [f'(1 - w) * a{k} + w * b{k}' for k in range(3)])}, {sv.cols('p', [f'(1 - w) * s{k} + w * e{k}' for k in range(3)])} FROM br",
        "sn": "SELECT flight, min(t) AS t0, max(t) AS t1 FROM ep GROUP BY 1",
        "r2": f"SELECT obs_id, tm.seq, lm_id, x, CASE WHEN tm.t IS NULL THEN 'no line time' WHEN t0 IS NULL THEN 'no trajectory' WHEN tm.t < t0 THEN 'before trajectory' WHEN tm.t > t1 THEN 'after trajectory' ELSE 'ok' END AS status, {', '.join(f'r1.r{k}, r1.p{k}, coalesce(mr{k}, 0) AS mr{k}, coalesce(mt{k}, 0) AS mt{k}' for k in range(3))} FROM tm LEFT JOIN r1 ON r1.flight = tm.flight AND r1.t = tm.t LEFT JOIN mount ON mount.flight = tm.flight LEFT JOIN sn ON sn.flight = tm.flight",
        "r3": f"SELECT *, {sv.cols('a', sv.rod(sv.n('r')))}, {sv.cols('b', sv.rod(sv.n('mr')))} FROM r2",
        "r4": f"SELECT *, {sv.cols('v', sv.mv(sv.n('b', 9), ['0', '((x - 10) / 33)', '1']))} FROM r3",
        "r5": f"SELECT obs_id, status, {sv.cols('o', [f'CASE WHEN status = $$ok$$ THEN {e} + p{k} END' for k, e in enumerate(sv.mv(sv.n('a', 9), sv.n('mt')))])}, {sv.cols('d', [f'CASE WHEN status = $$ok$$ THEN {e} END' for e in sv.mv(sv.n('a', 9), sv.n('v'))])} FROM r4"}


@query("L5_observation_rays", sql(f"SELECT obs_id, status, {sv.rnd('o', 'o', 3)}, {sv.rnd('d', 'd', 5)} FROM r5", **RAYS))
def _(spark, sf):
    out = op.observation_rays(inp.landmark_obs(spark, sf), lines(spark, sf), seq_poses(spark, sf), seq_mounting(spark, sf), S, 33.0)
    return out.select("obs_id", "status", *rounded("o", digits=3), *rounded("d", digits=5))


def sighted(spark, sf):
    """Rays from scattered origins towards the landmark, a little off; every 13th looks away from it."""
    o = inp.landmark_obs(spark, sf).withColumnsRenamed({"x": "u", "y": "v"}).join(inp.landmarks(spark, sf), "lm_id")
    k, side = F.col("obs_id"), F.when(F.col("obs_id") % 13 == 0, -1.0).otherwise(1.0)
    origin = [F.col("u") * 3, F.col("v") * 2, k % 5 - 30.0]
    off = [(k % 7 - 3) / 50, (k % 11 - 5) / 50, (k % 3 - 1) / 50]
    target = [F.col(c) for c in "xyz"]
    return vec.keep(o, o=origin, d=[side * (t - p + e) for t, p, e in zip(target, origin, off)])


SIGHT = {"sg": "SELECT lm_id, o.x * 3 AS o0, o.y * 2 AS o1, o.obs_id % 5 - 30.0::DOUBLE AS o2, CASE WHEN o.obs_id % 13 = 0 THEN -1 ELSE 1 END AS sd, l.x AS l0, l.y AS l1, l.z AS l2, (o.obs_id % 7 - 3) / 50 AS f0, (o.obs_id % 11 - 5) / 50 AS f1, (o.obs_id % 3 - 1) / 50 AS f2 FROM obs o JOIN lms l USING (lm_id)",
         "ry": "SELECT lm_id, o0, o1, o2, sd * (l0 - o0 + f0) AS d0, sd * (l1 - o1 + f1) AS d1, sd * (l2 - o2 + f2) AS d2 FROM sg",
         "rz": "SELECT *, d0 * d0 + d1 * d1 + d2 * d2 AS dd, d0 * o0 + d1 * o1 + d2 * o2 AS dp FROM ry",
         "ne": "SELECT lm_id, " + ", ".join(f"sum({'dd' if a == b else '0'} - d{a} * d{b}) AS a{a}{b}" for a in range(3) for b in range(3)) + ", " + ", ".join(f"sum(dd * o{k} - d{k} * dp) AS b{k}, avg(o{k}) AS mp{k}, avg(d{k} / sqrt(dd)) AS md{k}" for k in range(3)) + " FROM rz GROUP BY 1",
         "dt": "SELECT *, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20) AS det FROM ne",
         "so": "SELECT *, (b0 * (a11 * a22 - a12 * a21) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a21 - a11 * b2)) / det AS x0, (a00 * (b1 * a22 - a12 * b2) - b0 * (a10 * a22 - a12 * a20) + a02 * (a10 * b2 - b1 * a20)) / det AS x1, (a00 * (a11 * b2 - b1 * a21) - a01 * (a10 * b2 - b1 * a20) + b0 * (a10 * a21 - a11 * a20)) / det AS x2 FROM dt WHERE abs(det) > 0",
         "c1": "SELECT lm_id, min(d0 * (x0 - o0) + d1 * (x1 - o1) + d2 * (x2 - o2)) AS fr, avg(sqrt(pow(x0 - o0, 2) + pow(x1 - o1, 2) + pow(x2 - o2, 2))) AS rg FROM ry JOIN so USING (lm_id) GROUP BY 1",
         "s2": "SELECT lm_id, mp0 + md0 * greatest(10, rg) AS x0, mp1 + md1 * greatest(10, rg) AS x1, mp2 + md2 * greatest(10, rg) AS x2 FROM so JOIN c1 USING (lm_id) WHERE fr <= 0",
         "c2": "SELECT lm_id, min(d0 * (x0 - o0) + d1 * (x1 - o1) + d2 * (x2 - o2)) AS fr FROM ry JOIN s2 USING (lm_id) GROUP BY 1",
         "tri": "SELECT lm_id, x0, x1, x2, 'least squares' AS method FROM so JOIN c1 USING (lm_id) WHERE fr > 0 UNION ALL SELECT lm_id, x0, x1, x2, 'mean of rays' FROM s2 JOIN c2 USING (lm_id) WHERE fr > 0"}


def many(df):
    """Landmarks seen at least four times: two nearly parallel rays have no stable point to compare."""
    return df.join(df.groupBy("lm_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("lm_id"), "lm_id", "left_semi")


@query("L6_triangulate", sql(f"SELECT lm_id, {sv.rnd('x', 'x', 4)}, method FROM tri", **{**SIGHT, "sg": SIGHT["sg"] + " WHERE lm_id IN (SELECT lm_id FROM obs GROUP BY 1 HAVING count(*) >= 4)"}))
def _(spark, sf):
    return op.triangulate(many(sighted(spark, sf))).select("lm_id", *rounded("x", digits=4), "method")


def posed(spark, sf):
    """Observation with landmark, pose, lever arm and rates as columns."""
    o = inp.landmark_obs(spark, sf).withColumnsRenamed({"x": "u", "y": "v"}).join(inp.landmarks(spark, sf), "lm_id")
    k = F.col("obs_id")
    third = lambda n: [(k % a - b) / n for a, b in ((7, 3), (5, 2), (3, 1))]
    return vec.keep(o, l=[F.col(c) for c in "xyz"], r=third(50), p=[F.col("u") / 2, F.col("v") / 2, F.lit(-20.0)],
                    mr=third(80), mt=third(10), w=third(900), vel=third(30))


def _res(moved):
    third = lambda n: [f"((obs_id % {a} - {b}) / {n})" for a, b in ((7, 3), (5, 2), (3, 1))]
    dt = "(v * 0.25::DOUBLE)"
    r, p = third(50), ["u / 2", "v / 2", "-20.0::DOUBLE"]
    if moved:
        r = [f"({a} + {b} * {dt})" for a, b in zip(r, third(900))]
        p = [f"({a} + {b} * {dt})" for a, b in zip(p, third(30))]
    poly = lambda c: "(" + " + ".join(f"{x}::DOUBLE * pow(u / 1201, {i})" for i, x in enumerate(c)) + ")"
    return sql(f"SELECT obs_id, {s6('CASE WHEN g2 > 0 THEN g1 / g2 * 35 + 600 - (u + ' + poly(CAM['a']) + ') END', 'res_u', 5)}, {s6('CASE WHEN g2 > 0 THEN g0 / g2 * 35 - (v + ' + poly(CAM['b']) + ') END', 'res_v', 5)} FROM k4",
               k1=f"SELECT obs_id, o.x AS u, o.y AS v, l.x AS l0, l.y AS l1, l.z AS l2 FROM obs o JOIN lms l USING (lm_id)",
               k2=f"SELECT *, {sv.cols('r', r)}, {sv.cols('p', p)}, {sv.cols('h', third(80))}, {sv.cols('m', third(10))} FROM k1",
               k3=f"SELECT *, {sv.cols('a', sv.rod(sv.n('r')))}, {sv.cols('b', sv.rod(sv.n('h')))} FROM k2",
               k35=f"SELECT *, {sv.cols('s', sv.mv(sv.tr(sv.n('a', 9)), [f'(l{k} - p{k})' for k in range(3)]))} FROM k3",
               k4=f"SELECT *, {sv.cols('g', [f'{e} + m{k}' for k, e in enumerate(sv.mv(sv.n('b', 9), sv.n('s')))])} FROM k35")


@query("L7_reprojection_residual", _res(False))
def _(spark, sf):
    return op.reprojection_residual(posed(spark, sf), **CAM).select("obs_id", r6("res_u", digits=5), r6("res_v", digits=5))


@query("L7_reprojection_errors")
def _(spark, sf):
    """The whole chain: line time, pose on the trajectory, lever arm, distortion."""
    e = inp.poses_raw(spark, sf)
    poses = vec.keep(e, r=[F.col(c) for c in ("roll", "pitch", "yaw")], p=[F.col("n") % 97 / 2, F.col("n") % 89 / 2, -F.col("height") / 10])
    poses = poses.select(F.col("flight").alias("seq"), "t", *[f"{n}_{k}" for n in "rp" for k in range(3)])
    out = op.reprojection_errors(inp.landmark_obs(spark, sf), inp.landmarks(spark, sf), lines(spark, sf), poses, seq_mounting(spark, sf), **CAM)
    return out.select("obs_id", "lm_id", r6("res_u", digits=3), r6("res_v", digits=3))


@query("L8_rate_reprojection", _res(True))
def _(spark, sf):
    return op.rate_reprojection(posed(spark, sf), 0.25, **CAM).select("obs_id", r6("res_u", digits=5), r6("res_v", digits=5))


def closest(spark, sf):
    e = inp.poses_raw(spark, sf)
    poses = vec.keep(e, r=[F.col(c) for c in ("roll", "pitch", "yaw")], p=[F.col("n") % 97 / 2, F.col("n") % 89 / 2, -F.col("height") / 10])
    poses = poses.select(F.col("flight").alias("seq"), "t", *[f"{n}_{k}" for n in "rp" for k in range(3)])
    lm = inp.landmarks(spark, sf).where("is_set").select("lm_id", F.col("x").alias("l_0"), F.col("y").alias("l_1"), F.col("z").alias("l_2"))
    obs = inp.landmark_obs(spark, sf).withColumn("x", F.col("x") * 1.3 - 1).join(lm, "lm_id")
    return op.closest_approach_time(obs, poses, S, lambda s: [F.lit(0.0), s - 9.5, F.lit(30.0)], block=16)


CLOSE = {"cp": f"SELECT flight, t, n % 97 / 2 AS p0, n % 89 / 2 AS p1, -height / 10 AS p2, {sv.cols('m', sv.rod(['roll', 'pitch', 'yaw']))} FROM poses",
         "cb": "SELECT obs_id, seq, o.y, l.x AS l0, l.y AS l1, l.z AS l2, least(greatest(o.x * 1.3::DOUBLE - 1, 0), 19) - 9.5::DOUBLE AS v1 FROM obs o JOIN lms l USING (lm_id) WHERE is_set AND ceil(o.x * 1.3::DOUBLE - 1) >= 0 AND floor(o.x * 1.3::DOUBLE - 1) < 20",
         "cc": f"SELECT obs_id, seq, y, t, l0 - p0 AS e0, l1 - p1 AS e1, l2 - p2 AS e2, {sv.cols('g', sv.mv(sv.n('m', 9), ['0', 'v1', '30']))} FROM cb JOIN cp ON cp.flight = cb.seq",
         "cd": "SELECT *, (g0 * e0 + g1 * e1 + g2 * e2) / (g0 * g0 + g1 * g1 + g2 * g2) AS s FROM cc",
         "ce": "SELECT obs_id, seq, y, t, sqrt(pow(e0 - s * g0, 2) + pow(e1 - s * g1, 2) + pow(e2 - s * g2, 2)) AS dist FROM cd",
         "cl": "SELECT obs_id, seq, y, arg_min(t, dist) AS t, min(dist) AS dist FROM ce GROUP BY 1, 2, 3"}


@query("L9_closest_approach_time", sql(f"SELECT obs_id, {s6('t')}, {s6('dist', 'dist', 5)} FROM cl", **CLOSE))
def _(spark, sf):
    return closest(spark, sf).select("obs_id", r6("t"), r6("dist", digits=5))


@query("L10_fit_time_line", sql(f"SELECT seq, {s6('regr_slope(t - 1704067200, y)', 'slope', 2)}, {s6('regr_intercept(t - 1704067200, y)', 'intercept', 2)} FROM tm WHERE t IS NOT NULL GROUP BY 1", tm=TIMED))
def _(spark, sf):
    from swathline.operators.trajectory import time_at_line

    timed = time_at_line(lines(spark, sf), inp.landmark_obs(spark, sf)).where("t is not null").withColumn("t", F.col("t") - 1704067200)
    return op.fit_time_line(timed).select("seq", r6("slope", digits=2), r6("intercept", digits=2))


@query("L10_time_line_report", sql(f"SELECT s.flight AS seq, line, {s6('predicted', 'predicted', 2)}, {s6('predicted - (t - 1704067200)', 'delta', 2)} FROM (SELECT scan.*, slope * line + intercept AS predicted, n FROM scan JOIN (SELECT flight, count(*) AS n FROM scan GROUP BY 1) USING (flight) JOIN (SELECT seq AS flight, regr_slope(t - 1704067200, y) AS slope, regr_intercept(t - 1704067200, y) AS intercept FROM tm WHERE t IS NOT NULL GROUP BY 1) USING (flight)) s WHERE line % greatest(n // 20, 1) = 0", tm=TIMED))
def _(spark, sf):
    from swathline.operators.trajectory import time_at_line

    shifted = lines(spark, sf).withColumn("t", F.col("t") - 1704067200)
    fit = op.fit_time_line(time_at_line(shifted, inp.landmark_obs(spark, sf)).where("t is not null"))
    return op.time_line_report(fit, shifted).select("seq", "line", r6("predicted", digits=2), r6("delta", digits=2))


@query("L11_dtm_prior", sql(f"SELECT obs_id, lm_id, {sv.rnd('e', 'e', 3)} FROM pe",
       dc="SELECT obs_id, lm_id, x, y, floor(y) + a AS ci, floor(x) + b AS cj, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM obs, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)",
       dz="SELECT obs_id, lm_id, x, y, sum(w * z) AS z FROM dc LEFT JOIN dtm ON dtm.i = ci AND dtm.j = cj WHERE w > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) = count(z)",
       pg=f"SELECT obs_id, lm_id, {sv.cols('g', sv.ecef('(y * (-0.0001::DOUBLE) + 46.0)', '(x * 0.0001::DOUBLE + 6.0)', 'z'))}, {sv.cols('f', sv.frame('enu', '46.0', '6.0'))}, {sv.cols('c', sv.ecef('46.0', '6.0', '0'))} FROM dz",
       pe=f"SELECT obs_id, lm_id, {sv.cols('e', sv.mv(sv.n('f', 9), [f'(g{k} - c{k})' for k in range(3)]))} FROM pg"))
def _(spark, sf):
    return op.dtm_prior(inp.landmark_obs(spark, sf), inp.dtm(spark, sf), GT, 46.0, 6.0).select("obs_id", "lm_id", *rounded("e", digits=3))


@query("L12_valid_observations", sql("SELECT obs_id, reason, CASE WHEN reason = 'ok' THEN 2 ELSE 0 END::BIGINT AS equations FROM (SELECT obs_id, CASE WHEN l.lm_id IS NULL THEN 'no landmark' WHEN NOT enabled THEN 'disabled' WHEN NOT is_set THEN 'no position' WHEN t IS NULL THEN 'no time' WHEN t0 IS NULL THEN 'no trajectory' WHEN t < t0 OR t > t1 THEN 'outside trajectory' ELSE 'ok' END AS reason FROM tm LEFT JOIN lms l USING (lm_id) LEFT JOIN (SELECT flight, min(t) AS t0, max(t) AS t1 FROM poses GROUP BY 1) USING (flight))", tm=TIMED))
def _(spark, sf):
    poses = inp.poses_raw(spark, sf).withColumnRenamed("flight", "seq")
    return op.valid_observations(inp.landmark_obs(spark, sf), inp.landmarks(spark, sf), lines(spark, sf), poses)


def numbered_matches(spark, sf):
    """Matches named by their line item (order, line, part are unique together for practical purposes)."""
    li = inp.table(spark, sf, "lineitem")
    n = inp.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    raw = li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("match_id"), F.col("l_suppkey").alias("c1"),
        (F.col("l_partkey") % n).alias("c2"), (F.col("l_quantity").cast("bigint") % 20).alias("x1"), F.col("l_linenumber").cast("bigint").alias("y1"),
        (F.col("l_partkey") % 20).alias("x2"), (F.col("l_orderkey") % 24).alias("y2"), (F.col("l_returnflag") == "N").alias("ok"))
    return raw.where("x1 <> 0 and y1 <> 0 and x2 <> 0 and y2 <> 0")


def pairs(spark, sf):
    _, chunks, _ = inp.tie_tables(spark, sf)
    m = numbered_matches(spark, sf)
    return op.ray_pairs(m.drop("ok"), chunks, m.where("ok").select("match_id"), lines(spark, sf), seq_poses(spark, sf), S, 35.0)


F_C = "(19 / (2 * tan(radians(35::DOUBLE) / 2)))"
_V = lambda x: ["0", f"((9.5::DOUBLE - {x}) / sqrt(pow(9.5::DOUBLE - {x}, 2) + pow({F_C}, 2)))", f"({F_C} / sqrt(pow(9.5::DOUBLE - {x}, 2) + pow({F_C}, 2)))"]


@query("L13_ray_pairs", sql(f"SELECT match_id, {sv.rnd('v', 'v1')}, {sv.rnd('u', 'v2')}, {sv.rnd('z', 'r', 5, 9)}, {sv.rnd('t', 't', 2)} FROM w3", **sv.ecef_poses(), br=sv.bracket("scan"),
       lpz=f"SELECT scan.flight AS b, scan.line AS y, {sv.cols('r', [f'(1 - w) * a{k} + w * b{k}' for k in range(3)])}, {sv.cols('p', [f'(1 - w) * s{k} + w * e{k}' for k in range(3)])} FROM scan JOIN br USING (flight, t) WHERE w IS NOT NULL",
       mt="SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS match_id, l_suppkey AS c1, l_partkey % (SELECT count(*) FROM supplier) AS c2, l_quantity::BIGINT % 20 AS x1, l_linenumber::BIGINT AS y1, l_partkey % 20 AS x2, l_orderkey % 24 AS y2, l_returnflag = 'N' AS ok FROM lineitem",
       mz="SELECT * FROM mt WHERE x1 <> 0 AND y1 <> 0 AND x2 <> 0 AND y2 <> 0 AND match_id IN (SELECT match_id FROM mt WHERE ok AND x1 <> 0 AND y1 <> 0 AND x2 <> 0 AND y2 <> 0)",
       w1=f"SELECT match_id, x1, x2, {', '.join(f'k1.p{k} - k2.p{k} AS q{k}' for k in range(3))}, {sv.cols('m', sv.rod(['k1.r0', 'k1.r1', 'k1.r2']))}, {sv.cols('o', sv.rod(['k2.r0', 'k2.r1', 'k2.r2']))} FROM mz JOIN chunks h1 ON h1.chunk_id = c1 JOIN chunks h2 ON h2.chunk_id = c2 JOIN lpz k1 ON k1.b = h1.bil_id AND k1.y = y1 JOIN lpz k2 ON k2.b = h2.bil_id AND k2.y = y2 WHERE h1.bil_id <> h2.bil_id",
       w3=f"SELECT match_id, {sv.cols('v', _V('x1'))}, {sv.cols('u', _V('x2'))}, {sv.cols('z', sv.mm(sv.tr(sv.n('o', 9)), sv.n('m', 9)))}, {sv.cols('t', sv.mv(sv.tr(sv.n('o', 9)), sv.n('q')))} FROM w1"))
def _(spark, sf):
    return pairs(spark, sf).select("match_id", *rounded("v1"), *rounded("v2"), *rounded("r", digits=5, k=9), *rounded("t", digits=2))


@query("L14_bootstrap_boresight")
def _(spark, sf):
    return op.bootstrap_boresight(pairs(spark, sf), max_obs=500)


@query("L15_tie_point_uvt", sql(f"SELECT obs_id AS pt_id, seq, {s6('x', 'u')}, 0.0::DOUBLE AS v, {s6('coalesce(t, y)', 't', 3)} FROM tm", tm=TIMED))
def _(spark, sf):
    pts = inp.landmark_obs(spark, sf).select("seq", F.col("obs_id").alias("pt_id"), F.col("x").alias("u"), F.col("y").alias("v"))
    return op.tie_point_uvt(pts, lines(spark, sf)).select("pt_id", "seq", r6("u"), "v", r6("t", digits=3))


def image(spark, sf):
    return inp.pixels(spark, sf).select(F.col("file_id").alias("img"), "line", "sample", F.col("dns")[12].alias("value"))


HARRIS = {"im": "SELECT file_id AS img, line, sample, dn AS value FROM px WHERE band = 12",
          "gr": "SELECT c.img, c.line, c.sample, (r.value - l.value) / 2 AS gx, (d.value - u.value) / 2 AS gy FROM im c JOIN im l ON l.img = c.img AND l.line = c.line AND l.sample = c.sample - 1 JOIN im r ON r.img = c.img AND r.line = c.line AND r.sample = c.sample + 1 JOIN im u ON u.img = c.img AND u.line = c.line - 1 AND u.sample = c.sample JOIN im d ON d.img = c.img AND d.line = c.line + 1 AND d.sample = c.sample",
          "hs": "SELECT a.img, a.line, a.sample, sum(b.gx * b.gx) AS xx, sum(b.gy * b.gy) AS yy, sum(b.gx * b.gy) AS xy FROM gr a JOIN gr b ON a.img = b.img AND abs(a.line - b.line) <= 3 AND abs(a.sample - b.sample) <= 3 GROUP BY 1, 2, 3",
          "sc": "SELECT img, line, sample, xx * yy - xy * xy - 0.04::DOUBLE * (xx + yy) * (xx + yy) AS response FROM hs",
          "co": "SELECT * FROM sc a WHERE response > 0 AND response >= (SELECT max(response) FROM sc b WHERE a.img = b.img AND abs(a.line - b.line) <= 3 AND abs(a.sample - b.sample) <= 3)"}


ALL_BANDS = {**HARRIS, "im": "SELECT file_id * 64 + band AS img, line, sample, dn AS value FROM px"}


@query("L16_corner_candidates", sql("SELECT img, line, sample, row_number() OVER (PARTITION BY img ORDER BY response DESC, line, sample) AS rank FROM co", **ALL_BANDS))
def _(spark, sf):
    """Corners of every band of every file."""
    every = inp.pixels_long(spark, sf).select((F.col("file_id") * 64 + F.col("band")).alias("img"), "line", "sample", F.col("dn").alias("value"))
    return op.corner_candidates(every).select("img", "line", "sample", "rank")


def matched(spark, sf):
    """Corners of each file against those of the next one, compared by spectrum."""
    corners = op.corner_candidates(image(spark, sf))
    px = inp.pixels(spark, sf).select(F.col("file_id").alias("img"), "line", "sample", "spectrum")
    pts = corners.join(px, ["img", "line", "sample"]).select("img", (F.col("line") * 20 + F.col("sample")).alias("id"), F.col("spectrum").alias("desc"))
    return op.match_corners(pts.withColumnRenamed("img", "pair"), pts.select((F.col("img") - 1).alias("pair"), "id", "desc"))


DESC = {**HARRIS, "ds": "SELECT p.file_id AS img, p.line * 20 + p.sample AS id, p.band, p.v FROM px p JOIN co ON co.img = p.file_id AND co.line = p.line AND co.sample = p.sample",
        "gp": "SELECT x.img AS pair, x.id AS a, y.id AS b, sum((x.v - y.v) * (x.v - y.v)) AS dist FROM ds x JOIN ds y ON y.img = x.img + 1 AND x.band = y.band GROUP BY 1, 2, 3",
        "mn": "SELECT pair, a, b, dist FROM gp g WHERE dist = (SELECT min(dist) FROM gp h WHERE h.pair = g.pair AND h.a = g.a) AND dist = (SELECT min(dist) FROM gp h WHERE h.pair = g.pair AND h.b = g.b)"}


@query("L17_match_corners", sql(f"SELECT pair, a, b, {s6('dist')} FROM mn", **DESC))
def _(spark, sf):
    return matched(spark, sf).select("pair", "a", "b", r6("dist"))


def _moved(x: str, y: str) -> list[str]:
    """A known affine map, and every fifth match thrown far off (in another direction each)."""
    out = "CASE WHEN (a + pair) % 5 = 0 THEN {} * (200 + (a * 37) % 100) ELSE 0 END"
    return [f"1.02 * {x} - 0.03 * {y} + 5 + {out.format('(1 - 2 * (a % 2))')}", f"0.03 * {x} + 0.98 * {y} - 7 + {out.format('(1 - 2 * (a % 3 % 2))')}"]


@query("L17_filter_inliers", sql("SELECT file_id AS pair, line * 20 + sample AS a FROM px WHERE band = 0 AND (line * 20 + sample + file_id) % 5 <> 0"))
def _(spark, sf):
    at = inp.pixels(spark, sf).select(F.col("file_id").alias("pair"), (F.col("line") * 20 + F.col("sample")).alias("a"),
                                      (F.col("sample") * 40.0).alias("x1"), ((F.col("line") % 10) * 40.0).alias("y1"))
    x2, y2 = _moved("x1", "y1")
    return op.filter_inliers(at.select("pair", "a", F.col("a").alias("b"), "x1", "y1", F.expr(x2).alias("x2"), F.expr(y2).alias("y2"))).select("pair", "a")


SEEN_AGAIN = {k: v.replace("<= 3", "<= 1") for k, v in HARRIS.items()}


def seen_again(spark, sf):
    """Corners of each file, and those of the same ground seen three lines and two samples further on."""
    px = inp.pixels(spark, sf).select(F.col("file_id").alias("img"), "line", "sample", "spectrum", F.col("dns")[12].alias("value"))

    def corners(seen):
        at = op.corner_candidates(seen.select("img", "line", "sample", "value"), radius=1).join(seen, ["img", "line", "sample"])
        return at.select(F.col("img").alias("pair"), (F.col("line") * 32 + F.col("sample")).alias("id"), F.col("spectrum").alias("desc"))

    return corners(px), corners(px.withColumns({"line": F.col("line") + 3, "sample": F.col("sample") + 2}))


@query("L17_matched_inliers", sql("SELECT img AS pair, line * 32 + sample AS a, (line + 3) * 32 + sample + 2 AS b FROM co WHERE img IN (SELECT img FROM co GROUP BY 1 HAVING count(*) >= 4)", **SEEN_AGAIN))
def _(spark, sf):
    """Mutual nearest corners, then those that agree with a map."""
    m = op.match_corners(*seen_again(spark, sf))
    at = [(F.col(c) % 32).alias(f"x{k}") for c, k in (("a", 1), ("b", 2))] + [F.floor(F.col(c) / 32).alias(f"y{k}") for c, k in (("a", 1), ("b", 2))]
    return op.filter_inliers(m.select("pair", "a", "b", *at), threshold=0.5).select("pair", "a", "b")


@query("L17_assigned_corners", sql("SELECT img AS pair, line * 32 + sample AS a, (line + 3) * 32 + sample + 2 AS b, 0.0::DOUBLE AS dist FROM co", **SEEN_AGAIN))
def _(spark, sf):
    """One-to-one matches among all pairs of corners of a file: the same ground costs nothing, so the best total is known."""
    return op.assign_corners(*seen_again(spark, sf), reach=100.0, step=1e-4).select("pair", "a", "b", "dist")


@query("L18_timed_observations", sql(f"SELECT seq % 3 AS trajectory, seq, obs_id, lm_id, {s6('t', 't', 3)} FROM tm", tm=TIMED))
def _(spark, sf):
    obs = inp.landmark_obs(spark, sf)
    flown = obs.select("seq").distinct().withColumn("trajectory", F.col("seq") % 3)
    out = op.timed_observations(obs, flown, lines(spark, sf))
    return out.select("trajectory", "seq", "obs_id", "lm_id", r6("t", digits=3))


@query("L19_landmark_coordinates", sql("SELECT obs_id, lm_id, l.x, l.y, l.z, CASE WHEN l.lm_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM obs LEFT JOIN (SELECT * FROM lms WHERE is_set) l USING (lm_id)"))
def _(spark, sf):
    ids = inp.landmark_obs(spark, sf).select("obs_id", "lm_id")
    return op.landmark_coordinates(ids, inp.landmarks(spark, sf)).select("obs_id", "lm_id", "x", "y", "z", "status")
