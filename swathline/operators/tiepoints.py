"""Tie points, landmarks, triangulation and calibration tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec
from swathline.operators import projection, trajectory
from swathline.operators.raster import bilinear_sample
from swathline.plans.lines import spread
from swathline.session import cut_lineage


def group_observations(obs: DataFrame, solved: DataFrame) -> DataFrame:
    """Observations of landmarks seen at least twice and not solved yet: lm_id, seq, obs_id. One row per observation,
    so a landmark with many observations needs no list."""
    many = obs.groupBy("lm_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("lm_id")
    return obs.select("lm_id", "seq", "obs_id").join(many, "lm_id", "left_semi").join(solved.select("lm_id"), "lm_id", "left_anti")


def attached_landmarks(obs: DataFrame, landmarks: DataFrame, distinct: bool = True) -> DataFrame:
    """Landmark ids that observations of a sequence refer to and that exist; duplicates kept if not ``distinct``."""
    found = obs.select("seq", "lm_id").join(landmarks.select("lm_id"), "lm_id", "left_semi")
    return found.distinct() if distinct else found


def count_referred(obs: DataFrame, landmarks: DataFrame, excluded: DataFrame, compat: bool = False) -> DataFrame:
    """Referred landmarks per sequence without the excluded ids; ``compat`` counts and excludes observation ids."""
    live = obs.join(landmarks.select("lm_id"), "lm_id", "left_semi")
    counted = live.select("seq", F.col("obs_id" if compat else "lm_id").alias("id"))
    return counted.join(excluded.select("id"), "id", "left_anti").groupBy("seq").agg(F.countDistinct("id").alias("n"))


def nearest_observation(obs: DataFrame, asked: DataFrame, tol: float = 3.0, refine: tuple[int, ...] = (16, 4, 1)) -> DataFrame:
    """Nearest observation of the sequence by Chebyshev distance below ``tol``, the lowest id on a tie.

    Grid join with cells from fine (tol/16) to tol: a hit within one cell width is final, only points without one go
    on to the next grid, so crowded places are settled on small cells. Copies at one position count once.
    ``asked`` has seq, q_id, x, y; adds obs_id, dist (NULL for none).
    """
    unique = obs.groupBy("seq", "x", "y").agg(F.min("obs_id").alias("obs_id"))
    open_points, done = asked.select("seq", "q_id", "x", "y"), None
    for parts in refine:
        cell = tol / parts
        placed = unique.select(
            "seq", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"),
            F.col("x").alias("ox"), F.col("y").alias("oy"), "obs_id",
        )
        around = F.sequence(F.lit(-1), F.lit(1))
        wide = open_points.withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around)).select(
            "seq", "q_id", "x", "y", (F.floor(F.col("x") / cell) + F.col("_a")).alias("cx"), (F.floor(F.col("y") / cell) + F.col("_b")).alias("cy")
        )
        dist = F.greatest(F.abs(F.col("x") - F.col("ox")), F.abs(F.col("y") - F.col("oy")))
        hits = wide.join(placed, ["seq", "cx", "cy"]).where((dist < cell) if parts == 1 else (dist <= cell))
        best = hits.groupBy("seq", "q_id").agg(F.min(F.struct(dist.alias("d"), "obs_id")).alias("_m"))
        best = best.select("seq", "q_id", F.col("_m.obs_id").alias("obs_id"), F.col("_m.d").alias("dist"))
        done = best if done is None else done.unionByName(best)
        open_points = open_points.join(best, ["seq", "q_id"], "left_anti")
    return asked.join(done, ["seq", "q_id"], "left")


def observation_rays(
    obs: DataFrame, lines: DataFrame, poses: DataFrame, mounting: DataFrame, n_samples: int, focal: float,
) -> DataFrame:
    """Ray of each observation: obs_id, seq, lm_id, status, o_0..2, d_0..2 (NULL unless status is 'ok').

    Time from the line position, pose by component blend, lever arm added, direction (0, (x-mid)/f, 1) turned by
    mounting and pose. ``poses`` and ``mounting`` are keyed by seq.
    """
    timed = trajectory.time_at_line(lines, obs)
    at = trajectory.pose_at_time(poses, timed, "components", key="seq")
    met = timed.join(at, ["seq", "t"], "left").join(mounting, "seq", "left")
    met = met.fillna(0.0, [f"m{n}_{k}" for n in "rt" for k in range(3)])
    span = poses.groupBy("seq").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    met = met.join(span, "seq", "left")
    status = (
        F.when(F.col("t").isNull(), "no line time").when(F.col("_t0").isNull(), "no trajectory")
        .when(F.col("t") < F.col("_t0"), "before trajectory").when(F.col("t") > F.col("_t1"), "after trajectory").otherwise("ok")
    )
    met = vec.with_rodrigues(vec.with_rodrigues(met.withColumn("status", status), "a", vec.ref("r")), "b", vec.ref("mr"))
    turned = vec.matvec(vec.ref("b", 9), [F.lit(0.0), (F.col("x") - n_samples // 2) / focal, F.lit(1.0)])
    met = vec.keep(met, v=turned)
    met = vec.keep(met, o=vec.add(vec.matvec(vec.ref("a", 9), vec.ref("mt")), vec.ref("p")), d=vec.matvec(vec.ref("a", 9), vec.ref("v")))
    ok = F.col("status") == "ok"
    return met.select("obs_id", "seq", "lm_id", "status", *[F.when(ok, F.col(f"{n}_{k}")).alias(f"{n}_{k}") for n in "od" for k in range(3)])


def triangulate(rays: DataFrame) -> DataFrame:
    """Point of each landmark nearest to its rays in the sense d x x = d x p: lm_id, x_0..2, method.

    The normal equations are sums over rays, so a landmark with any number of observations is one partial-plus-final
    aggregation; the 3x3 system is solved in columns. When the point lies behind a ray, the mean of p + distance*d is
    taken (distance: mean range, at least 10), and landmarks behind a ray even then are left out.
    """
    d, p = vec.ref("d"), vec.ref("o")
    dd, dp = vec.dot(d, d), vec.dot(d, p)
    unit = vec.scale(d, F.try_divide(F.lit(1.0), F.sqrt(dd)))
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    sums = rays.groupBy("lm_id").agg(
        *[F.sum((dd if a == b else F.lit(0.0)) - d[a] * d[b]).alias(f"a{a}{b}") for a, b in pairs],
        *[F.sum(dd * p[k] - d[k] * dp).alias(f"b_{k}") for k in range(3)],
        *[F.avg(p[k]).alias(f"mp_{k}") for k in range(3)], *[F.avg(unit[k]).alias(f"md_{k}") for k in range(3)],
    )
    m = lambda a, b: F.col(f"a{min(a, b)}{max(a, b)}")
    cof = lambda a, b, c, e: m(a, b) * m(c, e) - m(a, e) * m(c, b)
    adj = [cof(1, 1, 2, 2), -cof(0, 1, 2, 2), cof(0, 1, 1, 2), cof(0, 0, 2, 2), -cof(0, 0, 1, 2), cof(0, 0, 1, 1)]
    sums = sums.withColumns({f"c{k}": e for k, e in enumerate(adj)})
    sums = sums.withColumn("det", m(0, 0) * F.col("c0") + m(0, 1) * F.col("c1") + m(0, 2) * F.col("c2"))
    inv = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
    b = vec.ref("b")
    solved = vec.keep(sums, x=[
        F.try_divide(F.col(f"c{row[0]}") * b[0] + F.col(f"c{row[1]}") * b[1] + F.col(f"c{row[2]}") * b[2], F.col("det")) for row in inv
    ]).select("lm_id", *[f"{n}_{k}" for n in ("x", "mp", "md") for k in range(3)])
    ahead = lambda df, point: rays.select("lm_id", *[f"{n}_{k}" for n in "od" for k in range(3)]).join(df, "lm_id").groupBy("lm_id").agg(
        F.min(vec.dot(vec.ref("d"), vec.sub(vec.ref(point), vec.ref("o")))).alias("front"),
        F.avg(vec.norm(vec.sub(vec.ref("o"), vec.ref(point)))).alias("range"),
    )
    first = solved.join(ahead(solved, "x"), "lm_id")
    good = first.where("front > 0").select("lm_id", "x_0", "x_1", "x_2", F.lit("least squares").alias("method"))
    reach = F.greatest(F.lit(10.0), F.col("range"))
    behind = vec.keep(first.where("front <= 0"), y=vec.add(vec.ref("mp"), vec.scale(vec.ref("md"), reach))).select("lm_id", "y_0", "y_1", "y_2")
    second = behind.join(ahead(behind, "y").select("lm_id", "front"), "lm_id").where("front > 0")
    return good.unionByName(second.select("lm_id", *[F.col(f"y_{k}").alias(f"x_{k}") for k in range(3)], F.lit("mean of rays").alias("method")))


def reprojection_residual(
    df: DataFrame, focal: float, pp: float, width: float, a: list[float], b: list[float],
) -> DataFrame:
    """Add res_u, res_v: sensor coordinates of the landmark minus the observed ones with distortion.

    ``df`` has the pose r_*, p_* (body to world), lever arm mr_*, mt_* (body to sensor), landmark l_*, observation u, v.
    Points behind the sensor get NULL.
    """
    df = vec.with_rodrigues(vec.with_rodrigues(df, "q", vec.ref("r")), "n", vec.ref("mr"))
    df = vec.keep(df, s=vec.matvec(vec.transpose(vec.ref("q", 9)), vec.sub(vec.ref("l"), vec.ref("p"))))
    df = vec.keep(df, s=vec.add(vec.matvec(vec.ref("n", 9), vec.ref("s")), vec.ref("mt")))
    front = F.col("s_2") > 0
    du, dv = projection.distortion(F.col("u"), width, a), projection.distortion(F.col("u"), width, b)
    return vec.drop(df.withColumns({
        "res_v": F.when(front, F.col("s_0") / F.col("s_2") * focal - (F.col("v") + dv)),
        "res_u": F.when(front, F.col("s_1") / F.col("s_2") * focal + pp - (F.col("u") + du)),
    }), "q", "n", "s")


def reprojection_errors(
    obs: DataFrame, landmarks: DataFrame, lines: DataFrame, poses: DataFrame, mounting: DataFrame, focal: float, pp: float,
    width: float, a: list[float], b: list[float],
) -> DataFrame:
    """Residual of every observation at the pose of its line time (manifold blend): obs_id, lm_id, res_u, res_v."""
    timed = trajectory.time_at_line(lines, obs)
    at = trajectory.pose_at_time(poses, timed, key="seq", inside_only=True)
    lm = landmarks.select("lm_id", F.col("x").alias("l_0"), F.col("y").alias("l_1"), F.col("z").alias("l_2"))
    met = timed.join(at, ["seq", "t"]).join(lm, "lm_id").join(mounting, "seq", "left")
    met = met.fillna(0.0, [f"m{n}_{k}" for n in "rt" for k in range(3)])
    met = met.withColumns({"u": F.col("x"), "v": F.lit(0.0)})
    return reprojection_residual(met, focal, pp, width, a, b).select("obs_id", "lm_id", "res_u", "res_v")


def rate_reprojection(df: DataFrame, time_per_pixel: float, **camera) -> DataFrame:
    """Residual with the pose moved by rates: r + w*dt, p + v*dt with dt = time_per_pixel * v (the line coordinate)."""
    dt = F.col("v") * time_per_pixel
    moved = vec.keep(df, r=vec.add(vec.ref("r"), vec.scale(vec.ref("w"), dt)), p=vec.add(vec.ref("p"), vec.scale(vec.ref("vel"), dt)))
    return reprojection_residual(moved, **camera)


FAN = 16
"""Children of a node in the hierarchy of trajectory blocks."""


def _angle(of: str, to: str) -> Column:
    """Angle of the rotation between two attitudes held as matrices."""
    turned = vec.matmul(vec.transpose(vec.ref(of, 9)), vec.ref(to, 9))
    return F.acos(F.least(F.greatest((turned[0] + turned[4] + turned[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def trajectory_hierarchy(rows: DataFrame, block: int, fan: int) -> tuple[DataFrame, int]:
    """Spheres and cones around consecutive poses: level, seq, node, c_*, h_* (first pose), rad, cone; and the number of levels above 0.

    ``rows``: seq, k (row number), p_*, m_*. A node of level 0 holds ``block`` rows, one of level l ``fan`` nodes of level l - 1:
    every origin lies within ``rad`` of c, every attitude within the angle ``cone`` of h.
    """
    head = [*[f"c_{k}" for k in range(3)], *[f"h_{k}" for k in range(9)]]
    of_row = [*[F.col(f"p_{k}").alias(f"c_{k}") for k in range(3)], *[F.col(f"m_{k}").alias(f"h_{k}") for k in range(9)]]
    placed = rows.withColumn("node", F.floor(F.col("k") / block))
    first = placed.where(F.col("k") % block == 0).select("seq", "node", *of_row)
    near = placed.join(first, ["seq", "node"]).groupBy("seq", "node").agg(
        F.max(vec.norm(vec.sub(vec.ref("p"), vec.ref("c")))).alias("rad"), F.max(_angle("h", "m")).alias("cone"))
    nodes = cut_lineage(near.join(first, ["seq", "node"]).select(F.lit(0).alias("level"), "seq", "node", *head, "rad", "cone"))
    last = nodes.agg(F.max("node")).first()[0] or 0
    levels, out = 0, nodes
    while fan**levels <= last:
        levels += 1
        below = nodes.withColumns({"child": F.col("node"), "node": F.floor(F.col("node") / fan)})
        first = below.where(F.col("child") % fan == 0).select("seq", "node", *[F.col(c).alias(f"n{c}") for c in head])
        # a child's sphere reaches as far as its centre is away, and its own radius; and its cone likewise
        both = below.join(first, ["seq", "node"]).groupBy("seq", "node").agg(
            F.max(vec.norm(vec.sub(vec.ref("c"), vec.ref("nc"))) + F.col("rad")).alias("rad"), F.max(_angle("nh", "h") + F.col("cone")).alias("cone"))
        nodes = both.join(first, ["seq", "node"]).select(F.lit(levels).alias("level"), "seq", "node", *[F.col(f"n{c}").alias(c) for c in head], "rad", "cone")
        nodes = cut_lineage(nodes)
        out = out.unionByName(nodes)
    return out, levels


def closest_approach_time(obs: DataFrame, poses: DataFrame, n_samples: int, direction, block: int = 64, fan: int = FAN) -> DataFrame:
    """Trajectory row whose ray passes closest to the landmark: obs_id, seq, y, t, dist (first row on a tie).

    Branch and bound down ``trajectory_hierarchy``: an observation begins with the children of its sequence's one top node. At
    each level a node gives a lower bound of the distance, and its first row an exact one; nodes whose bound doesn't exceed the
    best exact distance so far go on to their children, and in the end to their rows. Children and rows come as one array a
    node and are worked on inside the observation's row, so only nodes that stay open become rows, and rows of poses never do.
    Sequences without observations are left out. ``poses``: seq, t, r_*, p_*; ``obs``: seq, obs_id, x, y, l_0..2.
    """
    from swathline.plans.ordered import with_row_index

    lo, hi = F.floor("x"), F.ceil("x")
    a, c = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n_samples - 1))
    w = F.when((lo < 0) | (hi > n_samples - 1), 0.0).otherwise(F.col("x") - lo)
    start, end = F.when(lo < 0, c).otherwise(a), F.when(hi > n_samples - 1, a).otherwise(c)
    seen = obs.where((hi >= 0) & (lo < n_samples))
    ray = [(1 - w) * s + w * e for s, e in zip(direction(start), direction(end))]
    of_obs = ["seq", "obs_id", "y", *[f"{n}_{k}" for n in "lv" for k in range(3)]]
    seen = cut_lineage(spread(vec.keep(seen, v=ray).select(*of_obs), "seq", "obs_id"))
    poses = poses.join(cut_lineage(seen.select("seq").distinct()), "seq", "left_semi")
    rows = vec.with_rodrigues(with_row_index(poses, ["seq"], "t", "k"), "m", vec.ref("r"))
    rows = cut_lineage(rows.select("seq", "t", "k", *[f"p_{k}" for k in range(3)], *[f"m_{k}" for k in range(9)]))
    nodes, levels = trajectory_hierarchy(rows, block, fan)

    def parts(x: Column, name: str, n: int = 3) -> list[Column]:
        return [x[f"{name}_{k}"] for k in range(n)]

    def distances(of: str, m: str, p: str) -> Column:
        """For each pose of an array: itself, the distance of the landmark to the line through p along m*v, and to p. Each step
        names what the next one uses more than once."""
        def ray_to(x: Column) -> Column:
            g, e = vec.matvec(parts(x, m, 9), vec.ref("v")), vec.sub(vec.ref("l"), parts(x, p))
            return F.struct(x.alias("of"), *[v.alias(f"{n}_{k}") for n, vs in (("g", g), ("e", e)) for k, v in enumerate(vs)])

        def along(x: Column) -> Column:
            g, e = parts(x, "g"), parts(x, "e")
            return F.struct(x.alias("at"), (vec.dot(g, e) / vec.dot(g, g)).alias("s"))

        def beside(x: Column) -> Column:
            g, e = parts(x["at"], "g"), parts(x["at"], "e")
            return F.struct(x["at"]["of"].alias("of"), vec.norm(vec.sub(e, vec.scale(g, x["s"]))).alias("dist"), vec.norm(e).alias("far"))

        return F.transform(F.transform(F.transform(of, ray_to), along), beside)

    def bounded(x: Column) -> Column:
        far, rad = x["far"], x["of"]["rad"]
        off = F.asin(F.least(F.try_divide(x["dist"], far), F.lit(1.0)))
        slack = x["of"]["cone"] + F.asin(F.least(F.coalesce(F.try_divide(rad, far), F.lit(1.0)), F.lit(1.0)))
        bound = F.when(far <= rad, 0.0).otherwise((far - rad) * F.sin(F.greatest(off - slack, F.lit(0.0))))
        return F.struct(x["of"]["node"].alias("node"), x["dist"].alias("dist"), (F.coalesce(bound, F.lit(0.0)) - 1e-9).alias("bound"))

    top = max(levels - 1, 0)
    front = seen.withColumns({"node": F.lit(0).cast("bigint"), "_best": F.lit(None).cast("double")})
    for level in range(top, -1, -1):
        child = F.struct(*[c for c in nodes.columns if c not in ("level", "seq")])
        below = nodes.where(F.col("level") == level).select("seq", F.floor(F.col("node") / fan).alias("node"), child.alias("child"))
        below = below.groupBy("seq", "node").agg(F.array_sort(F.collect_list("child")).alias("_at"))
        met = front.join(below, ["seq", "node"]).withColumn("_at", distances("_at", "h", "c")).withColumn("_at", F.transform("_at", bounded))
        if level == top:
            met = met.where(F.col("_at")[0]["dist"].isNotNull())  # that of the top node's first row, the first best one
        met = met.withColumn("_best", F.least("_best", F.array_min(F.transform("_at", lambda x: x["dist"]))))
        if level < top:  # before, all nodes of an observation are in its one row
            met = met.withColumn("_best", F.min("_best").over(Window.partitionBy("seq", "obs_id")))
        met = met.select(*of_obs, "_best", F.explode("_at").alias("_n")).select(*of_obs, "_best", "_n.node", "_n.bound")
        front = met = cut_lineage(met.where("bound <= _best"))
    held = rows.groupBy("seq", F.floor(F.col("k") / block).alias("node")).agg(F.collect_list(F.struct("t", *[f"p_{k}" for k in range(3)], *[f"m_{k}" for k in range(9)])).alias("_at"))
    pairs = front.drop("_best", "bound").join(held, ["seq", "node"]).withColumn("_at", distances("_at", "m", "p"))
    nearest = F.array_min(F.transform("_at", lambda x: F.struct(x["dist"].alias("d"), x["of"]["t"].alias("t"))))
    return pairs.select("seq", "obs_id", "y", nearest.alias("_m")).groupBy("seq", "obs_id").agg(
        F.first("y").alias("y"), F.min("_m").alias("_m")
    ).select("seq", "obs_id", "y", F.col("_m.t").alias("t"), F.col("_m.d").alias("dist"))


def fit_time_line(timed: DataFrame) -> DataFrame:
    """Least squares t = intercept + slope*y per sequence."""
    return timed.groupBy("seq").agg(F.regr_slope("t", "y").alias("slope"), F.regr_intercept("t", "y").alias("intercept"))


def time_line_report(fit: DataFrame, lines: DataFrame, tests: int = 20) -> DataFrame:
    """Predicted against observed time on about ``tests`` evenly spaced lines: seq, line, predicted, observed, delta."""
    n = lines.groupBy("seq").agg(F.greatest(F.floor((F.max("line") + 1) / tests), F.lit(1)).alias("_step"))
    picked = lines.join(n, "seq").where(F.col("line") % F.col("_step") == 0).join(fit, "seq")
    predicted = F.col("slope") * F.col("line") + F.col("intercept")
    return picked.select("seq", "line", predicted.alias("predicted"), F.col("t").alias("observed"), (predicted - F.col("t")).alias("delta"))


def dtm_prior(lm_obs: DataFrame, dtm: DataFrame, geotransform: list[float], lat0: float, lon0: float) -> DataFrame:
    """Prior position of landmarks marked on a raster (x column, y row): obs_id, lm_id, e_0..2 in the ENU frame at
    (lat0, lon0). Marks off the raster or on voids are left out."""
    a, b, c, d, e, f = geotransform
    at = bilinear_sample(lm_obs.withColumns({"pi": F.col("y"), "pj": F.col("x")}), dtm, ["obs_id"]).where("z is not null")
    lon, lat = F.col("x") * a + F.col("y") * b + c, F.col("x") * d + F.col("y") * e + f
    m, t = geo.local_frame("enu", F.lit(lat0), F.lit(lon0), F.lit(0.0))
    at = vec.keep(at, g=geo.geodetic_to_ecef(lat, lon, F.col("z")))
    return vec.keep(at, e=geo.apply_affine(m, t, vec.ref("g"))).select("obs_id", "lm_id", "e_0", "e_1", "e_2")


def valid_observations(obs: DataFrame, landmarks: DataFrame, lines: DataFrame, poses: DataFrame, equations: int = 2) -> DataFrame:
    """Audit of observations: obs_id, reason ('ok' or why it is not used), equations (0 unless ok)."""
    timed = trajectory.time_at_line(lines, obs)
    span = poses.groupBy("seq").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    met = timed.join(landmarks.select("lm_id", "is_set", F.lit(True).alias("_lm")), "lm_id", "left").join(span, "seq", "left")
    reason = (
        F.when(F.col("_lm").isNull(), "no landmark").when(~F.col("enabled"), "disabled").when(~F.col("is_set"), "no position")
        .when(F.col("t").isNull(), "no time").when(F.col("_t0").isNull(), "no trajectory")
        .when((F.col("t") < F.col("_t0")) | (F.col("t") > F.col("_t1")), "outside trajectory").otherwise("ok")
    )
    return met.select("obs_id", reason.alias("reason")).withColumn("equations", F.when(F.col("reason") == "ok", equations).otherwise(0))


def ray_pairs(
    matches: DataFrame, chunks: DataFrame, inliers: DataFrame | None, lines: DataFrame, poses: DataFrame, n_samples: int, fov_deg: float,
) -> DataFrame:
    """Ray pairs for boresight alignment: match_id, v1_*, v2_* (sensor rays), r_0..8, t_0..2 (body 1 to body 2).

    Poses and their matrices are made once per line, not per match. Matches inside one image, on lines outside the
    trajectory, or outside the inliers (if given) drop out. ``matches``: match_id, c1, c2, x1, y1, x2, y2.
    """
    if inliers is not None:
        matches = matches.join(inliers.select("match_id"), "match_id", "left_semi")
    at = trajectory.pose_at_time(poses, lines, "components", key="seq", inside_only=True)
    line_pose = vec.with_rodrigues(lines.join(at, ["seq", "t"]), "m", vec.ref("r"))
    matrix = [f"m_{k}" for k in range(9)] + [f"p_{k}" for k in range(3)]
    side = lambda n: line_pose.select(
        F.col("seq").alias(f"b{n}"), F.col("line").alias(f"y{n}"), *[F.col(c).alias(f"{c[0]}{n}{c[1:]}") for c in matrix])
    image = lambda n: chunks.select(F.col("chunk_id").alias(f"c{n}"), F.col("bil_id").alias(f"b{n}"))
    met = matches.join(image(1), "c1").join(image(2), "c2").where("b1 <> b2")
    met = met.join(side(1), ["b1", "y1"]).join(side(2), ["b2", "y2"])
    back = vec.transpose(vec.ref("m2", 9))
    met = vec.keep(
        met, r=vec.matmul(back, vec.ref("m1", 9)), t=vec.matvec(back, vec.sub(vec.ref("p1"), vec.ref("p2"))),
        v1=projection.fov_direction(F.col("x1"), n_samples, fov_deg, flipped=True),
        v2=projection.fov_direction(F.col("x2"), n_samples, fov_deg, flipped=True),
    )
    return met.select("match_id", *[f"v{n}_{k}" for n in (1, 2) for k in range(3)], *[f"r_{k}" for k in range(9)], *[f"t_{k}" for k in range(3)])


def bootstrap_boresight(
    pairs: DataFrame, max_obs: int, repeats: int = 100, share: float = 0.5, huber: float | None = None, max_iter: int = 50,
) -> DataFrame:
    """Boresight rotation by resampling: n_ok, n_fail, mean axis-angle (degrees) and mean deviation (degrees), mean
    iterations.

    Every repeat takes ``share`` of the rows, ``max_obs`` at most (the sample size of this estimator, so it has to be given):
    those with the smallest hash of (repeat, match). A row is only copied for repeats that it can belong to by a hash limit
    with a wide margin, so a repeat never holds much more than ``max_obs`` rows. Each repeat
    is aligned by Gauss-Newton on the coplanarity of the two rays with the baseline.
    """
    total = pairs.count()
    n = min(round(share * total), max_obs, total)
    repeats = 1 if n == total else repeats
    names = [f"v{s}_{k}" for s in (1, 2) for k in range(3)] + [f"r_{k}" for k in range(9)] + [f"t_{k}" for k in range(3)]
    cut = 1.0 if total == 0 else min(1.0, (n + 8 * math.sqrt(n) + 32) / total)
    place = lambda r: F.struct(r.alias("rep"), (F.pmod(F.xxhash64(r, "match_id"), F.lit(1 << 40)) / float(1 << 40)).alias("_h"))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), place), lambda x: x["_h"] < cut)
    drawn = pairs.withColumn("_d", F.explode(places)).withColumns({"rep": F.col("_d.rep"), "_h": F.col("_d._h")}).drop("_d")
    w = Window.partitionBy("rep").orderBy("_h", "match_id")
    drawn = drawn.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select("rep", *names)

    def align(pdf):
        import numpy as np
        import pandas as pd

        x = pdf[names].to_numpy()
        v1, v2, rel, t = x[:, :3], x[:, 3:6], x[:, 6:15].reshape(-1, 3, 3), x[:, 15:]
        t = t / np.linalg.norm(t, axis=1, keepdims=True)
        rot, ok, steps = np.eye(3), False, 0
        skew = lambda u: np.stack([np.zeros(len(u)), -u[:, 2], u[:, 1], u[:, 2], np.zeros(len(u)), -u[:, 0], -u[:, 1], u[:, 0], np.zeros(len(u))], 1).reshape(-1, 3, 3)
        for steps in range(1, max_iter + 1):
            a, b = v2 @ rot.T, np.einsum("nij,nj->ni", rel, v1 @ rot.T)
            e = np.einsum("ni,ni->n", a, np.cross(t, b))
            grad = -np.einsum("ni,nij->nj", np.cross(t, b), rot @ skew(v2))
            grad -= np.einsum("ni,nij->nj", np.cross(a, t), rel @ (rot @ skew(v1)))
            k = np.ones(len(e)) if huber is None else np.minimum(1.0, huber / np.maximum(np.abs(e), 1e-12))
            normal = (grad * k[:, None]).T @ grad
            try:
                step = -np.linalg.solve(normal + 1e-12 * np.eye(3), (grad * k[:, None]).T @ e)
            except np.linalg.LinAlgError:
                break
            if not np.isfinite(step).all():
                break
            size = np.linalg.norm(step)
            step = step if size < 0.5 else step * (0.5 / size)
            rot = rot @ _exp(step)
            if size < 1e-8:
                ok = True
                break
        axis = _log(rot)
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "a_0": [axis[0]], "a_1": [axis[1]], "a_2": [axis[2]], "iters": [float(steps)], "ok": [bool(ok)]})

    fits = drawn.groupBy("rep").applyInPandas(align, "rep int, a_0 double, a_1 double, a_2 double, iters double, ok boolean")
    good = F.col("ok")
    means = [F.avg(F.when(good, F.col(f"a_{k}"))).over(Window.partitionBy()).alias(f"m_{k}") for k in range(3)]
    fits = fits.select("*", *means)  # one row per repeat
    deviation = F.sqrt(sum((F.col(f"a_{k}") - F.col(f"m_{k}")) ** 2 for k in range(3)))
    return fits.agg(
        F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_fail"),
        *[F.degrees(F.first(f"m_{k}")).alias(f"axis_{k}") for k in range(3)],
        F.degrees(F.avg(F.when(good, deviation))).alias("deviation"), F.avg(F.when(good, F.col("iters"))).alias("iterations"),
    )


def _exp(r):
    import numpy as np

    angle = np.linalg.norm(r)
    k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def _log(m):
    import numpy as np

    v = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    s, c = np.linalg.norm(v), (np.trace(m) - 1) / 2
    return v if s < 1e-12 else v / s * np.arctan2(s, c)


def tie_point_uvt(points: DataFrame, lines: DataFrame, start: int = 0) -> DataFrame:
    """Detected (u, v) to (seq, u, v=0, t): time at line start+v, the line number itself where there is no time."""
    timed = trajectory.time_at_line(lines, points.withColumn("y", start + F.col("v")))
    return timed.select("seq", "pt_id", "u", F.lit(0.0).alias("v"), F.coalesce("t", "y").alias("t"))


def corner_candidates(image: DataFrame, radius: int = 3, top: int | None = None, k: float = 0.04) -> DataFrame:
    """Corners per image, the strongest first: img, line, sample, response, rank.

    Harris response of central differences summed over a (2r+1)^2 window, kept where it is the maximum of such a
    window, all of them or the ``top`` ones of each image. ``image`` has img, line, sample, value. Windows are summed one axis at a time by
    sending narrow rows to their neighbours; ranking keeps ``top`` rows per task before its shuffle.
    """
    keys = ["img", "line", "sample"]
    offsets = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    copies = F.array(*[F.struct((F.col("line") - a).alias("line"), (F.col("sample") - b).alias("sample"), F.lit(n).alias("n")) for n, (a, b) in enumerate(offsets)])
    met = image.select("img", F.explode(copies).alias("_t"), "value").groupBy("img", "_t.line", "_t.sample").agg(
        *[F.max(F.when(F.col("_t.n") == n, F.col("value"))).alias(f"n{n}") for n in range(4)]).where("n0 is not null and n1 is not null and n2 is not null and n3 is not null")
    gy, gx = (F.col("n1") - F.col("n0")) / 2, (F.col("n3") - F.col("n2")) / 2
    grad = met.select(*keys, (gx * gx).alias("xx"), (gy * gy).alias("yy"), (gx * gy).alias("xy"))
    def windowed(df: DataFrame, axis: str, fn, cols: list[str]) -> DataFrame:
        sent = df.withColumn(axis, F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius)))
        return sent.groupBy(*keys).agg(*[fn(c).alias(c) for c in cols])
    total = windowed(windowed(grad, "sample", F.sum, ["xx", "yy", "xy"]), "line", F.sum, ["xx", "yy", "xy"])
    det, trace = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.col("xx") + F.col("yy")
    score = total.join(grad.select(*keys), keys, "left_semi").select(*keys, (det - k * trace * trace).alias("response"))
    peak = windowed(windowed(score, "sample", F.max, ["response"]), "line", F.max, ["response"]).withColumnRenamed("response", "_m")
    corners = score.join(peak, keys).where("response >= _m and response > 0").select(*keys, "response")
    w = Window.partitionBy("img").orderBy(F.col("response").desc(), "line", "sample")
    ranked = corners.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


PIVOTS = 256
"""Cells that the descriptors of an image are divided into, at most; the number follows the square root of their count."""
RINGS = 64
SLACK = 1e-9


def _gap(x: Column, y: Column) -> Column:
    """Squared distance of two descriptors, summed in the order of their elements."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def _pivots(points: DataFrame) -> DataFrame:
    """Per pair, an array of about ``sqrt(n)`` descriptors (those with the smallest hashes, ``PIVOTS`` at most)."""
    mixed = points.select("pair", F.xxhash64("id", "desc").alias("_x"), "id", "desc")
    counts = points.groupBy("pair").agg(F.least(F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(PIVOTS)).alias("_n"))
    ranked = mixed.withColumn("_r", F.row_number().over(Window.partitionBy("pair").orderBy("_x", "id"))).where(F.col("_r") <= PIVOTS)
    kept = ranked.join(counts, "pair").where(F.col("_r") <= F.col("_n"))
    return kept.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "desc"))), lambda p: p["desc"]).alias("_pivots"))


def _measured(points: DataFrame, pivots: DataFrame) -> DataFrame:
    """Distances of each point to the pivots of its pair, and which is the nearest."""
    met = points.join(pivots, "pair").withColumn("_far", F.transform("_pivots", lambda p: F.sqrt(_gap(F.col("desc"), p))))
    return met.drop("_pivots").withColumn("cell", (F.array_position("_far", F.array_min("_far")) - 1).cast("int"))


def _cells(found: DataFrame) -> DataFrame:
    """Nearest and farthest point of each cell from its pivot, and the width of its rings: an array per pair, by cell."""
    away = F.get("_far", F.col("cell"))
    edges = found.groupBy("pair", "cell").agg(F.min(away).alias("inner"), F.max(away).alias("outer"))
    width = F.greatest((F.col("outer") - F.col("inner")) / RINGS, F.lit(1e-300))
    return edges.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("cell", "inner", "outer", width.alias("width")))).alias("_cells"))


def _ring(away: Column, inner: Column, width: Column) -> Column:
    return F.least(F.greatest(F.floor((away - inner) / width), F.lit(0)), F.lit(RINGS)).cast("int")


def _compared(met: DataFrame) -> DataFrame:
    return met.select("pair", "a", "b", _gap(F.col("da"), F.col("db")).alias("dist"))


def _prepared(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left points with their distances to the pivots and the cells of their pair; right points by cell and ring."""
    left, right = (side.select("pair", "id", "desc").where("desc is not null") for side in (left, right))
    pivots = cut_lineage(_pivots(right))
    there = cut_lineage(_measured(right, pivots))
    cells = _cells(there)
    away = F.get("_far", F.col("cell"))
    there = there.join(cells, "pair").withColumn("_c", F.filter("_cells", lambda c: c["cell"] == F.col("cell"))[0])
    there = there.select("pair", "cell", _ring(away, F.col("_c.inner"), F.col("_c.width")).alias("ring"), away.alias("away"), F.col("id").alias("b"), F.col("desc").alias("db"))
    here = _measured(left, pivots).join(cells, "pair").withColumnsRenamed({"id": "a", "desc": "da"})
    return cut_lineage(here), there


def _met(probes: DataFrame, there: DataFrame) -> DataFrame:
    return _compared(probes.join(there, ["pair", "cell", "ring"]).where(F.abs(F.col("reach") - F.col("away")) <= F.col("bound")))


def _probes(here: DataFrame) -> DataFrame:
    """All rings that hold points within ``bound`` of a left point, by the triangle inequality."""
    def rings(c: Column) -> Column:
        at = F.get("_far", c["cell"])
        low, high = at - F.col("bound"), at + F.col("bound")
        span = F.sequence(_ring(low, c["inner"], c["width"]), _ring(high, c["inner"], c["width"]))
        open_ = (low <= c["outer"]) & (high >= c["inner"])
        return F.when(open_, F.transform(span, lambda r: F.struct(c["cell"].alias("cell"), r.alias("ring"), at.alias("reach"))))

    probes = here.withColumn("_p", F.explode(F.flatten(F.filter(F.transform("_cells", rings), lambda x: x.isNotNull()))))
    return probes.select("pair", "a", "da", "bound", "_p.cell", "_p.ring", "_p.reach")


def nearest_descriptors(left: DataFrame, right: DataFrame) -> DataFrame:
    """The nearest right descriptor of each left one: pair, a, b, dist (squared); of equal distances the smallest id.

    Inputs: pair, id, desc ARRAY<DOUBLE>. An exact metric join: right points lie in cells around pivots and in rings of a cell by
    their distance from its pivot. A left point first meets the ring of its nearest pivot's cell where its own distance
    falls, and the pivots themselves are right points, which bounds its nearest distance. By the triangle inequality only rings
    within that bound of its distance from their pivot can hold a nearer point, and only those are met. Points without a
    descriptor, and pairs with points on one side only, give no row.
    """
    here, there = _prepared(left, right)
    here = here.withColumn("bound", F.array_min("_far") * (1 + SLACK))
    own = F.filter("_cells", lambda c: c["cell"] == F.col("cell"))[0]
    first = here.withColumns({"_c": own, "reach": F.get("_far", F.col("cell"))}).withColumn("ring", _ring(F.col("reach"), F.col("_c.inner"), F.col("_c.width")))
    first = _met(first, there).groupBy("pair", "a").agg((F.sqrt(F.min("dist")) * (1 + SLACK)).alias("_b"))
    near = here.join(first, ["pair", "a"], "left").withColumn("bound", F.least("bound", "_b") + F.array_max("_far") * SLACK)
    best = _met(_probes(near), there).groupBy("pair", "a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select("pair", "a", F.col("m.b").alias("b"), F.col("m.dist").alias("dist"))


def descriptors_within(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """All pairs of descriptors with a squared distance of at most ``reach``: pair, a, b, dist. Exact, through the same cells and rings."""
    here, there = _prepared(left, right)
    here = here.withColumn("bound", F.lit(math.sqrt(reach)) * (1 + SLACK) + F.array_max("_far") * SLACK)
    return _met(_probes(here), there).where(F.col("dist") <= reach)


def assign_corners(left: DataFrame, right: DataFrame, reach: float, step: float | None = None) -> DataFrame:
    """One-to-one matches of the lowest total cost: pair, a, b, dist. A match costs its squared distance, a left corner without one ``reach``.

    An auction: each left corner without a match bids for the right corner that gains it most at the present price, raising that
    by what the second best would lose it and by ``step`` (a thousandth of ``reach`` by default); the highest bid takes the corner,
    and who had it bids again. Prices start at nothing, so the total is at most ``step`` per matched corner above the
    lowest. All corners of all pairs bid in the same round, a join and two aggregations over the candidate pairs of those
    still without a match; rounds end when nobody gains by a bid. Ties go to the smaller id.
    """
    step = reach / 1000 if step is None else step
    if step <= 0 or reach <= 0:
        raise ValueError("reach and step have to be positive")
    edges = cut_lineage(descriptors_within(left, right, reach).groupBy("pair", "a", "b").agg(F.min("dist").alias("dist")))
    kinds = {n: t for n, t in edges.dtypes}
    state = edges.sparkSession.createDataFrame([], f"pair {kinds['pair']}, b {kinds['b']}, price double, owner {kinds['a']}, moved boolean")
    order = Window.partitionBy("pair", "a").orderBy(F.col("net").desc(), "b")
    while True:
        taken = state.select("pair", F.col("owner").alias("a"))
        open_ = edges.join(taken, ["pair", "a"], "left_anti").join(state.select("pair", "b", "price"), ["pair", "b"], "left")
        open_ = open_.withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("net", reach - F.col("dist") - F.col("price"))
        two = open_.where("net > 0").withColumn("_r", F.row_number().over(order)).where("_r <= 2")
        bids = two.groupBy("pair", "a").agg(
            F.max(F.when(F.col("_r") == 1, F.struct("b", "price", "net"))).alias("m"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("net"))), F.lit(0.0)).alias("second"))
        bids = bids.select("pair", "a", "m.b", (F.col("m.price") + F.col("m.net") - F.col("second") + step).alias("bid"))
        won = bids.groupBy("pair", "b").agg(F.max("bid").alias("bid"), F.min_by("a", F.struct(-F.col("bid"), "a")).alias("by"))
        after = state.join(won, ["pair", "b"], "full").select(
            "pair", "b", F.coalesce("bid", "price").alias("price"), F.coalesce("by", "owner").alias("owner"), F.col("by").isNotNull().alias("moved"))
        state = cut_lineage(after)
        if state.where("moved").isEmpty():
            return state.select("pair", F.col("owner").alias("a"), "b").join(edges, ["pair", "a", "b"])


def match_corners(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mutual nearest neighbours of corner descriptors: pair, a, b, dist. Inputs: pair, id, desc ARRAY<DOUBLE>."""
    from_a = nearest_descriptors(left, right)
    from_b = nearest_descriptors(right, left).select("pair", F.col("a").alias("b"), F.col("b").alias("a"))
    return from_a.join(from_b, ["pair", "a", "b"])


POOL = 4096
"""Matches of an image pair that hypotheses are drawn from, at most: those with the smallest hashes. All matches vote."""
SLICE = 8192


def _hypotheses(iterations: int):
    """Projective maps through four matches each, for the pool of one pair: h and nine numbers, row by row; degenerate draws are left out."""
    def draw(pdf):
        import numpy as np
        import pandas as pd

        names = ["pair", "h", "map"]
        if len(pdf) < 4:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values(["a", "b", "x1", "y1", "x2", "y2"])
        rng = np.random.default_rng(abs(int(pdf["pair"].iloc[0])))
        pick = np.argpartition(rng.random((iterations, len(pdf))), 3, axis=1)[:, :4] if len(pdf) < 64 else rng.integers(0, len(pdf), (iterations, 4))
        src, dst = pdf[["x1", "y1"]].to_numpy(float)[pick], pdf[["x2", "y2"]].to_numpy(float)[pick]

        def flat(p):  # three of the four on a line, or one point twice
            def area(i, j, k):
                a, b = p[:, j] - p[:, i], p[:, k] - p[:, i]
                return abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])

            return np.minimum.reduce([area(0, 1, 2), area(0, 1, 3), area(0, 2, 3), area(1, 2, 3)]) < 1e-9

        sound = np.flatnonzero(~flat(src) & ~flat(dst))
        x, y, u, v = src[sound, :, 0], src[sound, :, 1], dst[sound, :, 0], dst[sound, :, 1]
        one, zero = np.ones_like(x), np.zeros_like(x)
        to_u = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=2)
        to_v = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=2)
        found, maps = [], []
        for h, left, right in zip(sound, np.concatenate([to_u, to_v], axis=1), np.concatenate([u, v], axis=1), strict=True):
            try:
                maps.append([*np.linalg.solve(left, right), 1.0])
                found.append(int(h))
            except np.linalg.LinAlgError:  # the four allow no such map
                continue
        if not found:
            return pd.DataFrame(columns=names)
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]] * len(found), "h": found, "map": maps}, columns=names)

    return draw


def _votes(threshold: float):
    """How many matches of a slice each map of the pair brings to within the threshold."""
    def vote(key, part, maps):
        import numpy as np
        import pandas as pd

        if not len(part) or not len(maps):
            return pd.DataFrame(columns=["pair", "h", "votes"])
        at = np.stack([part["x1"], part["y1"], np.ones(len(part))]).astype(float)
        want = part[["x2", "y2"]].to_numpy(float).T
        counts = []
        for row in maps["map"]:
            with np.errstate(divide="ignore", invalid="ignore"):
                moved = np.reshape(row, (3, 3)) @ at
                counts.append(int((np.hypot(*(moved[:2] / moved[2] - want)) < threshold).sum()))
        return pd.DataFrame({"pair": [key[0]] * len(maps), "h": maps["h"].to_numpy(), "votes": counts})

    return vote


def best_maps(matches: DataFrame, iterations: int = 2000, threshold: float = 20.0) -> DataFrame:
    """The projective map of each image pair that most matches agree with: pair, map (nine numbers, row by row), votes.

    Maps are drawn from a pool of at most ``POOL`` matches of a pair; all its matches vote in slices of about ``SLICE``, whose
    counts are summed. So a pair with any number of matches is worked on by many tasks. A pair with less than four
    matches has no map; of equal counts the earliest draw wins.
    """
    kind = matches.schema["pair"].dataType.simpleString()
    mixed = F.xxhash64("a", "b", "x1", "y1", "x2", "y2")
    near = Window.partitionBy("pair").orderBy(mixed, "a", "b")
    pool = matches.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= POOL).drop("_r")  # kept per task before the shuffle
    maps = cut_lineage(pool.groupBy("pair").applyInPandas(_hypotheses(iterations), f"pair {kind}, h bigint, map array<double>"))
    sizes = matches.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("_n"))
    sliced = matches.join(sizes, "pair").withColumn("_slice", F.pmod(mixed, F.col("_n"))).select("pair", "_slice", "x1", "y1", "x2", "y2")
    asked = maps.join(sizes, "pair").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).select("pair", "_slice", "h", "map")
    counts = sliced.groupBy("pair", "_slice").cogroup(asked.groupBy("pair", "_slice")).applyInPandas(_votes(threshold), f"pair {kind}, h bigint, votes bigint")
    total = counts.groupBy("pair", "h").agg(F.sum("votes").alias("votes"))
    best = total.groupBy("pair").agg(F.max_by("h", F.struct("votes", -F.col("h"))).alias("h"), F.max("votes").alias("votes"))
    return maps.join(best, ["pair", "h"]).select("pair", "map", "votes")


def filter_inliers(matches: DataFrame, iterations: int = 2000, threshold: float = 20.0) -> DataFrame:
    """Matches that agree with the best projective map of their image pair, of ``iterations`` drawn ones (``best_maps``).

    ``matches``: pair, a, b, x1, y1, x2, y2. Less than four matches fix no map, so none of them is an inlier.
    """
    at = [F.get("map", F.lit(3 * r)) * F.col("x1") + F.get("map", F.lit(3 * r + 1)) * F.col("y1") + F.get("map", F.lit(3 * r + 2)) for r in range(3)]
    gap = [F.try_divide(at[r], at[2]) - F.col(c) for r, c in enumerate(("x2", "y2"))]
    met = matches.join(best_maps(matches, iterations, threshold).select("pair", "map"), "pair")
    return met.where(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]) < threshold).select(*matches.columns)


def timed_observations(obs: DataFrame, sequences: DataFrame, lines: DataFrame) -> DataFrame:
    """Observations of all sequences flown on a trajectory, with their time: trajectory, seq, obs_id, lm_id, t."""
    return trajectory.time_at_line(lines, obs.join(sequences, "seq")).select("trajectory", "seq", "obs_id", "lm_id", "t")


def landmark_coordinates(ids: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Coordinates for a list of landmark ids; ids without a landmark or position come with status 'missing'."""
    met = ids.join(landmarks.where("is_set").select("lm_id", "x", "y", "z"), "lm_id", "left")
    return met.withColumn("status", F.when(F.col("x").isNull(), "missing").otherwise("ok"))
