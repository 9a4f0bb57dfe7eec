"""Trajectory joins (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog import sqlvec as sv
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.catalog.geodesy import rounded
from swathline.functions import vec
from swathline.operators import trajectory as op
from swathline.operators.geodesy import poses_to_ecef
from swathline.plans import inputs as inp

EP = sv.ecef_poses()
BR = {**EP, "br": sv.bracket("scan")}
POSE_OUT = f"flight, t, {sv.rnd('r', 'r', 5)}, {sv.rnd('p', 'p', 3)}"


def ecef(spark, sf):
    return poses_to_ecef(inp.poses_raw(spark, sf))


def pose_cols():
    return ["flight", "t", *rounded("r", digits=5), *rounded("p", digits=3)]


def obs_on_lines(spark, sf):
    return inp.landmark_obs(spark, sf).select("seq", "obs_id", "lm_id", "x", "y")


@query("T1_time_at_line", sql(f"""SELECT obs_id, {s6('(l.line + 1 - y) * l.t + (y - l.line) * u.t', 't', 3)} FROM obs o
       LEFT JOIN scan l ON l.flight = o.seq AND l.line = floor(o.y) LEFT JOIN scan u ON u.flight = o.seq AND u.line = floor(o.y) + 1"""))
def _(spark, sf):
    lines = inp.scan_lines(spark, sf).withColumnRenamed("flight", "seq")
    return op.time_at_line(lines, obs_on_lines(spark, sf)).select("obs_id", r6("t", digits=3))


@query("T2_time_at_line_linear", sql(f"SELECT obs_id, {s6('1000 + y * 0.004651', 't')} FROM obs"))
def _(spark, sf):
    return inp.landmark_obs(spark, sf).select("obs_id", r6(op.time_at_line_linear(F.col("y"), F.lit(1000.0), F.lit(0.004651)), "t"))


_CUTS = """SELECT seq, file_no, lines, rows, coalesce(sum(lines) OVER w, 0)::BIGINT AS line0, coalesce(sum(rows) OVER w, 0)::BIGINT AS row0
       FROM (SELECT seq, file_no, lines, lines // 2 + file_no AS rows FROM headers WHERE lines IS NOT NULL)
       WINDOW w AS (PARTITION BY seq ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _files(spark, sf):
    h = inp.headers(spark, sf).where("lines is not null")
    return h.select("seq", "file_no", "lines", (inp.idiv("lines", 2) + F.col("file_no")).alias("rows"))


@query("T3_line_breakpoints", sql("SELECT * FROM cuts", cuts=_CUTS))
def _(spark, sf):
    return op.line_breakpoints(_files(spark, sf)).select("seq", "file_no", "lines", "rows", "line0", "row0")


@query("T3_bil_to_lcf_line", sql(f"""SELECT q.seq, q.line, {s6('CASE WHEN c.line0 IS NULL THEN 0 WHEN u.line0 IS NULL OR u.line0 = c.line0 THEN c.row0 ELSE c.row0 + (q.line - c.line0)::DOUBLE / (u.line0 - c.line0) * (u.row0 - c.row0) END', 'row')}
       FROM (SELECT DISTINCT o_orderkey % 5 AS seq, o_custkey AS line FROM orders) q ASOF LEFT JOIN brk c ON q.seq = c.seq AND q.line >= c.line0
       ASOF LEFT JOIN brk u ON q.seq = u.seq AND q.line <= u.line0""",
       cuts=_CUTS, brk="SELECT seq, line0, row0 FROM cuts UNION ALL SELECT seq, sum(lines)::BIGINT, sum(rows)::BIGINT FROM cuts GROUP BY 1"))
def _(spark, sf):
    asked = inp.table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("seq"), F.col("o_custkey").alias("line")).distinct()
    return op.image_line_to_row(_files(spark, sf), asked).select("seq", "line", r6("row"))


@query("T4_first_after", sql("""SELECT s.flight, s.line, coalesce(l.idx + 1, 0) AS first_after FROM scan s
       ASOF LEFT JOIN (SELECT flight, t, row_number() OVER (PARTITION BY flight ORDER BY t) - 1 AS idx FROM poses) l
       ON s.flight = l.flight AND s.t >= l.t"""))
def _(spark, sf):
    lines = inp.scan_lines(spark, sf)
    found = op.first_after(inp.poses_raw(spark, sf), lines, ["flight"])
    return lines.join(found, ["flight", "t"]).select("flight", "line", "first_after")


@query("T5_pose_components", sql(f"SELECT {POSE_OUT} FROM o", **BR,
       o=f"SELECT flight, t, {sv.cols('r', [f'(1 - w) * a{k} + w * b{k}' for k in range(3)])}, {sv.cols('p', [f'(1 - w) * s{k} + w * e{k}' for k in range(3)])} FROM br"))
def _(spark, sf):
    return op.pose_at_time(ecef(spark, sf), inp.scan_lines(spark, sf), "components").select(*pose_cols())


@query("T5_pose_manifold", sql(f"SELECT {POSE_OUT} FROM pt", **BR, **sv.manifold()))
def _(spark, sf):
    return op.pose_at_time(ecef(spark, sf), inp.scan_lines(spark, sf)).select(*pose_cols())


@query("T5_pose_relative", sql(f"SELECT {POSE_OUT} FROM pt", **BR, **sv.manifold()))
def _(spark, sf):
    return op.pose_at_time(ecef(spark, sf), inp.scan_lines(spark, sf), "relative").select(*pose_cols())


def clocked(spark, sf):
    """Headers as flights; the frame rate is slowed to a line every few hours so that lines span the trajectory."""
    return inp.headers(spark, sf).select(F.col("file_no").alias("flight"), "lines", (F.col("framerate") / 100000).alias("framerate"))


_LERP = {c: f"(1 - w) * l.{c} + w * u.{c}" for c in ("lat", "lon", "height")}
_ANG = {c: f"CASE WHEN abs(l.{c} - u.{c}) > pi() THEN CASE WHEN (1 - w) * l.{c} + w * u.{c} < 0 THEN (1 - w) * l.{c} + w * u.{c} + pi() ELSE (1 - w) * l.{c} + w * u.{c} - pi() END ELSE (1 - w) * l.{c} + w * u.{c} END" for c in ("roll", "pitch", "yaw")}
_ATT = sv.mm(sv.mm(sv.rz("yaw"), sv.ry("pitch")), sv.rx("roll"))
_FLIP = [e if k % 3 == 0 else f"-{e}" for k, e in enumerate(_ATT)]


@query("T6_pose_per_scanline_clock", sql(f"SELECT flight, line, {sv.rnd('r', 'r', 5)}, {sv.rnd('v', 'p', 3)} FROM o4",
       clk="""SELECT flight, unnest(range(lines)) AS line, t0 + unnest(range(lines)) / fr AS t FROM (SELECT file_no AS flight, lines, framerate / 100000 AS fr FROM headers WHERE lines IS NOT NULL)
              JOIN (SELECT flight, min(t) AS t0 FROM poses GROUP BY 1) USING (flight)""",
       bb=f"SELECT q.flight, q.line, {', '.join(f'{e} AS {n}' for n, e in {**_LERP, **_ANG}.items())} FROM (SELECT q.*, CASE WHEN u.t > l.t THEN (q.t - l.t) / (u.t - l.t) WHEN u.t = l.t THEN 0 END AS w, l.t AS lt, u.t AS ut FROM clk q ASOF LEFT JOIN poses l ON q.flight = l.flight AND q.t >= l.t ASOF LEFT JOIN poses u ON q.flight = u.flight AND q.t <= u.t) q JOIN poses l ON l.flight = q.flight AND l.t = q.lt JOIN poses u ON u.flight = q.flight AND u.t = q.ut",
       mean="SELECT avg(lat) AS lat, avg(lon) AS lon FROM bb",
       fr=f"SELECT {sv.cols('f', sv.frame('enu', 'lat', 'lon'))}, {sv.cols('c', sv.ecef('lat', 'lon', '0'))} FROM mean",
       o1=f"SELECT flight, line, {sv.cols('m', _FLIP)}, {sv.cols('p', sv.ecef('lat', 'lon', 'height'))} FROM bb",
       o2=f"SELECT *, {sv.cols('q', sv.quat(sv.n('m', 9)))} FROM o1",
       o4=f"SELECT flight, line, {sv.cols('r', sv.axis(sv.n('q', 4)))}, {sv.cols('v', sv.mv(sv.n('f', 9), [f'(p{k} - c{k})' for k in range(3)]))} FROM o2, fr"))
def _(spark, sf):
    out = op.scanline_poses(clocked(spark, sf), inp.poses_raw(spark, sf))
    return out.select("flight", "line", *rounded("r", digits=5), *rounded("p", digits=3))


def mounting(spark, sf):
    """Mounting angles and lever arm per flight for the flights that have a supplier of that number."""
    k = F.col("s_nationkey")
    return inp.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("flight"), ((k - 12) / 100).alias("mr_0"), (k / 50).alias("mr_1"), (0.1 - k / 200).alias("mr_2"),
        (k / 10).alias("mt_0"), (1 - k / 10).alias("mt_1"), (k * 0 + 0.25).alias("mt_2"),
    )


MOUNT = """SELECT s_suppkey AS flight, (s_nationkey - 12) / 100 AS mr0, s_nationkey / 50 AS mr1, 0.1::DOUBLE - s_nationkey / 200 AS mr2,
       s_nationkey / 10 AS mt0, 1 - s_nationkey / 10 AS mt1, 0.25::DOUBLE AS mt2 FROM supplier"""
COMPOSED = {
    "x1": f"SELECT ep.*, {', '.join(f'coalesce(m{n}{k}, 0) AS m{n}{k}' for n in 'rt' for k in range(3))} FROM ep LEFT JOIN mount USING (flight)",
    "x2": f"SELECT *, {sv.cols('a', sv.rod(sv.n('r')))}, {sv.cols('b', sv.rod(sv.n('mr')))} FROM x1",
    "x3": f"SELECT flight, t, {sv.cols('z', sv.mm(sv.n('a', 9), sv.n('b', 9)))}, {sv.cols('p', [f'{e} + p{k}' for k, e in enumerate(sv.mv(sv.n('a', 9), sv.n('mt')))])} FROM x2",
    "x4": f"SELECT *, {sv.cols('q', sv.quat(sv.n('z', 9)))} FROM x3",
    "mo": f"SELECT flight, t, {sv.cols('r', sv.axis(sv.n('q', 4)))}, p0, p1, p2 FROM x4",
}


@query("T7_compose_mounting", sql(f"SELECT {POSE_OUT} FROM mo", **EP, mount=MOUNT, **COMPOSED))
def _(spark, sf):
    return op.compose_mounting(ecef(spark, sf), mounting(spark, sf)).select(*pose_cols())


@query("T8_nearest_node", sql(f"SELECT flight, t, CASE WHEN w IS NULL THEN 'outside' ELSE 'ok' END AS status, {s6('node_t', 'node_t', 3)}, {sv.rnd('d', 'd', 5)}, {sv.rnd('h', 's', 2)} FROM n4", **BR,
       **sv.manifold(extra=f", CASE WHEN w IS NOT NULL THEN CASE WHEN t - lt < ut - t THEN lt ELSE ut END END AS node_t, {', '.join(f'CASE WHEN w IS NOT NULL THEN CASE WHEN t - lt < ut - t THEN {a}{k} ELSE {b}{k} END END AS {o}{k}' for o, a, b in (('n', 'a', 'b'), ('u', 's', 'e')) for k in range(3))}"),
       n1=f"SELECT flight, t, w, node_t, {sv.cols('o', sv.rod(sv.n('n')))}, {', '.join(sv.n('k', 9))}, {sv.cols('v', [f'p{k} - u{k}' for k in range(3)])} FROM pt",
       n2=f"SELECT *, {sv.cols('x', sv.mm(sv.tr(sv.n('o', 9)), sv.n('k', 9)))}, {sv.cols('h', sv.mv(sv.tr(sv.n('o', 9)), sv.n('v')))} FROM n1",
       n3=f"SELECT *, {sv.cols('q', sv.quat(sv.n('x', 9)))} FROM n2",
       n4=f"SELECT *, {sv.cols('d', [f'CASE WHEN w IS NOT NULL THEN {e} END' for e in sv.axis(sv.n('q', 4))])} FROM n3"))
def _(spark, sf):
    out = op.nearest_node(ecef(spark, sf), inp.scan_lines(spark, sf))
    return out.select("flight", "t", "status", r6("node_t", digits=3), *rounded("d", digits=5), *rounded("s", digits=2))


@query("T9_pps_clock_fix", sql("""SELECT file_id, line, CASE WHEN l IS NOT NULL AND (u IS NULL OR line - l < u - line) THEN lv ELSE uv END + clock AS time FROM (
       SELECT q.file_id, q.line, q.clock, l.line AS l, u.line AS u, l.tow * 10 - l.pps AS lv, u.tow * 10 - u.pps AS uv FROM c q
       ASOF LEFT JOIN f l ON q.file_id = l.file_id AND q.line >= l.line ASOF LEFT JOIN f u ON q.file_id = u.file_id AND q.line <= u.line)
       WHERE l IS NOT NULL OR u IS NOT NULL""", c="SELECT *, line // 2000 AS file_id FROM clock", f="SELECT * FROM c WHERE flag"))
def _(spark, sf):
    lines = inp.frame_clock(spark, sf).withColumn("file_id", inp.idiv("line", 2000))
    return op.pps_clock_fix(lines)


@query("T10_ref_track_align", sql("""SELECT flight, CASE WHEN f0 = n THEN n ELSE f0 - 1 END AS first, f1 AS last FROM (
       SELECT g.flight, (SELECT count(*) FROM poses p WHERE p.flight = g.flight AND p.t <= g.t0) AS f0,
       (SELECT count(*) FROM poses p WHERE p.flight = g.flight AND p.t <= g.t1) AS f1, (SELECT count(*) FROM poses p WHERE p.flight = g.flight) AS n
       FROM (SELECT flight, min(t) AS t0, max(t) AS t1 FROM scan GROUP BY 1) g)"""))
def _(spark, sf):
    segments = inp.scan_lines(spark, sf).groupBy("flight").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    out = op.ref_track_align(inp.poses_raw(spark, sf), segments, ["flight"])
    return out.select("flight", F.col("start").alias("first"), F.col("end").alias("last"))


@query("T11_orientation_rate_residual", sql(f"SELECT flight, t, {sv.rnd('g', 'd', 5)} FROM y4",
       y0="SELECT flight, t, roll AS r0, pitch AS r1, yaw AS r2, lead(t) OVER w AS nt, lead(roll) OVER w AS n0, lead(pitch) OVER w AS n1, lead(yaw) OVER w AS n2 FROM poses WINDOW w AS (PARTITION BY flight ORDER BY t)",
       y1=f"SELECT *, {sv.cols('a', sv.rod(sv.n('r')))}, {sv.cols('b', sv.rod([f'(r{k} * 1e-6::DOUBLE * (nt - t))' for k in range(3)]))} FROM y0 WHERE nt IS NOT NULL",
       y2=f"SELECT *, {sv.cols('m', sv.mm(sv.n('a', 9), sv.n('b', 9)))} FROM y1",
       y3=f"SELECT *, {sv.cols('q', sv.quat(sv.n('m', 9)))} FROM y2",
       y4=f"SELECT flight, t, {sv.cols('g', [f'{e} - n{k}' for k, e in enumerate(sv.axis(sv.n('q', 4)))])} FROM y3"))
def _(spark, sf):
    poses = inp.poses_raw(spark, sf)
    poses = vec.keep(poses, r=[F.col(c) for c in ("roll", "pitch", "yaw")], w=[F.col(c) * 1e-6 for c in ("roll", "pitch", "yaw")])
    return op.orientation_rate_residual(poses).select("flight", "t", *rounded("d", digits=5))
