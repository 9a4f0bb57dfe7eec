"""Shift estimation, line order and rectification (H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.operators import shifts as op
from swathline.operators.radiometry import normalize_channels
from swathline.plans import inputs as inp

S, B = inp.SAMPLES, 64


def cube(spark, sf):
    """The cube as one sequence."""
    return inp.pixels(spark, sf).withColumn("seq", F.lit(0).cast("bigint"))


def rgb(spark, sf):
    return cube(spark, sf).select("seq", "line", "sample", F.array(*[F.col("dns")[b] for b in (43, 27, 12)]).alias("dns"))


PROD = {
    "fx": "SELECT line, sample, band, dn - 20000 AS v FROM px",
    "cand": "SELECT unnest(range(-3, 4)) AS d",
    "pr": """SELECT f.line, d, sum(f.v * f.v)::DOUBLE AS ff, sum(f.v * t.v)::DOUBLE AS ft, sum(t.v * t.v)::DOUBLE AS tt, coalesce(sum(t.v * n.v), 0)::DOUBLE AS tn
          FROM fx f JOIN cand ON true JOIN fx t ON t.line = f.line + 1 AND t.sample = f.sample + d AND t.band = f.band
          LEFT JOIN fx n ON d < 3 AND n.line = f.line + 1 AND n.sample = f.sample + d + 1 AND n.band = f.band WHERE f.sample BETWEEN 3 AND 16 GROUP BY 1, 2""",
    "bst": "SELECT line, -max(o).nd AS d, max(o).s AS score FROM (SELECT line, {'s': ft / sqrt(ff * tt), 'nd': -d} AS o FROM pr) GROUP BY 1",
}


def centred(spark, sf):
    """Counts around zero, so that the correlation separates the candidates."""
    return cube(spark, sf).withColumn("dns", F.transform("dns", lambda v: v - 20000))


def products(spark, sf):
    return op.line_pair_products(centred(spark, sf), "dns", S, line_block=8, sample_block=6)


@query("H1_shift_ncc", sql(f"SELECT line, d, {s6('score', 'score', 9)} FROM bst", **PROD))
def _(spark, sf):
    return op.best_shift(products(spark, sf)).select("line", "d", r6("score", digits=9))


@query("H1_shift_cc", sql("SELECT line, -max(o).nd AS d, max(o).s AS score FROM (SELECT line, {'s': ft, 'nd': -d} AS o FROM pr) GROUP BY 1", **PROD))
def _(spark, sf):
    return op.best_shift(products(spark, sf), normalized=False).select("line", "d", "score")


SUB = {**PROD,
       "ga": """SELECT b.line, b.d, b.score, c.ff, c.ft AS fa, c.tt AS aa, c.tn AS ar, l.ft AS fl, l.tt AS ll, l.tn AS al, r.ft AS fr, r.tt AS rr FROM bst b
             JOIN pr c USING (line, d) LEFT JOIN pr l ON l.line = b.line AND l.d = b.d - 1 LEFT JOIN pr r ON r.line = b.line AND r.d = b.d + 1""",
       "gb": "SELECT *, (fl - fa - al + aa) / (ll - 2 * al + aa) AS xl, (fr - fa - ar + aa) / (rr - 2 * ar + aa) AS xr FROM ga",
       "gc": "SELECT *, ((1 - xl) * fa + xl * fl) / sqrt(ff * ((1 - xl) * (1 - xl) * aa + 2 * (1 - xl) * xl * al + xl * xl * ll)) AS sl, ((1 - xr) * fa + xr * fr) / sqrt(ff * ((1 - xr) * (1 - xr) * aa + 2 * (1 - xr) * xr * ar + xr * xr * rr)) AS sr FROM gb",
       "gd": "SELECT *, coalesce(sl > score, false) AS ul, greatest(score, coalesce(sl, score)) AS s1 FROM gc",
       "sub": "SELECT line, CASE WHEN coalesce(sr > s1, false) THEN d + xr WHEN ul THEN d - xl ELSE d END AS dx, CASE WHEN coalesce(sr > s1, false) THEN sr ELSE s1 END AS score FROM gd"}


@query("H2_shift_ncc_subpixel", sql(f"SELECT line, {s6('dx')}, {s6('score', 'score', 9)} FROM sub", **SUB))
def _(spark, sf):
    return op.subpixel_shift(products(spark, sf)).select("line", r6("dx"), r6("score", digits=9))


ACC = {"ru": "SELECT line + 1 AS line, sum(-dx) OVER (ORDER BY line) AS run FROM shifts UNION ALL SELECT 0, 0",
       "mm": "SELECT floor(least(0, min(run)))::BIGINT AS lo, ceil(greatest(0, max(run)))::BIGINT AS hi FROM ru",
       "acc": "SELECT line, run - lo AS acc, lo AS min_delta, hi AS max_delta FROM ru, mm"}


def acc(spark, sf):
    rel = inp.shifts(inp.pixels(spark, sf)).withColumn("seq", F.lit(0).cast("bigint"))
    return op.accumulate_shifts(rel)


@query("H3_accumulate_shifts", sql(f"SELECT line, {s6('acc')}, min_delta, max_delta FROM acc", **ACC))
def _(spark, sf):
    return acc(spark, sf).select("line", r6("acc"), "min_delta", "max_delta")


def _weights():
    inv, det = op.kernel_tables(op.shift_candidates(2.0, 0.5), 5, 2.0)
    dx = op.shift_candidates(2.0, 0.5)
    rows = ", ".join(f"({dx[c]!r}::DOUBLE, {a}, {b}, {float(inv[c][a][b])!r}::DOUBLE)" for c in range(len(dx)) for a in range(10) for b in range(10))
    dets = ", ".join(f"({dx[c]!r}::DOUBLE, {float(det[c])!r}::DOUBLE)" for c in range(len(dx)))
    return rows, dets


_W, _D = _weights()
LIK = {"wt": f"SELECT * FROM (VALUES {_W}) w(dx, a, b, k)", "ld": f"SELECT * FROM (VALUES {_D}) w(dx, det)",
       "sd": "SELECT line, sample, band, (dn - avg(dn) OVER q) / stddev_pop(dn) OVER q AS v FROM px WINDOW q AS (PARTITION BY band)",
       "iv": """SELECT line, band, sample // 5 AS win, sample % 5 AS e, v FROM sd WHERE line < (SELECT max(line) FROM px)
             UNION ALL SELECT line - 1, band, sample // 5, sample % 5 + 5, v FROM sd WHERE line > 0""",
       "qf": "SELECT x.line, dx, sum(x.v * k * y.v) AS q FROM iv x JOIN iv y USING (line, band, win) JOIN wt ON wt.a = x.e AND wt.b = y.e GROUP BY 1, 2",
       "lik": "SELECT line, dx, q + 256 * det + 0.5::DOUBLE * dx * dx AS cost FROM qf JOIN ld USING (dx)"}


def likelihood(spark, sf):
    return op.shift_likelihood(cube(spark, sf), "dns", S, 5, 0.5, 2.0, op.shift_candidates(2.0, 0.5))


@query("H4_shift_likelihood", sql(f"SELECT line, dx, {s6('cost', 'cost', 4)} FROM lik", **LIK))
def _(spark, sf):
    return likelihood(spark, sf).select("line", "dx", r6("cost", digits=4))


@query("H4_likely_shift", sql(f"""SELECT line, {s6('m + coalesce(CASE WHEN a - 2 * b + c > 0 THEN (a - c) / (2 * (a - 2 * b + c)) * 0.5 END, 0)', 'dx', 5)}, a IS NOT NULL AND c IS NOT NULL AS converged FROM (
       SELECT o.line, m, max(cost) FILTER (dx = m - 0.5) AS a, max(cost) FILTER (dx = m) AS b, max(cost) FILTER (dx = m + 0.5) AS c
       FROM lik o JOIN (SELECT line, arg_min(dx, cost) AS m FROM lik GROUP BY 1) USING (line) GROUP BY 1, 2)""", **LIK))
def _(spark, sf):
    return op.likely_shift(likelihood(spark, sf), 0.5).select("line", r6("dx", digits=5), "converged")


def _rho_sql():
    parts = " UNION ALL ".join(
        f"SELECT {k} AS k, {r!r}::DOUBLE AS rho" for k, r in enumerate(op.RHO_GRID))
    return {"sd": "SELECT line, sample, band, (dn - avg(dn) OVER q) / stddev_pop(dn) OVER q AS v FROM px WINDOW q AS (PARTITION BY band)",
            "rh": parts,
            "pa": "SELECT x.v AS a, y.v AS b, y.sample - x.sample AS dist FROM sd x JOIN sd y ON x.line = y.line AND y.sample = x.sample + 1 + (x.line * 31 + x.sample * 17) % 10 AND x.band = y.band WHERE x.band = (x.line * 7 + x.sample * 13) % 64",
            "pc": "SELECT rho, a, b, (1 + sqrt(3) * dist / rho) * exp(-sqrt(3) * dist / rho) AS c FROM pa, rh",
            "co": "SELECT rho, sum(ln(1 - c * c) + (a * a - 2 * c * a * b + b * b) / (1 - c * c)) AS cost FROM pc GROUP BY 1"}


@query("H5_matern_scale", sql(f"SELECT {s6('rho', 'rho', 9)}, {s6('cost', 'cost', 3)} FROM co", **_rho_sql()))
def _(spark, sf):
    return op.matern_scale(cube(spark, sf), "dns", S, B).select(r6("rho", digits=9), r6("cost", digits=3))


@query("H5_fit_matern_scale", sql(f"SELECT {s6('arg_min(rho, cost)', 'rho', 9)}, {s6('min(cost)', 'cost', 3)} FROM co", **_rho_sql()))
def _(spark, sf):
    return op.fit_matern_scale(op.matern_scale(cube(spark, sf), "dns", S, B)).select(r6("rho", digits=9), r6("cost", digits=3))


def event_shifts(spark, sf):
    """A shift per event and user: seq, line, dx; heavy-tailed, so that outliers occur."""
    from swathline.plans.ordered import with_row_index

    e = inp.table(spark, sf, "events").select(F.col("user_id").alias("seq"), inp._seconds("ts").alias("t"), (F.col("value") / 100 - 0.4).alias("dx"))
    return with_row_index(e, ["seq"], "t", "line").select("seq", "line", "dx")


@query("H6_smooth_shifts", "WITH RECURSIVE " + sql(f"SELECT seq, line, {s6('dx')} FROM sm",
       ev="SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS line, value / 100 - 0.4::DOUBLE AS dx FROM events",
       nx="SELECT *, lead(dx) OVER (PARTITION BY seq ORDER BY line) AS nxt FROM ev",
       sm="SELECT seq, line, dx FROM nx WHERE line = 0 UNION ALL SELECT n.seq, n.line, CASE WHEN n.nxt IS NOT NULL AND abs(n.dx - (s.dx + n.nxt) / 2) > 4 * greatest(abs(s.dx), abs(n.nxt)) THEN (s.dx + n.nxt) / 2 ELSE n.dx END FROM sm s JOIN nx n ON n.seq = s.seq AND n.line = s.line + 1")[5:])
def _(spark, sf):
    return op.smooth_shifts(event_shifts(spark, sf)).select("seq", "line", r6("dx"))


COSTS = """SELECT a.line AS i, b.line - a.line - 1 AS c, sum(abs(a.dn - b.dn))::DOUBLE / 20 AS cost FROM px a JOIN px b ON b.line BETWEEN a.line + 1 AND a.line + 6
       AND a.sample = b.sample AND a.band = b.band GROUP BY 1, 2"""


@query("H7_line_cost_band", sql(f"SELECT i, c, {s6('cost')} FROM k", k=COSTS))
def _(spark, sf):
    return op.line_costs(cube(spark, sf), "dns", S, 3, line_block=8).select("i", "c", r6("cost"))


@query("H7_line_cost_shifted", sql(f"""SELECT i, c, {s6('sum(abs(va - vb)) / max(size)', 'cost')} FROM (
       SELECT a.line AS i, b.line - a.line - 1 AS c, a.dn AS va, b.dn AS vb, 20 - abs(oa - ob) AS size FROM o a JOIN o b ON b.line BETWEEN a.line + 1 AND a.line + 6 AND a.band = b.band
       AND CASE WHEN oa > ob THEN b.sample = a.sample + (oa - ob) AND a.sample < 20 - (oa - ob) ELSE a.sample = b.sample + (ob - oa) AND b.sample < 20 - (ob - oa) END,
       (SELECT 0)) GROUP BY 1, 2""".replace("oa", "a.off").replace("ob", "b.off"), o="SELECT *, line % 4 AS off FROM px"))
def _(spark, sf):
    px = cube(spark, sf)
    offsets = px.select("seq", "line").distinct().withColumn("acc", (F.col("line") % 4).cast("double"))
    return op.line_costs(px, "dns", S, 3, offsets, line_block=8).select("i", "c", r6("cost"))


@query("H8_reorder_lines")
def _(spark, sf):
    px = rgb(spark, sf)
    return op.reorder_lines(op.line_costs(px, "dns", S, 3), px.select("seq", "line").distinct())


WIDE = {**ACC, "off": "SELECT line, acc, 20 + max_delta - min_delta AS width FROM acc"}
LINEAR = "SELECT o.line, o.sample, band, coalesce(sum(v.dn * (1 - abs(o.sample - o.acc - v.sample))), 0) AS v FROM og o LEFT JOIN px v ON v.line = o.line AND v.band = o.band AND abs(o.sample - o.acc - v.sample) < 1 GROUP BY 1, 2, 3"


@query("H9_rectify_horizontal", sql(f"SELECT line, sample, band, {s6('coalesce(sum(w * dn), 0)', 'v')} FROM (SELECT o.line, o.sample, o.band, v.dn, 1 - abs(o.sample - o.acc - v.sample) AS w FROM og o LEFT JOIN px v ON v.line = o.line AND v.band = o.band AND abs(o.sample - o.acc - v.sample) < 1) GROUP BY 1, 2, 3", **WIDE,
       og="SELECT line, acc, unnest(range(width)) AS sample, band FROM off, (SELECT DISTINCT band FROM px)"))
def _(spark, sf):
    out = op.rectify_horizontal(cube(spark, sf), "dns", acc(spark, sf), S)
    return inp.to_long(out, "dns", "v").select("line", "sample", "band", r6("v"))


@query("H10_rectify_mask", sql("SELECT line, sample, sample - acc >= 0 AND sample - acc < 20 AS inside FROM (SELECT line, acc, unnest(range(width)) AS sample FROM off)", **WIDE))
def _(spark, sf):
    return op.rectify_mask(acc(spark, sf), S).select("line", "sample", "inside")


ORD = "SELECT line, row_number() OVER (ORDER BY line + (line * 5) % 3 * 0.9::DOUBLE, line) - 1 AS order_idx FROM (SELECT DISTINCT line FROM px)"


def order(spark, sf):
    lines = cube(spark, sf).select("seq", "line").distinct()
    return op.order_by_position(lines.withColumn("y", F.col("line") + (F.col("line") * 5) % 3 * 0.9))


@query("H11_reorder_vertical", sql("SELECT order_idx AS line, sample, band, dn FROM px JOIN o USING (line)", o=ORD))
def _(spark, sf):
    out = op.reorder_vertical(cube(spark, sf).drop("spectrum"), order(spark, sf))
    return inp.to_long(out, "dns", "dn").select("line", "sample", "band", "dn")


BOTH = {"o": ORD, "dxs": "SELECT line, ((line * 37) % 11 - 4) / 4 AS dx FROM (SELECT DISTINCT line FROM px)",
        "en": "SELECT floor(least(0, min(dx)))::BIGINT AS lo, ceil(greatest(0, max(dx)))::BIGINT AS hi FROM dxs",
        "og": "SELECT line, order_idx, dx, lo, unnest(range(20 + hi - lo)) AS j, band FROM dxs JOIN o USING (line), en, (SELECT DISTINCT band FROM px)",
        "og2": "SELECT line, order_idx, j, band, j + lo - dx AS frac FROM og"}


def dxs(spark, sf):
    return cube(spark, sf).select("seq", "line").distinct().withColumn("dx", ((F.col("line") * 37) % 11 - 4) / 4)


@query("H12_rectify_both", sql(f"SELECT order_idx AS line, j AS sample, band, {s6('coalesce(sum(w * dn), 0)', 'v')} FROM (SELECT g.order_idx, g.j, g.band, v.dn, 1 - abs(frac - v.sample) AS w FROM og2 g LEFT JOIN px v ON v.line = g.line AND v.band = g.band AND abs(frac - v.sample) < 1) GROUP BY 1, 2, 3", **BOTH))
def _(spark, sf):
    out = op.rectify_both(cube(spark, sf), "dns", dxs(spark, sf), order(spark, sf), S)
    return inp.to_long(out, "dns", "v").select("line", "sample", "band", r6("v"))


@query("H12_rectify_both_nearest", sql("SELECT g.order_idx AS line, j AS sample, g.band, coalesce(v.dn, 0) AS v FROM og2 g LEFT JOIN px v ON v.line = g.line AND v.band = g.band AND v.sample = round(frac)", **BOTH))
def _(spark, sf):
    out = op.rectify_both(cube(spark, sf), "dns", dxs(spark, sf), order(spark, sf), S, nearest=True)
    return inp.to_long(out, "dns", "v").select("line", "sample", "band", "v")


def pts(spark, sf):
    return inp.landmark_obs(spark, sf).select(F.lit(0).cast("bigint").alias("seq"), "obs_id", "x", (F.col("y") * 1.25 - 2).alias("y"))


PTS = "SELECT obs_id, x, y * 1.25::DOUBLE - 2 AS y, round(y * 1.25::DOUBLE - 2)::BIGINT AS l FROM obs"


@query("H13_map_to_original", sql(f"""SELECT obs_id, {s6('x - acc', 'ox')}, {s6('(o.line + CASE WHEN l < 0 THEN l WHEN l >= n THEN l - n + 1 ELSE 0 END)::DOUBLE', 'oy')} FROM (SELECT *, (SELECT count(*) FROM o) AS n FROM p)
       JOIN o ON o.order_idx = least(greatest(l, 0), n - 1) JOIN acc USING (line)""", **ACC, o=ORD, p=PTS))
def _(spark, sf):
    out = op.map_to_original(pts(spark, sf), order(spark, sf), acc(spark, sf))
    return out.select("obs_id", r6("ox"), r6(F.col("oy").cast("double"), "oy"))


def _from(base):
    return sql(f"""SELECT obs_id, {s6('x + acc', 'rx')}, {s6('CASE WHEN l > 0 AND l < back THEN coalesce((SELECT max(s.k + (l - s.a)::DOUBLE / (s.b - s.a)) FROM sp s WHERE s.a <= l AND s.b >= l), l) WHEN l >= back THEN n - ' + str(base) + ' + l - back ELSE l END::DOUBLE', 'ry')}
       FROM p, bk JOIN acc ON acc.line = least(greatest(l, 0), n - 1)""", **ACC, o=ORD, p=PTS,
       sp="SELECT order_idx AS k, line AS a, lead(line) OVER (ORDER BY order_idx) AS b FROM o QUALIFY b > a",
       bk="SELECT count(*) AS n, arg_max(line, order_idx) AS back FROM o")


@query("H14_map_from_original", _from(1))
def _(spark, sf):
    return op.map_from_original(pts(spark, sf), order(spark, sf), acc(spark, sf)).select("obs_id", r6("rx"), r6("ry"))


@query("H14_map_from_original_compat", _from(0))
def _(spark, sf):
    return op.map_from_original(pts(spark, sf), order(spark, sf), acc(spark, sf), compat=True).select("obs_id", r6("rx"), r6("ry"))


@query("H15_undistort")
def _(spark, sf):
    px = normalize_channels(rgb(spark, sf)).select("seq", "line", "sample", F.col("scaled").alias("v"))
    out, _ = op.undistort(px, "v", S, "both")
    return inp.to_long(out, "v", "value").select("line", "sample", "band", r6("value"))


@query("H15_undistort_lines")
def _(spark, sf):
    px = normalize_channels(rgb(spark, sf)).select("seq", "line", "sample", F.col("scaled").alias("v"))
    _, table = op.undistort(px, "v", S, "horizontal", method="bayes")
    return table.select("line", r6("acc"), "order_idx")
