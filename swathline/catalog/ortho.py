"""Ortho-mosaic and raster operators (O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog import sqlvec as sv
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.catalog.geodesy import GT, rounded
from swathline.catalog.projection import GEOM
from swathline.operators import geodesy, ortho, raster
from swathline.plans import inputs as inp


def proj(spark, sf):
    return inp.projected(inp.pixels(spark, sf))


def rois(spark, sf):
    return ortho.file_roi(proj(spark, sf), ["file_id"])


ROI = {"roi": "SELECT file_id, min(pi) AS min_i, max(pi) AS max_i, min(pj) AS min_j, max(pj) AS max_j FROM proj WHERE pi IS NOT NULL AND pj IS NOT NULL GROUP BY 1"}


@query("O1_file_roi", sql("SELECT file_id, " + ", ".join(s6(c) for c in ("min_i", "max_i", "min_j", "max_j")) + " FROM roi", **ROI))
def _(spark, sf):
    return rois(spark, sf).select("file_id", *[r6(c) for c in ("min_i", "max_i", "min_j", "max_j")])


def _split(size, tile):
    n = f"ceil({size} / {tile})::BIGINT"
    return n, f"({tile} - CASE WHEN {n} > 1 AND {n} * {tile} <> {size} THEN ({tile} - {size} % {tile}) // ({n} - 1) ELSE 0 END)"


FIXED = {"sz": "SELECT floor((max(i) + 1) * 1.7::DOUBLE)::BIGINT AS h, floor((max(j) + 1) * 1.7::DOUBLE)::BIGINT AS w FROM dtm",
         "gr": f"SELECT h, w, {_split('h', 16)[0]} AS vn, {_split('h', 16)[1]} AS vp, {_split('w', 16)[0]} AS hn, {_split('w', 16)[1]} AS hp FROM sz",
         "ti": "SELECT *, unnest(range(vn)) AS tile_i FROM gr", "tj": "SELECT *, unnest(range(hn)) AS tile_j FROM ti"}


@query("O2_tile_grid_fixed", sql("SELECT tile_i, tile_j, tile_i * vp AS i0, tile_j * hp AS j0, CASE WHEN tile_i = vn - 1 THEN h - tile_i * vp ELSE vp END AS height, CASE WHEN tile_j = hn - 1 THEN w - tile_j * hp ELSE hp END AS width FROM tj", **FIXED))
def _(spark, sf):
    return ortho.tile_grid_fixed(inp.dtm(spark, sf), 1.7, 16)


FIT = {**ROI,
       "bx": "SELECT min(min_i) AS bi, min(min_j) AS bj, max(max_i) - min(min_i) AS bh, max(max_j) - min(min_j) AS bw FROM roi",
       "nn": "SELECT *, ceil(bh / (8 / 1.5::DOUBLE))::BIGINT AS ni, ceil(bw / (8 / 1.5::DOUBLE))::BIGINT AS nj FROM bx",
       "al": "SELECT a.tile_i, unnest(range(nj)) AS tile_j, bi, bj, bh / ni AS di, bw / nj AS dj FROM (SELECT *, unnest(range(ni)) AS tile_i FROM nn) a",
       "fit": "SELECT * FROM al WHERE EXISTS (SELECT 1 FROM roi WHERE max_i > bi + tile_i * di AND max_j > bj + tile_j * dj AND min_i < bi + (tile_i + 1) * di AND min_j < bj + (tile_j + 1) * dj)"}


@query("O3_tile_grid_fit", sql(f"SELECT tile_i, tile_j, {s6('bi + tile_i * di', 'i0')}, {s6('bj + tile_j * dj', 'j0')}, {s6('bi + tile_i * di + di', 'i1')}, {s6('bj + tile_j * dj + dj', 'j1')}, ceil(di * 1.5::DOUBLE)::BIGINT AS height, ceil(dj * 1.5::DOUBLE)::BIGINT AS width FROM fit", **FIT))
def _(spark, sf):
    out = ortho.tile_grid_fit(rois(spark, sf), 1.5, 8)
    return out.select("tile_i", "tile_j", *[r6(c) for c in ("i0", "j0", "i1", "j1")], "height", "width")


CORNERS = {"sz": "SELECT max(i)::DOUBLE AS h, max(j)::DOUBLE AS w FROM dtm",
           "co": f"SELECT h, w, {sv.cols('o', sv.ecef('46.0', '6.0', '0'))}, {sv.cols('a', sv.ecef('(h * (-0.0001::DOUBLE) + 46.0)', '6.0', '0'))}, {sv.cols('b', sv.ecef('46.0', '(w * 0.0001::DOUBLE + 6.0)', '0'))} FROM sz",
           "st": "SELECT *, sqrt(pow(a0 - o0, 2) + pow(a1 - o1, 2) + pow(a2 - o2, 2)) AS la, sqrt(pow(b0 - o0, 2) + pow(b1 - o1, 2) + pow(b2 - o2, 2)) AS lb FROM co"}


@query("O4_map_scale", sql(f"SELECT {s6('la / h', 'gsd_i', 5)}, {s6('lb / w', 'gsd_j', 5)}, {s6('greatest(la / h, lb / w) / 0.5::DOUBLE', 'scale', 5)} FROM st", **CORNERS))
def _(spark, sf):
    return ortho.map_scale(inp.dtm(spark, sf), GT, 0.5).select(*[r6(c, digits=5) for c in ("gsd_i", "gsd_j", "scale")])


@query("O5_tile_affine", sql(f"SELECT tile_i, tile_j, {s6('0.0001::DOUBLE / 1.5::DOUBLE', 'x_per_col', 9)}, 0.0::DOUBLE AS y_per_col, 0.0::DOUBLE AS x_per_row, {s6('-0.0001::DOUBLE / 1.5::DOUBLE', 'y_per_row', 9)}, {s6('(bj + tile_j * dj) * 0.0001::DOUBLE + 6', 'x0', 9)}, {s6('(bi + tile_i * di) * (-0.0001::DOUBLE) + 46', 'y0', 9)} FROM fit", **FIT))
def _(spark, sf):
    tiles = ortho.tile_grid_fit(rois(spark, sf), 1.5, 8)
    out = ortho.tile_affine(tiles, GT, 1.5)
    return out.select("tile_i", "tile_j", *[r6(c, digits=9) for c in out.columns[2:]])


def _splat_sql(scale, tile, extra=""):
    """CTE sp: tile_i, tile_j, i, j, line, sample, w from two per-axis lists."""
    def axis(p, size):
        n, per = _split(size, tile)
        t = lambda c: f"least(floor({c} / {per}), {n} - 1)::BIGINT"
        lo, hi = f"floor({p})::BIGINT", f"ceil({p})::BIGINT"
        same = f"({t(lo)} = {t(hi)} AND {lo} >= 0 AND {hi} < {size})"
        row = lambda c, w: f"SELECT line, sample, {t(c)} AS t, {c} - {t(c)} * {per} AS c, {c} AS g, CASE WHEN {same} THEN {w} ELSE 1 END AS w, {size} AS size FROM pt"
        return row(lo, f"{hi} - {p}") + " UNION ALL " + row(hi, f"1 - ({hi} - {p})")
    return {"sz": f"SELECT floor((max(i) + 1) * {scale}::DOUBLE)::BIGINT AS h, floor((max(j) + 1) * {scale}::DOUBLE)::BIGINT AS wd FROM dtm",
            "pt": f"SELECT line, sample, pi * {scale}::DOUBLE AS si, pj * {scale}::DOUBLE AS sj, h, wd FROM proj, sz WHERE pi IS NOT NULL AND pj IS NOT NULL",
            "axi": axis("si", "h"), "axj": axis("sj", "wd"),
            "sp": "SELECT a.line, a.sample, a.t AS tile_i, b.t AS tile_j, a.c AS i, b.c AS j, a.w * b.w AS w FROM axi a JOIN axj b USING (line, sample) WHERE a.w > 0 AND b.w > 0 AND a.g >= 0 AND a.g < a.size AND b.g >= 0 AND b.g < b.size",
            "ort": "SELECT tile_i, tile_j, i, j, band, sum(w) AS w, sum(w * dn) / sum(w) AS v FROM sp JOIN px USING (line, sample) GROUP BY 1, 2, 3, 4, 5"}


def grid_size(spark, sf, scale):
    size = inp.dtm(spark, sf).agg(F.struct(
        F.floor((F.max("i") + 1) * scale).alias("h"), F.floor((F.max("j") + 1) * scale).alias("w"))).scalar()
    return size["h"], size["w"]


def mosaic(spark, sf, scale, tile):
    h, w = grid_size(spark, sf, scale)
    return ortho.splat(proj(spark, sf), "dns", scale, tile, h, w, n_bands=64)


@query("O6_splat", sql(f"SELECT tile_i, tile_j, i, j, band, {s6('w')}, {s6('v', 'v', 4)} FROM ort", **_splat_sql(1.3, 16)))
def _(spark, sf):
    out = inp.to_long(mosaic(spark, sf, 1.3, 16), "dns", "v")
    return out.select("tile_i", "tile_j", "i", "j", "band", r6("w"), r6("v", digits=4))


@query("O7_ortho_rgb", sql(f"SELECT tile_i, tile_j, i, j, {s6('max(v) FILTER (band = 43)', 'r', 4)}, {s6('max(v) FILTER (band = 27)', 'g', 4)}, {s6('max(v) FILTER (band = 63)', 'b', 4)} FROM ort GROUP BY 1, 2, 3, 4", **_splat_sql(1.3, 16)))
def _(spark, sf):
    out = ortho.ortho_rgb(mosaic(spark, sf, 1.3, 16), "dns", (43, 27, 99))
    return out.select("tile_i", "tile_j", "i", "j", *[r6(c, digits=4) for c in "rgb"])


def _tile_size(size, tile, index):
    n, per = _split(size, tile)
    return f"CASE WHEN {index} = {n} - 1 THEN {size} - ({n} - 1) * {per} ELSE {per} END::BIGINT"


_SAME = "c.tile_i = o.tile_i AND c.tile_j = o.tile_j"


@query("O8_inpaint_nearest", sql(f"SELECT tile_i, tile_j, i, j, band, painted, {s6('v', 'v', 4)} FROM res", **_splat_sql(4, 16),
       occ="SELECT DISTINCT tile_i, tile_j, i, j FROM sp",
       til=f"SELECT DISTINCT tile_i, tile_j, {_tile_size('h', 16, 'tile_i')} AS hh, {_tile_size('wd', 16, 'tile_j')} AS ww FROM occ, sz",
       cell="SELECT *, unnest(range(ww)) AS j FROM (SELECT *, unnest(range(hh)) AS i FROM til)",
       hole=f"SELECT c.tile_i, c.tile_j, c.hh, c.ww, c.i, c.j, min((pow(c.i - o.i, 2) + pow(c.j - o.j, 2))::BIGINT * 100000000 + o.i * 10000 + o.j) AS m FROM cell c JOIN occ o ON {_SAME} AND abs(c.i - o.i) <= 3 AND abs(c.j - o.j) <= 3 GROUP BY ALL HAVING m >= 100000000",
       wide=f"SELECT DISTINCT c.tile_i, c.tile_j, c.i, c.j FROM cell c JOIN occ o ON {_SAME} AND abs(c.i - o.i) <= 6 AND abs(c.j - o.j) <= 6",
       seen=f"SELECT c.tile_i, c.tile_j, c.i, c.j, c.hh, c.ww, c.m, count(*) AS n FROM hole c JOIN wide o ON {_SAME} AND abs(c.i - o.i) <= 7 AND abs(c.j - o.j) <= 7 GROUP BY ALL",
       clo="SELECT *, (m // 10000) % 10000 AS si, m % 10000 AS sj FROM seen WHERE n = (least(i + 7, hh - 1) - greatest(i - 7, 0) + 1) * (least(j + 7, ww - 1) - greatest(j - 7, 0) + 1)",
       res=f"SELECT tile_i, tile_j, i, j, band, false AS painted, v FROM ort UNION ALL SELECT c.tile_i, c.tile_j, c.i, c.j, o.band, true, o.v FROM clo c JOIN ort o ON {_SAME} AND o.i = c.si AND o.j = c.sj"))
def _(spark, sf):
    """All bands, on tiles small enough that many holes lie at a border."""
    h, w = grid_size(spark, sf, 4)

    def size(whole, index):
        n, per = ortho.fixed_split(whole, 16)
        return F.when(F.col(index) == n - 1, whole - (n - 1) * per).otherwise(per)

    tiles = ortho.splat(proj(spark, sf), "dns", 4, 16, h, w, n_bands=64)
    out = inp.to_long(ortho.inpaint_nearest(tiles, "dns", 3, size(h, "tile_i"), size(w, "tile_j")), "dns", "v")
    return out.select("tile_i", "tile_j", "i", "j", "band", "painted", r6("v", digits=4))


_L = "SELECT *, sqrt({0}0 * {0}0 + {0}1 * {0}1 + {0}2 * {0}2) AS len FROM {1}"


@query("O9_rectify_dtm", sql(f"SELECT i, j, {s6('avg(z)', 'z', 3)}, count(*) AS n_obs FROM fin GROUP BY 1, 2", **CORNERS,
       f1="SELECT o0, o1, o2, la / h AS ga, lb / w AS gb, (a0 - o0) / la AS x0, (a1 - o1) / la AS x1, (a2 - o2) / la AS x2, b0 - o0 AS y0, b1 - o1 AS y1, b2 - o2 AS y2 FROM st",
       f2=f"SELECT *, {sv.cols('c', sv.cross(sv.n('x'), sv.n('y')))} FROM f1", f3=_L.format("c", "f2"),
       f4="SELECT o0, o1, o2, ga, gb, x0, x1, x2, c0 / len AS z0, c1 / len AS z1, c2 / len AS z2 FROM f3",
       f5=f"SELECT *, {sv.cols('y', sv.cross(sv.n('z'), sv.n('x')))} FROM f4",
       g1=f"SELECT {sv.cols('g', sv.ecef('(i * (-0.0001::DOUBLE) + 46.0)', '(j * 0.0001::DOUBLE + 6.0)', 'z'))} FROM dtm WHERE z IS NOT NULL",
       fin="SELECT round(((g0 - o0) * x0 + (g1 - o1) * x1 + (g2 - o2) * x2) / ga)::BIGINT AS i, round(((g0 - o0) * y0 + (g1 - o1) * y1 + (g2 - o2) * y2) / gb)::BIGINT AS j, (g0 - o0) * z0 + (g1 - o1) * z1 + (g2 - o2) * z2 AS z FROM g1, f5"))
def _(spark, sf):
    return raster.rectify_dtm(inp.dtm(spark, sf), GT).select("i", "j", r6("z", digits=3), "n_obs")


@query("O10_bilinear_sample", sql(f"SELECT line, sample, {s6('bz.z', 'z')} FROM proj LEFT JOIN bz USING (line, sample)", **GEOM))
def _(spark, sf):
    return raster.bilinear_sample(proj(spark, sf), inp.dtm(spark, sf), ["line", "sample"]).select("line", "sample", r6("z"))


def _down(missing):
    return sql(f"SELECT a.oi AS i, b.oj AS j, max({missing}) AS z FROM oi a, oj b, sz, (VALUES (0), (1)) p(u), (VALUES (0), (1)) q(v) LEFT JOIN dtm d ON d.i = (CASE u WHEN 0 THEN floor(a.oi * sc) ELSE ceil(a.oi * sc) END) AND d.j = (CASE v WHEN 0 THEN floor(b.oj * sc) ELSE ceil(b.oj * sc) END) GROUP BY 1, 2",
        s0="SELECT max(i) + 1 AS h, max(j) + 1 AS w FROM dtm",
        sz="SELECT h, w, CASE WHEN greatest(h, w) > 17 THEN greatest(h, w) / 17 ELSE 1 END AS sc, CASE WHEN greatest(h, w) > 17 THEN h * 17 // greatest(h, w) ELSE h END AS oh, CASE WHEN greatest(h, w) > 17 THEN w * 17 // greatest(h, w) ELSE w END AS ow FROM s0",
        oi="SELECT unnest(range(oh)) AS oi FROM sz", oj="SELECT unnest(range(ow)) AS oj FROM sz")


@query("O11_downscale_max", _down("CASE WHEN d.i IS NULL THEN 0 ELSE d.z END"))
def _(spark, sf):
    return raster.downscale_max(inp.dtm(spark, sf), 17)


@query("O11_downscale_max_finite", _down("d.z"))
def _(spark, sf):
    return raster.downscale_max(inp.dtm(spark, sf), 17, finite_only=True)


def _norm_sql():
    pairs = []
    for di in (-1, 1):
        for dj in (-1, 1):
            a, b = ("u" if di < 0 else "d"), ("l" if dj < 0 else "r")
            va, vb = [f"({a}.{c} - o.{c})" for c in "xyz"], [f"({b}.{c} - o.{c})" for c in "xyz"]
            pairs.append([f"{di * dj} * {e}" for e in sv.cross(va, vb)])
    terms = ", ".join(f"{e} AS k{n}{c}" for n, p in enumerate(pairs) for c, e in enumerate(p))
    ln = [f"nullif(sqrt(k{n}0 * k{n}0 + k{n}1 * k{n}1 + k{n}2 * k{n}2), 0)" for n in range(4)]
    sums = ", ".join("(" + " + ".join(f"coalesce(k{n}{c} / {ln[n]}, 0)" for n in range(4)) + f") AS s{c}" for c in range(3))
    return sql("SELECT i, j, " + ", ".join(f"round(coalesce(s{c} / nullif(sqrt(s0 * s0 + s1 * s1 + s2 * s2), 0), 0), 6) + 0.0::DOUBLE AS n_{c}" for c in range(3)) + " FROM s",
               pt="SELECT i, j, i * 10.0::DOUBLE AS x, j * 10.0::DOUBLE AS y, z + (i * 7 + j * 13) % 11 AS z FROM dtm WHERE z IS NOT NULL",
               k=f"SELECT o.i, o.j, {terms} FROM pt o LEFT JOIN pt u ON u.i = o.i - 1 AND u.j = o.j LEFT JOIN pt d ON d.i = o.i + 1 AND d.j = o.j LEFT JOIN pt l ON l.i = o.i AND l.j = o.j - 1 LEFT JOIN pt r ON r.i = o.i AND r.j = o.j + 1",
               s=f"SELECT i, j, {sums} FROM k")


@query("O12_terrain_normals", _norm_sql())
def _(spark, sf):
    i, j = F.col("i"), F.col("j")
    pts = inp.dtm(spark, sf).where("z is not null").select("i", "j", (i * 10.0).alias("x"), (j * 10.0).alias("y"), (F.col("z") + (i * 7 + j * 13) % 11).alias("z"))
    return raster.terrain_normals(pts).select("i", "j", *rounded("n"))


@query("O13_terrain_faces", sql("""SELECT a.idx AS a, b.idx AS b, c.idx AS c FROM ix a JOIN ix b ON b.i = a.i + 1 AND b.j = a.j JOIN ix c ON c.i = a.i AND c.j = a.j + 1
       UNION ALL SELECT a.idx, b.idx, c.idx FROM ix a JOIN ix b ON b.i = a.i - 1 AND b.j = a.j JOIN ix c ON c.i = a.i AND c.j = a.j - 1""",
       ix="SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS idx FROM dtm WHERE z IS NOT NULL"))
def _(spark, sf):
    return raster.terrain_faces(inp.dtm(spark, sf))
