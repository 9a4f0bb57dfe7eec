"""Rotations (F13, F14), geodesy (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog import sqlvec as sv
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.functions import geo, vec
from swathline.operators import geodesy as op
from swathline.plans import inputs as inp

LL = ["lat", "lon", "height"]
GT = [0.0001, 0.0, 6.0, 0.0, -0.0001, 46.0]


def rounded(name: str, out: str | None = None, digits: int = 6, k: int = 3):
    return [r6(f"{name}_{i}", f"{out or name}_{i}", digits) for i in range(k)]


def c(*names):
    return [F.col(n) for n in names]


@query("F13_rotation_from_euler", sql(f"SELECT n, {sv.rnd('r', 'r')} FROM b", a=f"SELECT n, {sv.cols('m', sv.mm(sv.mm(sv.rz('yaw'), sv.ry('pitch')), sv.rx('roll')))} FROM poses",
       q=f"SELECT n, {sv.cols('q', sv.quat(sv.n('m', 9)))} FROM a", b=f"SELECT n, {sv.cols('r', sv.axis(sv.n('q', 4)))} FROM q"))
def _(spark, sf):
    df = vec.with_rotation(inp.poses_raw(spark, sf), "r", "euler_xyz", c("roll", "pitch", "yaw"))
    return df.select("n", *rounded("r"))


@query("F13_rotation_from_quaternion", sql(f"SELECT n, {sv.rnd('r', 'r')} FROM b", b=f"SELECT n, {sv.cols('r', sv.axis(['(1 + roll)', 'pitch', 'yaw', '(roll * pitch)']))} FROM poses"))
def _(spark, sf):
    q = [1 + F.col("roll"), F.col("pitch"), F.col("yaw"), F.col("roll") * F.col("pitch")]
    df = vec.with_rotation(inp.poses_raw(spark, sf), "r", "quaternion", q)
    return df.select("n", *rounded("r"))


@query("F14_rodrigues", sql(f"SELECT n, {sv.rnd('m', 'm', k=9)} FROM a", a=f"SELECT n, {sv.cols('m', sv.rod(['roll', 'pitch', 'yaw']))} FROM poses"))
def _(spark, sf):
    df = vec.with_rodrigues(inp.poses_raw(spark, sf), "m", c("roll", "pitch", "yaw"))
    return df.select("n", *rounded("m", k=9))


@query("F14_inverse_compose", sql(f"SELECT n, {sv.rnd('v', 'v')} FROM d",
       a=f"SELECT n, lon, lat, height, {sv.cols('m', sv.rod(['roll', 'pitch', 'yaw']))}, {sv.cols('o', sv.rod(['yaw', 'roll', 'pitch']))} FROM poses",
       b=f"SELECT n, {sv.cols('x', sv.mm(sv.n('m', 9), sv.tr(sv.n('o', 9))))}, {sv.cols('v', sv.mv(sv.tr(sv.n('o', 9)), ['lon', 'lat', 'height']))}, {sv.cols('m', sv.n('m', 9))}, lon, lat, height FROM a",
       d=f"SELECT n, {sv.cols('v', [f'{a} + {b}' for a, b in zip(sv.mv(sv.n('m', 9), ['-v0', '-v1', '-v2']), ['lon', 'lat', 'height'])])} FROM b"))
def _(spark, sf):
    """Translation of (R1, t) composed with (R2, t)^-1."""
    df = vec.with_rodrigues(inp.poses_raw(spark, sf), "a", c("roll", "pitch", "yaw"))
    df = vec.with_rodrigues(df, "b", c("yaw", "roll", "pitch"))
    t = c("lon", "lat", "height")
    ri, ti = vec.inverse(vec.ref("b", 9), t)
    df = vec.keep(df, i=ri, u=ti)
    _, v = vec.compose(vec.ref("a", 9), t, vec.ref("i", 9), vec.ref("u"))
    return vec.keep(df, v=v).select("n", *rounded("v"))


@query("G1_geodetic_to_ecef", sql(f"SELECT n, {sv.rnd('p', 'p', 3)} FROM a", a=f"SELECT n, {sv.cols('p', sv.ecef(*LL))} FROM poses"))
def _(spark, sf):
    return vec.keep(inp.poses_raw(spark, sf), p=geo.geodetic_to_ecef(*c(*LL))).select("n", *rounded("p", digits=3))


@query("G2_ecef_to_geodetic", sql(f"SELECT n, {s6('lat', 'lat', 8)}, {s6('lon', 'lon', 8)}, {s6('height', 'height', 3)} FROM poses"))
def _(spark, sf):
    """Round trip: the oracle is the input itself."""
    df = vec.keep(inp.poses_raw(spark, sf).select("n", *LL), p=geo.geodetic_to_ecef(*c(*LL)))
    lat, lon, h = geo.ecef_to_geodetic(*vec.ref("p"))
    return df.select("n", r6(lat, "lat", 8), r6(lon, "lon", 8), r6(h, "height", 3))


def _frame(kind):
    text = sql(f"SELECT n, {sv.rnd('m', 'm', k=9)}, {sv.rnd('t', 't', 3)} FROM b",
               a=f"SELECT n, {sv.cols('m', sv.frame(kind, 'lat', 'lon'))}, {sv.cols('p', sv.ecef(*LL))} FROM poses",
               b=f"SELECT *, {sv.cols('t', ['-' + x for x in sv.mv(sv.n('m', 9), sv.n('p'))])} FROM a")

    def run(spark, sf):
        m, t = geo.local_frame(kind, *c(*LL))
        return vec.keep(inp.poses_raw(spark, sf), m=m, t=t).select("n", *rounded("m", k=9), *rounded("t", digits=3))

    return text, run


for _id, _kind in (("G3_local_frame_enu", "enu"), ("G4_local_frame_nwu", "nwu"), ("G4_local_frame_ned", "ned")):
    _text, _run = _frame(_kind)
    query(_id, _text)(_run)


@query("G5_poses_to_ecef", sql(f"SELECT flight, t, {sv.rnd('r', 'r')}, {sv.rnd('p', 'p', 3)} FROM ep", **sv.ecef_poses()))
def _(spark, sf):
    return op.poses_to_ecef(inp.poses_raw(spark, sf)).select("flight", "t", *rounded("r"), *rounded("p", digits=3))


def _local(points, lat="lat", lon="lon", h="height"):
    """CTEs: fr = one-row frame at the mean of ``points``."""
    return {
        "mean": f"SELECT avg({lat}) AS lat, avg({lon}) AS lon FROM {points}",
        "fr": f"SELECT {sv.cols('f', sv.frame('enu', 'lat', 'lon'))}, {sv.cols('c', sv.ecef('lat', 'lon', '0'))} FROM mean",
    }


_SHIFTED = [f"(p{k} - c{k})" for k in range(3)]


@query("G6_local_track", sql(f"SELECT flight, t, {s6('v0', 'x', 3)}, {s6('v1', 'y', 3)}, {s6('v2', 'z', 3)} FROM o",
       **_local("poses"), a=f"SELECT flight, t, {sv.cols('p', sv.ecef(*LL))} FROM poses",
       o=f"SELECT flight, t, {sv.cols('v', sv.mv(sv.n('f', 9), _SHIFTED))} FROM a, fr"))
def _(spark, sf):
    return op.local_track(inp.poses_raw(spark, sf)).select("flight", "t", *[r6(x, x, 3) for x in "xyz"])


@query("G7_apply_affine", sql(f"SELECT obs_id, {sv.rnd('v', 'v')} FROM b", a=f"SELECT obs_id, x, y, {sv.cols('m', sv.rod(['x / 20', 'y / 20', '0.3::DOUBLE']))} FROM obs",
       b=f"SELECT obs_id, {sv.cols('v', [f'{e} + {k}' for k, e in enumerate(sv.mv(sv.n('m', 9), ['x', 'y', '1']))])} FROM a"))
def _(spark, sf):
    df = inp.landmark_obs(spark, sf)
    df = vec.with_rodrigues(df, "m", [F.col("x") / 20, F.col("y") / 20, F.lit(0.3)])
    return vec.keep(df, v=geo.apply_affine(vec.ref("m", 9), vec.const(0, 1, 2), [F.col("x"), F.col("y"), F.lit(1.0)])).select("obs_id", *rounded("v"))


@query("G8_dtm_points", sql(f"SELECT i, j, {sv.rnd('p', 'p', 3)}, {sv.rnd('v', 'q', 3)} FROM o",
       g="SELECT i, j, z, j * 0.0001::DOUBLE + i * 0 + 6.0 AS lon, j * 0 + i * (-0.0001::DOUBLE) + 46.0 AS lat FROM dtm WHERE z IS NOT NULL",
       **_local("g"), a=f"SELECT i, j, {sv.cols('p', sv.ecef('lat', 'lon', 'z'))} FROM g",
       o=f"SELECT i, j, p0, p1, p2, {sv.cols('v', sv.mv(sv.n('f', 9), _SHIFTED))} FROM a, fr"))
def _(spark, sf):
    return op.dtm_points(inp.dtm(spark, sf), GT).select("i", "j", *rounded("p", digits=3), *rounded("q", digits=3))


@query("G9_track_extent", sql(f"SELECT {s6('low', 'low', 3)}, {s6('high', 'high', 3)}, {s6('12 / greatest(abs(low), high)', 'scale', 9)} FROM e",
       **_local("poses"), a=f"SELECT flight, t, {sv.cols('p', sv.ecef(*LL))} FROM poses",
       o=f"SELECT {sv.cols('v', sv.mv(sv.n('f', 9), _SHIFTED))} FROM a, fr",
       e="SELECT least(-1, min(v0), min(v1)) AS low, greatest(1, max(v0), max(v1)) AS high FROM o"))
def _(spark, sf):
    out = op.track_extent(op.local_track(inp.poses_raw(spark, sf)))
    return out.select(r6("low", digits=3), r6("high", digits=3), r6("scale", digits=9))
