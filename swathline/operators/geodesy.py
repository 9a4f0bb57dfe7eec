"""Trajectories and terrain cells in ECEF and local frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec


def poses_to_ecef(poses: DataFrame) -> DataFrame:
    """flight, t, r_0..2 (body to ECEF axis-angle), p_0..2 (position) from degrees, metres and radians."""
    lat, lon = F.col("lat"), F.col("lon")
    staged = vec.keep(
        poses, p=geo.geodetic_to_ecef(lat, lon, F.col("height")),
        m=geo.body_to_ecef(lat, lon, F.col("roll"), F.col("pitch"), F.col("yaw")),
    )
    staged = vec.with_log(staged, "r", "m")
    return staged.select("flight", "t", *[f"r_{k}" for k in range(3)], *[f"p_{k}" for k in range(3)])


def mean_frame(points: DataFrame, kind: str = "enu") -> tuple[list[Column], list[Column]]:
    """ECEF-to-local map at the mean latitude and longitude (height 0) as scalar subqueries: no join."""
    m, t = geo.local_frame(kind, F.col("lat"), F.col("lon"), F.lit(0.0))
    mean = points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    frame = mean.select(F.struct(*[c.alias(f"m{k}") for k, c in enumerate([*m, *t])])).scalar()
    return [frame[f"m{k}"] for k in range(9)], [frame[f"m{9 + k}"] for k in range(3)]


def local_track(poses: DataFrame) -> DataFrame:
    """Positions in one east-north-up frame at the mean position of all poses: flight, t, x, y, z."""
    m, t = mean_frame(poses)
    staged = vec.keep(poses, p=geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("height")))
    xyz = geo.apply_affine(m, t, vec.ref("p"))
    return staged.select("flight", "t", *[c.alias(n) for c, n in zip(xyz, "xyz")])


def dtm_points(dtm: DataFrame, geotransform: list[float], kind: str = "enu") -> DataFrame:
    """Valid terrain cells as ECEF points and as points of a local frame at the mean cell.

    ``geotransform`` = [a, b, c, d, e, f]: lon = a*j + b*i + c, lat = d*j + e*i + f.
    """
    a, b, c, d, e, f = geotransform
    cells = dtm.where(spectral.valid_height(F.col("z"))).select(
        "i", "j", "z", (F.col("j") * a + F.col("i") * b + c).alias("lon"), (F.col("j") * d + F.col("i") * e + f).alias("lat")
    )
    m, t = mean_frame(cells, kind)
    cells = vec.keep(cells, p=geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("z")))
    return vec.keep(cells, q=geo.apply_affine(m, t, vec.ref("p")))


def track_extent(track: DataFrame, compat: bool = False) -> DataFrame:
    """Extent of a local track and the display scale 12/extent. The box never shrinks below -1..1.

    ``compat`` ignores y, which the display does by a slip.
    """
    axes = ["x"] if compat else ["x", "y"]
    low = F.least(F.lit(-1.0), *[F.min(a) for a in axes])
    high = F.greatest(F.lit(1.0), *[F.max(a) for a in axes])
    box = track.agg(low.alias("low"), high.alias("high"))
    return box.withColumn("scale", 12.0 / F.greatest(F.abs("low"), F.col("high")))
