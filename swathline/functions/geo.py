"""WGS84 geodesy as closed-form column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline.functions import vec
from swathline.functions.vec import Vec

# WGS84 semi-major axis and flattening.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
EP2 = E2 / (1 - E2)


def geodetic_to_ecef(lat: Column, lon: Column, h: Column) -> Vec:
    """Degrees and metres above the ellipsoid to X, Y, Z."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return [
        (n + h) * F.cos(phi) * F.cos(lam),
        (n + h) * F.cos(phi) * F.sin(lam),
        (n * (1 - E2) + h) * F.sin(phi),
    ]


def ecef_to_geodetic(x: Column, y: Column, z: Column, iterations: int = 2) -> Vec:
    """X, Y, Z to latitude, longitude (degrees) and height; Bowring steps unrolled into columns."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    phi = theta
    for _ in range(iterations):
        s, c = F.sin(theta), F.cos(theta)
        phi = F.atan2(z + EP2 * B * s * s * s, p - E2 * A * c * c * c)
        theta = F.atan2(B * F.sin(phi), A * F.cos(phi))
    height = p * F.cos(phi) + z * F.sin(phi) - A * F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return [F.degrees(phi), F.degrees(F.atan2(y, x)), height]


def up(lat: Column, lon: Column) -> Vec:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def east(lon: Column) -> Vec:
    lam = F.radians(lon)
    return [-F.sin(lam), F.cos(lam), F.lit(0.0)]


def frame_axes(kind: str, lat: Column, lon: Column) -> Vec:
    """Rows of the ECEF-to-local rotation for 'enu', 'nwu' or 'ned'."""
    u, e = up(lat, lon), east(lon)
    if kind == "enu":
        return [*e, *vec.cross(u, e), *u]
    if kind == "nwu":
        west = vec.scale(e, -1.0)
        return [*vec.cross(west, u), *west, *u]
    if kind == "ned":
        down = vec.scale(u, -1.0)
        return [*vec.cross(e, down), *e, *down]
    raise ValueError(f"unknown local frame {kind!r}")


def local_frame(kind: str, lat: Column, lon: Column, h: Column) -> tuple[Vec, Vec]:
    """Rotation (9) and translation (3) of the affine map from ECEF to the local frame."""
    rows = frame_axes(kind, lat, lon)
    return rows, vec.scale(vec.matvec(rows, geodetic_to_ecef(lat, lon, h)), -1.0)


def apply_affine(m: Vec, t: Vec, p: Vec) -> Vec:
    return vec.add(vec.matvec(m, p), t)


def body_to_ecef(lat: Column, lon: Column, roll: Column, pitch: Column, yaw: Column, roll_sign: int = -1,
                 flip_yz: bool = False, to_ned: bool = True) -> Vec:
    """Attitude matrix Rz(yaw) Ry(pitch) Rx(roll_sign*roll), by default carried from NED to ECEF.

    ``flip_yz`` turns the camera's y and z axes around, as the patch convention does.
    """
    attitude = vec.matmul(vec.matmul(vec.rot_z(yaw), vec.rot_y(pitch)), vec.rot_x(roll * roll_sign))
    if flip_yz:
        attitude = [c if k % 3 == 0 else -c for k, c in enumerate(attitude)]
    if not to_ned:
        return attitude
    return vec.matmul(vec.transpose(frame_axes("ned", lat, lon)), attitude)
