"""3-vectors and rotations as lists of columns: vectors have 3 entries, matrices 9 (row by row).

Everything stays a built-in expression. ``keep`` writes intermediate results to named columns, so that long chains
(rotation of a rotation of ...) do not repeat their inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = list[Column]
TINY = 1e-8


def keep(df: DataFrame, **parts: list[Column]) -> DataFrame:
    """Store each list as columns name_0, name_1, ..."""
    return df.withColumns({f"{n}_{k}": c for n, cols in parts.items() for k, c in enumerate(cols)})


def ref(name: str, n: int = 3) -> Vec:
    return [F.col(f"{name}_{k}") for k in range(n)]


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"{n}_{k}" for n in names for k in range(9)])


def const(*values: float) -> Vec:
    return [F.lit(float(v)) for v in values]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s: Column | float) -> Vec:
    return [x * s for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def transpose(m: Vec) -> Vec:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def matvec(m: Vec, v: Vec) -> Vec:
    return [dot(m[3 * r: 3 * r + 3], v) for r in range(3)]


def matmul(a: Vec, b: Vec) -> Vec:
    return [dot(a[3 * r: 3 * r + 3], [b[c], b[3 + c], b[6 + c]]) for r in range(3) for c in range(3)]


def rot_x(a: Column) -> Vec:
    o, z = F.lit(1.0), F.lit(0.0)
    return [o, z, z, z, F.cos(a), -F.sin(a), z, F.sin(a), F.cos(a)]


def rot_y(a: Column) -> Vec:
    o, z = F.lit(1.0), F.lit(0.0)
    return [F.cos(a), z, F.sin(a), z, o, z, -F.sin(a), z, F.cos(a)]


def rot_z(a: Column) -> Vec:
    o, z = F.lit(1.0), F.lit(0.0)
    return [F.cos(a), -F.sin(a), z, F.sin(a), F.cos(a), z, z, z, o]


def with_rodrigues(df: DataFrame, name: str, r: Vec) -> DataFrame:
    """Add name_0..8, the matrix of the axis-angle vector ``r``; its angle functions are computed once."""
    df = keep(df, _v=r).withColumn("_angle", norm(ref("_v")))
    small = F.col("_angle") < TINY
    df = df.withColumns({
        "_a": F.when(small, F.lit(1.0)).otherwise(F.sin("_angle") / F.col("_angle")),
        "_b": F.when(small, F.lit(0.5)).otherwise((1 - F.cos("_angle")) / (F.col("_angle") * F.col("_angle"))),
    })
    (x, y, z), a, b = ref("_v"), F.col("_a"), F.col("_b")
    m = [
        1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
        b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
        b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y),
    ]
    return drop(keep(df, **{name: m}), "_v").drop("_angle", "_a", "_b")


def with_axis_angle(df: DataFrame, name: str, q: Vec) -> DataFrame:
    """Add name_0..2, the axis-angle vector (angle in [0, pi]) of the quaternion (w, x, y, z) of any scale."""
    df = keep(df, _q=q)
    sign = F.when(F.col("_q_0") < 0, -1.0).otherwise(1.0)
    df = df.withColumns({"_w": F.abs("_q_0"), "_sign": sign, "_len": norm(ref("_q", 4)[1:])})
    w, length = F.col("_w"), F.col("_len")
    factor = F.when(length < TINY * w, 2.0 / w).otherwise(2 * F.atan2(length, w) / length) * F.col("_sign")
    df = df.withColumn("_factor", factor)
    out = keep(df, **{name: scale(ref("_q", 4)[1:], F.col("_factor"))})
    return drop(out, "_q").drop("_w", "_sign", "_len", "_factor")


def with_log(df: DataFrame, name: str, matrix: str) -> DataFrame:
    """Add name_0..2, the axis-angle vector of the matrix columns matrix_0..8.

    Goes through the quaternion whose largest component is taken from the diagonal, so half turns stay exact.
    """
    m = ref(matrix, 9)
    trace = m[0] + m[4] + m[8]
    pick = (
        F.when(trace > 0, 0).when((m[0] >= m[4]) & (m[0] >= m[8]), 1).when(m[4] >= m[8], 2).otherwise(3)
    )
    df = df.withColumns({
        "_pick": pick, "_dx": m[7] - m[5], "_dy": m[2] - m[6], "_dz": m[3] - m[1],
        "_xy": m[1] + m[3], "_xz": m[2] + m[6], "_yz": m[5] + m[7],
    })
    k, dx, dy, dz = F.col("_pick"), F.col("_dx"), F.col("_dy"), F.col("_dz")
    xy, xz, yz = F.col("_xy"), F.col("_xz"), F.col("_yz")

    def choose(*cases: Column) -> Column:
        return F.when(k == 0, cases[0]).when(k == 1, cases[1]).when(k == 2, cases[2]).otherwise(cases[3])

    q = [
        choose(1 + trace, dx, dy, dz),
        choose(dx, 1 + m[0] - m[4] - m[8], xy, xz),
        choose(dy, xy, 1 - m[0] + m[4] - m[8], yz),
        choose(dz, xz, yz, 1 - m[0] - m[4] + m[8]),
    ]
    return with_axis_angle(df, name, q).drop("_pick", "_dx", "_dy", "_dz", "_xy", "_xz", "_yz")


def compose(r1: Vec, t1: Vec, r2: Vec, t2: Vec) -> tuple[Vec, Vec]:
    """(R1, t1) after (R2, t2), matrices in and out."""
    return matmul(r1, r2), add(matvec(r1, t2), t1)


def inverse(r: Vec, t: Vec) -> tuple[Vec, Vec]:
    rt = transpose(r)
    return rt, scale(matvec(rt, t), -1.0)


def with_rotation(df: DataFrame, name: str, kind: str, cols: Vec) -> DataFrame:
    """Axis-angle from 'axis_angle' (x, y, z), 'quaternion' (w, x, y, z) or 'euler_xyz' (x, y, z; Rz*Ry*Rx)."""
    if kind == "axis_angle":
        return keep(df, **{name: cols})
    if kind == "quaternion":
        return with_axis_angle(df, name, cols)
    if kind == "euler_xyz":
        x, y, z = cols
        df = keep(df, _e=matmul(matmul(rot_z(z), rot_y(y)), rot_x(x)))
        return drop(with_log(df, name, "_e"), "_e")
    raise ValueError(f"unknown rotation representation {kind!r}")
