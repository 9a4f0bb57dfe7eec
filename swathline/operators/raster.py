"""Operators on height grids (i, j, z): sampling, scaling, normals, faces, re-gridding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec
from swathline.plans.ordered import SLOT_LINES, with_running_sum


def bilinear_sample(points: DataFrame, dtm: DataFrame, keys: list[str], x: str = "pi", y: str = "pj") -> DataFrame:
    """Height at fractional (row, column): the four corners are exploded and met by one equi-join, then summed.

    A point off the grid, or with a void corner of positive weight, gets NULL. Adds ``z``.
    """
    px, py = F.col(x), F.col(y)
    i0, j0 = F.floor(px), F.floor(py)
    fi, fj = px - i0, py - j0
    corners = F.array(*[
        F.struct((i0 + a).alias("i"), (j0 + b).alias("j"), ((fi if a else 1 - fi) * (fj if b else 1 - fj)).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    asked = points.where(px.isNotNull() & py.isNotNull()).select(*keys, F.explode(corners).alias("_c")).where("_c.w > 0")
    asked = asked.select(*keys, "_c.i", "_c.j", "_c.w")
    valid = dtm.where(spectral.valid_height(F.col("z"))).select("i", "j", "z")
    summed = asked.join(valid, ["i", "j"], "left").groupBy(*keys).agg(
        F.when(F.count_if(F.col("z").isNull()) == 0, F.sum(F.col("w") * F.col("z"))).alias("z")
    )
    return points.join(summed, keys, "left")


def image_geometry(points: DataFrame, dtm: DataFrame, keys: list[str], geotransform: list[float]) -> DataFrame:
    """Map coordinates and height of projected pixels: keys, x, y, z."""
    a, b, c, d, e, f = geotransform
    at = bilinear_sample(points, dtm, keys)
    x = F.col("pj") * a + F.col("pi") * b + c
    y = F.col("pj") * d + F.col("pi") * e + f
    return at.where("pi is not null").select(*keys, x.alias("x"), y.alias("y"), "z")


def geometry_ranges(geometry: DataFrame) -> DataFrame:
    """Extremes of the geometry columns and the mean height."""
    return geometry.agg(
        *[fn(c).alias(f"{n}_{c}") for c in "xyz" for n, fn in (("min", F.min), ("max", F.max))], F.avg("z").alias("mean_z")
    )


def downscale_max(dtm: DataFrame, max_side: int, finite_only: bool = False) -> DataFrame:
    """Grid of at most ``max_side`` cells a side; a cell is the maximum of its (up to four) source cells.

    Every source cell names the target cells it belongs to, so there is one aggregation and no join. Source positions
    off the grid count as height 0; ``finite_only`` ignores them and yields NULL where nothing is valid.
    """
    size = dtm.agg(F.struct((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w")).alias("s")).scalar()
    cells = dtm.withColumn("_d", size)
    big = F.greatest("_d.h", "_d.w")
    scale = F.when(big > max_side, big / max_side).otherwise(F.lit(1.0))
    cells = cells.withColumns({"_scale": scale, "_big": big})
    def targets(c: str, n: str) -> Column:
        shrunk = F.when(F.col("_big") > max_side, F.floor(F.col(n) * max_side / F.col("_big"))).otherwise(F.col(n))
        guess = F.floor(F.col(c) / F.col("_scale"))
        return F.filter(
            F.sequence(guess - 1, guess + 1),
            lambda t: (t >= 0) & (t < shrunk)
            & ((F.floor(t * F.col("_scale")) == F.col(c)) | (F.ceil(t * F.col("_scale")) == F.col(c))),
        )
    out = cells.withColumn("_i", F.explode(targets("i", "_d.h"))).withColumn("_j", F.explode(targets("j", "_d.w")))
    ok = spectral.valid_height(F.col("z"))
    outside = (F.ceil(F.col("_i") * F.col("_scale")) >= F.col("_d.h")) | (F.ceil(F.col("_j") * F.col("_scale")) >= F.col("_d.w"))
    top = F.max(F.when(ok, F.col("z")))
    if not finite_only:
        top = F.when(F.bool_or(outside), F.greatest(top, F.lit(0.0))).otherwise(top)
    return out.groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(top.alias("z"))


def terrain_normals(points: DataFrame) -> DataFrame:
    """Unit normal per cell: mean of the normalised cross products of up to four neighbour pairs.

    ``points`` has i, j and x, y, z of valid cells only. Each cell is sent to itself and its four neighbours (one
    shuffle) instead of four joins.
    """
    offsets = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    copies = F.array(*[
        F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(k).alias("k")) for k, (a, b) in enumerate(offsets)
    ])
    sent = points.select(F.explode(copies).alias("_t"), F.struct("x", "y", "z").alias("_p"))
    met = sent.groupBy("_t.i", "_t.j").agg(*[F.max(F.when(F.col("_t.k") == k, F.col("_p"))).alias(f"n{k}") for k in range(5)])
    met = met.where("n0 is not null")
    def delta(k: int) -> vec.Vec:
        return [F.col(f"n{k}.{c}") - F.col(f"n0.{c}") for c in "xyz"]
    met = vec.keep(met, a=delta(1), b=delta(2), c=delta(3), d=delta(4))
    pairs = [("a", "c", 1), ("a", "d", -1), ("b", "c", -1), ("b", "d", 1)]
    for k, (u, v, sign) in enumerate(pairs):
        met = vec.keep(met, **{f"x{k}": vec.scale(vec.cross(vec.ref(u), vec.ref(v)), float(sign))})
    units = [vec.scale(vec.ref(f"x{k}"), F.try_divide(F.lit(1.0), vec.norm(vec.ref(f"x{k}")))) for k in range(4)]
    zero = F.lit(0.0)
    met = vec.keep(met, s=[sum((F.coalesce(u[c], zero) for u in units), zero) for c in range(3)])
    met = met.withColumn("_len", vec.norm(vec.ref("s")))
    return met.select("i", "j", *[F.coalesce(F.try_divide(F.col(f"s_{c}"), F.col("_len")), zero).alias(f"n_{c}") for c in range(3)])


def dense_index(cells: DataFrame) -> DataFrame:
    """Row-major number of each cell: cells before its row plus its place in the row."""
    rows = cells.groupBy("i").agg(F.count(F.lit(1)).alias("n")).withColumn("grid", F.lit(0))
    rows = with_running_sum(rows, ["grid"], "i", F.col("n"), "base", SLOT_LINES, inclusive=False).select("i", "base")
    placed = cells.select("i", "j", F.row_number().over(Window.partitionBy("i").orderBy("j")).alias("_k"))
    return placed.join(rows, "i").select("i", "j", (F.col("base") + F.col("_k") - 1).alias("idx"))


def terrain_faces(dtm: DataFrame) -> DataFrame:
    """Triangles of valid cells, two per quad: a, b, c are dense indices."""
    idx = dense_index(dtm.where(spectral.valid_height(F.col("z"))))
    at = lambda di, dj, n: idx.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("idx").alias(n))
    def triangles(d: int) -> DataFrame:
        return idx.withColumnRenamed("idx", "a").join(at(d, 0, "b"), ["i", "j"]).join(at(0, d, "c"), ["i", "j"]).select("a", "b", "c")
    return triangles(1).unionByName(triangles(-1))


def rectify_dtm(dtm: DataFrame, geotransform: list[float]) -> DataFrame:
    """Re-grid valid cells onto the plane spanned by three raster corners: i, j, z (mean local height), n_obs.

    Axes come from the corners (first column down, first row along) in ECEF at height 0; one output cell is the mean
    step of its axis.
    """
    a, b, c, d, e, f = geotransform
    def corner(i: Column, j: Column) -> vec.Vec:
        return geo.geodetic_to_ecef(j * d + i * e + f, j * a + i * b + c, F.lit(0.0))
    size = dtm.agg((F.max("i")).cast("double").alias("h"), F.max("j").cast("double").alias("w"))
    zero = F.lit(0.0)
    fr = vec.keep(size, o=corner(zero, zero), x=corner(F.col("h"), zero), y=corner(zero, F.col("w")))
    fr = vec.keep(fr, x=vec.sub(vec.ref("x"), vec.ref("o")), y=vec.sub(vec.ref("y"), vec.ref("o")))
    fr = fr.withColumns({"px": vec.norm(vec.ref("x")) / F.col("h"), "py": vec.norm(vec.ref("y")) / F.col("w")})
    fr = vec.keep(fr, x=vec.scale(vec.ref("x"), 1 / vec.norm(vec.ref("x"))))
    fr = vec.keep(fr, z=vec.cross(vec.ref("x"), vec.ref("y")))
    fr = vec.keep(fr, z=vec.scale(vec.ref("z"), 1 / vec.norm(vec.ref("z"))))
    fr = vec.keep(fr, y=vec.cross(vec.ref("z"), vec.ref("x")))
    frame = fr.select(F.struct("px", "py", *[f"{n}_{k}" for n in "oxyz" for k in range(3)])).scalar()
    cells = dtm.where(spectral.valid_height(F.col("z"))).select("i", "j", F.col("z").alias("h")).withColumn("_f", frame)
    cells = vec.keep(cells, g=geo.geodetic_to_ecef(
        F.col("j") * d + F.col("i") * e + f, F.col("j") * a + F.col("i") * b + c, F.col("h")))
    get = lambda n: [F.col(f"_f.{n}_{k}") for k in range(3)]
    cells = vec.keep(cells, g=vec.sub(vec.ref("g"), get("o")))
    at = cells.select(
        F.round(vec.dot(vec.ref("g"), get("x")) / F.col("_f.px")).cast("bigint").alias("i"),
        F.round(vec.dot(vec.ref("g"), get("y")) / F.col("_f.py")).cast("bigint").alias("j"),
        vec.dot(vec.ref("g"), get("z")).alias("z"),
    )
    return at.groupBy("i", "j").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n_obs"))
