"""From pixels to rays, to a plane and to the terrain."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec
from swathline.functions.vec import Vec
from swathline.plans.lines import spread
from swathline.session import cut_lineage

POSE = [f"{n}_{k}" for n in "rp" for k in range(3)]


def fov_focal(n_samples: int, fov_deg: float, centred: bool = True) -> tuple[float, float]:
    """Focal length in pixels and the middle sample: over S-1 intervals, or over S pixels when not ``centred``."""
    half = math.radians(fov_deg) / 2
    width = n_samples - 1 if centred else n_samples
    return width / (2 * math.tan(half)), width / 2


def fov_direction(sample: Column, n_samples: int, fov_deg: float, flipped: bool = False) -> Vec:
    """(0, i-mid, f), or the normalised (0, mid-i, f) when ``flipped``."""
    f, mid = fov_focal(n_samples, fov_deg)
    d = [F.lit(0.0), (mid - sample) if flipped else (sample - mid), F.lit(f)]
    return vec.scale(d, 1 / vec.norm(d)) if flipped else d


def distortion(u: Column, width: float, coeffs: list[float]) -> Column:
    s = u / width
    terms = [F.lit(float(c)) * s ** k if k else F.lit(float(c)) for k, c in enumerate(coeffs)]
    return sum(terms[1:], terms[0])


def pinhole_direction(u: Column, width: float, focal: float, pp: float, a: list[float], b: list[float]) -> Vec:
    """Ray of a line camera with two distortion polynomials in u/width, z component 1."""
    return [distortion(u, width, b) / focal, (u + distortion(u, width, a) - pp) / focal, F.lit(1.0)]


def rays(lines: DataFrame, n_samples: int, direction, keep: list[str]) -> DataFrame:
    """One ray per line and sample: ``keep``, sample, o_0..2 (origin), d_0..2. Samples are generated per line row,
    so lines and samples meet without a join. ``direction`` maps the sample column to a vector."""
    rotated = vec.with_rodrigues(spread(lines.select(*keep, *POSE), *keep), "m", vec.ref("r"))
    wide = rotated.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_samples - 1).cast("bigint"))))
    d = vec.matvec(vec.ref("m", 9), direction(F.col("sample")))
    wide = vec.keep(wide, o=vec.ref("p"), d=d)
    return wide.select(*keep, "sample", *[f"{n}_{k}" for n in "od" for k in range(3)])


def project_to_plane(
    lines: DataFrame, reference: DataFrame, key: str, n_samples: int, fov_deg: float, ground: float,
) -> DataFrame:
    """Pixels of every line on the plane z = ``ground`` of the reference line's frame, in ground pixels (x, y).

    ``lines`` has key, line and a pose; ``reference`` one pose per key. Camera rays are (i-S/2, 0, f).
    """
    f, mid = fov_focal(n_samples, fov_deg, centred=False)
    gsd = ground / f
    ref = reference.select(key, *[F.col(c).alias(f"ref_{c}") for c in POSE])
    pairs = lines.select(key, "line", *POSE).join(ref, key)
    pairs = vec.with_rodrigues(vec.with_rodrigues(pairs, "m", vec.ref("r")), "n", vec.ref("ref_r"))
    back = vec.transpose(vec.ref("n", 9))
    pairs = vec.keep(pairs, c=vec.matmul(back, vec.ref("m", 9)), t=vec.matvec(back, vec.sub(vec.ref("p"), vec.ref("ref_p"))))
    pairs = pairs.select(key, "line", *[f"c_{k}" for k in range(9)], *[f"t_{k}" for k in range(3)])
    pairs = spread(pairs, key, "line")
    wide = pairs.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_samples - 1).cast("bigint"))))
    d = vec.matvec(vec.ref("c", 9), [F.col("sample") - mid, F.lit(0.0), F.lit(f)])
    wide = vec.keep(wide, d=d)
    s = F.try_divide(ground - F.col("t_2"), F.col("d_2"))
    return wide.select(
        key, "line", "sample", *[((F.col(f"t_{k}") + s * F.col(f"d_{k}")) / gsd).alias(n) for k, n in enumerate("xy")]
    )


def project_point_to_line(points: DataFrame, focal: float, pp: float) -> DataFrame:
    """Camera-frame points x, y, z to (u, vertical error)."""
    return points.withColumns({
        "u": F.try_divide(F.col("x"), F.col("z")) * focal + pp, "v_error": F.try_divide(F.col("y"), F.col("z")),
    })


def patch_band(
    px: DataFrame, array: str, lines: DataFrame, reference: DataFrame, key: str, n_samples: int, fov_deg: float,
    ground: float, max_delta: int, radius: int, n_bands: int | None = None,
) -> DataFrame:
    """Rectified patch around one reference line per key: key, y, x, w, patch (band means), weights above 0 only.

    Lines within ``max_delta`` of the reference are projected to the plane and spread over four cells.
    """
    near = lines.join(reference.select(key, F.col("line").alias("_ref")), key)
    near = near.where(F.abs(F.col("line") - F.col("_ref")) <= max_delta).drop("_ref")
    plane = project_to_plane(near, reference, key, n_samples, fov_deg, ground)
    x, y = F.col("x") + n_samples / 2, F.col("y")
    def taps(c: Column) -> Column:
        """Cells floor and ceil with bilinear weights; an integer position (to 1e-9) is one cell of weight 1."""
        c = F.round(c, 9)
        lo = F.floor(c)
        first = F.struct(lo.alias("c"), (1 - (c - lo)).alias("w"))
        second = F.struct((lo + 1).alias("c"), (c - lo).alias("w"))
        return F.when(lo == c, F.array(first)).otherwise(F.array(first, second))
    cells = plane.where("x is not null").select(
        key, "line", "sample", F.explode(taps(x)).alias("_x"), y.alias("_yc")
    ).select(key, "line", "sample", "_x", F.explode(taps(F.col("_yc"))).alias("_y"))
    cells = cells.where(
        (F.col("_x.c") >= 0) & (F.col("_x.c") < n_samples) & (F.abs(F.col("_y.c")) <= radius)
    ).select(key, "line", "sample", F.col("_x.c").alias("x"), (F.col("_y.c") + radius).alias("y"), (F.col("_x.w") * F.col("_y.w")).alias("w"))
    joined = cells.join(px.select(key, "line", "sample", array), [key, "line", "sample"])
    return weighted_means(joined, [key, "y", "x"], array, F.col("w"), band_count(px, array) if n_bands is None else n_bands)


BANDS_PER_AGGREGATE = 64


def band_count(px: DataFrame, array: str) -> int:
    """Length of all arrays of a pixel table (0 for an empty one); a scan of this table alone. Unequal lengths are an error."""
    sizes = px.where(F.col(array).isNotNull()).agg(F.min(F.size(array)).alias("least"), F.max(F.size(array)).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"spectra have {sizes['least']} to {sizes['most']} bands")
    return sizes["most"] or 0


def weighted_means(cells: DataFrame, keys: list[str], array: str, w: Column, n_bands: int) -> DataFrame:
    """Weighted mean spectrum per key: keys, w, ``array``; cells whose weight is 0 are left out.

    One sum per band in a partial-plus-final hash aggregate, at most 64 bands at a time so that generated code stays
    compilable; the parts share their hash partitioning and are joined without another shuffle. A spectrum with another
    number of bands ends the job.
    """
    wrong = F.raise_error(F.concat(F.lit(f"a spectrum doesn't have {n_bands} bands but "), F.size(array).cast("string"))).cast("double")
    weighted = cells.withColumn("_w", F.when(F.size(array) == n_bands, w).when(F.col(array).isNotNull(), wrong))
    parts = []
    for start in range(0, n_bands, BANDS_PER_AGGREGATE):
        bands = range(start, min(start + BANDS_PER_AGGREGATE, n_bands))
        sums = [F.sum(F.col("_w") * F.col(array)[b]).alias(f"s{b}") for b in bands]
        total = F.sum("_w").alias("w" if start == 0 else f"w{start}")
        parts.append(weighted.groupBy(*keys).agg(total, *sums))
    if not parts:
        return weighted.groupBy(*keys).agg(F.sum("_w").alias("w"), F.first(array).alias(array))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys)
    means = F.array(*[F.col(f"s{b}") / F.col("w") for b in range(n_bands)])
    return out.where("w > 0").select(*keys, "w", means.alias(array))


# ---- terrain ---------------------------------------------------------------------------------------------------

TILE = 64


def terrain_tiles(dtm: DataFrame, tile: int = TILE) -> DataFrame:
    """Height cells assigned to every tile that needs them: a tile holds its cells plus one row and column more."""
    i, j = F.col("i"), F.col("j")
    home_i, home_j = F.floor(i / tile), F.floor(j / tile)
    own = F.struct(home_i.alias("ti"), home_j.alias("tj"))
    up = F.when((i % tile == 0) & (i > 0), F.struct((home_i - 1).alias("ti"), home_j.alias("tj")))
    left = F.when((j % tile == 0) & (j > 0), F.struct(home_i.alias("ti"), (home_j - 1).alias("tj")))
    both = F.when((i % tile == 0) & (i > 0) & (j % tile == 0) & (j > 0), F.struct((home_i - 1).alias("ti"), (home_j - 1).alias("tj")))
    spread = dtm.select("i", "j", "z", F.explode(F.array_compact(F.array(own, up, left, both))).alias("_t"))
    return spread.select("_t.ti", "_t.tj", "i", "j", "z")


def _first_hits(heights, i0: int, j0: int, o, d, s0, s1):
    """First crossing of rays with the bilinear surface of one tile: parameter s per ray, NaN for none.

    Walks all rays of the batch cell by cell; inside a cell height minus surface is a quadratic in s, solved exactly.
    """
    import numpy as np

    ni, nj = heights.shape[0] - 1, heights.shape[1] - 1
    hit = np.full(len(o), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        lo, hi = s0.copy(), s1.copy()
        for axis, size in ((0, ni), (1, nj)):
            start = o[:, axis] - (i0, j0)[axis]
            a, b = (0 - start) / d[:, axis], (size - start) / d[:, axis]
            flat = d[:, axis] == 0
            inside = (start >= 0) & (start <= size)
            lo = np.where(flat, np.where(inside, lo, np.inf), np.maximum(lo, np.minimum(a, b)))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(a, b)))
        live = np.flatnonzero(lo <= hi)
        s = lo[live]
        for _ in range(2 * (ni + nj) + 4):
            if len(live) == 0:
                break
            x = o[live, 0] - i0 + s * d[live, 0]
            y = o[live, 1] - j0 + s * d[live, 1]
            # on a cell border the direction decides which cell comes next
            ci = np.where(d[live, 0] < 0, np.ceil(x - 1e-9) - 1, np.floor(x + 1e-9))
            cj = np.where(d[live, 1] < 0, np.ceil(y - 1e-9) - 1, np.floor(y + 1e-9))
            ci, cj = np.clip(ci, 0, ni - 1).astype(int), np.clip(cj, 0, nj - 1).astype(int)
            edge_i = np.where(d[live, 0] > 0, ci + 1, ci) - (o[live, 0] - i0)
            edge_j = np.where(d[live, 1] > 0, cj + 1, cj) - (o[live, 1] - j0)
            exit_s = np.minimum(
                np.where(d[live, 0] == 0, np.inf, edge_i / d[live, 0]), np.where(d[live, 1] == 0, np.inf, edge_j / d[live, 1])
            )
            exit_s = np.minimum(np.maximum(exit_s, s), hi[live])
            h00, h10 = heights[ci, cj], heights[ci + 1, cj]
            h01, h11 = heights[ci, cj + 1], heights[ci + 1, cj + 1]
            u0, v0 = o[live, 0] - i0 - ci, o[live, 1] - j0 - cj
            du, dv = d[live, 0], d[live, 1]
            hu, hv, huv = h10 - h00, h01 - h00, h11 - h10 - h01 + h00
            c2 = -huv * du * dv
            c1 = d[live, 2] - hu * du - hv * dv - huv * (u0 * dv + v0 * du)
            c0 = o[live, 2] - h00 - hu * u0 - hv * v0 - huv * u0 * v0
            root = _first_root(c2, c1, c0, s, exit_s)
            found = ~np.isnan(root)
            hit[live[found]] = root[found]
            on = ~found & (exit_s < hi[live] - 1e-12)
            s = np.maximum(exit_s[on], s[on] + 1e-12)
            live = live[on]
    return hit


def _first_root(c2, c1, c0, lo, hi):
    """Smallest root of c2 s^2 + c1 s + c0 in [lo, hi], NaN for none (also for NaN heights)."""
    import numpy as np

    tol = 1e-9 * np.maximum(1.0, np.abs(hi))
    linear = -c0 / c1
    disc = np.sqrt(c1 * c1 - 4 * c2 * c0)
    q = -0.5 * (c1 + np.where(c1 >= 0, disc, -disc))
    roots = np.stack([np.where(c2 == 0, linear, q / c2), np.where(c2 == 0, linear, c0 / q)])
    ok = (roots >= lo - tol) & (roots <= hi + tol)
    best = np.where(ok, roots, np.inf).min(axis=0)
    return np.where(np.isfinite(best), best, np.nan)


def _surface(heights, x, y):
    """Bilinear heights at rows x and columns y of a tile; positions on its rim count to the cells inside."""
    import numpy as np

    i = np.clip(np.floor(x).astype(int), 0, heights.shape[0] - 2)
    j = np.clip(np.floor(y).astype(int), 0, heights.shape[1] - 2)
    a, b = x - i, y - j
    near = (1 - b) * heights[i, j] + b * heights[i, j + 1]
    return (1 - a) * near + a * ((1 - b) * heights[i + 1, j] + b * heights[i + 1, j + 1])


FAN = 8


def height_pyramid(dtm: DataFrame, tile: int, levels: int, fan: int = FAN) -> DataFrame:
    """Lowest and highest terrain of each tile, of each square of ``fan`` x ``fan`` tiles, and so on: level, ti, tj, lo, hi."""
    own = terrain_tiles(dtm, tile).where("z is not null").groupBy("ti", "tj").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    base = cut_lineage(own)
    out = base.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        square = [F.floor(F.col(c) / fan**level).alias(c) for c in ("ti", "tj")]
        up = base.groupBy(*square).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = out.unionByName(up.withColumn("level", F.lit(level)))
    return cut_lineage(out.select("level", "ti", "tj", "lo", "hi"))


def _squares(size: float, rows: tuple[Column, Column], cols: tuple[Column, Column]) -> Column:
    """Squares of ``size`` that the ray's ground track meets between parameters ``_a`` and ``_b``: ti, tj, a, b.

    Row after row: the part of the track in a row of squares gives the columns met there, so their number grows with the
    track's length. Only squares within ``rows`` and ``cols`` (both ends included) count.
    """
    tiny = 1e-6

    def at(axis: int, s: Column) -> Column:
        return F.col(f"o_{axis}") + s * F.col(f"d_{axis}")

    def range_of(axis: int, a: Column, b: Column, limits: tuple[Column, Column]) -> Column:
        lo = F.floor((F.least(at(axis, a), at(axis, b)) - tiny) / size)
        hi = F.floor((F.greatest(at(axis, a), at(axis, b)) + tiny) / size)
        lo, hi = F.greatest(lo, limits[0]), F.least(hi, limits[1])
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def in_row(r: Column) -> tuple[Column, Column]:
        near, far = (F.try_divide(r * size - tiny - F.col("o_0"), F.col("d_0")), F.try_divide((r + 1) * size + tiny - F.col("o_0"), F.col("d_0")))
        return F.greatest(F.col("_a"), F.least(near, far)), F.least(F.col("_b"), F.greatest(near, far))  # NULL ends count for nothing

    def row(r: Column) -> Column:
        a, b = in_row(r)
        return F.transform(range_of(1, a, b, cols), lambda q: F.struct(r.alias("ti"), q.alias("tj"), a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(range_of(0, F.col("_a"), F.col("_b"), rows), row))


def tiles_crossed(ray_table: DataFrame, dtm: DataFrame, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """Rays with the tiles in which they can meet the terrain: all columns, plus ti, tj and the ray's parameters _s0 to _s1.

    A pyramid of lowest and highest heights is descended from one square over the whole raster: the part of a ray inside a
    square and between its heights goes on to those squares of the next level that it crosses. So a ray over flat land
    skips what it can't touch in large steps, and the rows per ray grow with its length inside the terrain's heights.
    """
    size = dtm.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    if size["hi"] is None:
        none = ray_table.where("false")
        return none.withColumns({"ti": F.lit(0).cast("bigint"), "tj": F.lit(0).cast("bigint"), "_s0": F.lit(0.0), "_s1": F.lit(0.0)})
    reach = max(int(size["i"]), int(size["j"])) // tile + 1
    levels = 0
    while fan**levels < reach:
        levels += 1
    tops = height_pyramid(dtm, tile, levels, fan)
    hi, lo = F.lit(float(size["hi"]) + 1e-6), F.lit(float(size["lo"]) - 1e-6)
    # parameters between which the ray is between the highest and the lowest terrain
    s_top, s_low = F.try_divide(hi - F.col("o_2"), F.col("d_2")), F.try_divide(lo - F.col("o_2"), F.col("d_2"))
    # a level or rising ray can hit a slope until it leaves the top or the raster
    below = F.when(F.col("o_2") <= hi, F.greatest(F.lit(0.0), F.when(F.col("d_2") > 0, s_low).otherwise(0.0)))
    leaves = [
        F.greatest(F.try_divide(-F.col(f"o_{k}"), F.col(f"d_{k}")), F.try_divide(F.lit(float(last)) - F.col(f"o_{k}"), F.col(f"d_{k}")))
        for k, last in ((0, size["i"]), (1, size["j"]))
    ]
    until = F.least(s_top, *leaves)  # what is parallel to a border is NULL and left out; all NULL: the ray stands still
    falls = F.col("d_2") < 0
    ray = ray_table.withColumns({
        "_s0": F.when(falls, F.greatest(F.lit(0.0), s_top)).otherwise(below), "_s1": F.when(falls, s_low).otherwise(until + 1e-9),
    }).where(F.col("_s1") >= F.col("_s0"))
    zero = F.lit(0).cast("bigint")
    at = ray.withColumns({"ti": zero, "tj": zero, "_a": F.col("_s0"), "_b": F.col("_s1")})
    for level in range(levels, -1, -1):
        known = tops.where(F.col("level") == level).select(F.col("ti").alias("_ti"), F.col("tj").alias("_tj"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        met = at.join(known, (F.col("ti") == F.col("_ti")) & (F.col("tj") == F.col("_tj")))
        up, down = (F.try_divide(F.col("_hi") + 1e-6 - F.col("o_2"), F.col("d_2")), F.try_divide(F.col("_lo") - 1e-6 - F.col("o_2"), F.col("d_2")))
        level_ray = F.col("d_2") == 0
        inside = F.col("o_2").between(F.col("_lo") - 1e-6, F.col("_hi") + 1e-6)
        met = met.withColumns({
            "_a": F.when(level_ray, F.col("_a")).otherwise(F.greatest(F.col("_a"), F.least(up, down) - 1e-9)),
            "_b": F.when(level_ray, F.col("_b")).otherwise(F.least(F.col("_b"), F.greatest(up, down) + 1e-9)),
        }).where((F.col("_a") <= F.col("_b")) & (~level_ray | inside))
        if level:
            first = [F.col(c) * fan for c in ("ti", "tj")]
            next_ = _squares(float(tile * fan ** (level - 1)), (first[0], first[0] + fan - 1), (first[1], first[1] + fan - 1))
            met = met.withColumn("_q", F.explode(next_))
            met = met.withColumns({"ti": F.col("_q.ti"), "tj": F.col("_q.tj"), "_a": F.col("_q.a"), "_b": F.col("_q.b")})
        at = met.select(*ray_table.columns, "ti", "tj", "_s0", "_s1", "_a", "_b")
    return at.drop("_a", "_b")


RAYS = 1 << 14


def project_to_terrain(
    ray_table: DataFrame, dtm: DataFrame, keys: list[str], line: str = "line", tile: int = TILE, block: int = 256,
) -> DataFrame:
    """First hit of each ray with the terrain: all rays, plus pi, pj, z (NULL without a hit).

    Rays and terrain are in terrain coordinates (x = row, y = column, z). The rays are spread over all tasks, and each is sent to
    the tiles of ``tiles_crossed``. The blocks of lines over a tile are dealt to groups of about ``RAYS`` rays, so a tile below
    many rays is worked on by many tasks, and a group's fixed costs and copy of the tile are shared by many rays. The nearest
    hit over all tiles of a ray wins. ``keys`` identify a ray. A cell with a corner that has no valid height has no surface.
    A level or rising ray from below the surface sees nothing.
    """
    solid = dtm.withColumn("z", F.when(spectral.valid_height(F.col("z")), F.col("z")))
    spread_rays = spread(ray_table.select(*keys, *([] if line in keys else [line]), *[f"{n}_{k}" for n in "od" for k in range(3)]), *keys)
    parts = cut_lineage(tiles_crossed(spread_rays, solid, tile))
    group = ["ti", "tj", "_b"]
    per_tile = parts.groupBy("ti", "tj").agg(F.ceil(F.count(F.lit(1)) / RAYS).alias("_n"))
    dealt = per_tile.select(F.col("ti").alias("gi"), F.col("tj").alias("gj"), "_n")
    parts = parts.join(dealt, (F.col("ti") == F.col("gi")) & (F.col("tj") == F.col("gj")))
    parts = parts.withColumn("_b", F.pmod(F.xxhash64(F.floor(F.col(line) / block)), F.col("_n"))).select(
        *group, *keys, *[f"{n}_{k}" for n in "od" for k in range(3)], "_s0", "_s1"
    )
    zero = F.lit(0).cast("bigint")
    needed = dealt.select("gi", "gj", F.explode(F.sequence(zero, F.col("_n") - 1)).alias("gb"))
    ground = terrain_tiles(solid, tile).join(needed, (F.col("ti") == F.col("gi")) & (F.col("tj") == F.col("gj")))
    ground = ground.select("gi", "gj", "gb", "i", "j", "z")
    names = [*keys, "s", "pi", "pj", "z"]

    def solve(key: tuple, r, g) -> Iterator:
        import numpy as np
        import pandas as pd

        empty = pd.DataFrame(columns=names)
        if len(r) == 0 or len(g) == 0:
            return empty
        i0, j0 = int(key[0]) * tile, int(key[1]) * tile
        heights = np.full((tile + 1, tile + 1), np.nan)
        heights[g["i"].to_numpy() - i0, g["j"].to_numpy() - j0] = g["z"].to_numpy(dtype=float)
        o, d = r[["o_0", "o_1", "o_2"]].to_numpy(), r[["d_0", "d_1", "d_2"]].to_numpy()
        s = _first_hits(heights, i0, j0, o, d, r["_s0"].to_numpy(), r["_s1"].to_numpy())
        out = r[keys].assign(s=s, pi=o[:, 0] + s * d[:, 0], pj=o[:, 1] + s * d[:, 1], z=o[:, 2] + s * d[:, 2])
        # a level or rising ray that comes through the ground from below started under it: its first hit is none
        up = np.flatnonzero((d[:, 2] >= 0) & ~np.isnan(s))
        just_before = o[up] + (s[up] - 1e-6)[:, None] * d[up]
        buried = up[just_before[:, 2] < _surface(heights, just_before[:, 0] - i0, just_before[:, 1] - j0)]
        out.iloc[buried, [out.columns.get_loc(c) for c in ("pi", "pj", "z")]] = np.nan
        return out[~np.isnan(s)][names]

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ray_table.select(*keys).schema.fields)
    hits = parts.groupBy(*group).cogroup(ground.groupBy("gi", "gj", "gb")).applyInPandas(
        solve, f"{key_types}, s double, pi double, pj double, z double"
    )
    first = hits.groupBy(*keys).agg(F.min_by(F.struct("pi", "pj", "z"), "s").alias("_h"))
    return ray_table.join(first, keys, "left").select(
        *ray_table.columns, *[F.col(f"_h.{c}").alias(c) for c in ("pi", "pj", "z")]
    )


def line_footprint(hits: DataFrame, keys: list[str], n_samples: int) -> DataFrame:
    """Terrain cells on the segment between the hits of the first and last sample: keys, i, j."""
    ends = hits.where(F.col("sample").isin(0, n_samples - 1) & F.col("pi").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("pi", "pj"), "sample").alias("a"), F.max_by(F.struct("pi", "pj"), "sample").alias("b"),
        F.count(F.lit(1)).alias("n"),
    ).where("n = 2")
    di, dj = F.col("b.pi") - F.col("a.pi"), F.col("b.pj") - F.col("a.pj")
    steps = F.greatest(F.ceil(F.greatest(F.abs(di), F.abs(dj))), F.lit(1))
    walk = ends.select(*keys, "a", di.alias("di"), dj.alias("dj"), steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), steps)).alias("k"))
    share = F.col("k") / F.col("n")
    cell = lambda at, step: F.floor(F.col(at) + share * F.col(step) + 0.5).cast("bigint")
    return walk.select(*keys, cell("a.pi", "di").alias("i"), cell("a.pj", "dj").alias("j")).distinct()


def coverage_mask(dtm: DataFrame, cells: DataFrame) -> DataFrame:
    """Every raster cell with a flag whether some cell list covers it; cells off the raster drop out of the join."""
    seen = cells.select("i", "j").distinct().withColumn("covered", F.lit(True))
    return dtm.select("i", "j").join(seen, ["i", "j"], "left").fillna(False, ["covered"])


def view_angles(lines: DataFrame, n_samples: int, direction, keep: list[str], ground: Column) -> DataFrame:
    """zenith (deg x100), heading (deg x10) and height above ``ground``, rounded, per line and sample.

    ``lines`` has ECEF poses. Geodetic position, down and north are worked out once per line, before samples are made;
    ``ground`` may use the sample column.
    """
    lat, lon, h = geo.ecef_to_geodetic(*vec.ref("p"))
    at = lines.select(*keep, *POSE).withColumns({"_lat": lat, "_lon": lon, "_h": h})
    north = geo.geodetic_to_ecef(F.col("_lat") + 1 / 3600, F.col("_lon"), F.col("_h"))
    at = vec.keep(at, n=vec.sub(north, vec.ref("p")), w=vec.scale(geo.up(F.col("_lat"), F.col("_lon")), -1.0))
    at = vec.keep(at, n=vec.scale(vec.ref("n"), 1 / vec.norm(vec.ref("n"))))
    frame = ["_h", *[f"{c}_{k}" for c in "nw" for k in range(3)]]
    df = rays(at, n_samples, direction, [*keep, *frame])
    df = vec.keep(df, v=vec.scale(vec.ref("d"), 1 / vec.norm(vec.ref("d"))))
    df = df.withColumn("_cos", vec.dot(vec.ref("v"), vec.ref("w")))
    df = vec.keep(df, f=vec.sub(vec.ref("v"), vec.scale(vec.ref("w"), F.col("_cos"))))
    across = vec.dot(vec.cross(vec.ref("f"), vec.ref("n")), vec.scale(vec.ref("w"), -1.0))
    heading = F.atan2(across, vec.dot(vec.ref("f"), vec.ref("n")))
    df = df.withColumn("_heading", heading)
    turned = F.when(F.col("_heading") < 0, F.col("_heading") + 2 * math.pi).otherwise(F.col("_heading"))
    zenith = F.acos(F.least(F.greatest(F.col("_cos"), F.lit(-1.0)), F.lit(1.0)))
    return df.select(
        *keep, "sample", F.round(F.degrees(zenith) * 100).cast("bigint").alias("zenith"),
        F.round(F.degrees(turned) * 10).cast("bigint").alias("heading"),
        F.round(F.col("_h") - ground).cast("bigint").alias("height"),
    )
