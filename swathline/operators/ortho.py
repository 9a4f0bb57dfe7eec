"""Ortho-mosaic: regions, tile grids, the weighted splat of pixels into tiles, previews and hole filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions import geo, spectral, vec
from swathline.operators.projection import band_count, weighted_means


def file_roi(proj: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box of the projected pixels of a file."""
    hit = proj.where(spectral.valid_height(F.col("pi")) & spectral.valid_height(F.col("pj")))
    return hit.groupBy(*keys).agg(
        F.min("pi").alias("min_i"), F.max("pi").alias("max_i"), F.min("pj").alias("min_j"), F.max("pj").alias("max_j")
    )


def fixed_split(size: Column, tile: int) -> tuple[Column, Column]:
    """Number of tiles and pixels per tile on one side of ``size`` pixels; the last tile takes the rest."""
    splits = F.ceil(size / tile)
    missing = F.floor(F.try_divide(tile - size % tile, splits - 1))
    shrink = F.when((splits > 1) & (splits * tile != size), missing).otherwise(F.lit(0))
    return splits, tile - shrink


def tile_grid_fixed(dtm: DataFrame, scale: float, tile: int) -> DataFrame:
    """Tiles over the whole scaled raster: tile_i, tile_j, i0, j0, height, width."""
    size = dtm.agg(F.floor((F.max("i") + 1) * scale).alias("h"), F.floor((F.max("j") + 1) * scale).alias("w"))
    (vn, vp), (hn, hp) = fixed_split(F.col("h"), tile), fixed_split(F.col("w"), tile)
    grid = size.select("h", "w", vn.alias("vn"), vp.alias("vp"), hn.alias("hn"), hp.alias("hp"))
    zero = F.lit(0).cast("bigint")
    grid = grid.withColumn("tile_i", F.explode(F.sequence(zero, F.col("vn") - 1)))
    grid = grid.withColumn("tile_j", F.explode(F.sequence(zero, F.col("hn") - 1)))
    i0, j0 = F.col("tile_i") * F.col("vp"), F.col("tile_j") * F.col("hp")
    return grid.select(
        "tile_i", "tile_j", i0.alias("i0"), j0.alias("j0"),
        F.when(F.col("tile_i") == F.col("vn") - 1, F.col("h") - i0).otherwise(F.col("vp")).alias("height"),
        F.when(F.col("tile_j") == F.col("hn") - 1, F.col("w") - j0).otherwise(F.col("hp")).alias("width"),
    )


def tile_grid_fit(rois: DataFrame, scale: float, tile: int) -> DataFrame:
    """Equal tiles over the union of the file regions, only those that meet a region.

    Each region names the tiles it can meet, which are then filtered by the exact test: no range join.
    tile_i, tile_j, i0, j0, i1, j1 (terrain pixels), height, width (tile pixels).
    """
    box = rois.agg(F.struct(
        F.min("min_i").alias("i"), F.min("min_j").alias("j"), (F.max("max_i") - F.min("min_i")).alias("h"),
        (F.max("max_j") - F.min("min_j")).alias("w"))).scalar()
    side = tile / scale
    r = rois.withColumn("_b", box).withColumns({f"_{k}": F.col(f"_b.{k}") for k in "ijhw"}).drop("_b")
    r = r.withColumns({"_ni": F.ceil(F.col("_h") / side), "_nj": F.ceil(F.col("_w") / side)})
    r = r.withColumns({"_di": F.col("_h") / F.col("_ni"), "_dj": F.col("_w") / F.col("_nj")})
    def met(axis: str) -> Column:
        low = F.floor(F.try_divide(F.col(f"min_{axis}") - F.col(f"_{axis}"), F.col(f"_d{axis}"))) - 1
        high = F.floor(F.try_divide(F.col(f"max_{axis}") - F.col(f"_{axis}"), F.col(f"_d{axis}"))) + 1
        start, step = F.col(f"_{axis}"), F.col(f"_d{axis}")
        return F.filter(
            F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col(f"_n{axis}") - 1)),
            lambda k: (F.col(f"max_{axis}") > start + k * step) & (F.col(f"min_{axis}") < start + (k + 1) * step),
        )
    tiles = r.withColumn("tile_i", F.explode(met("i"))).withColumn("tile_j", F.explode(met("j")))
    tiles = tiles.select(
        "tile_i", "tile_j",
        (F.col("_i") + F.col("tile_i") * F.col("_di")).alias("i0"), (F.col("_j") + F.col("tile_j") * F.col("_dj")).alias("j0"),
        F.col("_di"), F.col("_dj"),
    ).distinct()
    return tiles.select(
        "tile_i", "tile_j", "i0", "j0", (F.col("i0") + F.col("_di")).alias("i1"), (F.col("j0") + F.col("_dj")).alias("j1"),
        F.ceil(F.col("_di") * scale).alias("height"), F.ceil(F.col("_dj") * scale).alias("width"),
    )


def map_scale(dtm: DataFrame, geotransform: list[float], target_gsd: float) -> DataFrame:
    """Terrain pixel size (mean step of the first column and first row, in ECEF) over the wanted ground distance."""
    a, b, c, d, e, f = geotransform
    def corner(i: Column, j: Column) -> vec.Vec:
        return geo.geodetic_to_ecef(j * d + i * e + f, j * a + i * b + c, F.lit(0.0))
    size = dtm.agg(F.max("i").cast("double").alias("h"), F.max("j").cast("double").alias("w"))
    zero = F.lit(0.0)
    o = corner(zero, zero)
    down = vec.norm(vec.sub(corner(F.col("h"), zero), o)) / F.col("h")
    along = vec.norm(vec.sub(corner(zero, F.col("w")), o)) / F.col("w")
    out = size.select(down.alias("gsd_i"), along.alias("gsd_j"))
    return out.withColumn("scale", F.greatest("gsd_i", "gsd_j") / target_gsd)


def tile_affine(tiles: DataFrame, geotransform: list[float], scale: float) -> DataFrame:
    """Pixel-to-map transform of each tile as world-file values: a (x per column), d (y per column), b, e, x0, y0."""
    a, b, c, d, e, f = geotransform
    i0, j0 = F.col("i0"), F.col("j0")
    return tiles.select(
        "tile_i", "tile_j", F.lit(a / scale).alias("x_per_col"), F.lit(d / scale).alias("y_per_col"),
        F.lit(b / scale).alias("x_per_row"), F.lit(e / scale).alias("y_per_row"),
        (j0 * a + i0 * b + c).alias("x0"), (j0 * d + i0 * e + f).alias("y0"),
    )


def _axis_cells(p: Column, size: Column, tile: int) -> Column:
    """Array of (tile, cell in tile, weight) of a coordinate: floor and ceil share the weight inside a tile, a cell
    whose partner lies in another tile or off the raster takes all of it."""
    splits, per_tile = fixed_split(size, tile)
    lo, hi = F.floor(p), F.ceil(p)
    w = hi - p
    tile_of = lambda c: F.least(F.floor(c / per_tile), splits - 1)
    cell = lambda c, weight: F.struct(
        tile_of(c).alias("t"), (c - tile_of(c) * per_tile).alias("c"), weight.alias("w"), c.alias("g"))
    same = (tile_of(lo) == tile_of(hi)) & (lo >= 0) & (hi < size)
    one = F.lit(1.0)
    pair = F.when(same, F.array(cell(lo, w), cell(hi, 1 - w))).otherwise(F.array(cell(lo, one), cell(hi, one)))
    return F.filter(pair, lambda x: (x["g"] >= 0) & (x["g"] < size) & (x["w"] > 0))


def splat(
    px: DataFrame, array: str, scale: float, tile: int, height: int | Column, width: int | Column,
    n_bands: int | None = None,
) -> DataFrame:
    """Spread projected pixels over the cells of a tiled grid: tile_i, tile_j, i, j (in tile), w, ``array`` (means).

    Each pixel names its (at most four) cells, then one partial-plus-final aggregation sums weights and bands per cell:
    neighbouring pixels of a task meet in the partial step, so a busy tile costs no more than its cells. ``px`` has
    pi, pj in terrain pixels.
    """
    h = height if isinstance(height, Column) else F.lit(height)
    w = width if isinstance(width, Column) else F.lit(width)
    base = px.where(F.col("pi").isNotNull() & F.col("pj").isNotNull()).select(
        array, (F.col("pi") * scale).alias("_pi"), (F.col("pj") * scale).alias("_pj"), h.alias("_h"), w.alias("_w0")
    )
    cells = base.withColumn("_i", F.explode(_axis_cells(F.col("_pi"), F.col("_h"), tile)))
    cells = cells.withColumn("_j", F.explode(_axis_cells(F.col("_pj"), F.col("_w0"), tile)))
    cells = cells.select(
        F.col("_i.t").alias("tile_i"), F.col("_j.t").alias("tile_j"), F.col("_i.c").alias("i"), F.col("_j.c").alias("j"),
        (F.col("_i.w") * F.col("_j.w")).alias("_weight"), array,
    )
    return weighted_means(cells, ["tile_i", "tile_j", "i", "j"], array, F.col("_weight"), band_count(px, array) if n_bands is None else n_bands)


def ortho_rgb(ortho: DataFrame, array: str, bands: tuple[int, int, int] = (43, 27, 12)) -> DataFrame:
    """Three bands of a mosaic; a band number past the end falls back to the first, middle and last band."""
    n = F.size(array)
    spare = [F.lit(0), F.floor(n / 2).cast("int"), n - 1]
    picked = [F.when(n > b, F.get(array, F.lit(b))).otherwise(F.get(array, s)) for b, s in zip(bands, spare)]
    return ortho.select("tile_i", "tile_j", "i", "j", *[c.alias(k) for c, k in zip(picked, "rgb")])


def _along(keys: list[str], axis: str) -> Window:
    return Window.partitionBy(*[k for k in keys if k != axis]).orderBy(axis)


def _widened(cells: DataFrame, keys: list[str], axis: str, by: int, size: Column) -> DataFrame:
    """Cells within ``by`` of a cell along ``axis``, each once: a cell goes as far as its following neighbour lets it."""
    here, w = F.col(axis), _along(keys, axis)
    low = F.least(here, F.greatest(here - by, F.coalesce(F.lag(axis).over(w) + by + 1, here - by), F.lit(0)))
    high = F.least(here + by, F.coalesce(F.lead(axis).over(w) - 1, here + by), size - 1)
    return cells.select(*keys, low.alias("_low"), high.alias("_high")).withColumn(axis, F.explode(F.sequence("_low", "_high"))).select(*keys)


def _narrowed(cells: DataFrame, keys: list[str], axis: str, by: int, size: Column) -> DataFrame:
    """Cells whose neighbours up to ``by`` along ``axis`` (clipped to the tile) are all present: the run of cells reaches that far."""
    here, w = F.col(axis), _along(keys, axis)
    before, after = F.lag(axis).over(w), F.lead(axis).over(w)
    ends = cells.select(*keys, F.when(before.isNull() | (before < here - 1), here).alias("_a"), F.when(after.isNull() | (after > here + 1), here).alias("_b"))
    runs = ends.select(
        *keys, F.last("_a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
        F.first("_b", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_b"))
    return runs.where((F.col("_a") <= F.greatest(here - by, F.lit(0))) & (F.col("_b") >= F.least(here + by, size - 1))).select(*keys)


def _nearest_cells(full: DataFrame, keys: list[str], radius: int, height: Column, width: Column) -> DataFrame:
    """Empty cells within ``radius`` rows and columns of a sample, and its row and column: keys, si, sj.

    One axis after the other. In a row each empty cell takes the nearer of the samples at both sides, once. In a column
    the results of the rows travel to the empty cells up to the next sample, which is nearer to all cells behind it.
    """
    j, row, column = F.col("j"), _along(keys, "j"), _along(keys, "i")
    before, after = F.lag("j").over(row), F.lead("j").over(row)
    low = F.greatest(j - radius, F.coalesce(F.floor((before + j) / 2) + 1, j - radius), F.lit(0))
    high = F.least(j + radius, F.coalesce(F.floor((j + after) / 2), j + radius), width - 1)
    rows = full.select(*keys, j.alias("sj"), low.alias("_low"), high.alias("_high"))
    rows = rows.withColumn("j", F.explode(F.sequence("_low", "_high"))).select(*keys, "sj")
    sample = F.when(F.col("sj") == j, F.col("i"))
    up = F.last(sample, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, -1))
    down = F.first(sample, ignorenulls=True).over(column.rowsBetween(1, Window.unboundedFollowing))
    sent = rows.select(
        *keys, "sj", F.greatest(F.col("i") - radius, F.coalesce(up + 1, F.lit(0)), F.lit(0)).alias("_low"),
        F.least(F.col("i") + radius, F.coalesce(down - 1, height - 1), height - 1).alias("_high"))
    sent = sent.withColumn("si", F.col("i")).withColumn("i", F.explode(F.sequence("_low", "_high")))
    sent = sent.where((F.col("i") != F.col("si")) | (j != F.col("sj")))
    di, dj = F.col("i") - F.col("si"), j - F.col("sj")
    best = sent.groupBy(*keys).agg(F.min(F.struct((di * di + dj * dj).alias("d"), "si", "sj")).alias("_s"))
    return best.select(*keys, "_s.si", "_s.sj")


def inpaint_nearest(ortho: DataFrame, array: str, radius: int, height: int | Column, width: int | Column) -> DataFrame:
    """Fill empty cells that have a sample within ``radius`` rows and columns with the nearest sample of their tile.

    Ties go to the lower row, then column. Filled cells outside the closed footprint (footprint widened by 2r, then
    narrowed by 2r+1; off the tile nothing is narrowed) are left out. ``height`` and ``width`` are those of a tile and may
    be columns of tile_i and tile_j. Work is done on cell keys alone, along rows and columns of a tile: a sample goes to the empty
    cells next to it, so full areas cost a row per cell whatever the radius. Spectra are fetched at the end for the filled cells.
    """
    keys = ["tile_i", "tile_j", "i", "j"]
    high, wide = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    full = ortho.select(*keys).distinct()
    holes = _nearest_cells(full, keys, radius, high, wide)
    closed = _widened(_widened(full, keys, "i", 2 * radius, high), keys, "j", 2 * radius, wide)
    closed = _narrowed(_narrowed(closed, keys, "j", 2 * radius + 1, wide), keys, "i", 2 * radius + 1, high)
    filled = holes.join(closed, keys, "left_semi")
    source = ortho.select("tile_i", "tile_j", F.col("i").alias("si"), F.col("j").alias("sj"), array)
    painted = filled.join(source, ["tile_i", "tile_j", "si", "sj"]).select(*keys, array, F.lit(True).alias("painted"))
    return ortho.select(*keys, array, F.lit(False).alias("painted")).unionByName(painted)
