"""Dark frames, percentile levels, stretching, band statistics and covariance."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions import spectral


def average_frame(px_long: DataFrame, keep: list[str], value: str, integer: bool = True) -> DataFrame:
    """Mean over the axes not in ``keep``; integer cubes truncate, as a cast back to the pixel type does."""
    if integer:
        mean = F.expr(f"cast(sum({value}) div count({value}) as bigint)")
    else:
        mean = F.avg(value)
    return px_long.groupBy(*keep).agg(mean.alias("mean"))


def subtract_dark(px: DataFrame, dark: DataFrame, array: str = "dns", floor_at_zero: bool = True) -> DataFrame:
    """``array`` minus the dark frame of the sample, saturating at zero. One dark row per sample of the sensor: the frame
    enters as one scalar array, in which a pixel finds its row by the sample's number; so the cube is not shuffled."""
    by_sample = F.map_from_entries(F.collect_list(F.struct("sample", "dark")))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.max("sample"), F.lit(0)).cast("bigint"))
    rows = dark.agg(by_sample.alias("m"), numbers.alias("n")).select(F.transform("n", lambda k: F.try_element_at("m", k.cast(dark.schema["sample"].dataType))))
    left = px.withColumn("_frame", rows.scalar()).withColumn("dark", F.get("_frame", F.col("sample").cast("int"))).drop("_frame")
    def minus(v: Column, d: Column) -> Column:
        d = F.coalesce(d, F.lit(0))
        return v - (F.least(d, v) if floor_at_zero else d)
    return left.withColumn(array, F.zip_with(array, F.coalesce("dark", F.array()), minus)).drop("dark")


def percentile_levels(
    values: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95, bins: int = 4096,
    widen_when_equal: bool = False,
) -> DataFrame:
    """Exact order statistics ``black`` = sorted[int(low*n)] and ``white`` = sorted[int(high*n)] per key.

    No sort of the pixels: a histogram (at most ``bins`` rows per key) finds the bin of each rank, a second one the
    sub-bin, and only the values in there are put in order. ``widen_when_equal`` takes minimum and maximum if both ranks are the same.
    """
    values = values.where(F.col(value).isNotNull()).select(*keys, value)
    stats = values.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    raw = F.when(span > 0, F.floor((F.col(value) - F.col("_lo")) / span * bins)).otherwise(0)
    binned = values.join(stats, keys).withColumn("_bin", F.least(raw, F.lit(bins - 1)).cast("int"))
    # the histogram carries n along, so ranks need no further join
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    lo_rank, hi_rank = F.floor(F.col("_n") * low), F.least(F.floor(F.col("_n") * high), F.col("_n") - 1)
    if widen_when_equal:
        same = lo_rank == hi_rank
        lo_rank, hi_rank = F.when(same, 0).otherwise(lo_rank), F.when(same, F.col("_n") - 1).otherwise(hi_rank)
    wanted = hist.select(*keys, "_bin", "_before", "_c", F.posexplode(F.array(lo_rank, hi_rank)).alias("_which", "_rank"))
    wanted = wanted.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    wanted = wanted.withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_before", "_c")
    bins_hit = wanted.select(*keys, "_bin").distinct()
    inner = binned.withColumn("_sub", F.when(span > 0, F.floor(((F.col(value) - F.col("_lo")) / span * bins % 1) * bins)).otherwise(0))
    inner = inner.withColumn("_sub", F.when(F.col(value) == F.col("_hi"), F.lit(bins)).otherwise(F.col("_sub")))
    counts = inner.join(bins_hit, [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_sub", value).agg(
        F.count(F.lit(1)).alias("_c")
    )
    # values of a bin are ranked per sub-bin; the sums of earlier sub-bins (at most ``bins`` rows) come by join
    subs = counts.groupBy(*keys, "_bin", "_sub").agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy(*keys, "_bin").orderBy("_sub").rowsBetween(Window.unboundedPreceding, 0)
    subs = subs.withColumn("_end", F.sum("_c").over(before)).join(wanted, [*keys, "_bin"])
    subs = subs.where((F.col("_end") > F.col("_rank")) & (F.col("_end") - F.col("_c") <= F.col("_rank"))).select(
        *keys, "_bin", "_sub", "_which", (F.col("_rank") - F.col("_end") + F.col("_c")).alias("_rank")
    )
    ranked = Window.partitionBy(*keys, "_bin", "_sub").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hits = counts.join(subs.select(*keys, "_bin", "_sub").distinct(), [*keys, "_bin", "_sub"], "left_semi")
    hits = hits.withColumn("_end", F.sum("_c").over(ranked))
    picked = hits.join(subs, [*keys, "_bin", "_sub"]).where(
        (F.col("_end") > F.col("_rank")) & (F.col("_end") - F.col("_c") <= F.col("_rank"))
    )
    return picked.groupBy(*keys).agg(
        F.max(F.when(F.col("_which") == 0, F.col(value))).alias("black"),
        F.max(F.when(F.col("_which") == 1, F.col(value))).alias("white"),
    )


def channels(px: DataFrame, array: str, bands: list[int]) -> DataFrame:
    """Selected bands as (channel, value) rows; the scan still reads one array column."""
    picked = spectral.select_bands(array, bands)
    keep = [c for c in px.columns if c not in ("spectrum", "dns")]
    return px.select(*keep, F.posexplode(picked).alias("channel", "value"))


def stretch_preview(px: DataFrame, array: str, bands: list[int], per: list[str] | None = None) -> DataFrame:
    """Percentile levels per channel (per file or for the whole sequence), then a linear stretch to 0..255."""
    per = per or []
    long = channels(px, array, bands)
    levels = percentile_levels(long, [*per, "channel"], "value")
    if per:
        joined = long.join(levels, [*per, "channel"])
    else:  # a row per channel: no reason to move the pixels
        table = levels.agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("black", "white"))))).scalar()
        joined = long.withColumn("_l", table).withColumn("_l", F.try_element_at("_l", F.col("channel"))).select("*", "_l.black", "_l.white").drop("_l")
    level = spectral.stretch(F.col("value").cast("double"), F.col("black"), F.col("white"))
    return joined.withColumn("level", level)


def white_level(headers: DataFrame, px_long: DataFrame, value: str = "dn") -> DataFrame:
    """Header ceiling when it is positive, else the maximum of the file's pixels."""
    peak = px_long.groupBy("file_id").agg(F.max(value).alias("_max"))
    got = headers.select(F.col("file_no").alias("file_id"), F.when(F.col("ceiling") > 0, F.col("ceiling")).alias("_ceil"))
    return peak.join(got, "file_id", "left").select(
        "file_id", F.coalesce("_ceil", "_max").alias("white"), F.col("_ceil").isNotNull().alias("from_header")
    )


def band_extent(px: DataFrame, array: str) -> DataFrame:
    """Min and max per band, one row per band; partial aggregation leaves B rows per task."""
    return px.select(F.posexplode(array).alias("band", "_v")).groupBy("band").agg(
        F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )


def normalize_channels(px: DataFrame, array: str = "dns") -> DataFrame:
    """Min-max scaling of every band to 0..1. The band table enters as one scalar array, not as a join."""
    rows = band_extent(px, array)
    ordered = F.array_sort(F.collect_list(F.struct("band", "lo", "hi")))
    extent = rows.agg(F.transform(ordered, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))).scalar()
    px = px.withColumn("_extent", extent)
    scaled = F.zip_with(
        array, "_extent", lambda v, e: F.coalesce(F.try_divide((v - e["lo"]).cast("double"), e["hi"] - e["lo"]), F.lit(0.0))
    )
    return px.withColumn("scaled", scaled).drop("_extent")


def raster_range(dtm: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Min and max of the valid heights, optionally inside rows [i0, i1) and columns [j0, j1)."""
    cells = dtm.where(spectral.valid_height(F.col("z")))
    if window is not None:
        i0, i1, j0, j1 = window
        cells = cells.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1))
    return cells.agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def band_mean_var(px: DataFrame, array: str, compat: bool = False) -> DataFrame:
    """Mean and population variance per band.

    ``compat`` divides both sums by lines*samples*bands, the squares being taken around that smaller mean.
    """
    long = px.select(F.posexplode(array).alias("band", "_v"), F.size(array).alias("_b"))
    moments = long.groupBy("band").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_v").cast("double").alias("s"),
        F.sum(F.col("_v") * F.col("_v")).cast("double").alias("q"), F.max("_b").cast("double").alias("b"),
        F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var"),
    )
    if not compat:
        return moments.select("band", F.col("_mean").alias("mean"), F.col("_var").alias("variance"))
    total = F.col("n") * F.col("b")
    mean = F.col("s") / total
    spread = F.col("q") - 2 * mean * F.col("s") + F.col("n") * mean * mean
    return moments.select("band", mean.alias("mean"), (spread / total).alias("variance"))


def sampled_files(file_id: Column, n_files: Column, step: int) -> Column:
    """Every ``step``-th file, with the middle file taking the place of the first one."""
    middle = F.floor(n_files / 2)
    stepped = (file_id > 0) & (file_id % step == 0) & (file_id != middle)
    return (file_id == middle) | stepped | ((file_id == 0) & (middle % step == 0))


def band_covariance(
    px: DataFrame, array: str = "spectrum", file_step: int = 1, line_step: int = 1, sample_step: int = 1,
) -> DataFrame:
    """Band covariance and correlation of all pixels, or of every so many files, lines and samples: band_a, band_b, n, cov, corr.

    Each task reduces its pixels to the matrix of cross products with one matrix product per Arrow batch; Spark
    sums the matrices. Values are shifted by the rounded band mean of the sample to keep the sums small.
    ``px`` needs file_id, line_in_file, sample.
    """
    chosen = px
    if file_step > 1:
        n_files = px.agg(F.max("file_id") + 1).scalar()
        chosen = chosen.where(sampled_files(F.col("file_id"), n_files, file_step))
    if line_step > 1:
        chosen = chosen.where(F.col("line_in_file") % line_step == 0)
    if sample_step > 1:
        chosen = chosen.where(F.col("sample") % sample_step == 0)
    means = chosen.select(F.posexplode(array).alias("band", "_v")).groupBy("band").agg(F.round(F.avg("_v")).alias("m"))
    shift = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda r: r["m"])).scalar()
    shifted = chosen.withColumn("_shift", shift).select(F.zip_with(array, "_shift", lambda v, m: v - m).alias("x"))

    def cross_products(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        xtx = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x = np.stack(batch["x"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            xtx = x.T @ x if xtx is None else xtx + x.T @ x
        if xtx is not None:
            b = len(xtx) - 1
            a_idx, b_idx = np.meshgrid(np.arange(b), np.arange(b), indexing="ij")
            yield pd.DataFrame({
                "band_a": a_idx.ravel(), "band_b": b_idx.ravel(), "n": xtx[b, b],
                "sa": np.repeat(xtx[:b, b], b), "sb": np.tile(xtx[:b, b], b), "sab": xtx[:b, :b].ravel(),
            })

    parts = shifted.mapInPandas(
        cross_products, "band_a bigint, band_b bigint, n double, sa double, sb double, sab double"
    )
    sums = parts.groupBy("band_a", "band_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
    cov = sums.select(
        "band_a", "band_b", F.col("n").cast("bigint").alias("n"),
        F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.col("n") - 1).alias("cov"),
    )
    diag = cov.where("band_a = band_b").select(F.col("band_a").alias("_b"), F.sqrt("cov").alias("_s"))
    return (
        cov.join(diag.select(F.col("_b").alias("band_a"), F.col("_s").alias("_sa")), "band_a")
        .join(diag.select(F.col("_b").alias("band_b"), F.col("_s").alias("_sb")), "band_b")
        .select("band_a", "band_b", "n", "cov", F.try_divide(F.col("cov"), F.col("_sa") * F.col("_sb")).alias("corr"))
    )


def dataset_stats(headers: DataFrame) -> DataFrame:
    """Files, total lines and the number of headers without a line count, per dataset."""
    return headers.agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
        F.count_if(F.col("lines").isNull()).alias("bad_headers"),
        F.min(F.when(F.col("lines").isNull(), F.col("path"))).alias("first_bad"),
    )


def line_count(headers: DataFrame) -> DataFrame:
    """Lines per sequence, -1 when any header of the sequence has none."""
    return headers.groupBy("seq").agg(
        F.when(F.count_if(F.col("lines").isNull()) > 0, F.lit(-1)).otherwise(F.sum("lines")).alias("lines")
    )


def pick_rgb_bands(wavelengths: DataFrame, n_bands: Column) -> DataFrame:
    """Band nearest to red, green and blue: channel, band. Starts at B/4, B/2, B-B/4; ties keep the earlier choice.

    ``wavelengths`` has band, wl. With another number of rows than ``n_bands`` the starting bands are returned.
    """
    n = n_bands.cast("bigint")
    start = [F.floor(n / 4), F.floor(n / 2), F.least(n - F.floor(n / 4), n - 1)]
    refs = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(w).alias("ref"), start[c].alias("start"))
                     for c, w in enumerate(spectral.RGB_WAVELENGTHS)])
    long = wavelengths.withColumn("_r", F.explode(refs)).select("band", "wl", "_r.*")
    # the starting band wins a tie, then the lower band
    rank = F.struct(F.abs(F.col("wl") - F.col("ref")), (F.col("band") != F.col("start")).cast("int"), F.col("band"))
    best = long.groupBy("channel").agg(
        F.min_by("band", rank).alias("_best"), F.max("start").alias("_start"), F.count(F.lit(1)).alias("_n")
    )
    return best.select("channel", F.when(F.col("_n") == n, F.col("_best")).otherwise(F.col("_start")).alias("band"))
