"""Pixel functions (F*) and radiometry (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.catalog import r6
from swathline.catalog.base import query
from swathline.catalog.fixture_sql import r6 as s6
from swathline.catalog.fixture_sql import sql
from swathline.functions import spectral as sp
from swathline.operators import radiometry as rad
from swathline.plans import inputs as inp

RGB = [43, 27, 12]
RGB_SQL = "SELECT line, sample, file_id, CASE band WHEN 43 THEN 0 WHEN 27 THEN 1 ELSE 2 END::BIGINT AS channel, dn AS value FROM px WHERE band IN (43, 27, 12)"


def ranked(keys: str, source: str, value: str) -> str:
    """SQL levels by position in the sorted column."""
    return f"""SELECT {keys}, max(CASE WHEN rn = floor(0.05::DOUBLE * n) THEN {value} END) AS black,
        max(CASE WHEN rn = floor(0.95::DOUBLE * n) THEN {value} END) AS white FROM (
        SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn,
        count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys}"""


@query("F1_select_bands", sql("SELECT line, sample, max(dn) FILTER (band = 43) AS r, max(dn) FILTER (band = 27) AS g, max(dn) FILTER (band = 12) AS b FROM px GROUP BY 1, 2"))
def _(spark, sf):
    picked = sp.select_bands("dns", RGB)
    return inp.pixels(spark, sf).select("line", "sample", *[picked[k].alias(n) for k, n in enumerate("rgb")])


@query("F2_slice_lines", sql("SELECT line, count(*) AS cells, sum(dn)::BIGINT AS total FROM px WHERE line >= 3 AND line < 17 GROUP BY 1"))
def _(spark, sf):
    px = inp.to_long(inp.pixels(spark, sf).where("line >= 3 and line < 17"), "dns", "dn")
    return px.groupBy("line").agg(F.count(F.lit(1)).alias("cells"), F.sum("dn").alias("total"))


@query("F3_band_slice", sql("SELECT line, sample, dn FROM px WHERE band = ((-3 % 64) + 64) % 64"))
def _(spark, sf):
    px = inp.pixels(spark, sf)
    band = sp.wrap_band(F.lit(-3), F.size("dns"))
    return px.select("line", "sample", F.col("dns")[band].alias("dn"))


def wavelengths(spark, sf):
    px = inp.pixels(spark, sf)
    n = px.agg(F.max(F.size("dns"))).scalar()
    bands = px.select(F.posexplode("dns").alias("band", "_v")).select("band").distinct()
    return bands.select("band", sp.synth_wavelength(F.col("band"), n).alias("wl")), n


@query("F4_pick_rgb_bands", sql("""SELECT c AS channel, arg_min(band, abs(wl - ref) * 1e6 + band * 1e-9) AS band FROM wl,
    (VALUES (0::BIGINT, 630.0::DOUBLE), (1, 532), (2, 465)) r(c, ref) GROUP BY 1"""))
def _(spark, sf):
    wl, n = wavelengths(spark, sf)
    return rad.pick_rgb_bands(wl, n)


@query("F5_stretch_levels", sql(f"SELECT line, sample, band, {s6('least(greatest((dn - 15000) / 10000, 0), 1) * 255', 'level')}, {s6('least(greatest((dn - 15000) / 25000, 0), 1) * 255', 'level_compat')} FROM px"))
def _(spark, sf):
    v = F.col("dn").cast("double")
    b, w = F.lit(15000.0), F.lit(25000.0)
    return inp.pixels_long(spark, sf).select(
        "line", "sample", "band", r6(sp.stretch(v, b, w), "level"), r6(sp.stretch(v, b, w, compat=True), "level_compat")
    )


@query("F6_to_uint8", sql("SELECT line, sample, band, CASE WHEN dn < 15000 THEN 0 WHEN dn >= 25000 THEN 255 ELSE (255 * (dn - 15000)) // 10000 END::BIGINT AS level FROM px"))
def _(spark, sf):
    return inp.pixels_long(spark, sf).select(
        "line", "sample", "band", sp.to_uint8(F.col("dn"), F.lit(15000), F.lit(25000)).alias("level")
    )


@query("F7_gamma_preview", sql(f"SELECT line, sample, channel, {s6('pow(value / peak, 1 / 2.2::DOUBLE) * 255', 'level', 4)} FROM rgb JOIN (SELECT channel, max(value) AS peak FROM rgb GROUP BY 1) USING (channel)", rgb=RGB_SQL))
def _(spark, sf):
    long = rad.channels(inp.pixels(spark, sf), "dns", RGB)
    peaks = long.groupBy("channel").agg(F.max("value").alias("peak")).agg(F.map_from_entries(F.collect_list(F.struct("channel", "peak")))).scalar()
    peak = F.try_element_at("peaks", F.col("channel"))
    return long.withColumn("peaks", peaks).select("line", "sample", "channel", r6(sp.gamma_level(F.col("value"), peak), "level", 4))


def _ramp2(stops, p="q"):
    cols = []
    for c, n in enumerate("rgb"):
        a, b, d = (s[c] for s in stops)
        cols.append(f"trunc(CASE WHEN {p} < 0.5 THEN {a} * (1 - {p} * 2) + {b} * ({p} * 2) ELSE {b} * (1 - ({p} * 2 - 1)) + {d} * ({p} * 2 - 1) END)::BIGINT AS {n}")
    return ", ".join(cols)


@query("F8_color_ramp", sql(f"SELECT line, sample, {_ramp2(sp.WEIGHT_RAMP)} FROM (SELECT line, sample, least(greatest((dn - 10000) / 20000, 0), 1) AS q FROM px WHERE band = 5)"))
def _(spark, sf):
    px = inp.pixels(spark, sf)
    p = (F.col("dns")[5] - 10000).cast("double") / 20000
    return px.select("line", "sample", *[c.alias(n) for c, n in zip(sp.two_segment_ramp(p, sp.WEIGHT_RAMP), "rgb")])


@query("F8_color_ramp_terrain", sql("SELECT i, j, " + ", ".join(
    f"trunc((1 - (x - floor(x))) * list_extract({[s[c] for s in sp.TERRAIN_RAMP]}, least(floor(x), 4)::INT + 1) + (x - floor(x)) * list_extract({[s[c] for s in sp.TERRAIN_RAMP]}, least(ceil(x), 4)::INT + 1))::BIGINT AS {n}"
    for c, n in enumerate("rgb")) + " FROM (SELECT i, j, (z - 900) / 1100 * 5 AS x FROM dtm WHERE z IS NOT NULL)"))
def _(spark, sf):
    cells = inp.dtm(spark, sf).where(sp.valid_height(F.col("z")))
    colours = sp.stop_ramp((F.col("z") - 900) / 1100, sp.TERRAIN_RAMP)
    return cells.select("i", "j", *[c.alias(n) for c, n in zip(colours, "rgb")])


@query("F9_valid_height", sql("SELECT i, j, z FROM dtm WHERE z IS NOT NULL AND z >= 905 AND z <= 1500"))
def _(spark, sf):
    return inp.dtm(spark, sf).where(sp.valid_height(F.col("z"), 905.0, 1500.0))


@query("F10_rescale_time", sql(f"SELECT flight, line, {s6('t * 0.001 + 12.5', 't')} FROM scan"))
def _(spark, sf):
    return inp.scan_lines(spark, sf).select("flight", "line", r6(sp.rescale_time(F.col("t"), 0.001, 12.5), "t"))


_A = "CASE WHEN {0} < 0 THEN {0} + 2 * pi() ELSE {0} END"


@query("F11_angle_delta", sql(f"SELECT n, {s6('(' + _A.format('yaw') + ') - (' + _A.format('pitch') + ')', 'delta')} FROM poses"))
def _(spark, sf):
    return inp.poses_raw(spark, sf).select("n", r6(sp.angle_delta(F.col("yaw"), F.col("pitch")), "delta"))


@query("F12_angle_lerp", sql(f"""SELECT n, {s6('CASE WHEN abs(yaw - roll * 5) > pi() THEN CASE WHEN m < 0 THEN m + pi() ELSE m - pi() END ELSE m END', 'blend')},
    {s6('yaw + 0.25 * (a - 2 * pi() * floor(a / (2 * pi())) - pi())', 'arc')}
    FROM (SELECT *, 0.75 * yaw + 0.25 * (roll * 5) AS m, roll * 5 - yaw + pi() AS a FROM poses)"""))
def _(spark, sf):
    a, b, w = F.col("yaw"), F.col("roll") * 5, F.lit(0.25)
    return inp.poses_raw(spark, sf).select(
        "n", r6(sp.angle_lerp(a, b, w), "blend"), r6(sp.angle_lerp(a, b, w, "shortest_arc"), "arc")
    )


@query("F15_resolve_range", sql("""SELECT obs_id, least(a, b) AS first, greatest(a, b) AS last FROM (SELECT obs_id,
    CASE WHEN s < 0 THEN 1000 + s ELSE s END AS a, CASE WHEN e < 0 THEN 1000 + e ELSE e END AS b FROM
    (SELECT obs_id, obs_id % 300 - 150 AS s, lm_id % 400 - 200 AS e FROM obs))"""))
def _(spark, sf):
    obs = inp.landmark_obs(spark, sf)
    first, last = sp.resolve_range(F.col("obs_id") % 300 - 150, F.col("lm_id") % 400 - 200, F.lit(1000))
    return obs.select("obs_id", first.alias("first"), last.alias("last"))


@query("S18_synth_wavelengths", sql(f"SELECT band, {s6('wl')} FROM wl"))
def _(spark, sf):
    return wavelengths(spark, sf)[0].select("band", r6("wl"))


@query("R1_average_dark_frame", sql("SELECT sample, band, (sum(dn)::BIGINT // count(*))::BIGINT AS mean FROM px GROUP BY 1, 2"))
def _(spark, sf):
    return rad.average_frame(inp.pixels_long(spark, sf), ["sample", "band"], "dn")


@query("R1_average_over_samples", sql("SELECT line, band, (sum(dn)::BIGINT // count(*))::BIGINT AS mean FROM big GROUP BY 1, 2"))
def _(spark, sf):
    return rad.average_frame(inp.to_long(inp.pixels_big(spark, sf), "dns", "dn"), ["line", "band"], "dn")


@query("R2_subtract_dark_frame", sql("SELECT line, sample, band, dn - least(d, dn) AS dn FROM px JOIN dark USING (sample, band)"))
def _(spark, sf):
    clean = rad.subtract_dark(inp.pixels(spark, sf), inp.dark(spark, sf))
    return inp.to_long(clean, "dns", "dn").select("line", "sample", "band", "dn")


@query("R3_percentile_levels", sql(ranked("band", "px", "dn")))
def _(spark, sf):
    return rad.percentile_levels(inp.pixels_long(spark, sf), ["band"], "dn")


@query("R3_percentile_levels_big", sql(ranked("band", "big", "dn")))
def _(spark, sf):
    return rad.percentile_levels(inp.to_long(inp.pixels_big(spark, sf), "dns", "dn"), ["band"], "dn")


@query("R4_stretch_preview", sql(f"SELECT line, sample, channel, {s6('least(greatest((value - black) / (white - black), 0), 1) * 255', 'level')} FROM rgb JOIN lv USING (channel)",
       rgb=RGB_SQL, lv=ranked("channel", "rgb", "value")))
def _(spark, sf):
    return rad.stretch_preview(inp.pixels(spark, sf), "dns", RGB).select("line", "sample", "channel", r6("level"))


@query("R4_stretch_preview_per_file", sql(f"SELECT line, sample, channel, {s6('least(greatest((value - black) / (white - black), 0), 1) * 255', 'level')} FROM rgb JOIN lv USING (file_id, channel)",
       rgb=RGB_SQL, lv=ranked("file_id, channel", "rgb", "value")))
def _(spark, sf):
    return rad.stretch_preview(inp.pixels(spark, sf), "dns", RGB, ["file_id"]).select("line", "sample", "channel", r6("level"))


@query("R5_white_level", sql("""SELECT file_id, coalesce(c, m) AS white, c IS NOT NULL AS from_header FROM (SELECT file_id, max(dn) AS m FROM px GROUP BY 1)
    LEFT JOIN (SELECT file_no AS file_id, CASE WHEN ceiling > 0 THEN ceiling END AS c FROM headers) USING (file_id)"""))
def _(spark, sf):
    return rad.white_level(inp.headers(spark, sf), inp.pixels_long(spark, sf))


@query("R6_channel_max", sql("SELECT channel, max(value) AS peak FROM rgb GROUP BY 1", rgb=RGB_SQL))
def _(spark, sf):
    return rad.channels(inp.pixels(spark, sf), "dns", RGB).groupBy("channel").agg(F.max("value").alias("peak"))


@query("R7_normalize_channels", sql(f"SELECT line, sample, band, {s6('(dn - lo) / (hi - lo)', 'v')} FROM px JOIN (SELECT band, min(dn) AS lo, max(dn) AS hi FROM px GROUP BY 1) USING (band)"))
def _(spark, sf):
    px = rad.normalize_channels(inp.pixels(spark, sf))
    return inp.to_long(px, "scaled", "v").select("line", "sample", "band", r6("v"))


@query("R8_raster_range", sql("SELECT min(z) AS z_min, max(z) AS z_max FROM dtm"))
def _(spark, sf):
    return rad.raster_range(inp.dtm(spark, sf))


@query("R8_raster_range_viewport", sql("SELECT min(z) AS z_min, max(z) AS z_max FROM dtm WHERE i >= 1 AND i < 3 AND j >= 10 AND j < 40"))
def _(spark, sf):
    return rad.raster_range(inp.dtm(spark, sf), (1, 3, 10, 40))


@query("R9_band_mean_var", sql(f"SELECT band, {s6('avg(dn)', 'mean', 4)}, {s6('var_pop(dn)', 'variance', 2)} FROM px GROUP BY 1"))
def _(spark, sf):
    return rad.band_mean_var(inp.pixels(spark, sf), "dns").select("band", r6("mean", digits=4), r6("variance", digits=2))


@query("R9_band_mean_var_compat", sql(f"""SELECT band, {s6('m', 'mean', 4)}, {s6('(q - 2 * m * s + n * m * m) / (n * 64)', 'variance', 2)} FROM
    (SELECT band, count(*) AS n, sum(dn)::DOUBLE AS s, sum(dn * dn)::DOUBLE AS q, sum(dn)::DOUBLE / (count(*) * 64) AS m FROM px GROUP BY 1)"""))
def _(spark, sf):
    return rad.band_mean_var(inp.pixels(spark, sf), "dns", compat=True).select("band", r6("mean", digits=4), r6("variance", digits=2))


def cov_sql(where: str) -> str:
    return sql(f"""SELECT a.band AS band_a, b.band AS band_b, a.n, {s6('ab.cov', 'cov', 3)}, {s6('ab.cov / (sqrt(a.cov) * sqrt(b.cov))', 'corr')}
        FROM ab JOIN (SELECT * FROM ab WHERE ba = bb) a0 ON a0.ba = ab.ba JOIN (SELECT ba AS band, n, cov FROM ab WHERE ba = bb) a ON a.band = ab.ba
        JOIN (SELECT ba AS band, cov FROM ab WHERE ba = bb) b ON b.band = ab.bb""",
        x=f"SELECT line, sample, band, dn - round(avg(dn) OVER (PARTITION BY band)) AS d FROM px WHERE {where}",
        ab="""SELECT p.band AS ba, q.band AS bb, count(*) AS n,
              (sum(p.d * q.d) - sum(p.d) * sum(q.d) / count(*)) / (count(*) - 1) AS cov
              FROM x p JOIN x q USING (line, sample) GROUP BY 1, 2""")


def _with_file_line(px):
    return px.withColumn("line_in_file", F.col("line") % inp.LINES_PER_FILE)


@query("R10_band_covariance", cov_sql("true"))
def _(spark, sf):
    out = rad.band_covariance(_with_file_line(inp.pixels(spark, sf)), "dns", 1, 1, 1)
    return out.select("band_a", "band_b", "n", r6("cov", digits=3), r6("corr"))


@query("R10_band_covariance_sampled", cov_sql("""file_id IN (SELECT CASE WHEN f = 0 THEN m WHEN f = m THEN 0 ELSE f END FROM
    (SELECT DISTINCT file_id AS f, (SELECT max(file_id) + 1 FROM px) // 2 AS m FROM px) WHERE f % 2 = 0) AND (line % 10) % 3 = 0 AND sample % 4 = 0"""))
def _(spark, sf):
    out = rad.band_covariance(_with_file_line(inp.pixels(spark, sf)), "dns", 2, 3, 4)
    return out.select("band_a", "band_b", "n", r6("cov", digits=3), r6("corr"))


@query("R11_dataset_stats", sql("SELECT count(*) AS files, sum(lines)::BIGINT AS lines, count(*) FILTER (lines IS NULL) AS bad_headers, min(path) FILTER (lines IS NULL) AS first_bad FROM headers"))
def _(spark, sf):
    return rad.dataset_stats(inp.headers(spark, sf))


@query("R12_line_count", sql("SELECT seq, CASE WHEN count(*) > count(lines) THEN -1 ELSE sum(lines) END::BIGINT AS lines FROM headers GROUP BY 1"))
def _(spark, sf):
    return rad.line_count(inp.headers(spark, sf))
