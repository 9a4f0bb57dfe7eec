"""Tables to write, and the writers that need more than ``df.write``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions import geo, vec
from swathline.operators import ortho, trajectory
from swathline.sources import datasource, text
from swathline.sources.codec import TYPES
from swathline.sources.cubes import read_headers


def cube_header_rows(px: DataFrame, keys: list[str], array: str, data_type: int = 12) -> DataFrame:
    """Header values of each cube to write: keys, lines, samples, bands, data_type, ceiling (never negative)."""
    return px.groupBy(*keys).agg(
        F.countDistinct("line").alias("lines"), (F.max("sample") + 1).alias("samples"), F.max(F.size(array)).alias("bands"),
        F.lit(data_type).alias("data_type"), F.greatest(F.lit(0), F.max(F.array_max(array))).alias("ceiling"),
    )


def width_of_cut_line(px: DataFrame, seq: list[str]) -> Column:
    """Samples of a whole line, for the first pixel of a sequence's last line if that has fewer: a recording may end within a
    line. NULL elsewhere, so that fewer samples are an error there.

    Read from one look at ``line`` and ``sample``; the sequences that end so are a scalar map.
    """
    key = lambda line: F.struct(*seq, F.col(line).alias("line"))
    ends = px.groupBy(*seq).agg(F.max(F.struct("line", "sample")).alias("_end"), (F.max("sample") + 1).cast("int").alias("_width"))
    cut = ends.where(F.col("_end.sample") + 1 < F.col("_width"))
    widths = cut.agg(F.map_from_entries(F.collect_list(F.struct(key("_end.line"), "_width")))).scalar()
    return F.when(F.col("sample") == 0, F.try_element_at(widths, key("line")))


def cube_lines(px: DataFrame, array: str, folder: Column, data_type: int = 12, side: Column | None = None, width: Column | None = None) -> DataFrame:
    """Rows that the cube writer takes: the pixels of each line of each folder, in order, as bytes.

    ``px`` has ``line, sample`` and the array of bands. All lines of a folder go to one task, where one line is held at a time.
    A missing or repeated pixel, spectra of unequal length and values that the type can't hold are errors. ``side`` is a
    map of texts to add to files beside the cube, ``width`` the samples of a whole line where one was cut off
    (``width_of_cut_line``); those of a line's first pixel count.
    """
    kind = TYPES[data_type]
    none = F.lit(None).cast("map<string,string>")
    rows = px.select(folder.alias("folder"), "line", "sample", F.col(array).alias("values"), (none if side is None else side).alias("side"), (F.lit(None) if width is None else width).cast("int").alias("width"))
    dealt = rows.repartition("folder").sortWithinPartitions("folder", "line", "sample")
    return dealt.mapInArrow(codec_lines(kind), datasource.LINE_SCHEMA)


def codec_lines(kind: str):
    def encode(batches):
        import numpy as np
        import pyarrow as pa

        held, key = [], None

        def line(key, rows):
            place = f"{key[0]}: "
            table = pa.Table.from_batches(rows).combine_chunks()
            sample, values = table.column("sample").to_numpy(), table.column("values").combine_chunks()
            bands = len(values[0])
            if (np.diff(values.offsets.to_numpy()) != bands).any():
                raise ValueError(f"{place}spectra differ in length at line {key[1]}")
            if (sample != np.arange(len(sample))).any():
                raise ValueError(f"{place}pixels are missing or repeated at line {key[1]}")
            data = values.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), bands)
            if np.dtype(kind).kind in "iu":
                bounds = np.iinfo(kind)
                if data.min() < bounds.min or data.max() > bounds.max:
                    raise ValueError(f"{place}values from {data.min()} to {data.max()} don't fit type {kind}")
            peak = float(max(0, data.max()))
            return [key[0], int(key[1]), len(sample), bands, np.ascontiguousarray(data.T.astype(kind)).tobytes(), peak, table.column("side")[0].as_py(), table.column("width")[0].as_py()]

        def out(rows):
            schema = pa.schema([("folder", pa.string()), ("line", pa.int64()), ("samples", pa.int32()), ("bands", pa.int32()), ("data", pa.binary()), ("peak", pa.float64()), ("side", pa.map_(pa.string(), pa.string())), ("width", pa.int32())])
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            folders, lines = batch.column("folder").to_pylist(), batch.column("line").to_numpy()
            cuts = [0, *[i for i in range(1, len(lines)) if lines[i] != lines[i - 1] or folders[i] != folders[i - 1]], len(lines)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = (folders[a], lines[a])
                if here != key:
                    if held:
                        yield out([line(key, held)])
                    held, key = [], here
                held.append(batch.slice(a, b - a))
        if held:
            yield out([line(key, held)])

    return encode


def save_lines(lines: DataFrame, folder: str, data_type: int = 12, header: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """Writes rows of ``cube_lines``: files appear when all tasks have succeeded, and a cube's header after its data."""
    datasource.register(lines.sparkSession)
    to = lines.write.format(datasource.CUBE).option("dataType", data_type).option("header", json.dumps(header or {}))
    to.mode("overwrite" if overwrite else "append").save(folder)


def write_cube(px: DataFrame, array: str, folder: str, block: int = 512, data_type: int = 12, extra: dict[str, str] | None = None) -> DataFrame:
    """Writes BIL files with headers, one per block of lines (seq-block/frame.bil); path, lines, ceiling of the cubes there.

    ``extra`` adds header values, or replaces them. A cube that is there already is an error. The last line of a sequence may be
    cut off: it is filled up with zeros, and the header tells how many samples it has.
    """
    name = F.format_string("%04d-%d", F.col("seq").cast("long"), F.floor(F.col("line") / block))
    save_lines(cube_lines(px, array, name, data_type, width=width_of_cut_line(px, ["seq"])), folder, data_type, extra)
    return text.typed_headers(read_headers(px.sparkSession, folder)).select("path", "lines", "ceiling")


# Fixed values of converted frames: header entries beside the sizes, and the ends of the wavelengths.
FRAME_HEADER = {"ceiling": 65535, "field of view": 39.5, "imager serial number": "AVIRIS-4", "framerate": 215, "wavelength units": "nanometers"}
WAVELENGTHS = (380.0, 2490.0)


def convert_frames(frames: DataFrame, folder: str, samples: int, bands: int, flight: Column, height: int = 2000, times: DataFrame | None = None) -> None:
    """Raw frames (``path, line, data`` as their source reads them) to cubes of ``height`` lines in LLLL_BBBB folders.

    ``flight`` is the number that a folder's name begins with. ``times`` (``path, line, t``) become a timing file beside each cube,
    one line each. Only bytes are copied; a line that was cut off has fewer.
    """
    rows = frames.select("path", "line", "data", flight.alias("flight"))
    if times is not None:
        rows = rows.join(times.select("path", "line", "t"), ["path", "line"], "left")
        side = F.create_map(F.lit("frame.bil.timing"), F.concat(F.coalesce(F.col("t").cast("string"), F.lit("")), F.lit("\n")))
    else:
        side = F.lit(None).cast("map<string,string>")
    name = F.format_string("%04d_%04d", F.col("flight").cast("long"), F.floor(F.col("line") / height) + 1)
    here = F.expr(f"cast(octet_length(data) div {2 * bands} as int)")
    cut = here < samples
    sizes = [F.when(cut, here).otherwise(samples).alias("samples"), F.lit(bands).alias("bands")]
    lines = rows.select(name.alias("folder"), "line", *sizes, "data", F.lit(65535.0).alias("peak"), side.alias("side"), F.when(cut, samples).alias("width"))
    low, high = WAVELENGTHS
    waves = "{" + ",".join(f"{low + (high - low) * k / max(bands - 1, 1):g}" for k in range(bands)) + "}"
    save_lines(lines.repartition("folder").sortWithinPartitions("folder", "line"), folder, 12, {**FRAME_HEADER, "wavelength": waves})


def save_tiles(mosaic: DataFrame, tiles: DataFrame, world: DataFrame, folder: str, array: str, n_bands: int, data_type: int = 4) -> None:
    """A cube per tile (tile_V_H/frame.bil) with its world file (frame.wld); cells without a value are NaN, or 0 as integers.

    ``mosaic`` has tile_i, tile_j, i, j (in the tile) and the array of bands, ``tiles`` height and width of each tile, ``world``
    the numbers of ``world_files``.
    """
    zero = F.lit(0).cast("bigint")
    grid = tiles.select("tile_i", "tile_j", "width", F.explode(F.sequence(zero, F.col("height").cast("bigint") - 1)).alias("i"))
    grid = grid.select("tile_i", "tile_j", "i", F.explode(F.sequence(zero, F.col("width").cast("bigint") - 1)).alias("j"))
    hole = F.lit(0.0 if TYPES[data_type][-2] in "iu" else float("nan"))
    on = ["tile_i", "tile_j", "i", "j"]
    cells = grid.join(mosaic.select(*on, array), on, "left").withColumn(array, F.coalesce(array, F.array_repeat(hole, n_bands)))
    numbers = ["x_per_col", "y_per_col", "x_per_row", "y_per_row", "x0", "y0"]
    text_of = F.concat_ws("\n", *[F.format_string("%.16f", c) for c in numbers])
    cells = cells.join(world.select("tile_i", "tile_j", text_of.alias("world")), ["tile_i", "tile_j"], "left")
    side = F.when(F.col("i") == 0, F.create_map(F.lit("frame.wld"), F.col("world")))
    px = cells.select("tile_i", "tile_j", F.col("i").alias("line"), F.col("j").alias("sample"), array, side.alias("side"))
    name = F.format_string("tile_%d_%d", F.col("tile_i").cast("long"), F.col("tile_j").cast("long"))
    save_lines(cube_lines(px, array, name, data_type, F.col("side")), folder, data_type)


def frame_blocks(lines: DataFrame, height: int = 2000) -> DataFrame:
    """Blocks a raw frame is converted to: flight, block, folder, first_line, lines. Header values are fixed: ceiling
    65535, field of view 39.5, framerate 215."""
    block = F.floor(F.col("line") / height)
    name = F.format_string("%04d_%04d", F.col("flight"), F.col("block") + 1)
    out = lines.withColumn("block", block).groupBy("flight", "block").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("lines"))
    return out.select("flight", "block", name.alias("folder"), "first_line", "lines", F.lit(65535).alias("ceiling"), F.lit(39.5).alias("fov"), F.lit(215).alias("framerate"))


def merge_lcf(lines: DataFrame) -> DataFrame:
    """Non-empty pose rows of 'manual*' folders with the number of their folder: folder_no, n, value. Write it ordered
    by (folder_no, n); a range sort keeps it distributed."""
    folder = F.regexp_extract("path", r"manual[^/]*?([0-9]+)/[^/]*$", 1).try_cast("bigint")
    rows = lines.where((F.trim("value") != "") & F.col("path").contains("/manual"))
    return rows.select(folder.alias("folder_no"), F.col("pos").alias("n"), "value")


def shift_table(table: DataFrame) -> DataFrame:
    """Line table to export: a missing shift is 0, a missing place is the line itself."""
    return table.select("seq", "line", F.coalesce("acc", F.lit(0.0)).alias("dx"), F.coalesce("order_idx", "line").alias("y_idx"))


def landmark_table(obs: DataFrame, landmarks: DataFrame) -> DataFrame:
    return obs.join(landmarks.select("lm_id", "name"), "lm_id").select("name", "x", "y")


def rectified_landmark_table(obs: DataFrame, landmarks: DataFrame, lines: DataFrame, width: float, a: list[float], b: list[float]) -> DataFrame:
    """name, time, u, v with the distortion at u added."""
    from swathline.operators.projection import distortion

    timed = trajectory.time_at_line(lines, obs).join(landmarks.select("lm_id", "name"), "lm_id")
    x = F.col("x")
    return timed.where("t is not null").select("name", "t", (x + distortion(x, width, a)).alias("u"), distortion(x, width, b).alias("v"))


def world_files(tiles: DataFrame, geotransform: list[float], scale: float) -> DataFrame:
    """Six numbers of each tile's world file."""
    return ortho.tile_affine(tiles, geotransform, scale)


def write_tiles(mosaic: DataFrame, path: str) -> None:
    """Mosaic as parquet, one directory per tile."""
    mosaic.repartition("tile_i", "tile_j", F.pmod(F.col("i"), F.lit(16))).write.mode("overwrite").partitionBy("tile_i", "tile_j").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with header; ``order`` sorts over all files by range."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def reprojection_report(residuals: DataFrame) -> DataFrame:
    label = F.concat(F.lit("Landmark("), F.col("lm_id").cast("string"), F.lit(")"))
    return residuals.select(label.alias("landmark"), F.col("res_u").alias("error_u"), F.col("res_v").alias("error_v"))


def trajectory_debug(poses: DataFrame, original: DataFrame) -> DataFrame:
    """Pose per line with its geodetic position, attitude in degrees (NED) and the original angles where there are some."""
    lat, lon, h = geo.ecef_to_geodetic(*vec.ref("p"))
    df = poses.withColumns({"lat": lat, "lon": lon, "h": h})
    df = vec.with_rodrigues(df, "m", vec.ref("r"))
    df = vec.keep(df, n=geo.frame_axes("ned", F.col("lat"), F.col("lon")))
    df = vec.keep(df, b=vec.matmul(vec.ref("n", 9), vec.ref("m", 9)))
    b = vec.ref("b", 9)
    angles = {"roll": F.degrees(-F.atan2(b[7], b[8])), "pitch": F.degrees(F.asin(F.least(F.greatest(-b[6], F.lit(-1.0)), F.lit(1.0)))), "yaw": F.degrees(F.atan2(b[3], b[0]))}
    given = original.select("flight", "t", *[F.degrees(c).alias(f"given_{c}") for c in angles])
    out = df.withColumns(angles).join(given, ["flight", "t"], "left")
    return out.select("flight", "t", *[f"p_{k}" for k in range(3)], "lat", "lon", "h", *[f"r_{k}" for k in range(3)], *angles, *[f"given_{c}" for c in angles])


def preview_rows(levels: DataFrame) -> DataFrame:
    """Stretched levels as 8-bit values."""
    return levels.withColumn("level", F.floor("level").cast("short"))


def export_trajectory(poses: DataFrame, mounting: DataFrame) -> DataFrame:
    return trajectory.compose_mounting(poses, mounting)


