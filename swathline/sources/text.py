"""Text inputs as rows (path, pos, value) and the parsers that turn them into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathline.plans.ordered import SLOT_LINES, with_row_index, with_running_sum


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of small text files with their position: path, pos (0-based), value. One file is one split."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    split = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return whole.select("path", F.posexplode(split).alias("pos", "value"))


def list_sequence(files: DataFrame) -> DataFrame:
    """Cube files of a sequence in order: path, folder, number, file_no.

    A sub-folder counts when it holds exactly one cube; it is ordered by the integer after its last '-', folders
    without one come last by name. ``files`` has ``path``.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    cubes = files.where(F.col("path").endswith(".bil")).withColumn("folder", folder)
    single = cubes.groupBy("folder").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    number = F.regexp_extract("folder", r"(?:^|[-/])([0-9]+)$", 1).try_cast("bigint")
    root = F.regexp_extract("folder", r"^(.*?)/?[^/]*$", 1)
    named = single.withColumns({"number": number, "root": root})
    # folders are few; equal numbers are told apart by name
    w = Window.partitionBy("root").orderBy(F.col("number").asc_nulls_last(), "folder")
    return named.select("path", "folder", "number", (F.row_number().over(w) - 1).alias("file_no"))


def parse_headers(texts: DataFrame) -> DataFrame:
    """Header files (path, text) to path, valid, kv: first line 'ENVI', then 'key = value', the value ends at a second
    '=', the last of repeated keys wins."""
    rows = F.split("text", r"\r?\n")
    pairs = F.filter(F.transform(F.slice(rows, 2, 1 << 30), lambda r: F.split(r, "=")), lambda p: F.size(p) >= 2)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1 << 30), lambda o: o["key"] == e["key"]))
    return texts.select("path", (F.trim(rows[0]) == "ENVI").alias("valid"), F.map_from_entries(last).alias("kv"))


def typed_headers(headers: DataFrame) -> DataFrame:
    """Typed columns of valid headers; what is missing or not a number is NULL."""
    num = lambda key, t: F.try_element_at("kv", F.lit(key)).try_cast(t)
    return headers.where("valid").select(
        "path", num("lines", "bigint").alias("lines"), num("samples", "bigint").alias("samples"), num("bands", "bigint").alias("bands"),
        num("data type", "int").alias("data_type"), F.try_element_at("kv", F.lit("interleave")).alias("interleave"),
        num("framerate", "double").alias("framerate"), num("field of view", "double").alias("fov"), num("ceiling", "double").alias("ceiling"),
    )


def rejected_headers(headers: DataFrame) -> DataFrame:
    """path and reason of headers that cannot be read."""
    typed = typed_headers(headers)
    broken = typed.where("lines is null or samples is null or bands is null").select("path", F.lit("missing size").alias("reason"))
    return headers.where("not valid").select("path", F.lit("not ENVI").alias("reason")).unionByName(broken)


def sequence_offsets(headers: DataFrame) -> DataFrame:
    """First global line of each file of a sequence: adds line0. Keys: seq, file_no, lines."""
    return with_running_sum(headers, ["seq"], "file_no", F.col("lines"), "line0", SLOT_LINES, inclusive=False)


def parse_line_times(lines: DataFrame) -> DataFrame:
    """One double per line: path, line, t. A file with any other content is left out."""
    parsed = lines.select("path", F.col("pos").alias("line"), F.trim("value").try_cast("double").alias("t"))
    bad = parsed.where("t is null").select("path").distinct()
    return parsed.join(bad, "path", "left_anti")


def derive_line_times(headers: DataFrame, timing: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Times of all lines of a file: from its timing file, else first trajectory time + line/framerate.

    headers: path, lines, framerate; timing: path, line, t; trajectory: path, n, t.
    """
    start = trajectory.groupBy("path").agg(F.min_by("t", "n").alias("t0"))
    grid = headers.where("lines > 0").join(start, "path", "left").select(
        "path", "t0", "framerate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lines") - 1)).alias("line"))
    met = grid.join(timing.select("path", "line", "t"), ["path", "line"], "left")
    clocked = F.col("t0") + F.try_divide(F.col("line").cast("double"), F.col("framerate"))
    return met.select("path", "line", F.coalesce("t", clocked).alias("t"))


LCF_COLUMNS = ("t", "roll", "pitch", "yaw", "lon", "lat", "height")


def parse_lcf(lines: DataFrame) -> DataFrame:
    """Whitespace-separated pose rows: path, n, t, roll, pitch, yaw, lon, lat, height."""
    parts = F.split(F.trim("value"), r"\s+")
    cols = [F.get(parts, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(LCF_COLUMNS)]
    return lines.where(F.trim("value") != "").select("path", F.col("pos").alias("n"), *cols)


def parse_trajectory(
    lines: DataFrame, columns: dict[str, int] | None = None, separators: str = r"[\s,;]+", comment: str = "#",
) -> DataFrame:
    """Pose rows with configurable column numbers; comments, short and unreadable rows are skipped and not counted.

    path, n (position among accepted rows), then the columns.
    """
    columns = columns or {c: k for k, c in enumerate(LCF_COLUMNS)}
    parts = F.split(F.trim("value"), separators)
    rows = lines.where(~F.trim("value").startswith(comment))
    values = {c: F.get(parts, F.lit(k)).try_cast("double") for c, k in columns.items()}
    parsed = rows.select("path", "pos", *[v.alias(c) for c, v in values.items()]).dropna(subset=list(values))
    return with_row_index(parsed, ["path"], "pos", "n", SLOT_LINES).select("path", "n", *values)


def parse_ref_track(lines: DataFrame) -> DataFrame:
    """Tab-separated comparison track ('$' comments, at least 5 fields): path, t, lat, lon, alt."""
    parts = F.split("value", "\t")
    num = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    rows = lines.where(~F.col("value").startswith("$") & (F.size(parts) >= 5))
    return rows.select("path", num(0).alias("t"), num(2).alias("lat"), num(3).alias("lon"), num(4).alias("alt")).dropna()


def parse_tie_matches(lines: DataFrame) -> DataFrame:
    """13-column match rows: match_id, c1, c2, x1, y1, x2, y2; rows with a coordinate 0 are dropped."""
    parts = F.split("value", ",")
    num = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double").try_cast("bigint")
    names = {"match_id": 0, "c1": 1, "c2": 2, "x1": 7, "y1": 8, "x2": 11, "y2": 12}
    rows = lines.select(*[num(k).alias(c) for c, k in names.items()]).dropna()
    return rows.where("x1 <> 0 and y1 <> 0 and x2 <> 0 and y2 <> 0")


def parse_tie_chunks(lines: DataFrame) -> DataFrame:
    """Rows '_,chunk,bil': chunk_id, bil_id."""
    parts = F.split("value", ",")
    return lines.select(*[F.trim(F.get(parts, F.lit(k))).try_cast("bigint").alias(c) for k, c in ((1, "chunk_id"), (2, "bil_id"))]).dropna()


def frame_clock(header: Column) -> list[Column]:
    """(clock, flag, tow, pps) of a frame's header bytes: little-endian clock at 0, marker BABE at 80, big-endian time
    of week at 116, clock at the pulse at 164 with swapped words."""
    byte = lambda k: F.conv(F.hex(F.substring(header, k + 1, 1)), 16, 10).cast("bigint")
    join = lambda *ks: sum((byte(k) * (1 << (8 * n)) for n, k in enumerate(ks)), F.lit(0).cast("bigint"))
    return [join(0, 1, 2, 3), join(80, 81) == 0xBABE, join(119, 118, 117, 116), join(166, 167, 164, 165)]


def order_frames(frames: DataFrame) -> DataFrame:
    """Frames by their clock (both 16-bit words with the top bit flipped, high word first): path, file_no."""
    word = lambda shift: F.shiftrightunsigned(F.col("clock"), shift).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.lit(0x8000))
    value = word(16) * 65536 + word(0)
    return with_row_index(frames.withColumn("_v", value), ["seq"], "_v", "file_no", 1 << 24).drop("_v")


def affine_of_two_points(points: DataFrame) -> DataFrame:
    """Axis-aligned image-to-map transform from two points (j, i) -> (x, y): a, c, e, f with x = a*j + c, y = e*i + f."""
    a = F.try_divide(F.col("x1") - F.col("x0"), F.col("j1") - F.col("j0"))
    e = F.try_divide(F.col("y1") - F.col("y0"), F.col("i1") - F.col("i0"))
    out = points.withColumns({"a": a, "e": e})
    return out.withColumns({"c": F.col("x0") - F.col("a") * F.col("j0"), "f": F.col("y0") - F.col("e") * F.col("i0")})
