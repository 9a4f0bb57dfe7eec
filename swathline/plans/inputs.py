"""Cubes, trajectories, rasters and tie tables derived from the given parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 20
LINES_PER_FILE = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def idiv(a: Column | str, b: int) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / b).cast("bigint")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """B1, one row per pixel: file_id, line, sample, spectrum ARRAY<DOUBLE>, dns ARRAY<BIGINT>."""
    line = idiv("vec_id", SAMPLES)
    return table(spark, sf, "embeddings").select(
        idiv(line, LINES_PER_FILE).alias("file_id"),
        line.alias("line"),
        (F.col("vec_id") % SAMPLES).alias("sample"),
        F.col("embedding").cast("array<double>").alias("spectrum"),
        F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 20000)).alias("dns"),
    )


def to_long(px: DataFrame, array: str, value: str) -> DataFrame:
    """Explode an array column to (band, value) rows."""
    keep = [c for c in px.columns if c not in ("spectrum", "dns")]
    return px.select(*keep, F.posexplode(array).alias("band", value))


def pixels_long(spark: SparkSession, sf: str) -> DataFrame:
    """B1 long: file_id, line, sample, band, dn."""
    return to_long(pixels(spark, sf), "dns", "dn")


ROWS_PER_TASK = 1 << 19


def pixels_big(spark: SparkSession, sf: str) -> DataFrame:
    """B2: line, sample, dns ARRAY<BIGINT> (4 bands).

    Lines are dealt to as many tasks as the rows ask for, so that the tables of a task's aggregates keep their size as the
    input grows; what is grouped by line afterwards needs no other shuffle.
    """
    li = table(spark, sf, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // ROWS_PER_TASK + 1)
    bands = [
        F.col("l_quantity"), F.round(F.col("l_extendedprice") * 100), F.round(F.col("l_discount") * 100),
        F.round(F.col("l_tax") * 100),
    ]
    return (
        li.select(
            F.col("l_orderkey").alias("line"), (F.col("l_linenumber") - 1).cast("bigint").alias("sample"),
            *[b.cast("bigint").alias(f"b{k}") for k, b in enumerate(bands)],
        )
        .repartition(tasks, "line")
        .groupBy("line", "sample")
        .agg(*[F.max(f"b{k}").alias(f"b{k}") for k in range(4)])
        .select("line", "sample", F.array("b0", "b1", "b2", "b3").alias("dns"))
    )


def dark(spark: SparkSession, sf: str) -> DataFrame:
    """B3: sample, dark ARRAY<BIGINT>, the truncated mean of dn-15000 over file 0, floored at 0."""
    first = pixels(spark, sf).where("file_id = 0")
    per_band = to_long(first, "dns", "dn").groupBy("sample", "band").agg(
        F.greatest(F.lit(0), F.expr("sum(dn - 15000) div count(1)")).alias("d")
    )
    return per_band.groupBy("sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", "d"))), lambda x: x["d"]).alias("dark")
    )


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def poses_raw(spark: SparkSession, sf: str) -> DataFrame:
    """B4: flight, n, t, roll, pitch, yaw, lon, lat, height."""
    e = F.col("event_id")
    return table(spark, sf, "events").where("event_type <> 'view'").select(
        F.col("user_id").alias("flight"), e.alias("n"), _seconds("ts").alias("t"),
        ((e % 41 - 20) / 100).alias("roll"), ((e % 37 - 18) / 100).alias("pitch"), ((e % 629 - 314) / 100).alias("yaw"),
        (6 + (e % 777) / 1e4).alias("lon"), (46 + (e % 1000) / 1e4).alias("lat"),
        (400 + F.col("value")).alias("height"),
    )


def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """B5: flight, line, t; line = position of the exposure in its flight."""
    from swathline.plans.ordered import with_row_index

    views = table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("user_id").alias("flight"), _seconds("ts").alias("t")
    )
    return with_row_index(views, ["flight"], "t", "line").select("flight", "line", "t")


def header_text(spark: SparkSession, sf: str) -> DataFrame:
    """B6 as raw header text: path, text. Nation 13 lacks its line count."""
    k = F.col("n_nationkey")
    rows = [
        F.lit("ENVI"),
        F.when(k != 13, F.concat(F.lit("lines = "), (100 + 7 * k).cast("string"))),
        F.lit(" samples= 20 "), F.lit("bands =64"), F.lit("data type = 12"), F.lit("interleave = bil"),
        F.concat(F.lit("framerate = "), (10 + k % 5).cast("string")),
        F.lit("field of view = 35"), F.lit("ceiling = 40000"), F.lit("comment = a = b"),
    ]
    return table(spark, sf, "nation").select(
        F.concat(F.lit("run/seq-"), k.cast("string"), F.lit("/frame.bil")).alias("path"),
        F.concat_ws("\n", *rows).alias("text"),
    )


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """B6 typed: path, seq, file_no, lines (NULL for nation 13), samples, bands, framerate, ceiling."""
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("run/seq-"), k.cast("string"), F.lit("/frame.bil")).alias("path"),
        F.col("n_regionkey").cast("bigint").alias("seq"), k.alias("file_no"),
        F.when(k != 13, 100 + 7 * k).alias("lines"), F.lit(20).cast("bigint").alias("samples"),
        F.lit(64).cast("bigint").alias("bands"), (10 + k % 5).cast("double").alias("framerate"),
        F.when(k % 3 != 0, F.lit(40000)).cast("bigint").alias("ceiling"),
    )


def dtm(spark: SparkSession, sf: str) -> DataFrame:
    """B7: i, j, z on a grid 50 wide; every 97th cell is void."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        idiv("p_partkey", 50).alias("i"), (k % 50).alias("j"), F.when(k % 97 != 0, F.col("p_retailprice")).alias("z")
    )


def projected(px: DataFrame) -> DataFrame:
    """B8 columns on any (line, sample) table: pi, pj, NULL where the ray misses."""
    hit = (F.col("line") * 20 + F.col("sample")) % 53 != 0
    return px.withColumns({
        "pi": F.when(hit, F.col("line") * 0.73 + F.col("sample") * 0.11),
        "pj": F.when(hit, F.col("sample") * 0.87 + F.col("line") * 0.05),
    })


def landmark_obs(spark: SparkSession, sf: str) -> DataFrame:
    """B9: seq, obs_id, lm_id, x, y, enabled."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (k % 8).alias("seq"), k.alias("obs_id"), F.col("o_custkey").alias("lm_id"),
        ((k * 7919) % 2000 / 100).alias("x"), ((k * 104729) % 2400 / 100).alias("y"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
    )


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """B10: lm_id, x, y, z, is_set."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("lm_id"), (k % 97 / 10).alias("x"), (k % 89 / 10).alias("y"),
        (10 + F.col("c_nationkey")).cast("double").alias("z"), (F.col("c_acctbal") > 0).alias("is_set"),
    )


def tie_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B11: bils, chunks, matches."""
    bils = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("bil_id"))
    suppliers = table(spark, sf, "supplier")
    chunks = suppliers.select(F.col("s_suppkey").alias("chunk_id"), (F.col("s_nationkey") % 5).cast("bigint").alias("bil_id"))
    n = suppliers.agg(F.count(F.lit(1))).scalar()
    matches = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("c1"), (F.col("l_partkey") % n).alias("c2"),
        (F.col("l_quantity").cast("bigint") % 20).alias("x1"), F.col("l_linenumber").cast("bigint").alias("y1"),
        (F.col("l_partkey") % 20).alias("x2"), (F.col("l_orderkey") % 24).alias("y2"),
        (F.col("l_returnflag") == "N").alias("ok"),
    )
    return bils, chunks, matches


def shifts(px: DataFrame) -> DataFrame:
    """B12: line, dx; one row per pair of neighbouring lines."""
    lines = px.select("line").distinct()
    last = lines.agg(F.max("line")).scalar()
    return lines.where(F.col("line") < last).select("line", (((F.col("line") * 37) % 7 - 3) / 2).alias("dx"))


def frame_clock(spark: SparkSession, sf: str) -> DataFrame:
    """B14: line, clock, flag, tow, pps."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("line"), (e * 465).alias("clock"), (F.col("event_type") == "error").alias("flag"),
        (e * 1000).alias("tow"), (e * 465 - e % 200).alias("pps"),
    )


def line_poses(px: DataFrame) -> DataFrame:
    """A pose per cube line in terrain coordinates: file_id, line, r_0..2, p_0..2 (height 160 above a plane at 100)."""
    n = F.col("line")
    return px.select("file_id", "line").distinct().select(
        "file_id", "line", ((n % 7 - 3) / 100).alias("r_0"), ((n % 5 - 2) / 100).alias("r_1"), ((n % 3 - 1) / 100).alias("r_2"),
        (5 + n * 0.4).alias("p_0"), (25 + n % 4 * 0.1).alias("p_1"), F.lit(160.0).alias("p_2"),
    )


def flat_dtm(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of B7 at a height of 100 everywhere."""
    return dtm(spark, sf).select("i", "j", F.lit(100.0).alias("z"))
