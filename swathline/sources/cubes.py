"""Binary cubes and raw frames: headers, listings and plans of what to read."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.sources import datasource, text
from swathline.sources.codec import FRAME_BANDS, FRAME_SAMPLES, TYPES, file_system, opened, store_uri  # noqa: F401

FRAME_HEADER_BYTES = FRAME_SAMPLES * 2
FRAME_LINE_BYTES = FRAME_HEADER_BYTES * (FRAME_BANDS + 1)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """All headers below ``folder``: path of the cube, valid, kv. 'x.bil.hdr' and 'x.hdr' both belong to 'x.bil'."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hdr").text(folder, wholetext=True)
    cube = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"\.hdr$", ""), r"(?<!\.bil)$", ".bil")
    return text.parse_headers(texts.select(cube.alias("path"), F.col("value").alias("text")))


def list_cubes(spark: SparkSession, folder: str) -> DataFrame:
    """Cube files below ``folder`` in sequence order; only names are read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bil").load(folder)
    return text.list_sequence(files.select(F.col("_metadata.file_path").alias("path")))  # spelled as in read_headers


def line_blocks(files: DataFrame, first: int = 0, last: int = -1, block: int = 64) -> DataFrame:
    """Blocks of lines to read: adds start, count. ``files`` has lines and line0 (first global line of the file).

    Files and blocks outside [first, last) are gone before anything is opened; last = -1 means to the end.
    """
    top = F.col("lines") if last < 0 else F.least(F.col("lines"), last - F.col("line0"))
    low = F.greatest(F.lit(0).cast("bigint"), first - F.col("line0"))
    wanted = files.withColumns({"_a": low, "_b": top}).where("_a < _b")
    starts = F.sequence(F.col("_a"), F.col("_b") - 1, F.lit(block).cast("bigint"))
    cut = wanted.withColumn("start", F.explode(starts))
    return cut.withColumn("count", F.least(F.lit(block), F.col("_b") - F.col("start"))).drop("_a", "_b")


def read_sequence(spark: SparkSession, folder: str, first: int = 0, last: int = -1, bands: list[int] | None = None, block: int = 64) -> DataFrame:
    """All cubes of a folder as one sequence of lines.

    A cube whose header is missing or unreadable, or that differs from the others in samples, bands, type or interleave, is
    an error: leaving it out would give all later lines wrong numbers. Only headers are looked at here. Later filters on
    ``line`` and ``path`` reach the reader, which then plans no other blocks.
    """
    typed = text.typed_headers(read_headers(spark, folder))
    files = list_cubes(spark, folder).join(typed, "path", "left").withColumn("seq", F.lit(0))
    shape = ["samples", "bands", "data_type", "interleave"]
    unread = files.where(F.col("lines").isNull() | F.col("samples").isNull() | F.col("bands").isNull()).select("path").take(5)
    if unread:
        raise ValueError("no usable header: " + ", ".join(r["path"] for r in unread))
    kinds = files.select(*shape).distinct().take(2)
    if len(kinds) > 1:
        raise ValueError(f"cubes of one sequence differ: {kinds[0].asDict()}, {kinds[1].asDict()}")
    datasource.register(spark)
    options = {"path": folder, "first": first, "last": last, "block": block} | ({} if bands is None else {"bands": json.dumps(bands)})
    return spark.read.format(datasource.CUBE).options(**options).load().select("path", "line", "sample", "spectrum")


def list_frames(spark: SparkSession, pattern: str) -> DataFrame:
    """Raw frames: path, lines (from the file size)."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.floor(F.col("length") / FRAME_LINE_BYTES).alias("lines"))


def read_frames(frames: DataFrame, block: int = 16, headers_only: bool = False) -> DataFrame:
    """Lines of raw frames: path, line, header BINARY and, unless ``headers_only``, data ARRAY<INT> (band by band).

    A short read gives a line of zeros.
    """
    blocks = line_blocks(frames.withColumn("line0", F.lit(0).cast("bigint")), block=block).select("path", "start", "count")

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples(index=False):
                with opened(b.path) as f:
                    for line in range(int(b.start), int(b.start + b.count)):
                        f.seek(line * FRAME_LINE_BYTES)
                        size = FRAME_HEADER_BYTES if headers_only else FRAME_LINE_BYTES
                        raw = f.read(size)
                        raw = raw if len(raw) == size else bytes(size)
                        row = {"path": [b.path], "line": [line], "header": [raw[:FRAME_HEADER_BYTES]]}
                        if not headers_only:
                            row["data"] = [np.frombuffer(raw[FRAME_HEADER_BYTES:], "<u2").astype("int32")]
                        yield pd.DataFrame(row)

    schema = "path string, line bigint, header binary" + ("" if headers_only else ", data array<int>")
    return blocks.repartition("path", "start").mapInPandas(decode, schema)
