"""Helpers shared by the corpus operators: table access, Arrow slices, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from swathline.session import cut_lineage

SLICE_BYTES = 2 << 20
"""Text handled at once inside a task; a single longer text makes a slice of its own."""


BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are cut at 4 MB of data: by rows alone, 10,000 long texts would be one batch on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back (lineage cut, survives lost executors)."""
    return cut_lineage(df)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()  # workers live on between tasks: give back what the batch took


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as plain strings without nulls; a null counts as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space: offsets per text (one more than texts) and all words in order."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64) - int(parts.offsets[0].as_py())
    full = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (finalizer of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles in lower case (A-Z only).

    A text with fewer words is one shingle; a text without words has none.
    """
    offsets, words = split_words(pc.ascii_lower(texts))
    hashed = word_hashes(words)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(hashed), np.uint64)
    for k in range(width):  # the sum weighs each place in the window by another power of the step
        ahead = hashed[k:] if k else hashed
        rolled[: len(ahead)] = rolled[: len(ahead)] * step + ahead
    whole = mix(rolled)
    for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
        count = stop - start
        if count >= width:
            yield np.unique(whole[start : stop - width + 1])
        elif count:
            total = np.full(1, count, np.uint64)
            for h in hashed[start:stop]:
                total = total * step + h
            yield mix(total)
        else:
            yield np.zeros(0, np.uint64)
