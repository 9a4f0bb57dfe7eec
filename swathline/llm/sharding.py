"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. Packing depends only on how many groups there are of each size, and a corpus of ``n``
bytes has fewer than ``sqrt(2 n)`` different sizes, so one task packs this table: sizes in descending order enter the bin
with the least room that still holds them, found in a balanced tree. Groups then take their bin by their rank among those
of equal size. For a given number of shards the capacity is the smallest found by bisection; groups larger than an even share
get a shard each first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import stored

SHARDS = 16
RANK_ROWS = 100_000


class RoomTree:
    """Bins by room left, in a treap: a search tree on (room, bin) that is a heap on a fixed hash of the bin."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, weight, left, right]

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        return (key[1] * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) * 0xBF58476D1CE4E5B9 % (1 << 64)

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), self._weight((room, bin_)), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room that is ``size`` or more."""
        low, high = self._split(self.root, (size, -1))
        node = high
        while node is not None and node[2] is not None:
            node = node[2]
        if node is None:
            self.root = low
            return None
        room, bin_ = node[0]
        _, rest = self._split(high, (room, bin_ + 1))
        self.root = self._merge(low, rest)
        return room, bin_


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(size, bin, groups)`` in the order of filling, for ``(size, groups)`` in descending order; new bins open as needed.

    Equal sizes go in together: the tightest bin stays the tightest while it has room. None if more than ``most`` bins
    would be needed.
    """
    tree, bins, placed = RoomTree(), 0, []
    for size, groups in sizes:
        if size > capacity:
            raise ValueError("a group is larger than a shard")
        while groups:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found = capacity, bins
                bins += 1
            room, bin_ = found
            many = min(groups, room // size)
            placed.append((size, bin_, many))
            groups -= many
            tree.add(room - many * size, bin_)
    return placed


def even_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """``(size, shard, groups)`` over exactly ``shards`` bins of nearly equal filling."""
    left = [list(x) for x in sorted(sizes, reverse=True)]
    total = sum(s * n for s, n in left)
    alone: list[tuple[int, int, int]] = []
    while left and len(alone) < shards - 1 and left[0][0] * (shards - len(alone)) > total:
        size = left[0][0]
        alone.append((size, len(alone), 1))
        total -= size
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    rest = [(s, n) for s, n in left]
    if not rest:
        return alone
    bins = shards - len(alone)
    low = max(-(-total // bins), rest[0][0])
    high = low + rest[0][0]
    best = best_fit_decreasing(rest, high, bins)
    while low < high:  # to the smallest capacity that bisection finds: as many rounds as the largest size has binary digits
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return alone + [(s, b + len(alone), n) for s, b, n in best]


def _planned(shards: int):
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [x for b in batches for x in zip(b.column("total").to_pylist(), b.column("groups").to_pylist(), strict=True)]
        used: dict[int, int] = {}
        rows = []
        for size, shard, groups in even_shards(sizes, shards) if sizes else []:
            start = used.get(size, 0)
            used[size] = start + groups
            rows.append((size, start, start + groups, shard))
        columns = np.array(rows, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int32))], ["total", "low", "high", "shard"])

    return plan


def _ranked(df: DataFrame, keys: list[str], spread: Column, order: list[str], rows: int, name: str) -> DataFrame:
    """``df`` with a gapless rank from 0 within ``keys``, by windows over hash buckets and the counts of the buckets before."""
    dealt = df.withColumn("bucket", F.pmod(spread, F.lit(max(16, rows // RANK_ROWS))).cast("int"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).select(*keys, "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    return dealt.withColumn("own", own).join(starts, [*keys, "bucket"]).withColumn(name, (F.col("before") + F.col("own") - 1).cast("long")).drop("bucket", "own", "before")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row: sizes per shard nearly equal, equal texts in one shard.

    A size is the text's UTF-8 bytes plus one; a null text has no bytes and forms a group apart from empty texts. Rows that share
    a doc_id each have a slot. An empty table gives no rows; with fewer groups than shards some shards stay empty. A null
    doc_id is carried through. Other columns are not read.
    """
    text = F.col("text").cast("string")
    key = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))
    made = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            key.alias("key"),
        )
    )
    groups = stored(made.groupBy("key").agg(F.sum("size").alias("total")))
    plan = groups.groupBy("total").agg(F.count("*").alias("groups")).repartition(1).mapInArrow(_planned(shards), "total long, low long, high long, shard int")
    plan = stored(plan)
    ranked = _ranked(groups, ["total"], F.xxhash64("key"), ["key"], groups.count(), "rank")
    homes = ranked.join(plan, "total").where("rank >= low and rank < high").select("key", "shard")
    placed = stored(made.join(homes, "key").select("doc_id", "size", "text_crc32", "shard"))
    return _ranked(placed, ["shard"], F.xxhash64("doc_id", "text_crc32"), ["doc_id", "text_crc32"], made.count(), "slot")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``shard_documents`` with the law it keeps (sizes nearly equal) and no shard for one more."""
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
