"""Packing documents into fixed windows by minimum bin slack.

A document longer than a window gives full windows and one rest. What has to be packed is then described by a count per
length, at most one row per length up to the window, whatever the size of the corpus. On these counts each window takes the
longest rest that is left and the multiset of others that comes closest to the capacity, found by a subset-sum over bitsets
and traced back to counts. A filling is repeated as often as the counts allow, so the plan is a few thousand rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import slices, stored, text_of
from swathline.llm.tokens import BYTE_BPE, default_path, encode_bytes

WINDOW = 2048
END_ID = 1
RANK_ROWS = 100_000
PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def closest_filling(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of the given lengths (each at most as often as counted) whose sum comes closest to ``room`` from below."""
    reach = 1
    full = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies taken together, sums reachable before this step
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


class Filling(NamedTuple):
    """So many windows in a row hold the same lengths."""

    windows: int
    lengths: dict[int, int]


def minimum_slack(counts: dict[int, int], window: int) -> list[Filling]:
    """Fillings that use up all counts (lengths from 1 to ``window``)."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = closest_filling(window - longest, {k: v for k, v in rest.items() if v > 0 and k <= window - longest})
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // v for k, v in chosen.items())
        plan.append(Filling(times, chosen))
        for k, v in chosen.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return plan


def _pieces(path: str, window: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, ids = encode_bytes(text_of(part), path)
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "total", "ids")}
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = np.append(ids[a:b], np.int32(END_ID)).astype("<u4")
                for start in range(0, len(own), window):
                    piece = own[start : start + window]
                    rows["row"].append(row)
                    rows["start"].append(start)
                    rows["length"].append(len(piece))
                    rows["crc"].append(zlib.crc32(piece.tobytes()))
                    rows["total"].append(len(own))
                    if keep_ids:
                        rows["ids"].append(piece.astype(np.int32))
            columns = [
                part.column("doc_id").take(pa.array(rows["row"], pa.int64())),
                pa.array(rows["start"], pa.int64()),
                pa.array(rows["length"], pa.int32()),
                pa.array(rows["crc"], pa.int64()),
                pa.array(rows["total"], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return pieces


def token_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into full windows and a rest: one row per piece, with its ids if asked for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path or default_path(BYTE_BPE), window, keep_ids), PIECE + (", ids array<int>" if keep_ids else ""))


def _places(plan: list[Filling]):
    """Gives every (length, rank) its sequence and offset: a lookup in the plan's sorted bounds."""
    rows = []
    used: dict[int, int] = {}
    sequence = 0
    for filling in plan:
        offset = 0
        for length, many in sorted(filling.lengths.items(), reverse=True):
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * filling.windows
            offset += length * many
        sequence += filling.windows
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    bounds = np.array([(r[0] << 48) + r[1] for r in rows], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(bounds, (length << 48) + rank, side="right") - 1]
            along = rank - row[:, 1]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(row[:, 3] + along // row[:, 2]), pa.array(row[:, 4] + along % row[:, 2] * length)],
                [*names, "sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece; sequences are numbered from 0.

    A null or empty text has the end id alone. Rows that share a doc_id are packed each. An empty table gives no rows. A null
    doc_id is carried through. Other columns are not read.
    """
    made = stored(token_pieces(docs, path, window))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    buckets = max(16, max(counts.values(), default=0) // RANK_ROWS)
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(starts, ["length", "bucket"]).withColumn("rank", (F.col("before") + F.col("own") - 1).cast("long"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = ranked.mapInArrow(_places(minimum_slack(counts, window)), PIECE + ", sequence_id long, offset long")
    return placed.withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the padded windows themselves, from the documents (unique doc_id) and their ``pack`` table."""
    pieces = token_pieces(docs, path, window, keep_ids=True).select("doc_id", "start", "ids")
    parts = pieces.join(packed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `window` ids
    flat = F.flatten(F.col("parts.ids"))
    return rows.select("sequence_id", F.concat(flat, F.array_repeat(F.lit(pad_id), F.lit(window) - F.size(flat))).alias("ids"))
