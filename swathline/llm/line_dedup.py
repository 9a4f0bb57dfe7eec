"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents arrive in batches. A batch becomes one row per distinct line key, with the number of its documents that have it.
Keys that have reached the limit are settled: a batch is merge-anti-joined with the settled runs, and what is left is added
as a sorted run of counts. When a level holds ``FAN`` runs they are compacted into one run of the next level; keys that
reach the limit there move to a settled run of that level. Runs are bucketed and sorted by key, so that joins with them
move only the batch. The last compaction takes all levels together and makes the verdict exact.

A key is known by 128 bits of hash, so that even a trillion keys hold no two equal hashes by chance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm.common import slices, stored, text_of
from swathline.session import cut_lineage, own_path

BATCHES = 8
FAN = 4
SLOTS = 1 << 22
"""Bits of the table that tells lines and texts that can't be among the dropped ones; of fixed size, 0.5 MB."""
KEY = ["h1", "h2"]
BLANK = " \t\n\x0b\x0c\r"


def line_keys(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Offsets of the texts' lines, all lines, the code of each line's key, and per code its hash (two 64-bit numbers).

    Codes start from 0; the empty key has the code -1.
    """
    parts = pc.split_pattern(texts, "\n")
    lines = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64) - int(parts.offsets[0].as_py()) if len(parts) else np.zeros(1, np.int64)
    return offsets, lines, *_coded(lines)


def _coded(lines: pa.Array, min_chars: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANK)).dictionary_encode()
    codes = keys.indices.to_numpy().astype(np.int64)
    known = keys.dictionary
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in known.to_pylist())
    short = np.asarray(pc.less(pc.utf8_length(known), min_chars).to_numpy(zero_copy_only=False), dtype=bool)
    if short.any():
        codes = np.where(short[codes], -1, codes)
    return codes, np.frombuffer(digests, "<i8").reshape(-1, 2)


def _pairs(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) of the texts: rows, codes and the hash of each code; keys shorter than ``min_chars`` are left out."""
    parts = pc.split_pattern(texts, "\n")
    many = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    codes, hashes = _coded(parts.flatten(), min_chars)
    rows = np.repeat(np.arange(len(texts)), many)
    full = codes >= 0
    both = np.unique(rows[full] * max(len(hashes), 1) + codes[full])
    return both // max(len(hashes), 1), both % max(len(hashes), 1), hashes


def _counts(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, codes, hashes = _pairs(text_of(part), min_chars)
            arrival = part.column("batch").to_numpy()[rows].astype(np.int64)
            cells, n = np.unique(arrival * max(len(hashes), 1) + codes, return_counts=True)
            at = cells % max(len(hashes), 1)
            columns = [cells // max(len(hashes), 1), hashes[at, 0], hashes[at, 1], n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["batch", *KEY, "n"])

    return count


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``batch, h1, h2, n``: in how many rows of a batch a line key occurs. ``docs`` has ``text`` and ``batch``."""
    found = docs.mapInArrow(_counts(min_chars), "batch long, h1 long, h2 long, n long")
    return found.groupBy("batch", *KEY).agg(F.sum("n").alias("n"))


class LineRuns:
    """Counts of line keys as levelled sorted runs, to which batches are added.

    ``add`` takes a table ``h1, h2, n`` with one row per key; ``settled`` gives all keys found ``at_least`` times so far. Runs
    are bucketed tables below the shared folder; their names leave the catalog with ``close``.
    """

    def __init__(self, spark: SparkSession, at_least: int, fan: int = FAN, buckets: int | None = None) -> None:
        self.spark, self.at_least, self.fan = spark, at_least, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.known: list[str] = []
        self._paths: dict[str, str] = {}

    def _run(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, *KEY)
        path = own_path(self.spark)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def add(self, batch: DataFrame) -> None:
        """The batch's keys that no settled run has, as a run of the first level."""
        fresh = batch.select(*KEY, "n")
        for name in self.known:
            fresh = fresh.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        self._put(0, self._run(fresh))

    def _put(self, level: int, run: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            reached, rest = self._compacted(runs)
            self.known.append(self._run(reached))
            if len(self.known) >= self.fan:
                self.known = [self._run(self._union(self.known).distinct())]
            self._put(level + 1, self._run(rest))

    def _union(self, names: list[str]) -> DataFrame:
        """The runs' rows, read as plain files: a union of bucketed tables must not be taken for one bucketed table."""
        return reduce(DataFrame.union, [self.spark.read.schema(self.spark.table(n).schema).parquet(self._paths[n]) for n in names])

    def _compacted(self, runs: list[str]) -> tuple[DataFrame, DataFrame]:
        sums = cut_lineage(self._union(runs).groupBy(*KEY).agg(F.sum("n").alias("n")))
        return sums.where(F.col("n") >= self.at_least).select(*KEY), sums.where(F.col("n") < self.at_least)

    def settled(self) -> DataFrame:
        """Keys found ``at_least`` times in all batches: those of the settled runs, and of all levels together."""
        found = [self._union(self.known)] if self.known else []
        if runs := [r for level in self.levels for r in level]:
            sums = self._union(runs).groupBy(*KEY).agg(F.sum("n").alias("n"))
            found.append(sums.where(F.col("n") >= self.at_least).select(*KEY))
        if not found:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return stored(reduce(DataFrame.union, found)).distinct()

    def close(self) -> None:
        for name in self._paths:
            self.spark.sql(f"drop table if exists {name}")
        self._paths, self.levels, self.known = {}, [], []


def repeated_keys(docs: DataFrame, at_least: int, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """``h1, h2`` of the line keys found in ``at_least`` rows or more; ``docs`` is dealt into ``batches`` by its id."""
    dealt = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    counts = cut_lineage(line_counts(dealt, min_chars), by=("batch",))
    runs = LineRuns(docs.sparkSession, at_least)
    try:
        for batch in range(batches):
            runs.add(counts.where(F.col("batch") == batch))
        return runs.settled()
    finally:
        runs.close()


def _bits(keys: DataFrame, slot: Column) -> np.ndarray:
    """A bit per slot, set where a row falls into it; 64 slots are a row of the driver's table (``SLOTS`` / 64 at most)."""
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    rows = words.toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return table


def _has(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def _suspects(table: np.ndarray, min_chars: int):
    """Lines whose bit is set, with the signature of their text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, codes, hashes = _pairs(text_of(part), min_chars)
            may = _has(table, hashes[:, 0] & (SLOTS - 1))[codes] if len(codes) else np.zeros(0, bool)
            rows, codes = pa.array(rows[may]), codes[may]
            yield pa.RecordBatch.from_arrays(
                [part.column("s1").take(rows), part.column("s2").take(rows), pa.array(hashes[codes, 0]), pa.array(hashes[codes, 1])], ["s1", "s2", *KEY]
            )

    return find


def _cut(names: list[str], min_chars: int):
    """Texts without the lines whose keys are in ``dropped``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, lines, codes, hashes = line_keys(text_of(part))
            values, digests = lines.to_pylist(), hashes.tolist()
            short = np.asarray(pc.less(pc.utf8_length(pc.ascii_trim(lines, characters=BLANK)), min_chars).to_numpy(zero_copy_only=False), dtype=bool)
            kept, left = [], []
            for row, gone in enumerate(part.column("dropped").to_pylist()):
                out = {(d["h1"], d["h2"]) for d in gone or ()}
                span = range(offsets[row], offsets[row + 1])
                stay = [values[i] for i in span if short[i] or tuple(digests[codes[i]]) not in out]
                kept.append("\n".join(stay))
                left.append(len(span) - len(stay))
            own = [part.column(c) for c in names]
            many = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), many, pa.array(left, pa.int64())], [*names, "kept_text", "n_lines", "n_dropped"])

    return cut


def drop_repeated_lines(docs: DataFrame, at_least: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``kept_text, n_lines, n_dropped``: lines whose key is in ``at_least`` rows or more are gone from all rows.

    A key is the line without white space at its ends, in lower case (A-Z); keys under ``min_chars`` code points stay. A null
    or empty text is one empty line. Every row is a document of its own, also if it repeats another's id or text; ids may be
    null. An empty table gives no rows. Columns with the names of the three results are replaced.
    """
    out = ["kept_text", "n_lines", "n_dropped"]
    docs = docs.drop(*out)
    names = docs.columns
    keys = repeated_keys(docs, at_least, min_chars, batches)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    signed = docs.select(text.alias("text"), F.xxhash64(text).alias("s1"), F.xxhash64(F.lit(1), text).alias("s2"))
    table = _bits(keys, F.col("h1").bitwiseAND(F.lit(SLOTS - 1)))
    suspects = signed.mapInArrow(_suspects(table, min_chars), "s1 long, s2 long, h1 long, h2 long").distinct()  # copies are one text
    found = stored(suspects.join(keys, KEY, "left_semi"))
    dropped = stored(found.groupBy("s1", "s2").agg(F.collect_list(F.struct(*KEY)).alias("dropped")))  # at most a text's own lines

    # texts whose bit isn't set lose nothing and stay where they are
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    inner = [f"c{i}" for i in range(len(names))]
    here = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], text.alias("text"), F.xxhash64(text).alias("s1"), F.xxhash64(F.lit(1), text).alias("s2"))
    slot = F.col("s1").bitwiseAND(F.lit(SLOTS - 1))
    bits = docs.sparkSession.createDataFrame(pa.table({"w": np.flatnonzero(t := _bits(dropped, slot)), "b": t[t != 0]}))  # SLOTS / 64 rows at most
    marked = here.withColumn("w", F.shiftright(slot, 6)).join(F.broadcast(bits), "w", "left")
    marked = marked.withColumn("may", F.coalesce(F.expr("(shiftright(b, cast(s1 & 63 as int)) & 1) = 1"), F.lit(False)))
    whole = marked.where("not may").select(*inner, F.col("text").alias("kept_text"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    met = marked.where("may").select(*inner, "text", "s1", "s2").join(dropped, ["s1", "s2"], "left").select(*inner, "text", "dropped")
    types = [f.split("` ", 1)[1] for f in fields]
    cut = met.mapInArrow(_cut(inner, min_chars), ", ".join([*(f"{i} {t}" for i, t in zip(inner, types, strict=True)), "kept_text string, n_lines long, n_dropped long"]))
    return whole.union(cut).select(*[F.col(i).alias(c) for i, c in zip(inner, names, strict=True)], *out)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row; lines of 10 or more documents are dropped."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return drop_repeated_lines(texts).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
  )
),
gone as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select l.doc_id, l.i, l.line, g.key is not null as dropped from lines l left join gone g on l.key = g.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""
