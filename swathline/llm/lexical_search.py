"""Ranked lexical search: best-first document intervals under range-maximum bounds.

The queries' terms are known before the documents are read, so each document is reduced to the counts of those terms. Blocks of
documents then get posting lists of impacts with a sparse table of range maxima. A query starts with one interval, a block's
documents. The maxima of its terms over the interval, summed, bound every score inside. The interval with the largest bound
is split at the document with the single largest impact: that document is scored, and the intervals left and right of it get
bounds of their own. Intervals that can't reach the best ``k`` found so far are given up, so the result is exact. Intervals
are taken in rounds of a few hundred, which only changes the order of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import slices, stored, text_of
from swathline.llm.tokens import buffer_of

TOP = 10
ITEMS_AT_ONCE = 4096
QUERY_BYTES = 8 << 20
"""Queries are taken in blocks of this many rows or bytes, so that a task holds a bounded part of them."""
BLOCK_POSTINGS = 1 << 19
ROUND = 256
SALTS = 64

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case: offsets per text and all terms."""
    raw, offsets = buffer_of(texts)
    folded = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8)
    if not len(folded):
        return np.zeros(len(offsets), np.int64), pa.array([], pa.string())
    inside = folded != 0x20
    edge = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])) | _starts(inside, offsets))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False])) | _ends(inside, offsets)) + 1
    terms = _packed(folded, edge, ends)
    return np.searchsorted(edge, offsets), terms


def _starts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of texts that begin inside a term."""
    mark = np.zeros(len(inside), bool)
    mark[offsets[:-1][offsets[:-1] < len(inside)]] = True
    return mark & inside


def _ends(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(inside), bool)
    mark[offsets[1:][offsets[1:] > 0] - 1] = True
    return mark & inside


def _packed(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings: the bytes between them are dropped."""
    keep = np.zeros(len(folded) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    data = folded[np.cumsum(keep[:-1]) > 0]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))


@dataclass
class Queries:
    """Queries as term codes: ``terms[first[i]:first[i + 1]]`` are the codes of query ``i`` with ``times`` each."""
    vocabulary: pa.Array
    first: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Queries:
        offsets, words = split_terms(texts)
        coded = words.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        cells, times = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        return Queries(coded.dictionary, np.searchsorted(cells // size, np.arange(len(texts) + 1)), cells % size, times)


def _term_counts(vocabulary: pa.Array):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for part in slices(batches):
            offsets, words = split_terms(text_of(part))
            coded = words.dictionary_encode()
            place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False), np.int64)
            codes = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            cells, many = np.unique((rows * size + codes)[codes >= 0], return_counts=True)
            ends = np.searchsorted(cells // size, np.arange(part.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array((cells % size).astype(np.int32)))
            times = pa.ListArray.from_arrays(pa.array(ends), pa.array(many.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), found, times], ["doc_id", "n_terms", "terms", "times"])

    return count


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Block:
    """Posting lists of some documents, term after term, with range maxima."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((docs, terms))
        self.n_docs = n_docs
        self.docs, self.impacts = docs[order].astype(np.int64), impacts[order]
        terms = terms[order].astype(np.int64)
        self.keys = terms * n_docs + self.docs
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        longest = int(np.diff(self.first).max(initial=1))
        self.levels = [np.arange(len(order))]  # places of the maxima over 1, 2, 4 ... postings; a list's ranges stay inside it
        while (2 << len(self.levels) - 1) <= longest:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            other = np.concatenate((last[half:], last[-half:]))
            self.levels.append(np.where(self.impacts[other] > self.impacts[last], other, last))
        self.levels = np.stack(self.levels)

    def best(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the largest impact in ``[low, high)``; an empty range has the value 0."""
        width = high - low
        full = width > 0
        level = np.frexp(np.maximum(width, 1).astype(float))[1] - 1
        a = self.levels[level, np.where(full, low, 0)]
        b = self.levels[level, np.where(full, high - (1 << level), 0)]
        place = np.where(self.impacts[b] > self.impacts[a], b, a)
        return place, np.where(full, self.impacts[place], 0)


class Best:
    """The best ``k`` rows of a query so far: scores descending, ids ascending (null last)."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a score has to reach: 1, or the last of ``k`` (which a smaller id may replace)."""
        return max(1, int(self.scores[-1])) if len(self.scores) >= self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores, ids, nulls = (np.concatenate(p) for p in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.nulls, nulls[fit])))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def search(block: Block, terms: np.ndarray, times: np.ndarray, ids: np.ndarray, nulls: np.ndarray, best: Best, step: int = ROUND) -> int:
    """Adds the block's documents to ``best``; the number of documents scored is returned."""
    if not len(block.docs) or not len(terms):
        return 0
    scored = 0
    low, high = block.first[terms][None, :], block.first[terms + 1][None, :]
    place, value = block.best(low, high)
    gain = np.maximum(value, 0) * times
    bound = gain.sum(axis=1)
    lead = place[np.arange(len(gain)), gain.argmax(axis=1)]
    live = bound >= best.least
    low, high, bound, lead = low[live], high[live], bound[live], lead[live]
    while len(bound):
        if len(bound) > step:
            order = np.argpartition(-bound, step - 1)
            now, later = order[:step], order[step:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, np.int64)
        doc = block.docs[lead[now]]
        wanted = terms[None, :] * block.n_docs + doc[:, None]
        at = np.searchsorted(block.keys, wanted)
        there = block.keys[np.minimum(at, len(block.keys) - 1)] == wanted
        score = (np.where(there, block.impacts[np.minimum(at, len(block.keys) - 1)], 0) * times).sum(axis=1)
        best.add(score, ids[doc], nulls[doc])
        scored += len(now)
        lows, highs = np.concatenate((low[now], at + there)), np.concatenate((at, high[now]))
        place, value = block.best(lows, highs)
        gain = np.maximum(value, 0) * times
        sums = gain.sum(axis=1)
        fit = sums >= best.least
        tops = place[np.arange(len(gain)), gain.argmax(axis=1)]
        stay = later[bound[later] >= best.least]
        low, high = np.concatenate((low[stay], lows[fit])), np.concatenate((high[stay], highs[fit]))
        bound, lead = np.concatenate((bound[stay], sums[fit])), np.concatenate((lead[stay], tops[fit]))
    return scored


def _searcher(queries: Queries, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in range(len(queries.first) - 1)]
        for part in _blocks(batches):
            ids = part.column("doc_id")
            nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            own = pc.fill_null(ids, 0).to_numpy()
            m = 100 - 75 + 75 * part.column("n_terms").to_numpy() * n_docs // n_terms
            rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("terms")).to_numpy())
            terms, times = (part.column(c).flatten().to_numpy() for c in ("terms", "times"))
            impacts = weight[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[rows]))
            block = Block(terms, rows, impacts, part.num_rows, len(weight))
            for i, found in enumerate(best):
                span = slice(queries.first[i], queries.first[i + 1])
                search(block, queries.terms[span], queries.times[span], own, nulls, found)
        rows = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.nulls for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(np.concatenate([b.scores for b in best]))], ["query", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined into blocks of about ``BLOCK_POSTINGS`` postings (a document's postings are no more than the query terms)."""
    held, many = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += len(batch.column("terms").flatten())
        if many >= BLOCK_POSTINGS:
            yield _joined(held)
            held, many = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` for each row of ``items`` (``item_id, text``).

    Null texts have no terms; an item without terms, or none of whose terms is in a document, gives no rows. Rows of items with
    equal ids and texts count once; with equal ids and other texts each is ranked on its own. Rows of documents that repeat an
    id are documents of their own; a null id comes last among equal scores. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(math.ceil(size["n"] / ITEMS_AT_ONCE), math.ceil(size["b"] / QUERY_BYTES), 1)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    for block in range(blocks):
        own = items.where(F.col("block") == block).select("item_id", "text").toArrow().combine_chunks()
        if own.num_rows:
            found = _rank_block(docs, own, k)
            out = found if blocks == 1 else out.union(found)
    return out


def _rank_block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries.of(pa.array(items.column("text").to_pylist(), pa.string()))
    counted = docs.mapInArrow(_term_counts(queries.vocabulary), "doc_id long, n_terms long, terms array<int>, times array<long>")
    counted = stored(counted.where("n_terms > 0"))
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    met = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row per query term
    df = np.zeros(max(len(queries.vocabulary), 1), np.int64)
    df[met.column("term").to_numpy()] = met.column("df").to_numpy()
    run = _searcher(queries, weights(df, total["n"]), total["n"], max(total["l"], 1), k)
    found = counted.mapInArrow(run, "query long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # each task has k rows of a query at most; they meet in two steps, so that no query's rows of all tasks are sorted at once
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("r") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"query": np.arange(items.num_rows), "item_id": items.column("item_id")}))
    return last.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # at most ITEMS_AT_ONCE names


_TERMS = "regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
with words as (select doc_id, {_LOWER.format("unnest(" + _TERMS + ")")} as term from documents),
counts as (select doc_id, term, count(*)::bigint as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
asked as (
  select item_id, term, count(*)::bigint as times from (select item_id, {_LOWER.format("unnest(" + _TERMS + ")")} as term from benchmark) group by all
),
weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from counts, total where term in (select term from asked) group by term, docs
),
impacts as (
  select c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) as impact
  from counts c join weighed using (term) join lengths using (doc_id), total
),
scores as (select item_id, doc_id, sum(times * impact)::bigint as score from asked join impacts using (term) group by all),
ranks as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranks where rank <= {TOP}
"""
