"""Corpus pipeline: toxic and poor documents go, near duplicates leave one document, and the rest is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathline.llm.common import bounded_batches, stored, table
from swathline.llm.ngram_join import SLOTS, duplicate_groups, text_tag
from swathline.llm.packing import pack
from swathline.llm.quality import keep_good
from swathline.llm.toxicity import PREDICT, score_toxicity, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the limit; rules come from ``labels`` of the documents at hand."""
    out = "toxicity"
    while out in docs.columns:
        out += "_"
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")), out).where(F.col(out) < PREDICT).drop(out)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    bounded_batches(spark)
    return keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 on five-word shingles, the row with the smallest id (of one id's texts, that with the smallest hash).

    Rows are told apart by id and text: a repeated id with other texts is decided text by text, and of rows that repeat both one
    stays. Rows without an id or without a word are linked with nothing here and stay.
    """
    bounded_batches(spark)
    groups = stored(duplicate_groups(docs, width=5, num=4, den=5).where("doc_id is not null and group_id is not null"))
    first = groups.groupBy("group_id").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    units = groups.groupBy("group_id", "doc_id", "tag").agg(F.count("*").alias("n")).join(first, "group_id")
    stays = F.col("first") == F.struct("doc_id", "tag")
    decided = stored(units.where((F.col("n") > 1) | ~stays).select(F.col("doc_id").alias("id"), "tag", stays.alias("stays")))
    # only rows whose id falls in the slot of such an id are shuffled; the table of slots is bounded
    hit = F.broadcast(decided.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")).distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of our own beside those of any table
    known = [F.col("doc_id").cast("long").alias("id"), text_tag(F.col("text")).alias("tag")]
    placed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *known)
    placed = placed.withColumn("slot", F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SLOTS))))
    free = placed.join(hit, "slot", "left_anti").select(*names)
    met = placed.join(hit, "slot", "left_semi").join(decided, ["id", "tag"], "left")
    alone = met.where("stays is null").select(*names)
    one = met.where("stays").groupBy("id", "tag").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return free.union(alone).union(one).toDF(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    bounded_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack_windows),
]

ORACLE_SQL: str | None = None  # no SQL for deobfuscation, learned rules and packing: tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that ``STAGES`` make of ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
