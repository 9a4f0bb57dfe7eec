"""The registered queries of the corpus operators and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swathline.llm import bpe, conversation_trie, lexical_search, licenses, line_dedup, ngram_join, packing, quality, warc
from swathline.llm.common import table
from swathline.llm.fingerprints import fingerprint_table
from swathline.llm.ngram_join import near_duplicates
from swathline.llm.sharding import shard_table
from swathline.llm.token_counts import section_token_counts
from swathline.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at Jaccard 0.85 on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding at forced boundaries and decoding of every text."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_table(table(spark, sf_dir, "documents"))


def op5_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per line of every document, from whole-document encodings."""
    return section_token_counts(table(spark, sf_dir, "documents"))


def op7_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its restored text."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_table(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations with its members and subtree."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them hold."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_bpe_forced_boundaries": op3_bpe_forced_boundaries,
    "op4_best_fit_shards": op4_best_fit_shards,
    "op5_license_set_join": op5_license_set_join,
    "op6_section_token_counts": op6_section_token_counts,
    "op7_minimum_slack_packing": op7_minimum_slack_packing,
    "op8_toxicity_deobfuscation": op8_toxicity_deobfuscation,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_minhash_fingerprints": op10_minhash_fingerprints,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.sql(4, 85, 100),
    "op2_warc_zstd": warc.SQL,
    "op5_license_set_join": licenses.SQL,
    "op9_quality_cascade": quality.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_ranked_search": lexical_search.SQL,
    "op13_line_dedup": line_dedup.SQL,
}
