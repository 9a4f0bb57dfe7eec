"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits, in built-in functions only.

Every shingle is hashed once; its first bits name a bin, and each bin keeps its smallest hash. An empty bin borrows from the
bin that comes first in a pseudo-random order of its own among the filled ones, so two sets borrow alike. Of each bin's hash
the low-order byte is stored. Two unrelated bins agree by chance once in 256 times, and likeness is corrected for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import stored

WIDTH = 5
BINS = 128
BIN_BITS = 7
VALUE_BITS = 8
PRIME = 131  # the first prime above BINS + 1: multiplying by a smaller number permutes the bins
CHANCE = 1 / (1 << VALUE_BITS)
SLOT_BITS = 9
LEVEL_BITS = 16

_TIMES = [1 + (b * b * 37 + b * 101 + 11) % (PRIME - 1) for b in range(BINS)]
_PLUS = [(b * 59 + 7) % PRIME for b in range(BINS)]
TRIES = 8
# the bin that each bin asks first, second, ...: where (j + 1) * times + plus is 0, 1, ... (-1 or BINS and more: no bin)
_ASKED = [[(r - p) * pow(t, -1, PRIME) % PRIME - 1 for t, p in zip(_TIMES, _PLUS, strict=True)] for r in range(TRIES)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def shingle_keys(text: Column) -> Column:
    """63-bit hashes of the five-word shingles (lower case, words between ASCII white space), repeats included; a shorter text is
    one shingle, a text without words none."""
    blank = F.lit(" \t\n\x0b\x0c\r")

    def grams(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]), 1)
        )
        return F.when(F.size(h) >= WIDTH, many).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 1)))

    def words(inner: Column) -> Column:
        hashes = F.transform(F.split(inner, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
        return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(let(hashes, grams))

    return let(F.trim(F.lower(text), blank), words)


_SHIFT = 63 - BIN_BITS
_MASK = (1 << _SHIFT) - 1


def fingerprint(text: Column) -> Column:
    """``BINS`` signed bytes, or an empty array for a text without words.

    The largest key of every bin is added to the keys, so that after sorting the first key of each bin is its smallest hash
    or tells that the bin is empty.
    """
    largest, times, plus = F.lit([b << _SHIFT | _MASK for b in range(BINS)]), F.lit(_TIMES), F.lit(_PLUS)
    asked = [F.lit(row) for row in _ASKED]

    def first_of_bin(s: Column) -> Column:
        return F.filter(s, lambda k, i: (i == 0) | (F.shiftright(k, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))

    def low(key: Column) -> Column:
        return (key.bitwiseAND((1 << VALUE_BITS) - 1) - (1 << VALUE_BITS - 1)).cast("tinyint")

    def filled(key: Column) -> Column:
        return key.bitwiseAND(_MASK) != _MASK

    def dense(firsts: Column) -> Column:
        def tried(b: Column, row: Column) -> Column:
            key = F.get(firsts, F.get(row, b))
            return F.when(filled(key), low(key))

        def searched(b: Column) -> Column:  # the same order over all bins, for sets that fill few
            full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: filled(F.get(firsts, j)))
            turn = F.transform(full, lambda j: ((j + 1) * F.get(times, b) + F.get(plus, b)) % PRIME * BINS + j)
            return low(F.get(firsts, (F.array_min(turn) % BINS).cast("int")))

        def value(k: Column, b: Column) -> Column:
            return F.when(filled(k), low(k)).otherwise(F.coalesce(*[tried(b, row) for row in asked], searched(b)))

        return F.transform(firsts, value)

    def bins(keys: Column) -> Column:
        full = let(let(F.sort_array(F.concat(keys, largest)), first_of_bin), dense)
        return F.when(F.size(keys) > 0, full).otherwise(F.array().cast("array<tinyint>"))

    return let(shingle_keys(text), bins)


def packed(values: Column) -> Column:
    """The bytes in hexadecimal digits; empty for a text without words."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.substring(F.hex(v.cast("int") + 384), 2, 2))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, corrected for bytes that agree by chance; two texts without words are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    estimate = F.greatest(F.lit(0.0), (same / BINS - CHANCE) / (1 - CHANCE))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def successors(keys: DataFrame, bits: int) -> DataFrame:
    """``k, after`` for distinct signed numbers ``k`` of ``bits`` bits: the next larger one, null for the largest.

    Windows run within slots of ``2**LEVEL_BITS`` numbers; the way from a slot to the next filled one is found in the same way
    among slots, until their numbers are short. So no window holds more than ``2**LEVEL_BITS`` rows, however the numbers lie.
    """
    if bits <= LEVEL_BITS:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("after"))
    placed = keys.select("k", F.shiftright("k", LEVEL_BITS).alias("slot"))
    inner = placed.select("k", "slot", F.lead("k").over(Window.partitionBy("slot").orderBy("k")).alias("after"))
    firsts = placed.groupBy("slot").agg(F.min("k").alias("first"))
    up = successors(firsts.select(F.col("slot").alias("k")), bits - LEVEL_BITS)
    ways = up.join(firsts, F.col("after") == F.col("slot")).select(F.col("k").alias("slot"), "first")
    return inner.join(ways, "slot", "left").select("k", F.coalesce("after", "first").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id not null, text, fp) with text and fp of the next row by doc_id and text; after the last comes the first.

    Rows meet in slots of ``2**SLOT_BITS`` ids. The last row of a slot takes the first row of the next filled slot.
    """
    docs = docs.withColumn("slot", F.shiftright("doc_id", SLOT_BITS))
    firsts = stored(docs.groupBy("slot").agg(F.min("doc_id").alias("doc_id")))
    heads = docs.select("doc_id", "text").join(firsts, "doc_id").groupBy("slot").agg(F.min("text").alias("next_text"))
    heads = heads.select("slot", "next_text", fingerprint(F.col("next_text")).alias("next_fp"))
    order = stored(successors(firsts.select(F.col("slot").alias("k")), 64 - SLOT_BITS))
    lowest = order.agg(F.min("k")).first()[0]
    links = order.select(F.col("k").alias("from"), F.coalesce("after", F.lit(lowest)).alias("slot"))
    borders = heads.join(links, "slot").select(F.col("from").alias("slot"), F.col("next_text").alias("border_text"), F.col("next_fp").alias("border_fp"))
    w = Window.partitionBy("slot").orderBy("doc_id", "text")
    led = docs.withColumns({"lead_text": F.lead("text").over(w), "lead_fp": F.lead("fp").over(w)})
    return led.join(borders, "slot", "left").select(
        "doc_id", "text", "fp", F.coalesce("lead_text", "border_text").alias("next_text"), F.coalesce("lead_fp", "border_fp").alias("next_fp")
    )


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that of the next document.

    The edit replaces the last quarter of the code points by the first ones of the next document. A null text counts as empty.
    Rows that repeat a doc_id follow each other by text. A row without doc_id has no next document: its edit drops the last
    quarter, and ``near_next`` is null. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    made = docs.withColumn("fp", fingerprint(F.col("text")))
    alone = made.where("doc_id is null").select("doc_id", "text", "fp", F.lit("").alias("next_text"), F.lit(None).cast("array<tinyint>").alias("next_fp"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next_text", quarter))
    both = with_next(made.where("doc_id is not null")).union(alone).withColumns({"n_chars": n.cast("long"), "edited": edited})
    both = both.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        F.when(F.col("next_fp").isNotNull(), likeness(F.col("fp"), F.col("next_fp"))).alias("near_next"),
    )
