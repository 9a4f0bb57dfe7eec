"""Quality rules as a short-circuit cascade.

Each rule looks at a slice of documents and says which fail. Cost and rejections of every rule are measured on a sample; the
rules then run in the order of rejections per second, each only on the documents that all rules before it have kept. A
document is kept if no rule rejects it, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import slices, split_words, text_of, word_hashes
from swathline.llm.tokens import buffer_of

SAMPLE = 1000
WINDOW = 8
BLANK = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = 1


def repeated_words(windows: np.ndarray, width: int) -> int:
    """Words in windows that occur twice or more; ``windows`` has a hash per start."""
    ranked = np.sort(windows)
    double = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(double):
        return 0
    starts = np.isin(windows, double)
    edge = np.zeros(len(windows) + width, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


class Texts:
    """A slice of texts with the measures that rules need, each made when it is first asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = texts

    def take(self, rows: np.ndarray) -> Texts:
        """The given rows, with the words and measures made so far."""
        some = Texts(self.texts.take(pa.array(rows)))
        for name, made in self.__dict__.items():
            if name == "_words":
                offsets, words = made
                many = np.diff(offsets)[rows]
                after = np.concatenate(([0], np.cumsum(many)))
                at = np.repeat(offsets[:-1][rows] - after[:-1], many) + np.arange(after[-1])
                some.__dict__[name] = after, words.take(pa.array(at))
            elif name != "texts":
                some.__dict__[name] = made[rows]
        return some

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def _words(self) -> tuple[np.ndarray, pa.Array]:
        return split_words(self.texts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[0])

    @cached_property
    def word_chars(self) -> np.ndarray:
        offsets, words = self._words
        lengths = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False)))) if len(words) else np.zeros(1)
        return np.diff(lengths[offsets]).astype(np.int64)

    def _bytes_of(self, table: np.ndarray) -> np.ndarray:
        raw, offsets = buffer_of(self.texts)
        return np.diff(np.concatenate(([0], np.cumsum(table[raw])))[offsets])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._bytes_of(_SYMBOL)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._bytes_of(_UPPER)

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._bytes_of(_LETTER)

    @cached_property
    def _lines(self) -> np.ndarray:
        out = np.zeros((len(self.texts), 2), np.int64)
        for row, text in enumerate(self.texts.to_pylist()):
            lines = [line for line in text.split("\n") if line.strip(BLANK)]
            out[row] = len(lines), len(lines) - len(set(lines))
        return out

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[:, 0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[:, 1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        offsets, words = self._words
        hashed = word_hashes(words)
        step, rolled = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(hashed), np.uint64)
        for k in range(WINDOW):
            rolled[: max(0, len(hashed) - k)] = rolled[: max(0, len(hashed) - k)] * step + hashed[k:]
        spans = zip(offsets[:-1], offsets[1:], strict=True)
        return np.array([repeated_words(rolled[a : b - WINDOW + 1], WINDOW) if b - a > WINDOW else 0 for a, b in spans], np.int64)


Rule = Callable[[Texts], np.ndarray]

#: Name and test of each rule; True rejects. All compare whole numbers, so any engine gives the same verdicts.
RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 20,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > t.n_lines,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words),
    "capitals": lambda t: 10 * t.n_upper > 6 * t.n_letters,
}


def run_cascade(texts: Texts, order: list[str]) -> np.ndarray:
    """Whether each text is kept; every rule sees only what those before it kept."""
    kept = np.ones(len(texts), bool)
    rows, left = np.arange(len(texts)), texts
    for name in order:
        if not len(rows):
            break
        bad = RULES[name](left)
        kept[rows[bad]] = False
        if bad.any():
            rows = rows[~bad]
            left = left.take(np.flatnonzero(~bad))
    return kept


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Texts(text_of(part))._words  # made once for all rules, so charged to none
        for name, rule in RULES.items():
            texts = Texts(text_of(part))
            texts.__dict__["_words"] = words
            start = time.perf_counter()
            bad = int(rule(texts).sum())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([time.perf_counter() - start]), pa.array([bad], pa.int64())], ["rule", "cost", "bad"])


def rule_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Rules by rejections per second, measured on about ``sample`` rows, each drawn by itself whatever its id or text.

    A tie or an empty sample leaves the given order. The order decides cost alone, never a verdict.
    """
    some = docs.sample(min(1.0, sample / max(1, docs.count())), seed=7).select(F.col("text").cast("string").alias("text"))
    rows = some.mapInArrow(_measured, "rule string, cost double, bad long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("bad")).collect()
    worth = {r["rule"]: r["bad"] / max(r["cost"], 1e-9) for r in rows}
    return sorted(RULES, key=lambda name: -worth.get(name, 0.0))


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. A null text counts as empty and has too few words."""
    order = order or rule_order(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(run_cascade(Texts(text_of(part)), order)))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` per document.

    ``base_failed`` holds for fewer than 20 words or more than 30 % of words in repeated windows of eight. A null, empty or
    blank text has no words and fails. Rows that share a doc_id get a row each; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = order or rule_order(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(text_of(part))
            values = [getattr(texts, n) for n in names]
            failed = RULES["few_words"](texts) | RULES["repeated_words"](texts)
            kept = run_cascade(texts, order)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, values), pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    return docs.mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN p ON w.doc_id = p.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_upper > 6 * n_letters) AS kept
FROM m
"""
