"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are windows of consecutive words, half as long again as the template, that begin at any of its words; line breaks and
signs don't matter, so a notice may be wrapped or stand behind comment signs. (A window that begins elsewhere holds no more
template words than the one that begins at its first.) A template is found in a block that holds at least nine tenths of its
distinct words. Its words are ordered by the number of documents in the whole corpus that hold them, rarest first. A block
that meets the threshold holds one of the first ``m - need + 1`` (prefix filter) and ``need`` places of template words at
least (length filter). The rest is looked up in that order, and a block goes as soon as the words behind the present one can't
suffice (positional filter). What is left at the end is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import slices, text_of
from swathline.llm.tokens import buffer_of

NUM, DEN = 9, 10
STRETCH = (3, 2)

# fixed values: phrases that must be found wherever their words stand in a row
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# fixed values: words of license notices
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law has waived all copyright and related or neighboring rights",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
    "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "reserved-notice": "copyright c all rights reserved",
}

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x30:0x3A] = np.arange(0x30, 0x3A)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)

VOCABULARY = sorted({w for t in [*TEMPLATES.values(), *PHRASES.values()] for w in t.split()})


def scan_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the words of each text, and for all words their place in the vocabulary (or -1)."""
    raw, offsets = buffer_of(texts)
    clean = _CLEAN[raw]
    is_word = clean != 0x20
    before = np.concatenate(([False], is_word[:-1])) if len(raw) else is_word
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    at = np.searchsorted(np.flatnonzero(is_word & ~before), offsets)
    copy = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(clean.tobytes())])
    words = pc.ascii_split_whitespace(copy).flatten()
    words = words.filter(pc.not_equal(words, ""))
    place = pc.index_in(words, value_set=pa.array(VOCABULARY))
    return at, pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts_of(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = np.zeros(len(VOCABULARY), np.int64)
    for part in slices(batches):
        at, place = scan_words(text_of(part))
        known = place >= 0
        pairs = np.unique(_texts_of(at)[known] * len(VOCABULARY) + place[known])
        many += np.bincount(pairs % len(VOCABULARY), minlength=len(many))
    yield pa.RecordBatch.from_arrays([pa.array(VOCABULARY), pa.array(many)], ["word", "texts"])


def _next_within(places: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether one of the ascending places lies in [start, start + width)."""
    return np.searchsorted(places, starts) < np.searchsorted(places, starts + width)


class Join:
    """Templates in global word order with the filters' bounds."""

    def __init__(self, frequency: dict[str, int], num: int = NUM, den: int = DEN) -> None:
        self.rank = np.empty(len(VOCABULARY), np.int64)
        order = sorted(range(len(VOCABULARY)), key=lambda i: (frequency.get(VOCABULARY[i], 0), VOCABULARY[i]))
        self.rank[order] = np.arange(len(order))
        self.names = list(TEMPLATES)
        self.lengths = [len(text.split()) for text in TEMPLATES.values()]
        self.ranks = [np.sort(self.rank[[VOCABULARY.index(w) for w in set(text.split())]]) for text in TEMPLATES.values()]
        self.need = [-(-num * len(own) // den) for own in self.ranks]

    def matches(self, place: np.ndarray, block: np.ndarray, stretch: tuple[int, int] | None = None) -> list[tuple[int, int, float]]:
        """(block, template, containment) of all that meet the threshold, the best window of a block counting.

        ``place`` and ``block`` are those of all words in order, blocks ascending. Windows are ``stretch`` times as long as the
        template and stay inside a block; without it a block is one window.
        """
        at = np.flatnonzero(place >= 0)
        word, block = self.rank[place[at]], block[at]
        widths = [-(-n * stretch[0] // stretch[1]) if stretch else len(place) + 1 for n in self.lengths]
        at = at + block * max(widths)  # no window reaches the next block
        found = []
        for t, (own, need, width) in enumerate(zip(self.ranks, self.need, widths, strict=True)):
            prefix = np.zeros(len(VOCABULARY), bool)
            prefix[own[: len(own) - need + 1]] = True
            rare = at[prefix[word]]
            if not len(rare):
                continue
            member = np.zeros(len(VOCABULARY), bool)
            member[own] = True
            mine = np.flatnonzero(member[word])
            here, which = at[mine], word[mine]
            left = np.flatnonzero(_next_within(rare, here, width))
            left = left[np.searchsorted(here, here[left] + width) - left >= need]
            lost = np.zeros(len(left), np.int64)
            for r in own.tolist():
                lost += ~_next_within(here[which == r], here[left], width)
                stays = lost <= len(own) - need
                left, lost = left[stays], lost[stays]
                if not len(left):
                    break
            best: dict[int, int] = {}
            for b, miss in zip(block[mine[left]].tolist(), lost.tolist(), strict=True):
                best[b] = min(miss, best.get(b, miss))
            found += [(b, t, (len(own) - miss) / len(own)) for b, miss in best.items()]
        return found


def word_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents of the corpus each template word stands (one row per template word)."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_frequencies, "word string, texts long")
    return {r["word"]: r["texts"] for r in rows.groupBy("word").agg(F.sum("texts").alias("texts")).collect()}


def _scan(join: Join):
    phrases = [(label, [VOCABULARY.index(w) for w in text.split()]) for label, text in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, place = scan_words(text_of(part))
            rows = part.num_rows
            many, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
            base: list[set[str]] = [set() for _ in range(rows)]
            score = np.zeros(rows)
            for label, words in phrases:
                k = len(words)
                hit = np.ones(max(0, len(place) - k + 1), bool)
                for j, w in enumerate(words):
                    hit &= place[j : len(place) - k + 1 + j] == w
                starts = np.flatnonzero(hit)
                row = np.searchsorted(at, starts, side="right") - 1
                inside = starts + k <= at[row + 1]
                for r, s in zip(row[inside].tolist(), (starts - at[row])[inside].tolist(), strict=True):
                    many[r] += 1
                    first[r] = s if first[r] < 0 else min(first[r], s)
                    last[r] = max(last[r], s)
                    base[r].add(label)
                    score[r] = 1.0
            labels = [set(b) for b in base]
            for r, t, share in join.matches(place, _texts_of(at), STRETCH):
                labels[r].add(join.names[t])
                score[r] = max(score[r], share)
            gone = pa.array(first < 0)
            columns = [
                part.column("doc_id"), pa.array(np.diff(at)), pa.array(many), pc.if_else(gone, None, pa.array(first)), pc.if_else(gone, None, pa.array(last)),
                pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b)) for b in labels]), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: words, places of the phrases, their first and last word, phrase labels, all labels and a score.

    ``score`` is 1 with a phrase, else the largest containment of a template in a window that meets the threshold, else 0. A null or
    empty text has no words and no labels. Rows that share a doc_id get a row each; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_scan(Join(word_frequencies(docs))), schema)


def _sql() -> str:
    def width(text: str) -> int:
        return -(-len(text.split()) * STRETCH[0] // STRETCH[1])

    def places(words: list[str]) -> str:
        tests = " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(words, 1))
        return f"list_filter(range(0, greatest(len(words) - {len(words) - 1}, 0)), lambda i: {tests})"

    templates = ", ".join(f"('{name}', {sorted(set(text.split()))}, {width(text)}::BIGINT)" for name, text in TEMPLATES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    token = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    found = ", ".join(f'{places(text.split())} AS "{name}"' for name, text in PHRASES.items())
    names = [f'"{n}"' for n in PHRASES]
    labels = "list_filter([" + ", ".join(f"CASE WHEN len(\"{n}\") > 0 THEN '{n}' END" for n in PHRASES) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower}, {token}) AS words FROM documents),
p AS (SELECT id, doc_id, len(words)::BIGINT AS n_words, {found} FROM w),
b AS (SELECT id, doc_id, n_words, list_concat(list_concat({names[0]}, {names[1]}), {names[2]}) AS starts, {labels} AS base FROM p),
t AS (SELECT * FROM (VALUES {templates}) AS v(name, tokens, width)),
c AS (SELECT id, words, t.* FROM w JOIN t ON {DEN} * len(list_intersect(list_distinct(words), tokens)) >= {NUM} * len(tokens)),
o AS (SELECT id, name, tokens, width, unnest(words) AS word, unnest(range(len(words))) AS pos FROM c),
x AS (SELECT id, name, len(tokens) AS m, width, word, pos FROM o WHERE list_contains(tokens, word)),
y AS (SELECT id, name, m, count(DISTINCT word) OVER (PARTITION BY id, name ORDER BY pos RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM x),
h AS (SELECT id, name, max(n / m) AS share FROM y WHERE {DEN} * n >= {NUM} * m GROUP BY id, name),
m AS (SELECT id, list(name) AS names, max(share) AS share FROM h GROUP BY id)
SELECT b.doc_id, n_words, len(starts)::BIGINT AS n_base, list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.names, [])))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN m ON b.id = m.id
"""


SQL = _sql()
