"""Token counts per section from one encoding of the whole document.

Encoding sections one by one gives other tokens at their borders. Here the whole text is encoded once; every token covers
the characters whose bytes it holds; these spans are joined with the sections' spans. A token inside one section counts
there. The rule for a token that touches several: it goes whole to the section that holds most of its characters, the
earlier one on a tie. So the counts of a document add up to its token count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import slices, text_of
from swathline.llm.tokens import BYTE_BPE, buffer_of, default_path, encode_bytes, load_tokenizer, once

Sections = Callable[[str], list[int]]
ROW = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"


def lines(text: str) -> list[int]:
    """Where sections start, in characters: each line with its line feed is one section."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def token_bytes(path: str) -> np.ndarray:
    """The number of text bytes of each id."""
    tokenizer = load_tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return np.array([len(n.encode()) if n in special else len(n) for n in names], np.int64)


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (first and last character of each) per section, and those of them that cross a border."""
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, last, side="right") - 1
    owner = a.copy()
    over = np.flatnonzero(a != b)
    stops = np.append(starts[1:], length)
    for t in over:
        spans = np.minimum(stops[a[t] : b[t] + 1], last[t] + 1) - np.maximum(starts[a[t] : b[t] + 1], first[t])
        owner[t] = a[t] + int(np.argmax(spans))  # the first of equal ones
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[over], minlength=len(starts))


def _counts(path: str, sections: Sections):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = once(f"bytes {path}", lambda: token_bytes(path))
        for part in slices(batches):
            texts = text_of(part)
            raw, at = buffer_of(texts)
            offsets, ids = encode_bytes(texts, path)
            character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte, over all texts
            ends = np.cumsum(sizes[ids])
            first, last = character[ends - sizes[ids]], character[ends - 1]
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for row, text in enumerate(texts.to_pylist()):
                starts = np.array(sections(text), np.int64)
                lo, hi = offsets[row], offsets[row + 1]
                base = character[at[row]] if text else 0
                many, crossing = attribute(first[lo:hi] - base, last[lo:hi] - base, starts, len(text))
                k = len(starts)
                values = (np.full(k, row), np.arange(k), starts, np.append(starts[1:], len(text)), many, crossing, np.full(k, hi - lo))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            row, *rest = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])],
                ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return counts


def section_token_counts(docs: DataFrame, sections: Sections = lines, path: str | None = None) -> DataFrame:
    """One row per document and section: its characters ``start`` to ``stop``, its tokens, those of them allocated to it
    though they cross a border, and the document's tokens.

    ``sections`` gives the ascending first characters of a text's sections, 0 first. A null or empty text has one empty
    section without tokens. Rows that share a doc_id are counted each; a null doc_id is carried through; other columns are
    not read. Byte-level vocabularies only (a token's bytes are bytes of the text).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(path or default_path(BYTE_BPE), sections), ROW)
