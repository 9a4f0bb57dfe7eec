"""BPE encoding at forced boundaries, and decoding.

Two neighbouring bytes that no vocabulary token holds side by side can never end up in one token, so the text may be cut
between them and the fragments encoded one by one. White space occurs in no token of the word vocabulary, so its bytes
give cuts all over a text; inside the words that remain, the pairs of the vocabulary give more. A fragment inside a word is
encoded without the word-end mark, the last one of a word with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from swathline.llm.common import slices, split_words, text_of
from swathline.llm.tokens import WORD_BPE, byte_alphabet, default_path, encode_distinct, load_tokenizer, once

DECODE_TOKENS = 1 << 20
ENCODE_BYTES = 4 << 20
WORDS_KEPT = 1 << 17
# fixed value: the word pattern of the vocabulary file; below it, what it comes to for letters before U+0250
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
LATIN_END = "\u0250"
OTHER_NUMBERS = re.compile("[\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]")


class ForcedBoundaries:
    """Encoder of single pieces (no ASCII white space inside) for a tokenizer file of BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.tokenizer = load_tokenizer(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        bodies = [token.removesuffix(self.end) for token in vocab]
        self.inside = {body[i : i + 2] for body in bodies for i in range(len(body) - 1)}
        blanks = {chr(0x100 + b) for b in (0x20, *range(0x09, 0x0E))}  # their stand-ins in the byte alphabet
        if any(blanks & set(pair) for pair in self.inside):
            raise ValueError("a token holds white space beside another byte: texts can't be cut there")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.middle = BPE(vocab=vocab, merges=merges)
        self.last = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.bytes_as = {b: ch for b, ch in byte_alphabet().items() if chr(b) != ch}
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        self.latin = bool(steps) and steps[0].get("pattern") == {"Regex": PATTERN}

    def fragments(self, word: str) -> list[str]:
        """The byte-level word cut between all pairs that no token holds."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def word_ids(self, word: str) -> bytes:
        """Packed ids of a byte-level word; short words are kept, and the store starts anew when it is full."""
        found = self.known.get(word)
        if found is None:
            *front, tail = self.fragments(word)
            ids = [t.id for f in front for t in self.middle.tokenize(f)] + [t.id for t in self.last.tokenize(tail)]
            found = np.array(ids, np.int32).tobytes()
            if len(word) <= 48:
                if len(self.known) >= WORDS_KEPT:
                    self.known = {}
                self.known[word] = found
        return found

    def piece_ids(self, piece: str) -> bytes:
        if "<|" in piece and any(s in piece for s in self.special):  # their strings are taken out before the text is normalized
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.int32).tobytes()
        lower = piece.lower()
        if self.latin and piece.isprintable() and (lower.isascii() or max(lower) < LATIN_END and not OTHER_NUMBERS.search(lower)):
            words = [lower] if lower.isalpha() else LATIN_WORDS.findall(lower)  # the same rules without a call per piece
            if not lower.isascii():
                words = [w.encode().decode("latin-1").translate(self.bytes_as) for w in words]
        else:
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]
        return self.word_ids(words[0]) if len(words) == 1 else b"".join(map(self.word_ids, words))


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forced = once(f"forced {path}", lambda: ForcedBoundaries(path))
        for part in slices(batches, limit=ENCODE_BYTES):
            offsets, words = split_words(text_of(part))
            many, ids = encode_distinct(words, forced.piece_ids)
            ends = np.concatenate(([0], np.cumsum(many)))[offsets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"]
            )

    return encode


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every whole text, as the tokenizers library encodes it without adding special tokens.

    A null or empty text, or one of white space, has no ids. Other columns are not read; repeated rows are encoded each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoder(path or default_path(WORD_BPE)), "doc_id long, ids array<int>")


def _decoder(path: str):
    def make() -> pa.Array:
        tokenizer = load_tokenizer(path)
        return pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], pa.string())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = once(f"names {path}", make)
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(lengths)
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + DECODE_TOKENS, side="right")))
                part = batch.slice(start, stop - start)
                own = np.concatenate(([0], np.cumsum(lengths[start:stop])))
                words = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), names.take(part.column("ids").flatten()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pc.binary_join(words, " ")], ["doc_id", "ids", "decoded"])
                start = stop

    return decode


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the text of the ids, special tokens kept; this vocabulary file names no decoder, so
    tokens are joined by blanks as the library does then. Null or empty ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path or default_path(WORD_BPE)), "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding every text."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
