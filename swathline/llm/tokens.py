"""Tokenizer files in tasks: loaded once per Python worker, equal pieces encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
_LOADED: dict[str, object] = {}


def once(key: str, make: Callable[[], object]):
    """``make()``, kept for the life of the Python worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def load_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


def encode_distinct(pieces: pa.Array, encode: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each piece, and the ids of all in order; ``encode`` gives packed 32-bit ids, once per distinct piece."""
    if not len(pieces):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    coded = pieces.dictionary_encode()
    each = [encode(p) for p in coded.dictionary.to_pylist()]
    lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.int32)
    at = coded.indices.to_numpy()
    many = lengths[at]
    source = (np.cumsum(lengths) - lengths)[at] - (np.cumsum(many) - many)
    return many, flat[np.repeat(source, many) + np.arange(int(many.sum()))]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of the texts in them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def _byte_level(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The byte-level tokenizer file as ranks: same vocabulary, pattern and special tokens, so the same ids, in less time.

    Such a file's merges make the tokens in the order of their ids, after the single bytes; anything else is refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in byte_alphabet().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    for i, merge in enumerate(spec["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if ranks[bytes(byte_of[c] for c in left + right)] != 256 + i:
            raise ValueError("the ids of this vocabulary don't follow its merges")
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), special


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the names of byte-level tokens."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encode_bytes(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text by the byte-level tokenizer file at ``path``: offsets per text and all ids."""
    encoding, special = once(f"ranks {path}", lambda: _byte_level(path))
    each = []
    for text in texts.to_pylist():
        allowed = {s for s in special if s in text}
        each.append(encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()))
    ids = np.concatenate(each).astype(np.int32) if each else np.zeros(0, np.int32)
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each))))), ids
