import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathline.llm import bpe, packing, tokens
from swathline.llm.token_counts import lines, section_token_counts
from tests.llm.fixtures import awkward_texts, repeated, table


def library(name):
    return Tokenizer.from_file(tokens.default_path(name))


def test_forced_boundaries_round_trip(spark):
    tokenizer = library(tokens.WORD_BPE)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(table(spark)).collect()}
    for i, text in enumerate(awkward_texts(), 10):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(repeated(spark)).count() == 6
    assert bpe.round_trip_digests(table(spark, [], [])).count() == 0


def test_no_token_reaches_over_a_cut():
    forced = bpe.ForcedBoundaries(tokens.default_path(tokens.WORD_BPE))
    tokenizer = library(tokens.WORD_BPE)
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x260), 0x130, 0x307, 0x3A3, 0x3B1, 0x2028, 0xA0, 0x416, 0x4E2D, 0x1F600]] + ["'s", "ing", "<|endoftext|>"]
    cuts = 0
    for _ in range(3000):
        piece = "".join(rng.choices(alphabet, k=rng.randrange(1, 12)))
        assert np.frombuffer(forced.piece_ids(piece), np.int32).tolist() == tokenizer.encode(piece, add_special_tokens=False).ids
        cuts += len(forced.fragments(piece)) > 1
    assert cuts > 1000


def test_byte_level_ranks_equal_the_library():
    path = tokens.default_path(tokens.BYTE_BPE)
    tokenizer = library(tokens.BYTE_BPE)
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2000, 0x2028, 0x3000, *range(0xA1, 0x250), 0x4E2D, 0x1F600, 0x301]]
    texts = ["".join(rng.choices([*alphabet, "  ", "'s", "<|endoftext|>", "\n\n"], k=rng.randrange(30))) for _ in range(5000)]
    offsets, ids = tokens.encode_bytes(pa.array(texts), path)
    for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[offsets[k] : offsets[k + 1]].tolist()


def test_packing(spark):
    tokenizer = library(tokens.BYTE_BPE)
    rows = packing.pack(table(spark)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for i, text in enumerate(awkward_texts(), 10):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert len(by_sequence) == -(-total // packing.WINDOW)
    assert packing.pack(repeated(spark)).count() == 6
    assert packing.pack(table(spark, [], [])).count() == 0
    docs = table(spark)
    windows = packing.sequences(docs, packing.pack(docs)).collect()
    assert {len(r["ids"]) for r in windows} == {packing.WINDOW} and len(windows) == len(by_sequence)


def test_closest_filling_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        chosen = packing.closest_filling(room, counts)
        assert sum(k * v for k, v in chosen.items()) == max(sums)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_plan_uses_every_length_once():
    rng = random.Random(6)
    counts = {k: rng.randrange(1, 500) for k in rng.sample(range(1, 2049), 300)}
    used = defaultdict(int)
    for filling in packing.minimum_slack(counts, 2048):
        assert sum(k * v for k, v in filling.lengths.items()) <= 2048
        for k, v in filling.lengths.items():
            used[k] += v * filling.windows
    assert used == counts


def test_section_counts(spark):
    def halves(text):
        return sorted({0, len(text) // 2, len(text) // 2 + 1}) if len(text) > 1 else [0]

    tokenizer = library(tokens.BYTE_BPE)
    for sections in (lines, halves):
        got = defaultdict(dict)
        for r in section_token_counts(table(spark), sections).collect():
            got[r["doc_id"]][r["section"]] = (r["start"], r["stop"], r["n_tokens"], r["n_crossing"])
        for i, text in enumerate(awkward_texts(), 10):
            text = text or ""
            starts = sections(text)
            stops = [*starts[1:], len(text)]
            many, crossing = [0] * len(starts), [0] * len(starts)
            for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
                shares = [min(b, stops[k]) - max(a, starts[k]) for k in range(len(starts))]
                best = shares.index(max(shares))
                many[best] += 1
                crossing[best] += shares[best] < b - a
            assert [got[i][k] for k in range(len(starts))] == list(zip(starts, stops, many, crossing, strict=True))
    sums = section_token_counts(table(spark)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d")).where("n <> d")
    assert sums.count() == 0
    assert section_token_counts(repeated(spark)).count() == 6
    assert section_token_counts(table(spark, [], [])).count() == 0
