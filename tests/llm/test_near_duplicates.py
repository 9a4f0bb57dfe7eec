import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from swathline.llm import ngram_join
from swathline.llm.components import components
from swathline.llm.ngram_join import near_duplicates
from tests.llm.fixtures import LOWER, awkward_texts, repeated, table


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_awkward_table(spark, width, num, den):
    texts = awkward_texts()
    rows = list(zip(range(10, 10 + len(texts)), texts, strict=True))
    assert result(near_duplicates(table(spark), width, num, den)) == brute(rows, width, num, den)


def test_near_copies_with_a_common_passage(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(90)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words) + (" " + passage if rng.random() < 0.7 else ""))
    texts += [passage + f" q{i} r{i}" for i in range(12)]
    rows = list(enumerate(texts))
    want = brute(rows, 4, 85, 100)
    assert len({c for _, c in want.values()}) < len(rows)
    df = table(spark, texts, range(len(texts)))
    assert result(near_duplicates(df, 4, 85, 100)) == want
    monkeypatch.setattr(ngram_join, "COMMON", 0)  # the order of shingles never changes the result
    assert result(near_duplicates(df, 4, 85, 100)) == want


def match_counts(monkeypatch, choose):
    """Prefixes with the match count that ``choose`` gives for a set's size, in the order of the shingles' hashes."""
    def prefixes(width, num, den, common, counts):
        def prefix(batches):
            for batch in batches:
                rows = []
                for i, tokens in zip(batch.column("doc_id").to_pylist(), ngram_join.shingle_sets(ngram_join.text_of(batch), width), strict=True):
                    keys, n = sorted((tokens >> np.uint64(2)).astype(np.int64).tolist()), len(tokens)
                    need = -(-num * n // den)
                    l = min(choose(n), need)
                    prefix = keys[: n - need + l]
                    rows.append({"doc_id": i, "n": n, "sig": ngram_join._signature(tokens), "l": l, "end": prefix[-1], "prefix": prefix})
                types = [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("l", pa.int32()), ("end", pa.int64()), ("prefix", pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([t for t in types if t[0] in made]))

        return prefix

    made = ["doc_id", "n", "sig", "l", "end", "prefix"]
    monkeypatch.setattr(ngram_join, "_prefixes", prefixes)


def by_hash(words):
    """Words in the order that their one-word shingles have."""
    texts = pa.array(list(words))
    hashes = [int(t[0] >> np.uint64(2)) for t in ngram_join.shingle_sets(texts, 1)]
    return [w for _, w in sorted(zip(hashes, words, strict=True))]


@pytest.mark.parametrize("choose", [{40: 1, 43: 1, 50: 1}, {40: 1, 43: 5, 50: 3}, {40: 4, 43: 2, 50: 7}])
def test_shingles_behind_the_prefix_of_one_side(spark, monkeypatch, choose):
    words = by_hash([f"w{k}" for k in range(50)])  # the seven that only x has come first
    z, y, x = words[7:47], words[7:], words
    rows = [(0, " ".join(z)), (1, " ".join(y)), (2, " ".join(x))]
    want = brute(rows, 1, 85, 100)
    assert {c for _, c in want.values()} == {0}
    match_counts(monkeypatch, choose.get)
    assert result(near_duplicates(table(spark, [t for _, t in rows], range(3)), 1, 85, 100)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_sets_with_differing_match_counts(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(25):
        words = by_hash([f"g{group}w{k}" for k in range(rng.randrange(30, 60))])
        for _ in range(4):  # front, middle and back parts, each inside another
            a, b = rng.randrange(0, 5), rng.randrange(0, 5)
            rows.append((len(rows), " ".join(words)))
            words = words[a : len(words) - b]
        rows.append((len(rows), " ".join(rng.sample(words, len(words) - 3) + [f"own{group}"])))
    want = brute(rows, 1, 85, 100)
    match_counts(monkeypatch, lambda n: 1 + (n * 7 + seed) % 8)
    assert result(near_duplicates(table(spark, [t for _, t in rows], range(len(rows))), 1, 85, 100)) == want


def test_rows_that_share_ids_and_empty_table(spark):
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in near_duplicates(repeated(spark), 4, 85, 100).collect())
    assert rows == [(0, 1, 0), (0, 1, 0), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert near_duplicates(table(spark, [], []), 4, 85, 100).count() == 0


def test_links_through_rows_without_an_id(spark):
    first, middle, last = (" ".join(f"w{k}" for k in range(a, a + 40)) for a in (0, 3, 6))
    assert {i: c for i, (_, c) in brute([(0, first), (1, last)], 1, 85, 100).items()} == {0: 0, 1: 1}
    df = table(spark, [first, middle, middle, last], [4, None, None, 9])
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(df, 1, 85, 100).collect())
    assert got == [(0, 4), (0, 4), (4, 4), (9, 4)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    groups = defaultdict(int)
    for r in got.values():
        groups[r] += 1
    assert groups == {0: 61, 100: 2}
