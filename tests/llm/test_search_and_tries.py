import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from swathline.llm import conversation_trie, lexical_search, line_dedup
from tests.llm.fixtures import LOWER, awkward_texts, repeated, table

TURNS = "conv_id long, turn long, role string, text string, z1 string, class string, head int"


def talk(spark, rows):
    """Conversations; further columns bear names that the operator uses inside."""
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], TURNS)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(node[:-1] for node in members if node)

    def below(node):
        return [n for n in members if n[: len(node)] == node]

    return {
        (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], sum(not children[n] for n in below(node)),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below(node) if n),
            hashlib.sha256(",".join(map(str, sorted(c for c in cs if whole[c] == node))).encode()).hexdigest(),
        )
        for node, cs in members.items()
    }


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks():
    rng = random.Random(9)
    rows = []
    for c in [*range(40), 100, 101, 107, -3, -5]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "été"])))
    rows += [(200, None, "user", "first"), (200, 1, "user", "x"), (205, 3, "user", "first"), (205, 9, "user", "x"), (None, 1, "user", "lost")]
    rows += [(301, t, "user", "only after the base") for t in range(2)]  # its base is absent: turnless, if h is 2 or more
    return rows


@pytest.mark.parametrize("split, band, slot", [(512, 1024, 4096), (2, 3, 2)])
def test_trie_equals_plain_one(spark, monkeypatch, split, band, slot):
    for name, value in (("SPLIT", split), ("BAND", band), ("SLOT", slot)):
        monkeypatch.setattr(conversation_trie, name, value)
    got = conversation_trie.trie(talk(spark, talks())).select(*NAMES).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(talks())


def test_trie_of_copies_ties_and_nothing(spark):
    same = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got = {tuple(r) for r in conversation_trie.trie(talk(spark, same)).select(*NAMES).collect()}
    assert got == plain_trie(same)
    ties = [(5, 1, "user", "b"), (5, 1, "user", "a"), (10, 1, "user", "a"), (10, 1, "user", "b"), (5, 1, "user", "a"), (10, 1, "user", "a")]
    rows = conversation_trie.trie(talk(spark, ties)).collect()
    assert sorted(r["depth"] for r in rows)[-1] == 3  # repeated rows are turns of their own
    assert conversation_trie.trie(talk(spark, [])).count() == 0
    alone = conversation_trie.trie(talk(spark, [(7, 0, None, None)])).collect()
    assert {tuple(r[n] for n in NAMES) for r in alone} == plain_trie([(7, 0, None, None)])


def test_trie_equals_sql(spark):
    rows = [r for r in talks() if r[0] is not None]
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[i] for r in rows] for i, n in enumerate(["conv_id", "turn", "role", "text"])}))
    got = {tuple(r) for r in conversation_trie.trie(talk(spark, rows)).select(*NAMES).collect()}
    assert got == set(con.sql(f"select {', '.join(NAMES)} from ({conversation_trie.SQL})").fetchall())


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        one, two = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(-(1 << 62), 1 << 62, n)
        slots = conversation_trie.SlotTable(one, two)
        assert np.array_equal(np.sort(slots.slots), np.arange(n))
        assert np.array_equal(slots.of(one, two), slots.slots)
        assert (slots.of(one, two + 1) == -1).all()


def plain_search(docs, items, k=10):
    def terms(text):
        return [t.translate(LOWER) for t in re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")]

    have = [(i, Counter(terms(t))) for i, t in docs]
    have = [(i, c) for i, c in have if c]
    n, size = len(have), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in have:
            m = 25 + 75 * c.total() * n // size
            hit = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]]
            if sum(hit) > 0:
                scores.append((-sum(hit), i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def questions(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, query int")


def searched(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_plain_one(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "of", "Été", "x1", "ß", "naïve"] + [f"w{i}" for i in range(30)]
    texts = awkward_texts() + ["the " + " ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(150)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "nowhere"), (None, "w1 w2"), (53, "w1,W1 w2"), (53, "w1,W1 w2"), (54, awkward_texts()[-2])]
    want = plain_search(list(zip(range(10, 10 + len(texts)), texts, strict=True)), items)
    assert searched(lexical_search.ranked(table(spark, texts), questions(spark, items))) == want
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(lexical_search, "ITEMS_AT_ONCE", 7)
    assert searched(lexical_search.ranked(table(spark, texts), questions(spark, items))) == want


def test_search_of_repeated_rows_and_nothing(spark):
    rows = [(r["doc_id"], r["text"]) for r in repeated(spark).collect()]
    items = [(1, "same text of one id"), (2, "no id at all"), (3, "another")]
    assert searched(lexical_search.ranked(repeated(spark), questions(spark, items))) == plain_search(rows, items)
    assert lexical_search.ranked(table(spark, [], []), questions(spark, items)).count() == 0
    assert lexical_search.ranked(repeated(spark), questions(spark, [])).count() == 0


def test_intervals_are_pruned():
    rng = np.random.default_rng(1)
    n = 4000
    lists = [np.sort(rng.choice(n, size, replace=False)) for size in (3000, 1500, 40, 8)]
    terms, docs = np.repeat(np.arange(4), [len(x) for x in lists]), np.concatenate(lists)
    impacts = np.concatenate([rng.integers(1, 50, 3000), rng.integers(1, 100, 1500), rng.integers(500, 900, 40), rng.integers(900, 1000, 8)])
    impacts[:20] = -5
    total = np.bincount(docs, impacts, n).astype(np.int64)
    for step in (1, 8, 256):
        best = lexical_search.Best(10)
        ids = np.arange(n)
        scored = lexical_search.search(lexical_search.Block(terms, docs, impacts, n, 4), np.arange(4), np.ones(4, np.int64), ids, np.zeros(n, bool), best, step)
        order = np.lexsort((ids, -total))[:10]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == total[order].tolist()
        assert scored < n // 4


def plain_lines(texts, at_least, min_chars=1):
    blank = " \t\n\x0b\x0c\r"
    split = [(t or "").split("\n") for t in texts]
    keys = [[line.strip(blank).translate(LOWER) for line in lines] for lines in split]
    many = Counter(k for ks in keys for k in set(ks))
    gone = {k for k, n in many.items() if n >= at_least and len(k) >= min_chars}
    out = []
    for lines, ks in zip(split, keys, strict=True):
        kept = [line for line, k in zip(lines, ks, strict=True) if k not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined():
    rng = random.Random(8)
    pool = [f"Line {i}" for i in range(60)] + ["", "  ", "É", "é", "\tboth\r"]
    texts = ["\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    return [*texts, *awkward_texts(), "LINE 1", "only\n" * 3000, "\n".join(f"row {i}" for i in range(4000)), *["one copy\nof many"] * 30]


@pytest.mark.parametrize("at_least, min_chars, batches, fan", [(10, 1, 8, 4), (3, 4, 5, 2), (2, 1, 1, 2)])
def test_lines_equal_plain_ones(spark, monkeypatch, at_least, min_chars, batches, fan):
    monkeypatch.setattr(line_dedup.LineRuns.__init__, "__defaults__", (fan, None))
    texts = lined()
    docs = table(spark, texts).withColumnsRenamed({"size": "h1", "slot": "may", "sig": "kept_text", "token": "s1", "shard": "c0"})
    got = line_dedup.drop_repeated_lines(docs, at_least, min_chars, batches)
    assert got.columns == [c for c in docs.columns if c != "kept_text"] + ["kept_text", "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    want = dict(zip(range(10, 10 + len(texts)), plain_lines(texts, at_least, min_chars), strict=True))
    assert {k: (r["n_lines"], r["n_dropped"], r["kept_text"]) for k, r in rows.items()} == want


def test_lines_of_repeated_rows_and_nothing(spark):
    rows = line_dedup.drop_repeated_lines(repeated(spark), 2).collect()
    want = plain_lines([r["text"] for r in repeated(spark).collect()], 2)
    assert sorted((r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows) == sorted(want)
    assert line_dedup.line_dedup(table(spark, [], [])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_equal_sql(spark):
    texts = lined()
    docs = table(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, line_dedup.line_dedup(docs).select(*names).collect())) == sorted(con.sql(f"select {', '.join(names)} from ({line_dedup.SQL})").fetchall())


def test_runs_settle_each_key_once(spark):
    runs = line_dedup.LineRuns(spark, at_least=4, fan=2, buckets=3)
    total = Counter()
    rng = random.Random(2)
    for _ in range(7):
        batch = Counter(rng.choices(range(30), k=25))
        total.update(batch)
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in batch.items()], "h1 long, h2 long, n long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert {r["h1"] for r in runs.settled().collect()} == {k for k, n in total.items() if n >= 4}
    runs.close()
