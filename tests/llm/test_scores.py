import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.llm import licenses, quality, toxicity
from swathline.llm.fingerprints import fingerprint_table
from tests.llm.fixtures import LOWER, awkward_texts, repeated, table


def same_as_sql(df, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(result.fetchall(), key=key)


LICENSE_TEXTS = [
    "x cc by cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand", "released under the license",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "all\nrights Reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation", "licensed under cc by sa 4",
    None, "", "générale public license",
]


def test_licenses(spark):
    for docs in (table(spark), table(spark, LICENSE_TEXTS), table(spark, [], [])):
        same_as_sql(licenses.scan_licenses(docs), licenses.SQL, docs)
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(table(spark, LICENSE_TEXTS)).collect()}
    assert [found[10 + k] for k in range(7)] == ["cc-by", "", "", "gpl,gpl-notice", "reserved", "mit-grant", "cc-by"]
    assert licenses.scan_licenses(repeated(spark)).count() == 6


def test_license_filters_lose_nothing():
    rng = random.Random(7)
    words = licenses.VOCABULARY
    for _ in range(20):
        join = licenses.Join({w: rng.randrange(100) for w in words})
        sets = []
        for name in rng.choices(list(licenses.TEMPLATES), k=40):
            own = set(licenses.TEMPLATES[name].split())
            sets.append({w for w in own if rng.random() < 0.95} | set(rng.sample(words, rng.randrange(8))))
        place = [words.index(w) for s in sets for w in s]
        block = [b for b, s in enumerate(sets) for _ in s]
        import numpy as np

        got = {(b, join.names[t]) for b, t, _ in join.matches(np.array(place), np.array(block))}
        want = {(b, n) for b, s in enumerate(sets) for n, t in licenses.TEMPLATES.items() if 10 * len(s & set(t.split())) >= 9 * len(set(t.split()))}
        assert got == want


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"


def test_licenses_over_lines(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    strewn = filler.join(["copyright ", " c ", " all ", " rights ", " reserved"])
    texts = [
        GRANT, "# " + GRANT.replace("\n", "\n# "), "/*\n * " + GRANT.replace(" ", "\n * ") + "\n */", filler + "\n" + GRANT + "\n" + filler, strewn,
        strewn.replace("\n", " "), "Copyright (c) 2020,\nall rights are reserved", GRANT.replace(" ", " x "), GRANT.replace("\n", " "),
        licenses.TEMPLATES["mit-text"].replace(" software ", "\nsoftware ").upper(), "(" + licenses.TEMPLATES["apache-header"].replace(" the ", "\n// the ") + ")",
    ]
    docs = table(spark, texts)
    found = [r["labels"] for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert found[:4] == ["mit-grant"] * 4 and found[4:6] == ["", ""]
    assert found[6:9] == ["reserved-notice", "", "mit-grant"]
    assert found[9] == "mit-grant,mit-text" and found[10] == "apache-2.0,apache-header"
    same_as_sql(licenses.scan_licenses(docs), licenses.SQL, docs)
    halves = GRANT.split("\n")
    apart = table(spark, halves)  # the end of one text and the start of the next are no block
    assert {r["labels"] for r in licenses.scan_licenses(apart).collect()} == {""}
    ids = repeated(spark).withColumn("text", F.when(F.col("text") == "another text", GRANT).otherwise(F.col("text")))
    same_as_sql(licenses.scan_licenses(ids), licenses.SQL, ids)


def test_license_windows_against_brute_force():
    rng = random.Random(11)
    words = licenses.VOCABULARY
    for _ in range(8):
        join = licenses.Join({w: rng.randrange(100) for w in words})
        texts = []
        for _ in range(12):
            text = []
            for name in rng.choices(list(licenses.TEMPLATES), k=3):
                own = licenses.TEMPLATES[name].split()
                for w in own:
                    text += [] if rng.random() < 0.04 else [w]
                    text += [None] * rng.choice([0, 0, 0, 0, 1, 2]) if rng.random() < 0.9 else [rng.choice(words)]
            texts.append(text)
        place = np.array([-1 if w is None else words.index(w) for text in texts for w in text])
        block = np.array([b for b, text in enumerate(texts) for _ in text])
        want = {}
        for b, text in enumerate(texts):
            for t, template in enumerate(licenses.TEMPLATES.values()):
                own, width = set(template.split()), -(-len(template.split()) * 3 // 2)
                shared = max(len(own & set(text[i : i + width])) for i in range(len(text)))
                if 10 * shared >= 9 * len(own):
                    want[b, t] = shared / len(own)
        assert {(b, t): share for b, t, share in join.matches(place, block, licenses.STRETCH)} == want and want


def test_quality(spark):
    rng = random.Random(3)
    texts = awkward_texts() + [" ".join(rng.choices(["a", "b", "c"], k=rng.randrange(60))) for _ in range(60)]
    for docs in (table(spark, texts), table(spark, [], [])):
        same_as_sql(quality.quality(docs), quality.SQL, docs)
    docs = table(spark, texts)
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert quality.quality(docs, order).where("kept").count() == quality.keep_good(docs, order).count()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(quality.rule_order(docs)) == sorted(quality.RULES)
    assert quality.quality(repeated(spark)).count() == 6


def test_cascade_stops_early(monkeypatch):
    import pyarrow as pa

    seen = []
    rules = {"first": lambda t: t.n_words < 3, "second": lambda t: (seen.append(len(t)), t.n_words > 4)[1]}
    monkeypatch.setattr(quality, "RULES", rules)
    kept = quality.run_cascade(quality.Texts(pa.array(["a b", "a b c", "a b c d e f", ""])), ["first", "second"])
    assert kept.tolist() == [False, True, False, False] and seen == [2]


def test_measures_are_handed_on(monkeypatch):
    import pyarrow as pa

    calls = []
    plain = quality.split_words
    monkeypatch.setattr(quality, "split_words", lambda t: (calls.append(len(t)), plain(t))[1])
    texts = quality.Texts(pa.array([t or "" for t in awkward_texts()]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters"]
    rows = np.flatnonzero(texts.n_words % 2 == 1)
    early = texts.take(rows)  # words alone are known
    values = {n: getattr(texts, n)[rows].tolist() for n in names}
    late = texts.take(rows)
    quality.run_cascade(texts, list(quality.RULES))
    quality.run_cascade(late, list(quality.RULES)[::-1])
    for part in (early, late, early.take(np.arange(0)), late.take(np.arange(len(rows)))):
        if len(part):
            assert {n: getattr(part, n).tolist() for n in names} == values
    assert len(calls) == 1


def test_sample_with_one_id(spark):
    docs = table(spark, ["few words"] * 40, [None] * 40)
    assert sorted(quality.rule_order(docs, 5)) == sorted(quality.RULES)


BAD = ["grobnik", "vermilt", "stonkart"]


def labelled(spark, n=600):
    rng = random.Random(9)
    plain = ["the", "river", "runs", "over", "small", "stones", "and", "into", "wide", "meadow", "where", "birds", "sing", "all", "day"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_disguised_words(spark):
    texts, labels = labelled(spark)
    disguised = ["the gr0bn1k runs", "v e r m i l t", "s.t.o.n.k.a.r.t", "grooobnik sings", "$tonk4rt!!", "V3RM!LT", "birds GROBNIK"]
    clean = ["the river 1234 runs", "a b c d", "w0rd5 w1th d1g1t5", "!!! ???", "", None, "x" * 20_000, "1 2 3 4 5 6"]
    everything = [*texts, *disguised, *clean]
    docs = table(spark, everything, range(len(everything)))
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    n = len(texts)
    assert all(rows[n + k]["predicted"] == 1 for k in range(len(disguised))), [d for k, d in enumerate(disguised) if not rows[n + k]["predicted"]]
    assert all(rows[n + len(disguised) + k]["predicted"] == 0 for k in range(len(clean)))
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(n))
    right = sum(rows[i]["predicted"] == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def flat_model():
    """No character is likelier than another; one word is toxic, and so is the beginning of another."""
    return toxicity.Model(np.full((toxicity.SYMBOLS,) * 3, -3.3, np.float32), {"moron$": 0.95, "stonk": 0.9}, 0.1)


def scores(spark, texts):
    docs = table(spark, texts, range(len(texts)))
    return {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flat_model()).collect()}


def test_words_in_long_spelled_runs(spark):
    other = "abcdefghijklmnpqrstuvwxyz" * 2
    texts = [" ".join(other[:k] + word + other[k:40]) for word in ("moron", "m0r0n", "mmmmoooorrrroooonnnn", "stonkart") for k in range(41)]
    texts += ["m . o . r . o . n " + "a b c " * 30, "- - - - -", " ".join(other), "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9"]
    got = scores(spark, texts)
    assert [texts[i] for i in range(len(texts) - 3) if got[i] < 0.9] == []
    assert [got[len(texts) - k] for k in (1, 2, 3)] == [0.1] * 3
    assert len(toxicity._windows("ab" * 5000)) <= 40  # few different ones
    rng = np.random.default_rng(1)
    assert len(toxicity._windows("".join(rng.choice(list(other), 5000)))) < 20 * 5000


def test_words_in_long_and_glued_tokens(spark):
    texts = ["mo" + "r" * 60 + "on", "word-" * 12 + "m0r0n", "you_m0r0n", "you/m0r0n", "great,moron", "great!m0r0n!!", "great,m.o.r.o.n", "(m0r0n)", "http://a.example/" + "x/" * 400 + "moron?q=1"]
    clean = ["great,river", "word-" * 12 + "r1v3r", "1,2,3,4", "x" * 20_000, "-" * 300, "m-o-r-e", "12_34"]
    got = scores(spark, texts + clean)
    assert [t for i, t in enumerate(texts) if got[i] < 0.9] == []
    assert [t for i, t in enumerate(clean, len(texts)) if got[i] != 0.1] == []


def test_readings_against_all_readings():
    tokens = ("11!!||11!!||", "1!1|1!1", "aabbccddee", "m00rr11nn", "5t|_|p1d", "1l1l1l", "!!||11")  # a beam of 24 lost the best of the first
    for token in tokens:
        rng = np.random.default_rng(11)
        logp = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.1), (toxicity.SYMBOLS, toxicity.SYMBOLS)) + 1e-9)
        scored = {"": (0.0, 0, 0)}
        for ch, many in toxicity._runs(token):
            letters, cost = (ch, 0.0) if ch.isalpha() else (toxicity.LEET.get(ch, ""), toxicity.EDIT)
            options = [(c * k, cost + toxicity.SQUEEZE * (many > k or k == 1 and many > 1)) for c in letters for k in (1, 2)[: 1 + (many > 1)]]
            options += [] if ch.isalpha() else [("", toxicity.DROP if letters else 0.0)]
            grown = {}
            for text, (s, a, b) in scored.items():
                for more, weight in options:
                    w, x, y = s + weight, a, b
                    for c in map(toxicity.symbol, more):
                        w, x, y = w + float(logp[x, y, c]), y, c
                    grown[text + more] = max(grown.get(text + more, (w, x, y)), (w, x, y))
            scored = grown
        every = sorted(((s + float(logp[a, b, 0]), t) for t, (s, a, b) in scored.items() if t), reverse=True)
        assert toxicity.readings(token, logp) == [t for _, t in every[: toxicity.READINGS]], token


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(table(spark), none).collect()} == {0.0}
    assert toxicity.toxicity(table(spark, [], []), none).count() == 0
    assert toxicity.toxicity(repeated(spark), none).count() == 6
    scored = toxicity.score_toxicity(table(spark), toxicity.train(table(spark), none), "score")
    assert sorted(scored.columns) == sorted(table(spark).columns)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ids", [None, "sparse"])
def test_fingerprints(spark, ids):
    import hashlib

    texts = awkward_texts()
    keys = list(range(10, 10 + len(texts))) if ids is None else sorted(map(random.Random(1).randrange, [-(2**62)] * len(texts), [2**62] * len(texts)))
    rows = {r["doc_id"]: r for r in fingerprint_table(table(spark, texts, keys)).collect()}
    errors = []
    for k, (i, text) in enumerate(zip(keys, texts, strict=True)):
        own, after = text or "", texts[(k + 1) % len(texts)] or ""
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + after[:quarter]
        assert rows[i]["n_chars"] == len(own)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [rows[i]["near_edited"] - jaccard(shingles(own), shingles(edited)), rows[i]["near_next"] - jaccard(shingles(own), shingles(after))]
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.03
    prints = {}
    for i, text in zip(keys, texts, strict=True):
        assert prints.setdefault(text or "", rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_fingerprint_edges(spark):
    assert fingerprint_table(table(spark, [], [])).count() == 0
    rows = fingerprint_table(repeated(spark)).collect()
    assert len(rows) == 6 and sum(r["near_next"] is None for r in rows) == 2
    only = fingerprint_table(table(spark, ["just one text of some words here"])).collect()
    assert only[0]["near_next"] == 1.0


def test_plain_words_keep_their_only_reading():
    import pyarrow as pa

    logp = np.log(np.random.default_rng(0).random((28, 28, 28)) + 0.01).astype(np.float32)
    words = ["İstanbul", "ΣΑΣ", "Straße", "ÉÉÉ", "éé", "éééa", "aaa", "aab", "(word", "word)", "_x_", "don't", '"idiot"', "IDIOT!!", "id1ot", "@idiot", "5tupid", "stup,id", "ÿÿÿ", "œœ", "a-b", "...", "«été»", "Ω", "x"]
    cores, plain = toxicity.plain_words(pa.array(words))
    for word, core, is_plain in zip(words, cores.to_pylist(), plain, strict=True):
        assert not is_plain or toxicity.restore(word, logp) == [core]
    assert plain[words.index("IDIOT!!")] and plain[words.index("Straße")] and not plain[words.index("aaa")] and not plain[words.index("éééa")]
    rules = {"idiot$": 0.9, "stup": 0.8, "stupid": 0.85, "été$": 0.7}
    each = toxicity._Rules(rules).of(pa.array(["idiot", "idiots", "stup", "stupi", "stupid", "stupidly", "été"]))
    assert each.tolist() == [0.9, 0.0, 0.0, 0.8, 0.8, 0.85, 0.7]


def test_spelled_rules_longer_than_usual_are_met_inside_tokens():
    logp = np.zeros((28, 28, 28), np.float32)
    word = "abcdefghijklmnopqrst"
    assert word not in toxicity.restore(".".join("xy" + word + "z"), logp)
    assert word in toxicity.restore(".".join("xy" + word + "z"), logp, len(word))
