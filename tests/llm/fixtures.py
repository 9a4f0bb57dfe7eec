"""Small awkward tables for the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, token string, score double, slot int, sig string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Δelta", "été", "zo-ne", "x", "The", "of", "12", "don't"] + [f"w{i}" for i in range(60)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(120)
    near = base.split(" ")
    near[7] = "changed"
    far = [w if i % 5 else "other" for i, w in enumerate(near)]
    texts = [base, base, " ".join(near), " ".join(far), prose(40), prose(40), None, "", " \n\t ", "one", "one two three", "one two three"]
    texts += [" ".join([*base.split(" ")[:k], "edit", f"e{k}", *base.split(" ")[k:]]) for k in (5, 50, 100)]
    texts += [prose(30_000), "a" * 50_000, "same line here\n" * 30, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. cc by", "　  nbsp x"]
    texts += ["<|endoftext|> and <|startoftext|>x", "CC BY, cc\nby; general PUBLIC license", "### $$$ %%% " * 20, prose(25) + "\n" + prose(25)]
    return texts


def table(spark, texts=None, ids=None):
    """Documents with the given texts; the other columns bear names that operators use inside and hold nulls."""
    texts = awkward_texts() if texts is None else texts
    ids = range(10, 10 + len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None, 1, "x", "y", None, None, "z") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def repeated(spark):
    """Rows that share ids, one of them null, and repeated rows."""
    return table(spark, ["same text of one id", "same text of one id", "another text", None, "no id at all", "no id at all"], [1, 1, 1, 2, None, None])
