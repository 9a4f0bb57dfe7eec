"""Toxicity scores of text restored from leetspeak, spacing and repetition.

A token with digits or signs in place of letters, with stretched letters, or spelled letter by letter is a lattice of
readings. A Viterbi search takes the likeliest readings under a character trigram model of the whole corpus, weighed
with the cost of each edit (the noisy channel). Restored words are then scored by rules learned from labelled documents.

A rule is a word or a word beginning that hardly occurs in clean documents and explains enough toxic ones on its own. A
document's score is the share of toxic documents among the training documents with its strongest rule, or the rest's share
if no rule applies. A rule counts from any of the readings kept, whatever its share of the probability: a hidden word is
mostly unlikelier than harmless readings under a model of the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import slices, split_words, stored, text_of
from swathline.llm.tokens import buffer_of

SAMPLE = 20_000
"""Labelled rows that rules are learned from, at most; of more, those with the smallest hashes of the id."""
LEAST_SUPPORT = 3
LEAST_PRECISION = 0.9
LEAST_CREDIT = 1.0
PREDICT = 0.7
SYMBOLS = 28  # a boundary, a to z, any other letter
READINGS = 6
WIDEST = 16
"""Letters of a spelled word, where no rule is longer."""
_PRIME = (1 << 61) - 1

# fixed values: letters that a sign or digit may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
EDIT, DROP, SQUEEZE = -1.0, -6.0, -0.5  # log weights of a substitution, of a dropped sign that may be a letter, of a shortened run

_EDGE = re.compile(r"^[^\w@$!|+(€]+|[^\w]+$")
_SIGNS = re.compile(r"^[@$!|+(€]{2,}")
_ODD = re.compile(r"[0-9@$!|+(€._*~\-'/\\]|(.)\1\1")
_STRETCH, _TRIPLE = re.compile(r"(.)\1{3,}", re.S), re.compile(r"(.)\1\1", re.S)
_SEPARATORS, _MARKS, _PLAIN = re.compile(r"(?:[^\w@$!|+(€]|_)+"), re.compile(r"[\W_]+"), re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9.,:%/\-+]+")

_CODE = np.zeros(256, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODE[0x80:] = 27


def symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for part in slices(batches):
        raw, offsets = buffer_of(text_of(part))
        codes = np.zeros(len(raw) + len(offsets) + 1, np.int32)  # with a boundary between texts
        if len(raw):
            codes[np.arange(len(raw)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _CODE[raw]
        total += np.bincount(codes[:-2] * SYMBOLS**2 + codes[1:-1] * SYMBOLS + codes[2:], minlength=len(total))
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["code", "many"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from every character of ``text`` (28 symbols: a fixed table)."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "code long, many long")
    rows = counts.groupBy("code").agg(F.sum("many").alias("many")).toArrow()  # at most 28 * 28 * 28
    table = np.zeros(SYMBOLS**3)
    table[rows.column("code").to_numpy()] = rows.column("many").to_numpy()
    three = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _runs(token: str) -> list[tuple[str, int]]:
    return [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]


def readings(token: str, logp: np.ndarray, keep: int = READINGS) -> list[str]:
    """The likeliest readings of a lower-case token, best first.

    What follows depends on the last two symbols only, so the ``keep`` best texts for each pair of them make the search
    exact. A text is told by its hash and held as a path of pieces, so that the effort is linear in the token.
    """
    live: dict[tuple[int, int], dict[int, tuple[float, tuple | None]]] = {(0, 0): {0: (0.0, None)}}
    for ch, many in _runs(token):
        options: list[tuple[str, float]] = []
        letters = ch if ch.isalpha() else LEET.get(ch, "")
        cost = 0.0 if ch.isalpha() else EDIT
        for letter in letters:
            options.append((letter, cost + SQUEEZE * (many > 1)))
            if many > 1:
                options.append((letter * 2, cost + SQUEEZE * (many > 2)))
        if not ch.isalpha():
            options.append(("", DROP if letters else 0.0))
        grown: dict[tuple[int, int], dict[int, tuple[float, tuple | None]]] = {}
        for (a, b), held in live.items():
            for letters, gain in options:
                x, y = a, b
                for c in map(symbol, letters):
                    gain, x, y = gain + float(logp[x, y, c]), y, c
                into = grown.setdefault((x, y), {})
                for key, (score, path) in held.items():
                    for c in letters:
                        key = (key * 1_000_003 + ord(c)) % _PRIME
                    if key not in into or into[key][0] < score + gain:
                        into[key] = (score + gain, (path, letters) if letters else path)
        live = {s: t if len(t) <= keep else dict(sorted(t.items(), key=lambda i: (-i[1][0], i[0]))[:keep]) for s, t in grown.items()}
    done = [(score + float(logp[a, b, 0]), path) for (a, b), held in live.items() for score, path in held.values() if path]
    best = sorted(done, key=lambda d: -d[0])[:keep]
    return [_text(path) for _, path in best]


def _text(path: tuple | None) -> str:
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def restore(token: str, logp: np.ndarray, widest: int = WIDEST) -> list[str]:
    """Lower-case readings of a token between white space; a plain word has just one, bare signs or numbers none.

    Besides the whole token, the pieces between separators are read, with signs that may be letters kept and with them as
    separators too, and words spelled by pieces of one letter, of up to ``widest`` letters.
    """
    word = _SIGNS.sub("", _EDGE.sub("", token.lower()))
    if _PLAIN.fullmatch(word) and not _TRIPLE.search(word):
        return [word]  # no other part, and one reading
    if not word or _DIGITS.fullmatch(word):
        return []
    word = _STRETCH.sub(r"\1\1\1", word)
    kept, split = _SEPARATORS.split(word), _MARKS.split(word)
    parts = [word, *kept, *split]
    for one, run in groupby(kept, lambda p: len(p) == 1):
        joined = "".join(run) if one else ""
        parts += _windows(joined, widest) if len(joined) > 2 else []
    found: dict[str, None] = {}
    for part in dict.fromkeys(parts):
        if not any(map(str.isalpha, part)):
            continue
        found.update(dict.fromkeys([part] if _PLAIN.fullmatch(part) and not _ODD.search(part) else readings(part, logp)))
    found.update(dict.fromkeys(p for p in re.split(r"[\W\d_]+", word) if len(p) > 2))
    return list(found)


def features(word: str) -> list[str]:
    """Rules that a word may meet: itself (with its end) and its beginnings."""
    return [word + "$", *(word[:k] for k in range(4, min(len(word), 7)))]


@dataclass
class Model:
    logp: np.ndarray
    rules: dict[str, float] = field(default_factory=dict)
    rest: float = 0.0


class _Words:
    """Tokens to what they give, kept for tokens already seen by this worker."""

    def __init__(self, make, room: int = 1 << 17) -> None:
        self.make, self.room, self.known = make, room, {}

    def of(self, tokens: list[str]) -> list:
        if len(self.known) > self.room:
            self.known = {}
        out = []
        for t in tokens:
            found = self.known.get(t)
            if found is None:
                found = self.make(t)
                if len(t) <= 64:
                    self.known[t] = found
            out.append(found)
        return out


def _spelled(offsets: np.ndarray, words: pa.Array) -> list[tuple[int, str]]:
    """Words spelled with blanks: runs of three or more tokens of one character, joined, with the row of their text."""
    single = np.flatnonzero(pc.equal(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False))
    if len(single) < 3:
        return []
    row = np.searchsorted(offsets, single, side="right") - 1
    breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(row) != 0)) + 1
    starts, stops = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(single)]))
    long = np.flatnonzero(stops - starts >= 3)
    return [(int(row[starts[i]]), "".join(words[int(single[starts[i]]) : int(single[stops[i] - 1]) + 1].to_pylist())) for i in long]


def _windows(run: str, widest: int = WIDEST) -> list[str]:
    """A spelled run may hold other one-letter words around a word: its parts of 3 to ``widest`` letters from every start.

    Signs that stand for no letter are left out, repetitions beyond the third change no reading, and a part's length is counted
    in different letters in a row, so that the parts grow linearly with the run.
    """
    run = _STRETCH.sub(r"\1\1\1", "".join(c for c in run if c.isalpha() or c in LEET))
    change = np.cumsum([0] + [x != y for x, y in zip(run, run[1:])]).tolist()
    found: dict[str, None] = {}
    for a in range(len(run) - 2):
        for b in range(a + 3, len(run) + 1):
            if b - a > widest and change[b - 1] - change[a] >= widest:
                break
            found[run[a:b]] = None
    return list(found)


# fixed values: what _EDGE takes off at the two ends, of ASCII, and the letters whose lower case is the same in every library
_BEFORE, _AFTER = "\"#%&'*,-./:;<=>?[\\]^`{}~)", "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_LATIN = "^[a-zß-öø-ÿāăąćčďđēęěğīłńňōőœřśşšťūůűźżž]+$"


def plain_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words in lower case without signs at their ends, and which of them ``restore`` leaves so, as their only reading.

    A false answer is no loss: such words go through ``restore``. Words with three equal letters in a row are among them.
    """
    cores = pc.ascii_rtrim(pc.ascii_ltrim(pc.utf8_lower(words), characters=_BEFORE), characters=_AFTER)
    other = pc.match_substring(words, "İ")  # its lower case has two characters in Python
    plain = np.array(pc.and_not(pc.match_substring_regex(cores, _LATIN), other).to_numpy(zero_copy_only=False), dtype=bool)
    raw, offsets = buffer_of(cores)
    if len(raw) > 2:
        stretched = np.zeros(len(raw), bool)
        stretched[:-2] = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
        if len(raw) > 5:  # letters of two bytes
            two = raw[:-2] == raw[2:]
            stretched[:-5] |= two[:-3] & two[1:-2] & two[2:-1] & two[3:]
        plain[np.searchsorted(offsets, np.flatnonzero(stretched), side="right") - 1] = False
    return cores, plain


class _Rules:
    """Rules by kind, for many plain words at once."""

    def __init__(self, rules: dict[str, float]) -> None:
        self.kinds: list[tuple[int, pa.Array, np.ndarray]] = []
        for size in (0, 4, 5, 6):  # whole words, then beginnings
            own = [(f[:-1], v) for f, v in rules.items() if f.endswith("$")] if not size else [(f, v) for f, v in rules.items() if not f.endswith("$") and len(f) == size]
            if own:
                self.kinds.append((size, pa.array([f for f, _ in own], pa.string()), np.array([0.0, *(v for _, v in own)])))

    def of(self, words: pa.Array) -> np.ndarray:
        best = np.zeros(len(words))
        for size, names, values in self.kinds:
            met = words if not size else pc.if_else(pc.greater(pc.utf8_length(words), size), pc.utf8_slice_codeunits(words, 0, size), None)
            place = pc.fill_null(pc.index_in(met, value_set=names), -1).to_numpy(zero_copy_only=False)
            best = np.maximum(best, values[place + 1])
        return best


def _scorer(model: Model, schema_names: list[str], out: str):
    widest = max(WIDEST, *(len(f) for f in model.rules), 0)

    def word_score(token: str) -> float:
        return max((model.rules.get(f, 0.0) for w in restore(token, model.logp, widest) for f in features(w)), default=0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, rules = _Words(word_score), _Rules(model.rules)
        for part in slices(batches):
            offsets, words = split_words(text_of(part))
            best = np.zeros(part.num_rows)
            if len(words):
                coded = words.dictionary_encode()
                cores, plain = plain_words(coded.dictionary)
                own = rules.of(cores)
                odd = np.flatnonzero(~plain)
                own[odd] = words_of.of(coded.dictionary.take(pa.array(odd)).to_pylist())
                each = own[coded.indices.to_numpy()]
                full = np.flatnonzero(np.diff(offsets))
                best[full] = np.maximum.reduceat(each, offsets[:-1][full])
                for row, run in _spelled(offsets, words):
                    best[row] = max(best[row], *words_of.of(_windows(run, widest)), 0.0)
            value = pa.array(np.where(best > 0, np.maximum(best, model.rest), model.rest))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in schema_names] + [value], [*schema_names, out])

    return score


def score_toxicity(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with its columns and ``out``, 0 to 1, higher for likelier toxic; a column of that name is replaced.

    Only ``text`` is read; a null or empty text gets the share of documents without any rule.
    """
    docs = docs.drop(out)
    names = docs.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(_scorer(model, names, out), ", ".join([*fields, f"`{out}` double"]))


def _document_features(logp: np.ndarray, wanted: set[str] | None):
    """Feature counts by label of a task's documents, or, for wanted features, the toxic documents that have them."""
    def found(part: pa.RecordBatch, words_of: _Words) -> Iterator[tuple[int, set[str]]]:
        offsets, words = split_words(text_of(part))
        values = words.to_pylist()
        for row in range(part.num_rows):
            own = set(values[offsets[row] : offsets[row + 1]])
            yield row, {f for fs in words_of.of(list(own)) for f in fs}

    def make(token: str) -> list[str]:
        return [f for w in restore(token, logp) for f in features(w)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, many = _Words(make), (Counter(), Counter())
        for part in slices(batches):
            toxic = part.column("toxic").to_pylist()
            for row, own in found(part, words_of):
                many[toxic[row]].update(own)
        names = list(many[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([many[1][f] for f in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["feature", "n1", "n0"]
        )
        names = list(many[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([many[0][f] for f in names], pa.int64())], ["feature", "n1", "n0"]
        )

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Words(make)
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            rows = [(ids[row], sorted(own & wanted)) for row, own in found(part, words_of)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.list_(pa.string()))], ["doc_id", "features"])

    return count if wanted is None else having


def credit(documents: list[list[str]], rounds: int = 10) -> dict[str, float]:
    """How many documents each feature explains, where a document's weight is shared by its features.

    Shares follow what the features explain elsewhere (expectation maximization). Words that a group of copies has in common
    share few documents among many, so they end far below words that differing documents have in common.
    """
    names = {f: i for i, f in enumerate(sorted({f for fs in documents for f in fs}))}
    doc = np.repeat(np.arange(len(documents)), [len(fs) for fs in documents])
    which = np.array([names[f] for fs in documents for f in fs], np.int64)
    weight = np.ones(len(names))
    for _ in range(rounds if len(which) else 0):
        share = weight[which] / np.bincount(doc, weight[which], len(documents))[doc]
        weight = np.bincount(which, share, len(names))
    return dict(zip(names, weight.tolist(), strict=True))


def learn(documents: list[list[str]], counts: dict[str, tuple[int, int]], total: tuple[int, int]) -> tuple[dict[str, float], float]:
    """Rules with their shares of toxic documents, and that share where none applies."""
    rules = {f: (counts[f][0] + 0.5) / (sum(counts[f]) + 1) for f, w in credit(documents).items() if w >= LEAST_CREDIT}
    missed, clean = total[1] - sum(any(f in rules for f in fs) for fs in documents), total[0]
    return rules, missed / (missed + clean) if missed + clean else 0.0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Character model from all of ``docs``; rules from labelled ones whose ``crc32`` of the id as text is not 1 modulo 3.

    Labels that are null or of unknown documents are left out; an id labelled twice counts once, as toxic if any label says
    so. Without labels there are no rules, and every score is 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    logp = character_model(docs)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).where("crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = stored(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))  # at most `sample` ids
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    counts = rows.mapInArrow(_document_features(logp, None), "feature string, n1 long, n0 long").groupBy("feature")
    counts = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sharp = counts.where((F.col("n1") >= LEAST_SUPPORT) & (F.col("n1") >= LEAST_PRECISION * (F.col("n1") + F.col("n0")))).collect()
    table = {r["feature"]: (r["n1"], r["n0"]) for r in sharp}
    having = rows.where("toxic = 1").mapInArrow(_document_features(logp, set(table)), "doc_id long, features array<string>")
    each = having.select("doc_id", F.explode("features").alias("feature")).groupBy("doc_id").agg(F.collect_set("feature").alias("features"))
    documents = [sorted(r["features"]) for r in each.orderBy("doc_id").collect()]  # a row per id, however often it is repeated
    rules, rest = learn(documents, table, (totals.get(0, 0), totals.get(1, 0)))
    return Model(logp, rules, rest)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; held-out documents had no part in learning the rules."""
    model = train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_toxicity(texts, model).select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
    )
