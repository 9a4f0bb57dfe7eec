"""Jaccard self-join of documents on word shingles with adaptive multi-match prefixes.

Every set is sorted by one global order, rare shingles first. Two sets of similarity ``t`` or more share at least ``l``
shingles among the first ``n - ceil(t n) + l`` of each, for any ``l``. A document whose first shingles are expected to meet
many others takes a larger ``l``: a longer prefix, of which correspondingly more must be shared before anything is verified.
A pair is bound by the smaller ``l`` of the two.

Equal sets are one node. Links are found in two steps, so that a group of near copies is not expanded into its pairs:
each node is first compared with the node that comes first at the shingles they share; then all candidate pairs whose
ends are still in different components are compared. Every link is thereby either found or joins nodes already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import mix, shingle_sets, slices, stored, text_of
from swathline.llm.components import components

COMMON = 1 << 18
"""So many of the most frequent shingles get a place of their own in the global order (a table of 4 MB); all others count
as rare and are ordered by hash. The order never changes a result, only how many candidates there are."""
CHUNK = 1 << 22
MAX_MATCH = 8
SLOTS = 1 << 21
"""Hash slots of document ids that can be broadcast: this bounds the table, whatever the number of ids."""
COMMON_BIT = 1 << 62


def _common_counts(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, many = np.unique(np.concatenate(held), return_counts=True)
            keep = many > 1
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(many[keep].astype(np.int64))], ["token", "many"])

        for part in slices(batches):
            for tokens in shingle_sets(text_of(part), width):
                held.append(tokens)
                size += len(tokens)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return count


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, over all documents; a shingle met once in a chunk of a task adds nothing."""
    counts = docs.select("text").mapInArrow(_common_counts(width), "token long, many long").groupBy("token").agg(F.sum("many").alias("many"))
    top = counts.orderBy(F.desc("many"), "token").limit(COMMON).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    many = top.column("many").to_numpy()
    order = np.lexsort((token, many))  # rare ones first
    return token[order], many[order]


def _prefixes(width: int, num: int, den: int, common: np.ndarray, counts: np.ndarray):
    """One row per document: its size, set signature, chosen match count, prefix in global order and the prefix's last key."""
    by_token = np.argsort(common)
    sorted_common = common[by_token]

    def ranked(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (tokens >> np.uint64(2)).astype(np.int64)
        cost = np.zeros(len(tokens))
        if len(sorted_common):
            at = np.minimum(np.searchsorted(sorted_common, tokens), len(sorted_common) - 1)
            hit = sorted_common[at] == tokens
            rank = by_token[at[hit]]
            keys[hit] = COMMON_BIT | rank
            cost[hit] = counts[rank]
        order = np.argsort(keys)
        return keys[order], cost[order]

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, sizes, sigs, matches, ends, prefixes = part.column("doc_id"), [], [], [], [], []
            for tokens in shingle_sets(text_of(part), width):
                n = len(tokens)
                sizes.append(n)
                if not n:
                    sigs.append(0)
                    matches.append(0)
                    ends.append(-1)
                    prefixes.append(np.zeros(0, np.int64))
                    continue
                sigs.append(_signature(tokens))
                keys, cost = ranked(tokens)
                need = -(-num * n // den)
                base = n - need
                top = min(MAX_MATCH, need)
                met = np.cumsum(cost)[base : base + top]  # postings met with l = 1, 2, ...
                l = 1 + int(np.argmin(met + 8 * met / np.arange(1, top + 1) ** 2))
                matches.append(l)
                ends.append(int(keys[base + l - 1]))
                prefixes.append(keys[: base + l])
            lengths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(matches, pa.int32()), pa.array(ends, pa.int64()), lists],
                ["doc_id", "n", "sig", "l", "end", "prefix"],
            )

    return prefix


def _tagged(prefix):
    """``prefix`` with the column ``tag`` of its rows after its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = 0
            for out in prefix(iter([part])):
                yield pa.RecordBatch.from_arrays([*out.columns, part.column("tag").slice(at, out.num_rows)], [*out.schema.names, "tag"])
                at += out.num_rows

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by shingle, place and node: rows of shingles that two nodes or more have, with the first node."""
    names = ["token", "pos", "sig", "n", "l"]
    carry: list[np.ndarray] | None = None  # last row so far and whether it was written
    written = False
    first: tuple[int, ...] | None = None
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if carry is not None:
            cols = [np.concatenate((a, b)) for a, b in zip(carry, cols, strict=True)]
        token, _, sig, _, _ = cols
        same = token[1:] == token[:-1]
        fresh = np.concatenate(([True], ~(same & (sig[1:] == sig[:-1]))))
        if carry is None:
            written = False
        keep = np.flatnonzero(fresh)
        token, pos, sig, n, l = (c[keep] for c in cols)
        starts = np.concatenate(([True], token[1:] != token[:-1]))
        group = np.cumsum(starts) - 1
        head = np.flatnonzero(starts)
        sizes = np.bincount(group)
        lead = {"sig": sig[head], "pos": pos[head], "n": n[head], "l": l[head]}
        if first is not None and token[0] == first[0]:
            lead["sig"][0], lead["pos"][0], lead["n"][0], lead["l"][0] = first[1:]
        several = sizes > 1
        if first is not None and token[0] == first[0] and written:
            several[0] = True
        out = several[group]
        if first is not None and token[0] == first[0] and written:
            out[0] = False  # the carried row went out with the last batch
        g = group[out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (token[out], sig[out], n[out], pos[out], l[out], lead["sig"][g], lead["n"][g], lead["pos"][g], lead["l"][g])],
            ["token", "sig", "n", "pos", "l", "sig1", "n1", "pos1", "l1"],
        )
        written = bool(several[-1])
        first = (int(token[-1]), int(lead["sig"][-1]), int(lead["pos"][-1]), int(lead["n"][-1]), int(lead["l"][-1]))
        carry = [c[-1:] for c in (token, pos, sig, n, l)]


def _signature(tokens: np.ndarray) -> int:
    """Of a whole set, whatever the order; 0 for the empty set."""
    if not len(tokens):
        return 0
    total = np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5)), keepdims=True) + np.uint64(len(tokens))
    return int(mix(total).view(np.int64)[0])


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(s, t.view(np.int64)) for s, t in zip(part.column("sig").to_pylist(), shingle_sets(text_of(part), width), strict=True) if _signature(t) == s]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.int64()))], ["sig", "tokens"])

    return sets


def _signed(width: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = text_of(part)
            yield pa.RecordBatch.from_arrays([pa.array([_signature(t) for t in shingle_sets(texts, width)], pa.int64()), texts], ["sig", "text"])

    return signed


def _needed_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The sets of all nodes in ``pairs``. Only texts whose id falls in a hit slot are shuffled; there are ``SLOTS`` at most.

    Nodes met under no id are found by the signature of their text, among the rows without an id.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    own = F.pmod(F.xxhash64("sig"), F.lit(SLOTS))
    sigs = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = stored(nodes.join(sigs, "sig").select(F.col("rep").alias("doc_id"), "sig"))
    hit = wanted.select(slot.alias("slot")).distinct()
    near = docs.withColumn("slot", slot).join(F.broadcast(hit), "slot", "left_semi").select("doc_id", "text")
    texts = near.join(wanted, "doc_id").select("sig", "text")
    nameless = stored(wanted.where("doc_id is null").select("sig"))
    signed = docs.where("doc_id is null").select("text").mapInArrow(_signed(width), "sig long, text string").withColumn("slot", own)
    signed = signed.join(F.broadcast(nameless.select(own.alias("slot")).distinct()), "slot", "left_semi")
    texts = texts.union(signed.dropDuplicates(["sig"]).join(nameless, "sig").select("sig", "text"))
    return stored(texts.mapInArrow(_sets(width), "sig long, tokens array<long>"))


def _close(num: int, den: int, a: str, b: str):
    """Sizes that allow the similarity at all."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (n * den >= m * num) & (m * den >= n * num)


def _enough(num: int, den: int, a: str, b: str, left=None):
    """Whether the shingles left from the first shared place on (it included) can make up the overlap."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    left = F.least(n - F.col(f"pos{a}"), m - F.col(f"pos{b}")) if left is None else left
    return left * (num + den) >= (n + m) * num


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` whose sets reach the threshold."""
    both = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", shared.alias("o"), (F.size("ta") + F.size("tb")).alias("s")).where(f"o * {num + den} >= s * {num}").select("a", "b")


def _still_open(placed: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Places of shingles that two components or more have, of nodes that may still link with another component.

    A shingle met in one component only can't be shared across. Of a pair, all shingles of the prefix that ends first and
    are shared lie in the other prefix too, so they are open: ``most``, the open places and what is behind the prefix, bounds the
    overlap, and a node with fewer places than its match count links with none whose prefix ends at or after its own. The
    prefix that ends later may share more than its places show, and is not bounded: such a node stays (``leads`` is false)
    where a leading node's prefix ends no later. No row of a shingle in the prefix that leads a link is ever dropped.
    """
    for _ in range(2):
        known = "leads" in placed.columns
        from_ = F.min(F.when(F.col("leads"), F.col("end"))) if known else F.lit(None).cast("long")
        apart = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), from_.alias("from")).where("lo < hi")
        open_ = placed.join(apart.select("token", "from"), "token")
        if known:
            open_ = open_.where("leads or end >= from")
        open_ = stored(open_.select("token", "sig", "n", "pos", "l", "root"))
        most = F.ceil(F.first("n") * num / den) - F.first("l") + F.count("*")
        able = open_.groupBy("sig").agg(most.cast("long").alias("most"), (F.count("*") >= F.first("l")).alias("leads"))
        placed = open_.join(able.join(nodes.select("sig", "end"), "sig"), "sig")
    return stored(placed)


def _candidates(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes in different components that share enough open shingles of their prefixes.

    Side a is the one whose prefix ends first. A pair meets at its first shared shingle, which lies in the shortest prefix of
    both. A row whose open shingle before is the same on both sides isn't the first and is dropped in the join. Pairs that
    are asked for more than one match are then held against their longer prefixes.
    """
    before = F.lag("token").over(Window.partitionBy("sig").orderBy("pos")).alias("before")
    columns = ["sig", "n", "pos", "l", "root", "end", "before"]
    short = open_.select("token", *columns[:-1], "most", "leads", before).where(f"pos <= n - ceil(n * {num} / {den})")
    one = short.where("leads").select("token", F.col("most").alias("mosta"), *[F.col(c).alias(f"{c}a") for c in columns])
    two = short.select("token", *[F.col(c).alias(f"{c}b") for c in columns])
    found = one.join(two, "token").where("(enda < endb or enda = endb and siga < sigb) and roota <> rootb")
    found = found.where("beforea is null or beforeb is null or beforea <> beforeb")
    found = found.where(_close(num, den, "a", "b") & _enough(num, den, "a", "b") & _enough(num, den, "a", "b", F.col("mosta")))
    pairs = stored(found.select(F.col("siga").alias("a"), F.col("sigb").alias("b"), "na", "nb", F.least("la", "lb").alias("need")).distinct())

    lists = stored(open_.where("l > 1").groupBy("sig").agg(F.collect_list(F.struct("token", "pos")).alias("places")))  # parts of one prefix

    def within(s: str):  # the shingles of the prefix that goes with the match count
        base = F.col(f"n{s}") - F.ceil(F.col(f"n{s}") * num / den)
        return F.transform(F.filter(f"places{s}", lambda x: x["pos"] < base + F.col("need")), lambda x: x["token"])

    many = pairs.where("need > 1").join(lists.toDF("a", "placesa"), "a").join(lists.toDF("b", "placesb"), "b")
    many = many.where(F.size(F.array_intersect(within("a"), within("b"))) >= F.col("need"))
    return stored(pairs.where("need = 1").select("a", "b").union(many.select("a", "b")))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document: linked documents have Jaccard similarity ``num/den`` or more.

    Sets are distinct ``width``-word shingles of the whole text, lower case in A-Z, words between ASCII white space. A text with
    fewer words is one shingle. A null, empty or blank text has an empty set and is linked with nothing. The component is
    the smallest doc_id reachable by links, over rows without an id too. Rows that share a doc_id each get a row; a null
    doc_id has a null component unless an id is reachable. Columns other than doc_id and text are not read.
    """
    return duplicate_groups(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def text_tag(text: Column) -> Column:
    """A hash by which rows of one doc_id are told apart."""
    return F.xxhash64(text.cast("string"))


def duplicate_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``near_duplicates`` with ``tag``, the row's ``text_tag``, and ``group_id``, which is the same for linked rows and differs for others.

    A component_id may stand for two groups, if an id is repeated with other texts; a group_id doesn't. It is null without shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag(F.col("text")).alias("tag"))
    common, counts = common_shingles(docs, width)
    made = stored(docs.mapInArrow(_tagged(_prefixes(width, num, den, common, counts)), "doc_id long, n long, sig long, l int, end long, prefix array<long>, tag long"))
    nodes = stored(made.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("end").alias("end")))

    postings = made.where("n > 0").select("sig", "n", "l", F.posexplode("prefix").alias("pos", "token")).select("token", "pos", "sig", "n", "l")
    shared = stored(
        postings.repartition("token")
        .sortWithinPartitions("token", "pos", "sig")
        .mapInArrow(_shared, "token long, sig long, n long, pos int, l int, sig1 long, n1 long, pos1 int, l1 int")
    )

    # each node with the first node of its shingles: the one it shares most of them with
    met = shared.where(F.col("sig") != F.col("sig1")).where(_close(num, den, "", "1") & _enough(num, den, "", "1"))
    heads = met.groupBy("sig", "sig1").agg(F.count("*").alias("many"))
    best = stored(heads.groupBy("sig").agg(F.max_by("sig1", F.struct("many", "sig1")).alias("b")).withColumnRenamed("sig", "a"))

    links = stored(_verified(best, _needed_sets(docs, nodes, best, width), num, den))
    roots = stored(components(links))

    # all candidate pairs that are still apart
    placed = shared.select("token", "sig", "n", "pos", "l").join(roots, shared.sig == roots.node, "left").select(
        "token", "sig", "n", "pos", "l", F.coalesce("root", "sig").alias("root")
    )
    open_ = _still_open(placed, nodes, num, den)
    pairs = _candidates(open_, num, den)
    more = _verified(pairs, _needed_sets(docs, nodes, pairs, width), num, den)

    joined = components(links.union(more))
    named = joined.join(nodes, joined.node == nodes.sig).select("node", "root", "rep")
    lowest = named.groupBy("root").agg(F.min("rep").alias("low"))
    label = stored(named.join(lowest, "root").select(F.col("node").alias("sig"), "root", "low"))
    known = nodes.join(label, "sig", "left").select("sig", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "sig").alias("group_id"))
    full = made.where("n > 0").join(known, "sig").select("doc_id", "tag", F.col("n").alias("n_shingles"), "component_id", "group_id")
    return full.union(made.where("n = 0").select("doc_id", "tag", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long")))


def sql(width: int, num: int, den: int) -> str:
    """The same result in DuckDB, by counting shared shingles of all pairs and walking the links."""
    gram = "array_to_string(words[i:i + {}], ' ')".format(width - 1)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width - 1}, least(len(words), 1)) + 1)) AS i FROM w),
s AS (SELECT DISTINCT doc_id, {gram} AS gram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * o >= {num} * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
