"""The trie of conversation prefixes, with counts over subtrees.

A prefix is known by 128 bits: the exclusive or of a hash of (position, role, text) for each of its turns. So prefixes of a long
conversation come from slots of turns, and the parent's digest is the node's without its last turn. Distinct digests are the
nodes.

Sums over subtrees need nodes with two or more members only (below others there is one chain without savings, and one leaf).
These are cut into components: nodes with at most ``SPLIT`` members, with at most ``SPLIT ** 2``, and so on, and again every
``BAND`` turns of depth. A component holds at most ``SPLIT`` nodes of each depth, whatever the conversations share. Components of
a class are dealt into shards. In a shard, a minimal perfect hash gives each digest a slot, at which the digest is kept and
checked; counts are scattered into flat arrays by slot and summed through an array of parent slots, deepest nodes first. A
component's sum then goes to the node above, in a component of a later round; rounds grow with the logarithm of the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import mix, stored

SPLIT = 512
BAND = 1024
SLOT = 4096
SHARD_NODES = 1 << 16
SHARDS = 16
Z = ["z1", "z2"]
P = ["p1", "p2"]


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, each verified by the digest kept in it.

    Level by level, digests that are alone at their place of a bit table of twice their number are settled there; the others go
    on to the next level with another seed. A digest's slot is the number of set bits before its own.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []  # per level, the rank of each place, or -1
        rest, given = np.arange(len(one)), 0
        slots = np.zeros(len(one), np.int64)
        while len(rest):
            at = self._place(one[rest], two[rest], len(self.levels), 2 * len(rest))
            alone = np.bincount(at, minlength=2 * len(rest)) == 1
            rank = np.where(alone, given + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            slots[rest] = rank[at]
            given += int(alone.sum())
            rest = rest[~alone[at]]
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
        self.one, self.two = np.zeros_like(one), np.zeros_like(two)
        self.one[slots], self.two[slots] = one, two
        self.slots = slots

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(one.view(np.uint64) ^ mix(two.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those not in the table."""
        out = np.full(len(one), -1, np.int64)
        rest = np.arange(len(one))
        for level, rank in enumerate(self.levels):
            got = rank[self._place(one[rest], two[rest], level, len(rank))]
            out[rest[got >= 0]] = got[got >= 0]
            rest = rest[got < 0]
        met = out >= 0
        same = (self.one[out[met]] == one[met]) & (self.two[out[met]] == two[met])
        out[np.flatnonzero(met)[~same]] = -1
        return out


def _accumulated(nodes: pa.Table) -> pa.Table:
    """A shard's nodes with ``leaves`` and ``saved`` summed over what of their subtrees lies in the shard and came to it."""
    one, two, p1, p2, depth, leaves, saved = (nodes.column(c).to_numpy().copy() for c in (*Z, *P, "depth", "leaves", "saved"))
    table = SlotTable(one, two)
    at, above = table.slots, table.of(p1, p2)
    root = depth == 0
    above[root] = -1
    parent, deep, n_leaves, n_saved = (np.zeros(len(at), np.int64) for _ in range(4))
    parent[at], deep[at], n_leaves[at], n_saved[at] = above, depth, leaves, saved
    order = np.argsort(-deep, kind="stable")
    cuts = np.flatnonzero(np.diff(deep[order])) + 1
    for own in np.split(order, cuts):  # the deepest nodes first
        own = own[parent[own] >= 0]
        np.add.at(n_leaves, parent[own], n_leaves[own])
        np.add.at(n_saved, parent[own], n_saved[own])
    columns = [pa.array(c) for c in (one, two, p1, p2, above < 0, n_leaves[at], n_saved[at])]
    return pa.table(columns, [*Z, *P, "top", "leaves", "saved"])


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, the place of a turn in its conversation from 1; turns of a conversation are counted in slots."""
    slot = F.coalesce(F.floor(F.col("turn") / SLOT), F.lit(-(1 << 62)))
    dealt = rows.withColumn("slot", slot)
    near = Window.partitionBy("conv", "slot").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    local = dealt.withColumn("at", F.row_number().over(near).cast("long"))
    sizes = dealt.groupBy("conv", "slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("conv", "slot", before.alias("before")).where("before > 0")  # rows of conversations with several slots
    return local.join(shift, ["conv", "slot"], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0))).drop("slot", "before")


def _prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (``conv, at, t1, t2, bytes``) with the digests of the prefix that ends here (z1, z2) and of the one before it."""
    turn = rows.select("conv", "at", "bytes", F.xxhash64("at", "t1").alias("u1"), F.xxhash64("at", "t2").alias("u2"), F.floor(F.col("at") / SLOT).alias("slot"))
    near = Window.partitionBy("conv", "slot").orderBy("at")
    local = turn.select("*", F.expr("bit_xor(u1)").over(near).alias("x1"), F.expr("bit_xor(u2)").over(near).alias("x2"))
    whole = turn.groupBy("conv", "slot").agg(F.expr("bit_xor(u1)").alias("w1"), F.expr("bit_xor(u2)").alias("w2"))
    over = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("conv", "slot", F.expr("bit_xor(w1)").over(over).alias("c1"), F.expr("bit_xor(w2)").over(over).alias("c2"))
    carry = carry.where("slot > 0 and c1 is not null")
    both = local.join(carry, ["conv", "slot"], "left")
    z = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))).alias(f"z{i}") for i in (1, 2)]
    both = both.select("conv", F.col("at").alias("depth"), "bytes", "u1", "u2", *z)
    return both.select("conv", "depth", "bytes", *Z, *[F.col(f"z{i}").bitwiseXOR(F.col(f"u{i}")).alias(f"p{i}") for i in (1, 2)])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations as ``conv, h``, and the turns of their rebuilt forms as ``conv, at, t1, t2, bytes``.

    Conversation c is the first ``h = crc32(c) % 9`` turns of conversation ``c - c % 5``, then its own turns after the first h.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    said = turns.select(
        "conv", "turn", F.xxhash64(F.lit(1), "role", F.octet_length("role"), "text").alias("t1"), F.xxhash64(F.lit(2), "role", F.octet_length("role"), "text").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    said = stored(_positions(said))
    sizes = said.groupBy("conv").agg(F.max("at").alias("size"))
    convs = sizes.select("conv", "size", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9)).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = stored(convs.join(of_base, "base", "left").withColumn("base_size", F.coalesce("base_size", F.lit(0))))
    heads = said.where("at <= 8").select(F.col("conv").alias("base"), "at", "t1", "t2", "bytes")
    heads = convs.where("h > 0").select("conv", "base", "h").join(heads, "base").where("at <= h").select("conv", "at", "t1", "t2", "bytes")
    own = said.join(convs.select("conv", "h", "base_size"), "conv").where("at > h")
    own = own.withColumn("at", F.col("at") - F.col("h") + F.least("h", "base_size")).select("conv", "at", "t1", "t2", "bytes")
    return convs.select("conv", "h"), heads.union(own)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal digests in sorted rows, each with its first member and all members joined; a batch bounds a run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, conv = (batch.column(c).to_numpy() for c in (*Z, "conv"))
        cuts = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        starts = np.concatenate(([0], cuts))
        names = conv.astype(str).tolist()
        joined = [",".join(names[a:b]) for a, b in zip(starts, [*cuts, len(names)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(one[starts]), pa.array(two[starts]), pa.array(conv[starts]), pa.array(joined)], [*Z, "conv", "members"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of all members of each digest, from its chunks in order; one hash state is held at a time."""
    key, state = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for one, two, text in zip(*(batch.column(c).to_pylist() for c in (*Z, "members")), strict=True):
            if (one, two) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (one, two), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*Z, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], [*Z, "ends_sha256"])


def _ends(members: DataFrame, parts: int) -> DataFrame:
    """``z1, z2, ends_sha256`` of ``z1, z2, conv``: members in order, dealt by ranges, so that a digest with many is split."""
    chunks = members.repartitionByRange(parts, *Z, "conv").sortWithinPartitions(*Z, "conv").mapInArrow(_chunks, "z1 long, z2 long, conv long, members string")
    ranked = stored(chunks).repartition(parts, *Z).sortWithinPartitions(*Z, "conv")
    return ranked.mapInArrow(_digests, "z1 long, z2 long, ends_sha256 string")


def _subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``z1, z2, n_leaves, saved_tokens`` of the nodes with two or more members."""
    shared = nodes.where("n_convs > 1")
    steps = F.ceil(F.log(F.col("n_convs").cast("double")) / F.log(F.lit(float(SPLIT))) - 1e-9)  # which border is a component's is free
    shared = shared.withColumn("class", F.greatest(steps.cast("int"), F.lit(1))).withColumn("band", F.floor(F.col("depth") / BAND))
    # a node's component is known by its first node on the path of the node's smallest member
    paths = rows.join(shared.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_semi")
    paths = stored(paths.select("conv", "depth", *Z).join(shared.select(*Z, "class", "band"), Z))
    tops = paths.groupBy("conv", "class", "band").agg(F.min_by(F.struct(*Z), "depth").alias("head"))
    shared = shared.join(tops.withColumnRenamed("conv", "conv_id"), ["conv_id", "class", "band"], "left")
    # paths begin at depth 1; what is of the root's class and band hangs together with the root
    root = shared.where("depth = 0").select("class").first()
    of_root = (F.col("class") == (root["class"] if root else -1)) & (F.col("band") == 0)
    shared = shared.withColumn("head", F.when(of_root, F.struct(*[F.lit(0).cast("long").alias(z) for z in Z])).otherwise(F.col("head")))
    start = shared.select(
        "class", "band", "head", *Z, *P, "depth",
        (F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves0"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved0"),
    )
    start = stored(start)
    rounds = start.groupBy("class", "band").agg(F.count("*").alias("n")).orderBy(F.col("class"), F.col("band").desc()).collect()
    done, sent = None, None
    for r in rounds:
        now = start.where((F.col("class") == r["class"]) & (F.col("band") == r["band"]))
        if sent is None:
            now = now.select("*", F.col("leaves0").alias("leaves"), F.col("saved0").alias("saved"))
        else:
            got = sent.groupBy(*Z).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
            now = now.join(got, Z, "left").withColumn("leaves", F.col("leaves0") + F.coalesce("more", F.lit(0)))
            now = now.withColumn("saved", F.col("saved0") + F.coalesce("more_saved", F.lit(0)))
        shards = max(SHARDS, r["n"] // SHARD_NODES)
        now = now.select(*Z, *P, "depth", "leaves", "saved", F.pmod(F.xxhash64("head"), F.lit(shards)).alias("shard"))
        out = now.groupBy("shard").applyInArrow(_accumulated, "z1 long, z2 long, p1 long, p2 long, top boolean, leaves long, saved long")
        out = stored(out)
        up = out.where("top").select(F.col("p1").alias("z1"), F.col("p2").alias("z2"), "leaves", "saved")
        sums = out.select(*Z, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        sent, done = (up, sums) if done is None else (sent.union(up), done.union(sums))
    return nodes.sparkSession.createDataFrame([], "z1 long, z2 long, n_leaves long, saved_tokens long") if done is None else done


def trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct prefix of rebuilt conversations, as the registered query returns it.

    ``conversations`` has ``conv_id, turn, role, text``; other columns don't matter. Null roles and texts are empty; null turns
    come first, and turns with equal numbers follow each other by a hash of role and text, repeated rows included. Rows
    without a conv_id belong to no conversation and are not looked at. An empty table has no rows, not even the root.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs, turns = rebuilt(conversations)
    rows = stored(_prefixes(turns))
    inner = rows.groupBy(*Z).agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), (F.max("p1") == F.min("p1")).alias("same"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("z1"), zero.alias("z2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    checked = F.when(F.col("same"), F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes with equal digests")))
    plain = stored(inner.withColumn("depth", checked).drop("same").unionByName(root))
    below = plain.where("depth > 0").groupBy(*P).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    below = below.select(F.col("p1").alias("z1"), F.col("p2").alias("z2"), "n_children", "single")
    nodes = plain.join(below, Z, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "single")})
    nodes = stored(nodes)
    sums = _subtree_sums(rows, nodes)

    last = rows.groupBy("conv").agg(F.max_by(F.struct(*Z), "depth").alias("z"))
    members = convs.join(last, "conv", "left").select(F.coalesce("z.z1", zero).alias("z1"), F.coalesce("z.z2", zero).alias("z2"), "conv")
    ends = stored(_ends(members, parts))

    above = nodes.where("n_children > 0").select(F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    low = convs.agg(F.min("conv")).first()[0]  # the root's, which may have any number of children
    near = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(low).cast("long")))
    deep = nodes.where("depth > 1").join(above.where("p1 <> 0 or p2 <> 0"), P, "left")
    placed = stored(deep.select(*nodes.columns, "parent_conv_id").unionByName(near))
    out = placed.join(sums, Z, "left").join(ends, Z, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(s) + 1),
    lambda i: list_prepend(ascii(s[i])::bigint, [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295::bigint)"""

SQL = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
),
sizes as (select conv_id, max(place) as size from turns group by conv_id),
convs as (
  select conv_id, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from (select conv_id, conv_id::varchar as s from sizes)
),
parts as (
  select c.conv_id, 0 as own, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.place <= c.h
  union all
  select c.conv_id, 1, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place > c.h
),
placed as (select conv_id, row_number() over (partition by conv_id order by own, place) as depth, role, text from parts),
prefixes as (
  select conv_id, depth, strlen(text) as bytes,
    sha256(string_agg(sha256(role) || sha256(text), '/') over (partition by conv_id order by depth)) as node
  from placed
  union all
  select conv_id, 0, 0, '' from sizes
),
nodes as (select node, min(conv_id) as conv_id, min(depth) as depth, count(*) as n_convs, max(bytes) as bytes from prefixes group by node),
steps as (select distinct c.node, p.node as parent from prefixes c join prefixes p on c.conv_id = p.conv_id and c.depth = p.depth + 1),
children as (select parent as node, count(*) as n_children from steps group by parent),
pairs as (select distinct a.node as top, b.node from prefixes a join prefixes b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (
  select top as node, count(*) filter (n_children is null) as n_leaves, sum((n_convs - 1) * bytes) as saved
  from pairs join nodes using (node) left join children using (node) group by top
),
lasts as (select conv_id, max_by(node, depth) as node from prefixes group by conv_id),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from lasts group by node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n left join steps t using (node) left join nodes p on p.node = t.parent left join children c on c.node = n.node
left join sums s on s.node = n.node left join ends e on e.node = n.node
"""
