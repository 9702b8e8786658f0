"""Trie of conversation prefixes on minimal perfect hash tables (operator 11).

Conversation c is rebuilt: the first h turns of conversation ``c - c % 20`` (h = crc32 of c's decimals, modulo 4), then its
own turns after its first h. A node is a distinct sequence of first turns; it is named by its *digest*, a polynomial over
128-bit hashes of its turns modulo a prime of 127 bits. Digests of prefixes are running sums, so the turns of one conversation
may be spread over tasks, and the digest of a rebuilt prefix follows from digests of original ones.

- Turns are dealt by range of (conversation, turn), each range adds up its own; the driver adds the ranges' totals of
  conversations that go over a border (at most two rows a range).
- Equal prefixes are counted with partial sums before any shuffle. A node's weight is the number of (conversation, depth)
  below it, counted alike; it is at least the number of nodes below.
- Subtrees of at most ``limit`` weight are shards: a shard's nodes meet in one task. Their digests get slots of a minimal
  perfect hash table, each slot verified against the digest that it holds (two nodes of one digest raise); counts
  are scattered into flat arrays, and leaves and savings are added up through the array of parents' slots in order of
  depth, deepest first.
- What is above the shards is a smaller trie, with the shards' sums at its ends; it is worked through in the same way,
  until nothing is above.
- Ids of the conversations that end at a node are sorted by range, joined to pieces of text in each, and the pieces hashed
  one after another (SHA-256 goes in order), so nobody holds the ids of a node that a large part of all conversations share.

Defined cases: null role and text are empty. Turns: null first; equal ones by role, then by SHA-256 of role and text; repeated
rows are turns of their own. Rows without conversation id are left out. ``%`` has the sign of c. An empty table
gives no rows. Other columns are not read. Texts are taken whole; only their hashes are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, cut, n_partitions

PRIME = 2**127 - 1
BASE = 0x5DEECE66D1B54A32D192ED03A3B5F0C7 % PRIME  # fixed value
ZERO = bytes(16)  # digest of the root
HEAD = 3  # most turns taken from the other conversation
LIMIT = 10_000  # weight of a shard
BLOCK = 100_000  # nodes of shards in one table, if they allow
PIECE = 8_192  # ids in a piece of text
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _int(digest: bytes) -> int:
    return int.from_bytes(digest, "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, t (hash of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), t.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")
    )


RUN = "conv bigint, part int, i bigint, digest binary, parent binary, words bigint, edge boolean"


def _running(batches):
    """Sorted turns of a range to rows of ``RUN``: number and digest of each turn counted from the range's start. ``edge``: the last
    row of the first and of the last conversation of the range."""
    part, conv, i, total, power, number, first = TaskContext.get().partitionId(), None, 0, 0, 1, 0, True
    names = [x.split()[0] for x in RUN.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    held: list | None = None  # the last row waits: whether its conversation goes on shows with the next one
    for batch in batches:
        out = []
        for c, t, words in zip(*(batch.column(k).to_pylist() for k in ("conv", "t", "words"))):
            if held is not None:
                if c != conv:
                    held[6], first = first, False
                out.append(held)
            if c != conv:
                conv, i, total, power, number = c, 0, 0, 1, number + 1
            i, power = i + 1, power * BASE % PRIME
            before, total = total, (total + (_int(t) % PRIME) * power) % PRIME
            held = [c, part, i, _bytes(total), _bytes(before), words, False]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*out), kinds)], names=names)
    if held is not None:
        held[6] = True
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, kinds)], names=names)


def _carried(before: dict):
    """Rows of ``RUN`` with numbers and digests counted from the conversation's start. before: (conv, part) to
    (turns, digest) of earlier ranges, where there are any."""

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column("conv").to_pylist(), batch.column("part").to_pylist()))
            if any(k in before for k in keys):
                cols = {n: batch.column(n).to_pylist() for n in ("i", "digest", "parent")}
                for r, key in enumerate(keys):
                    if key in before:
                        n, digest = before[key]
                        power = pow(BASE, n, PRIME)
                        cols["i"][r] += n
                        for name in ("digest", "parent"):
                            cols[name][r] = _bytes((digest + power * _int(cols[name][r])) % PRIME)
                arrays = [pa.array(cols[n], batch.schema.field(n).type) if n in cols else batch.column(n) for n in batch.schema.names]
                batch = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
            yield batch

    return run


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of ``RUN`` for all turns, numbered from 1 within their conversation."""
    order = ["conv", "turn", "role", "t", "salt"]  # salt: equal rows may go to several ranges
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(n_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    runs = cut(spread.select("conv", "t", "words").mapInArrow(_running, RUN))
    before: dict = {}
    edges = sorted({(r["conv"], r["part"], r["i"], bytes(r["digest"])) for r in runs.filter("edge").select("conv", "part", "i", "digest").collect()})
    for (conv, part, n, digest), (c2, p2, _, _) in zip(edges, edges[1:]):  # at most two rows a range
        if conv == c2:
            n0, d0 = before.get((conv, part), (0, 0))
            before[c2, p2] = (n0 + n, (d0 + pow(BASE, n0, PRIME) * _int(digest)) % PRIME)
    return runs.mapInArrow(_carried(before), RUN).drop("edge", "part")


def _rebased(batches):
    """Digests of own turns moved to their place in the rebuilt conversation."""
    powers = {k: pow(BASE, k, PRIME) for k in range(-HEAD, 1)}  # never later than they were
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("digest", "parent", "shift", "cut_digest", "head_digest")]
        digests, parents = [], []
        for d, p, k, c, h in zip(*cols):
            power, c, h = powers[k], _int(c), _int(h)
            digests.append(_bytes((h + power * (_int(d) - c)) % PRIME))
            parents.append(_bytes((h + power * (_int(p) - c)) % PRIME))
        keep = ["conv", "depth", "words", "len"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(digests, pa.binary()), pa.array(parents, pa.binary())], names=[*keep, "digest", "parent"])


def members(conversations: DataFrame) -> DataFrame:
    """conv, depth, words, len, digest, parent: a row for each conversation and each node that it starts with, written."""
    runs = numbered(cut(turns(conversations)))  # one pass over the texts: dealing by range reads its input twice
    head = F.sort_array(F.collect_list(F.when(F.col("i") <= HEAD, F.struct("i", "digest", "parent", "words"))))
    convs = cut(runs.groupBy("conv").agg(F.max("i").alias("n"), head.alias("head")))
    other = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    plan = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4)
    plan = plan.withColumn("base", F.col("conv") - F.col("conv") % 20).join(other, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    digest_at = lambda arr, k: F.coalesce(F.try_element_at(arr, F.greatest(k, F.lit(1)).cast("int"))["digest"], F.lit(ZERO))
    plan = plan.select(
        "conv",
        "h",
        "k",
        (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        F.when(F.col("h") > 0, digest_at("head", F.col("h"))).otherwise(F.lit(ZERO)).alias("cut_digest"),
        F.when(F.col("k") > 0, digest_at("base_head", F.col("k"))).otherwise(F.lit(ZERO)).alias("head_digest"),
        F.slice(F.coalesce("base_head", F.array().cast("array<struct<i:bigint,digest:binary,parent:binary,words:bigint>>")), F.lit(1), F.col("k").cast("int")).alias("heads"),
    )
    plan = cut(plan)
    own = runs.join(plan.select("conv", "h", "k", "len", "cut_digest", "head_digest"), "conv").filter("i > h")
    own = own.select("conv", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "words", "len", "digest", "parent", (F.col("k") - F.col("h")).cast("int").alias("shift"), "cut_digest", "head_digest")
    kind = "conv bigint, depth bigint, words bigint, len bigint, digest binary, parent binary"
    own = own.mapInArrow(_rebased, kind)
    root = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(ZERO).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("words"))
    heads = plan.select("conv", "len", F.explode(F.concat(F.array(root), "heads")).alias("x"))
    heads = heads.select("conv", F.col("x.i").alias("depth"), "x.words", "len", "x.digest", "x.parent")
    return cut(own.unionByName(heads))


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests (n x 2 unsigned longs): in each level the digests that are alone at
    their place of a bit array stay there, the others go on to the next one; a slot is the number of set bits before."""

    def __init__(self, digests: np.ndarray) -> None:
        n = len(digests)
        self.levels, self.slots = [], np.empty(n, np.int64)
        left, start = np.arange(n), 0
        while len(left):
            if len(self.levels) == 40:
                raise ValueError("two nodes have the same digest")
            size = max(2, int(1.7 * len(left)))
            at = self._place(digests[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            ranks = start - 1 + np.cumsum(bits)
            self.levels.append((size, bits, ranks))
            self.slots[left[alone]] = ranks[at[alone]]
            start += int(alone.sum())
            left = left[~alone]
        self.keys = np.empty_like(digests)
        self.keys[self.slots] = digests

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        z = (digests[:, 0] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29)) ^ digests[:, 1]) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 where the slot's own digest is another one."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._place(digests[left], level, size)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        seen = np.flatnonzero(out >= 0)
        out[seen[(self.keys[out[seen]] != digests[seen]).any(1)]] = -1
        return out


def _pairs(digests: list) -> np.ndarray:
    return np.frombuffer(b"".join(d if d is not None else b"\xff" * 16 for d in digests), np.uint64).reshape(-1, 2)


SOLVED = "digest binary, depth bigint, conv bigint, n_convs bigint, parent binary, parent_conv bigint, n_children bigint, n_leaves bigint, saved bigint"


def solve(rows: dict) -> pa.RecordBatch:
    """Nodes of whole shards (lists by column) to rows of ``SOLVED``; n_children, n_leaves and saved come with what is below already."""
    table = SlotTable(_pairs(rows["digest"]))
    slot, n = table.slots, len(table.slots)

    def flat(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slot] = rows[name]
        return out

    depth, conv, n_convs, words = map(flat, ("depth", "conv", "n_convs", "words"))
    children, leaves, saved = map(flat, ("n_children", "n_leaves", "saved"))
    parent = np.empty(n, np.int64)
    parent[slot] = table.find(_pairs(rows["parent"]))
    parent[(depth == 0)] = -1
    np.add.at(children, parent[parent >= 0], 1)
    leaves += children == 0
    saved += (n_convs - 1) * words
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(depth[order]) != 0, [True]]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        level = order[a:b]
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = parent[slot]
    inside = up >= 0
    cols = [
        pa.array(rows["digest"], pa.binary()),
        *(pa.array(x[slot]) for x in (depth, conv, n_convs)),
        pa.array(rows["parent"], pa.binary()),
        pa.array(conv[np.maximum(up, 0)], pa.int64(), mask=~inside),
        *(pa.array(x[slot]) for x in (children, leaves, saved)),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SOLVED.split(", ")])


def _shards(batches):
    """Nodes sorted by shard to rows of ``SOLVED``; whole shards, about ``BLOCK`` nodes, at a time."""
    names = ["digest", "parent", "depth", "conv", "n_convs", "words", "n_children", "n_leaves", "saved"]
    held = {n: [] for n in names}
    last = None
    for batch in batches:
        shards = batch.column("shard").to_pylist()
        cols = [batch.column(n).to_pylist() for n in names]
        for shard, *row in zip(shards, *cols):
            if shard != last and len(held["digest"]) >= BLOCK:
                yield solve(held)
                held = {n: [] for n in names}
            last = shard
            for n, x in zip(names, row):
                held[n].append(x)
    if held["digest"]:
        yield solve(held)


def _pieces(batches):
    """(digest, conv), sorted, to (digest, first, ids): decimals of up to ``PIECE`` conversations, comma-joined."""
    digest, ids = None, []

    def piece():
        return [digest], [ids[0]], [",".join(map(str, ids))]

    def batch_of(rows):
        cols = [sum(c, []) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"])

    for batch in batches:
        out = []
        for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (d != digest or len(ids) == PIECE):
                out.append(piece())
                ids = []
            digest = d
            ids.append(c)
        if out:
            yield batch_of(out)
    if ids:
        yield batch_of([piece()])


def _hashed(batches):
    """Pieces, sorted, to (digest, ends_sha256); one piece is held at a time."""
    digest, state = None, None
    done: list = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], names=["digest", "ends_sha256"])

    for batch in batches:
        for k in range(batch.num_rows):
            d, ids = batch.column("digest")[k].as_py(), batch.column("ids")[k].as_py()
            if d != digest:
                if state is not None:
                    done.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield batch_of(done)
            done = []
    if state is not None:
        yield batch_of([(digest, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the nodes where conversations end. rows: (digest, conv)."""
    n = n_partitions(rows.sparkSession)
    pieces = rows.repartitionByRange(n, "digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(_pieces, "digest binary, first bigint, ids string")
    return pieces.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node."""
    spark = conversations.sparkSession
    n = n_partitions(spark)
    rows = members(conversations)
    # the parent and the words follow from the digest: as grouping columns they need not be buffers
    nodes = rows.groupBy("digest", "depth", "parent", "words").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight")
    )
    none = F.lit(0).cast("bigint")
    nodes = cut(nodes.withColumns({"n_children": none, "n_leaves": none, "saved": none}))
    paths = rows.select("conv", "depth", "digest")
    solved = []
    while True:
        paths = paths.join(nodes.select("conv").distinct(), "conv", "left_semi")  # of the conversations that name a node
        top = cut(nodes.filter(F.col("weight") > limit))
        rest = nodes.filter(F.col("weight") <= limit)
        above = top.count()
        if above:
            depths = paths.join(top.select("digest"), "digest", "left_semi").groupBy("conv").agg(F.max("depth").alias("above"))
            shards = paths.join(depths, "conv").filter("depth = above + 1").select("conv", F.col("digest").alias("shard"))
            rest = rest.join(shards, "conv")
        else:
            rest = rest.withColumn("shard", F.lit(ZERO))
        done = rest.repartition(n, "shard").sortWithinPartitions("shard").drop("weight").mapInArrow(_shards, SOLVED)
        parents = top.select(F.col("digest").alias("parent"), F.col("conv").alias("top_conv"))
        done = cut(done.join(parents, "parent", "left").withColumn("parent_conv", F.coalesce("parent_conv", "top_conv")).withColumn("tip", F.col("top_conv").isNotNull()).drop("top_conv"))
        solved.append(done)
        if not above:
            break
        below = done.filter("tip").groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        paths = cut(paths.join(top.select("digest"), "digest", "left_semi").join(top.select("conv").distinct(), "conv", "left_semi"))
        length = paths.groupBy("conv").agg(F.max("depth").alias("len"))
        weights = paths.join(length, "conv").groupBy("digest").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
        nodes = top.drop("weight").join(weights, "digest").join(below.withColumnRenamed("parent", "digest"), "digest", "left")
        add: dict[str, Column] = {a: F.col(a) + F.coalesce(b, none) for a, b in (("n_children", "c"), ("n_leaves", "l"), ("saved", "s"))}
        nodes = cut(nodes.withColumns(add).drop("c", "l", "s"))
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    out = out.join(ends(rows.filter("depth = len").select("digest", "conv")), "digest", "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
