"""MinHash near-duplicates with SuperMinHash signatures (operator 13).

A document's set holds the 64-bit hashes of its distinct word shingles (a text of fewer words: of its whole word
sequence). Equal sets are one node, with the smallest id that has it.

Signatures: each element deals the places 0..m-1 by a permutation of its own, and offers ``j + u`` (u in [0, 1)) to the
place that its permutation names at step j; a place keeps the least offer. Since ranks of one element are
correlated through its permutation, the estimate varies less than with independent hashes. All elements of a
batch take step j together; a document stops as soon as its greatest value is below the next step's least offer.

Banding: nodes that agree on all values of a band share a bucket. With 24 bands of 5 a pair of similarity 0.85 shares
none with a chance of 8e-7.

Verification and grouping, on full sets, in blocks of bounded size (never pairs as rows):

- every node is put in a block with the smallest node of the bucket partner that it shares most bands with; in a block all
  intersections are counted exactly, as a product of membership matrices, and a union-find forest of the links is sent back;
- buckets that still hold several classes are compared again, class against class: the largest class of a bucket in
  tiles, each with the tiles of all others. Pairs of one class need no comparison, so a large group of near copies costs
  as much as its odd members. Buckets of the same members are compared once.

All links together are grouped by connected components.

Defined cases: null text, text without words: empty set, linked with nothing (its own component). Null ids take part and
are nobody's smallest id; a group of null ids only has a null component. Repeated rows are equal rows of one node.
An empty table gives no rows. Other columns of the input are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, n_partitions, text_or_empty
from evalspark.llm.components import components

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 5
TILE = 128  # nodes compared with one another in a block (a block may hold two tiles and a pivot)
UNITS = 1 << 21  # elements of a tile's sets, if its nodes allow
SLAB = 1 << 16  # elements that take a step together
COLUMNS = 1 << 13  # columns of a membership matrix held at once
RANK = np.uint32(25)  # bits of u
UNSET = np.iinfo(np.uint32).max
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of splitmix64


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; A-Z are lower-cased."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([one(b" ".join(words))], np.uint64)
    grams = set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    return np.unique(np.fromiter(map(one, grams), np.uint64, len(grams)))


def _step(state: np.ndarray) -> np.ndarray:
    """One step of splitmix64 for each element; ``state`` moves on."""
    state += GOLDEN
    z = (state ^ (state >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return z ^ (z >> np.uint64(31))


def offer(values: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lowers ``values`` (documents x m, 32 bits: rank and u) by the elements of each ``owner``."""
    m = values.shape[1]
    state, flat = elements.copy(), values.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m < 256 else np.uint16), (len(elements), 1))
    for j in range(m):
        open_docs = values.max(1) >= np.uint32(j << int(RANK))
        go = open_docs[owner]
        if not go.all():
            state, owner, perm = state[go], owner[go], perm[go]
        if not len(owner):
            return
        z = _step(state)
        k = j + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        at = np.arange(len(owner))
        place = perm[at, k].astype(np.int64)
        perm[at, k] = perm[:, j]
        np.minimum.at(flat, owner * m + place, np.uint32(j << int(RANK)) | (z >> np.uint64(39)).astype(np.uint32))


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A signature of m 16-bit values for each set (of an empty one it means nothing)."""
    values = np.full((len(sets), m), UNSET, np.uint32)
    held, size = [], 0

    def send() -> None:
        docs = np.array([d for d, _ in held])
        some = values[docs]
        offer(some, np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), [len(s) for _, s in held]))
        values[docs] = some

    for d, s in enumerate(sets):
        for at in range(0, len(s), SLAB):
            part = s[at : at + SLAB]
            if held and (size + len(part) > SLAB or held[-1][0] == d):
                send()
                held, size = [], 0
            held.append((d, part))
            size += len(part)
    if held:
        send()
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _prints(shingle: int, m: int):
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
                sigs = signatures(sets, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("th"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sigs], pa.binary()),
                    ],
                    names=["doc_id", "th", "n_shingles", "key", "sig"],
                )

    return run


def _set_rows(shingle: int):
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a product of 0/1 matrices, some columns at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1  # elements of one set only meet nobody
    who, column = who[many], column[many]
    if len(column):
        again = np.ones(len(column), bool)
        again[1:] = column[1:] != column[:-1]
        column = np.cumsum(again) - 1
        edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + COLUMNS, COLUMNS))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            has = np.zeros((n, COLUMNS), np.float32)
            has[who[a:b], column[a:b] - k * COLUMNS] = 1
            out += has @ has.T
    return out


class Groups:
    """Union-find with path halving."""

    def __init__(self, names) -> None:
        self.parent = {x: x for x in names}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def block_links(nodes: list[int], classes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (larger, smaller node) of a block that connect what is linked in it and not of one class already."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.rint(intersections(sets)).astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    kind = np.array(classes)
    a, b = np.nonzero(np.triu(linked & (kind[:, None] != kind[None, :]), 1))
    groups, out = Groups(kind.tolist()), []
    for i, j in zip(a.tolist(), b.tolist()):
        if groups.join(classes[i], classes[j]):
            out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return out


def _compare(percent: int):
    """Batches of (block, node, class, elements), sorted by block, to links (a, b); one block is held at a time."""

    def links(held: dict) -> pa.RecordBatch:
        nodes = sorted(held)
        found = block_links(nodes, [held[x][0] for x in nodes], [np.frombuffer(held[x][1], np.uint64) for x in nodes], percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, last = {}, None
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                for row in whole.slice(k, 64).to_pylist():
                    if row["block"] != last and held:
                        yield links(held)
                        held = {}
                    last = row["block"]
                    held[row["node"]] = (row["class"], row["elements"])
        if held:
            yield links(held)

    return run


def _verified(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found in ``blocks`` (block: string, node, class), written."""
    rows = blocks.join(sets, "node").select("block", "node", "class", "elements")
    rows = rows.repartition(n_partitions(rows.sparkSession), "block").sortWithinPartitions("block")
    return cut(rows.mapInArrow(_compare(percent), "a bigint, b bigint"))


def _tiles(count, units, tile: int):
    return F.greatest(F.ceil(count / F.lit(tile)), F.ceil(units / F.lit(UNITS)), F.lit(1)).cast("int")


def _dealt(node, n):
    return F.pmod(F.xxhash64(F.lit("tile"), node), n).cast("int")


def star_blocks(members: DataFrame, tile: int) -> DataFrame:
    """Blocks of the first pass. members: (bucket, node, n). Every node goes, with others, to the smallest node of a
    bucket: that of those which it shares most buckets with."""
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"))
    met = members.join(pivots, "bucket").filter("node != pivot").groupBy("node", "n", "pivot").count()
    best = cut(met.groupBy("node", "n").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("pivot")))
    wide = best.groupBy("pivot").agg(_tiles(F.count("*"), F.sum("n"), tile).alias("tiles"))
    name = lambda part: F.concat_ws(":", F.col("pivot").cast("string"), part.cast("string"))
    rows = best.join(wide, "pivot").select(name(_dealt(F.col("node"), F.col("tiles"))).alias("block"), "node")
    heads = wide.select("pivot", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"))
    rows = rows.unionByName(heads.select(name(F.col("part")).alias("block"), F.col("pivot").alias("node")))
    return rows.withColumn("class", F.col("node"))


def class_blocks(members: DataFrame, classes: DataFrame, tile: int) -> DataFrame:
    """Blocks of the second pass: buckets of several classes, class against class. members: (bucket, node, n);
    classes: (node, root) of the nodes linked so far."""
    rows = members.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    rows = cut(rows)
    counts = rows.groupBy("bucket", "class").agg(F.count("*").alias("count"), F.sum("n").alias("units"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"))
    whole = counts.groupBy("bucket").agg(
        F.max_by("class", F.struct("count", "class")).alias("largest"),
        F.max(F.struct("count", "class"))["count"].alias("l_count"),
        F.max_by("units", F.struct("count", "class")).alias("l_units"),
        F.sum("count").alias("count"),
        F.sum("units").alias("units"),
        F.count("*").alias("kinds"),
        F.sum("print").alias("print"),
    )
    whole = whole.filter("kinds > 1").withColumn("first", F.struct("bucket", "largest", "l_count", "l_units"))
    whole = whole.groupBy("count", "units", "kinds", "print").agg(F.min("first").alias("first")).select("first.*", "count", "units")  # buckets of the same members: one
    whole = cut(
        whole.select(
            "bucket",
            "largest",
            _tiles(F.col("l_count"), F.col("l_units"), tile).alias("m"),
            _tiles(F.col("count") - F.col("l_count"), F.col("units") - F.col("l_units"), tile).alias("o"),
        )
    )
    rows = rows.join(whole, "bucket")
    in_largest = F.col("class") == F.col("largest")
    mine = _dealt(F.col("node"), F.when(in_largest, F.col("m")).otherwise(F.col("o")))
    rows = rows.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.col("o") - 1)
    pair = lambda kind, i, j: F.concat_ws(":", F.col("bucket").cast("string"), F.lit(kind), i.cast("string"), j.cast("string"))
    of_largest = F.transform(others, lambda i: pair("m", i, F.col("mine")))
    of_others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: pair("m", F.col("mine"), j)),
        F.when(F.col("o") > 1, F.transform(others, lambda i: pair("o", F.least(i, F.col("mine")), F.greatest(i, F.col("mine"))))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select(F.explode(F.when(in_largest, of_largest).otherwise(of_others)).alias("block"), "node", "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row: the size of its set, the smallest id linked with it at any distance,
    and whether that is its own. Linked: 100 * intersection >= ``percent`` * union."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), F.col(text_col).alias("text"))
    prints = cut(base.mapInArrow(_prints(shingle, bands * rows), f"doc_id {kind}, th bigint, n_shingles bigint, key binary, sig binary"))
    full = prints.filter("n_shingles > 0")
    # the signature follows from the key: as a grouping column it need not be a buffer
    nodes = full.groupBy("key", "sig", "n_shingles").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("rep"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    part = lambda b: F.struct(F.xxhash64(F.lit(b), F.substring("sig", 2 * rows * b + 1, 2 * rows)).alias("bucket"))
    members = nodes.select("node", F.col("n_shingles").alias("n"), F.explode(F.array(*map(part, range(bands)))).alias("k")).select("k.bucket", "node", "n")
    shared = members.groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1").select("bucket")
    members = cut(members.join(shared, "bucket"))

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th"))
    texts = base.join(wanted, base["doc_id"].eqNullSafe(F.col("r_id")) & (base["th"] == F.col("r_th"))).select("node", "text")
    sets = cut(texts.dropDuplicates(["node"]).mapInArrow(_set_rows(shingle), "node bigint, elements binary"))

    first = _verified(star_blocks(members, tile), sets, percent)
    second = _verified(class_blocks(members, components(first).select("node", "root"), tile), sets, percent)
    roots = components(first.unionByName(second))
    found = nodes.join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(least, "root").select("key", "component_id")
    out = prints.join(found, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
