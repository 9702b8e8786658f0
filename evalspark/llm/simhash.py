"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

Fingerprints: a bit is 1 if it is set in over half the 64-bit hashes of a text's word shingles.

Candidates: the 64 bits are dealt to partitions, correlated bits into the same one, and each partition i gets a
threshold t_i from -1 up with sum ``max_bits - m + 1``: two fingerprints within ``max_bits`` are then within t_i on
some partition. How many partitions and which thresholds is found by dynamic programming on the number of probes
and of candidates that a bounded sample of fingerprints lets expect. Each fingerprint is indexed by its bits on
every partition and probes with all values within the threshold; each candidate is verified.

A bucket of more than ``BUCKET`` fingerprints is not compared pair by pair: the fingerprints in it and those that probe
it are sent to all values within ``max_bits / 2`` bits (``max_bits`` is at most 2 there). Two within ``max_bits`` meet
at one in the middle, and all that meet at a value are linked to one of them.

Equal fingerprints are one node, with their smallest id. Null and empty texts have fingerprint zero; null ids
take part and are nobody's smallest id (a group of null ids only has a null component). Repeated rows
are linked as equal ones.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, text_or_empty
from evalspark.llm.components import components

SHINGLE, MAX_BITS = 3, 2
SAMPLE = 2048  # fingerprints that partitions and thresholds are estimated from
BUCKET = 100
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (signed) of a text's word shingles; A-Z are lower-cased, repeats count."""
    words = text.encode().lower().split() if text else ()  # of bytes: ASCII letters, and white space as contracted
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    ones, n, hashed = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    while some := b"".join([hashed(g, SEED) for g in itertools.islice(grams, 1 << 15)] if len(words) > shingle else [hashed(g, SEED) for g in grams] if not n else []):
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def groups_of_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deals 64 bits to m partitions of like size, each bit to that whose bits it is most correlated with."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(float) - bits.mean(0)
    scale = np.sqrt((centred**2).sum(0))
    alike = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-12)
    np.fill_diagonal(alike, 0)
    left, out = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        start = rest[int(alike[np.ix_(rest, rest)].max(1).argmax())] if rest else 0
        group = [start]
        left.discard(start)
        while len(group) < size:
            rest = sorted(left)
            best = rest[int(alike[np.ix_(rest, group)].mean(1).argmax())]
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def plan(sample: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each partition that is probed, from a sample of n fingerprints in all."""
    if len(sample) < 2:
        sample = np.array([0, 2**64 - 1], np.uint64)
    best: tuple[float, list] = (math.inf, [])
    pairs = len(sample) * (len(sample) - 1)
    for m in range(2, max_bits + 3):
        groups = groups_of_bits(sample, m)
        cost = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)
            near = np.bincount(apart.ravel(), minlength=65).cumsum() - len(sample)
            row = {-1: 0.0}
            probes = 0
            for t in range(max_bits + 1):
                probes += math.comb(len(bits), t)
                chance = max(near[t] / pairs, probes / 2.0 ** len(bits))
                row[t] = n * (1.0 + probes) + n * float(n) * chance / 8  # a row shuffled costs about 8 comparisons
            cost.append(row)
        # least total cost over thresholds with the given sum, partition by partition
        sums = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in sums.items():
                for t, x in row.items():
                    if c + x < step.get(s + t, (math.inf, []))[0]:
                        step[s + t] = (c + x, [*ts, t])
            sums = step
        total, ts = sums[max_bits - m + 1]
        if total < best[0]:
            best = (total, [(sum(1 << b for b in bits), bits, t) for bits, t in zip(groups, ts) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET, col: str = "fp") -> DataFrame:
    """``a, b`` (a > b): links that connect what is within ``max_bits`` among distinct fingerprints ``col``. In normal
    buckets every linked pair is given; in large ones each is joined to the smallest that meets at the same value."""
    if max_bits > 2:
        raise ValueError("large buckets are resolved for at most 2 bits")
    prints = prints.select(F.col(col).alias("fp"))
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan(np.array([r["fp"] for r in sample], np.int64).astype(np.uint64), n, max_bits)
    own = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, (mask, _, _) in enumerate(parts)))
    index = prints.select("fp", F.explode(own).alias("k")).select("fp", "k.i", "k.key")
    flips = [(i, _signed(mask), _signed(sum(1 << b for b in some))) for i, (mask, bits, t) in enumerate(parts) for r in range(t + 1) for some in itertools.combinations(bits, r)]
    tries = F.transform(
        F.array(*(F.struct(F.lit(i).alias("i"), F.lit(mask).alias("mask"), F.lit(flip).alias("flip")) for i, mask, flip in flips)),
        lambda s: F.struct(s["i"].alias("i"), F.col("fp").bitwiseAND(s["mask"]).bitwiseXOR(s["flip"]).alias("key")),
    )
    probes = prints.select("fp", F.explode(tries).alias("k")).select("fp", "k.i", "k.key")
    large = cut(index.groupBy("i", "key").count().filter(F.col("count") > bucket).select("i", "key"))
    few = index.join(large, ["i", "key"], "left_anti").alias("x")
    near = (F.col("x.fp") != F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
    pairs = few.join(probes.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & near)
    pairs = pairs.select(F.greatest("x.fp", "y.fp").alias("a"), F.least("x.fp", "y.fp").alias("b"))

    crowd = probes.join(large, ["i", "key"], "left_semi").select("fp").distinct()
    middle = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << b)) for b in range(64)))
    met = crowd.select("fp", F.explode(F.transform(middle, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    met = met.groupBy("at").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 65 values are within one bit
    stars = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` of each row: a hash of its text (null as empty), the fingerprint
    (signed long), the smallest fingerprint of its group, which names the group, and the smallest id in it."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), prints(F.col(text_col)).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, max_bits))
    found = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(least, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each group: that with the smallest id (of rows that share it, one with the smallest hash of
    its text; null ids last). Groups that share an id keep one each. All columns are kept."""
    from pyspark.sql import Window

    found = near_duplicates(docs, id_col, text_col, **kw)
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    kept = least.select(F.struct("doc_id", "text_hash").alias("key"))
    # each row travels as one struct, so its columns may have any names
    named = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")).alias("key"))
    named = named.join(kept, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col(f"row.`{text_col}`").isNull()))  # of repeated rows
    return named.withColumn("first", first).filter("first = 1").select(*(F.col(f"row.`{c}`") for c in docs.columns))
