"""Approximate nearest neighbours by robust-pruned directed graphs (operator 3).

Equal vectors are one node with their ``top + 1`` smallest different ids (each at most ``top`` times), so any number of
copies costs one place in the index and ties among copies are exact. Nodes are dealt to shards of about ``SHARD`` by a hash. In a shard a directed graph is built from
random edges: for each node, in batches, a greedy beam search over the graph so far proposes neighbours, and
robust pruning goes through them from near to far, keeps one and drops those that are nearer to it, by the factor ``ALPHA``, than
to the node; edges back are added and pruned alike. A query is searched with a beam in every shard; all of the beam is scored on the original vectors in double
precision, and the shards' best are merged.

All nodes of a shard search in step, so that the work is numpy's. A shard's graph is one row; queries come to it in
blocks. Vectors that are null, zero, empty or hold a null or non-finite component take no part, neither as query nor
as candidate; vectors of unlike length never meet. Rows that share a vec_id are different candidates with the same id,
except that a query leaves out all rows of its own id. No queries or no candidates give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import cut

TOP = 5
SHARD = 8_192
QUERIES = 4_096  # of a block
DEGREE, BEAM, ALPHA = 32, 64, 1.2
EXPAND = 4  # nodes of a beam expanded in one step
BATCH = 512


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each row is scaled first so that nothing overflows. In double precision: 1 - cosine of near copies
    is far below what single precision can tell from 0."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and distances (1 - cosine) of each query's beam, nearest first."""
    b, n = len(queries), len(x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), n)
    far = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = entry, 1 - queries @ x[entry], False
    seen[:, entry] = True
    padded = np.vstack([x, np.zeros((1, x.shape[1]))])
    links = np.where(graph < 0, n, graph)
    links = np.vstack([links, np.full((1, links.shape[1]), n)])
    live = np.arange(b)
    while len(live):
        waiting = np.where(done[live], np.inf, far[live])
        pick = np.argpartition(waiting, min(EXPAND, beam) - 1, 1)[:, :EXPAND]
        open_now = np.take_along_axis(waiting, pick, 1) < np.inf
        go = open_now.any(1)
        live, pick, open_now = live[go], pick[go], open_now[go]
        if not len(live):
            break
        row = live[:, None]
        at = np.where(open_now, ids[row, pick], n)
        done[row, pick] = True
        near = links[at].reshape(len(live), -1)
        # a node that two of the expanded ones point to is taken once
        order = np.argsort(near, 1)
        near = np.take_along_axis(near, order, 1)
        again = np.zeros(near.shape, bool)
        again[:, 1:] = near[:, 1:] == near[:, :-1]
        near[again | seen[row, near]] = n
        seen[row, near] = True
        d = 1 - np.einsum("brd,bd->br", padded[near], queries[live])
        d[near == n] = np.inf
        all_ids = np.concatenate([ids[live], near], 1)
        all_far = np.concatenate([far[live], d], 1)
        all_done = np.concatenate([done[live], near == n], 1)
        best = np.argpartition(all_far, beam - 1, 1)[:, :beam]
        ids[live], far[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_done))
    order = np.argsort(far, 1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isinf(far) | (ids == n), -1, ids), far[rows, np.arange(beam)]


def robust_prune(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates ``found`` (-1: none) of each node, diverse by the relaxed rule."""
    found = np.sort(np.where(found == nodes[:, None], -1, found), 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    vectors = x[found]
    d = 1 - np.einsum("bcd,bd->bc", vectors, x[nodes])
    d[found < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    apart = 1 - vectors @ vectors.transpose(0, 2, 1)
    live = d < np.inf
    kept = np.zeros_like(live)
    count = np.zeros(len(nodes), np.int64)
    for j in range(found.shape[1]):
        take = live[:, j] & (count < degree)
        if not take.any():
            continue
        kept[:, j] = take
        count += take
        live &= ~(take[:, None] & (alpha * apart[:, j, :] <= d))
    order = np.argsort(~kept, 1, kind="stable")[:, :degree]
    out = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(found, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def _back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges back from what ``nodes`` point to; where a node has no room, its edges are pruned."""
    to, source = graph[nodes].ravel(), np.repeat(nodes, graph.shape[1])
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    targets, start, count = np.unique(to, return_index=True, return_counts=True)
    width = int(count.max(initial=0))
    for size in {min(width, 1 << k) for k in range(width.bit_length() + 1)} - {0}:  # like numbers of new edges together
        some = (count <= size) & (count > size // 2)
        if not some.any():
            continue
        t, s, c = targets[some], start[some], count[some]
        k = np.arange(size)
        new = np.where(k < c[:, None], source[np.minimum(s[:, None] + k, len(source) - 1)], -1)
        for part in range(0, len(t), BATCH):
            p = t[part : part + BATCH]
            graph[p] = robust_prune(x, p, np.concatenate([graph[p], new[part : part + BATCH]], 1), degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """Graph (row per node, -1: no edge) and entry node of unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree)).astype(np.int64)
    graph[graph == np.arange(n)[:, None]] = -1
    entry = int((x @ x.mean(0)).argmax())
    if n == 1:
        return np.full((1, degree), -1, np.int64), 0
    nodes = rng.permutation(n)
    for k in range(0, n, BATCH):
        p = nodes[k : k + BATCH]
        found, _ = beam_search(x, graph, x[p], entry, beam)
        graph[p] = robust_prune(x, p, np.concatenate([found, graph[p]], 1), degree, alpha)
        _back(x, graph, p, degree, alpha)
    return _reachable(graph, entry), entry


def _reachable(graph: np.ndarray, entry: int) -> np.ndarray:
    """The graph with one more edge to each node that cannot be reached from the entry: a chain behind the entry's."""
    n = len(graph)
    seen = np.zeros(n, bool)
    seen[entry] = True
    front, last, more = np.array([entry]), entry, np.full(n, -1, np.int64)
    while True:
        while len(front):
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return np.concatenate([graph, more[:, None]], 1)
        more[last] = rest[0]
        last, front = int(rest[0]), rest[:1]
        seen[front] = True


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(all="ignore"):
        x, y = (a * a).sum(-1), (b * b).sum(-1)
        s = (a * b).sum(-1) / (np.sqrt(x) * np.sqrt(y))
        odd = ~(np.isfinite(x) & np.isfinite(y) & (x > 1e-280) & (y > 1e-280) & np.isfinite(s))
        if odd.any():  # squares left the range of doubles: these vectors are scaled first
            a, b = (v / np.abs(v).max(-1, keepdims=True) for v in (a, b))
            s = np.where(odd, (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))), s)
    return s


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v) for v in column])


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable")
    raw = _matrix(pdf["v"])
    graph, entry = build(unit(raw))
    ids = [list(map(int, i)) for i in pdf["ids"]]
    row = {"shard": pdf["shard"].iloc[0], "dim": int(raw.shape[1]), "kind": raw.dtype.str, "vectors": raw.tobytes(), "graph": graph.astype("<i4").tobytes(), "entry": entry, "ids": ids}
    return pd.DataFrame([row])


GRAPH = "shard int, dim int, kind string, vectors binary, graph binary, entry int, ids array<array<bigint>>"


def index(vectors: DataFrame, shard: int = SHARD, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """The nodes (``node, dim, ids, v, shard``: equal vectors as one) and a graph row for each shard (``GRAPH``), both
    written. vectors: vec_id, v."""
    # of each id of a vector at most top rows, then the top + 1 smallest ids: a query leaves out one id. Spark applies
    # both limits before their shuffles, too
    few = vectors.withColumn("_rank", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).filter(F.col("_rank") <= top)
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = few.withColumn("_rank", rank).filter(F.col("_rank") <= top + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).filter(F.size("ids") > 0)
    nodes = cut(nodes.select(F.col("ids")[0].alias("node"), F.size("v").alias("dim"), "ids", "v", F.xxhash64("v").alias("key")))
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # of the lengths of vectors, usually one
    start, shard_of = 0, F.lit(None).cast("int")
    for dim, n in sorted(sizes.items()):
        many = -(-n // shard)
        shard_of = F.when(F.col("dim") == dim, (F.pmod(F.xxhash64("node", "key"), F.lit(many)) + start).cast("int")).otherwise(shard_of)
        start += many
    nodes = nodes.withColumn("shard", shard_of)
    spread = nodes.repartition(max(1, start), "shard")  # by number, so that small shards are not put together in one task
    return nodes, cut(spread.groupBy("shard").applyInPandas(_build_shard, GRAPH))


def _search_block(beam: int, best: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cols = {"key": [], "node": [], "score": [], "ids": []}
        if len(graphs) and len(queries):
            g = graphs.iloc[0]
            raw = np.frombuffer(g["vectors"], g["kind"]).reshape(-1, g["dim"])
            graph = np.frombuffer(g["graph"], "<i4").reshape(len(raw), -1).astype(np.int64)
            x, ids = unit(raw), g["ids"]
            first = np.array([i[0] for i in ids])
            for k in range(0, len(queries), 256):
                some = queries.iloc[k : k + 256]
                q = _matrix(some["v"])
                found, _ = beam_search(x, graph, unit(q), int(g["entry"]), beam)
                scores = np.where(found >= 0, cosine(q[:, None, :], raw[found]), -np.inf)  # the whole beam, then the best of it
                order = np.lexsort((first[found], -scores))[:, :best]
                found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
                for key, node, nodes, values in zip(some["key"], some["node"], found, scores):
                    for f, s in zip(nodes, values):
                        if f >= 0:
                            cols["key"].append(key), cols["node"].append(node), cols["score"].append(s), cols["ids"].append(list(ids[f]))
        return pd.DataFrame({c: pd.Series(v, dtype={"score": "float64", "ids": "object"}.get(c, "int64")) for c, v in cols.items()})

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` where ``is_query``, its ``top`` nearest rows found."""
    rows = vectors.filter(usable(vector_col)).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    nodes, graphs = index(rows.filter(F.col("vec_id").isNotNull()).select("vec_id", "v"), shard, top)
    asks = rows.filter("asks").select("vec_id", F.xxhash64("v").alias("key"), "v")
    asks = asks.join(nodes.select("key", "v", "node", "dim"), ["key", "v"]).select("vec_id", "key", "node", "dim")
    asks = cut(asks.distinct())  # repeated query rows are one query
    # equal query vectors are searched once, in every shard with vectors of their length
    unique = asks.select("key", "node", "dim").distinct().join(nodes.select("key", "node", "v"), ["key", "node"])
    blocks = max(1, -(-unique.count() // QUERIES))
    where = graphs.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a row for each length
    sent = unique.join(F.broadcast(where), "dim").select("key", "node", "v", F.explode("shards").alias("shard"))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = spread.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
    found = found.applyInPandas(_search_block(beam, 2 * (top + 1)), "key bigint, node bigint, score double, ids array<bigint>")
    best = F.row_number().over(Window.partitionBy("key", "node").orderBy(F.desc("score"), F.col("ids")[0]))
    found = found.withColumn("_best", best).filter(F.col("_best") <= 2 * (top + 1))
    found = asks.select(F.col("vec_id").alias("query_id"), "key", "node").join(found, ["key", "node"])
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
