"""Removal of repeated byte strings by a suffix array (operator 4).

Removed is each byte covered by a string of ``window`` bytes that also starts elsewhere, in the same document or
another. Stretches of text that share an anchor meet in a task (see ``passages``). There a suffix array of a block of
stretches is sorted, and common prefixes come from its Burrows-Wheeler transform by breadth-first expansion: all
intervals of strings of one length are extended to the left by each byte that precedes them, and where an extended
interval ends at a place without a value yet, the common prefix there is the length reached. Lengths go up one by
one, and the expansion stops at ``window``: places still without a value have a common prefix of at least that.
A window repeats if a neighbour in the suffix array shares that much with it, or if its stretch has copies.

Null text counts as empty. Rows of equal id and text are documents of their own, each a copy of the other; null ids
are like any other id here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.passages import Bytes, keyed, merged, repeated_spans

WINDOW = 200
GRAM = 64
LIMIT = 6_000  # different stretches of an anchor that are sorted together
BLOCK = 1 << 17  # bytes of stretches sorted together, if their groups allow; arrays of this size stay in the cache

SYMBOL = np.uint64(9)  # bits: a byte plus one, 0 is the end of a stretch
FIRST = 7  # symbols in a 64-bit key


def suffix_array(symbols: np.ndarray, ends: np.ndarray, which: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols at least, and the keys of FIRST symbols. A suffix ends at its
    stretch's end; equal ones that end are in order of their stretch. ends, which: end and number of the stretch of each place."""
    n, many = len(symbols), int(which[-1]) + 1
    places = np.arange(n)
    left = ends - places  # symbols before the end
    keys = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(FIRST, np.uint64)])
    for k in range(FIRST):
        keys |= np.where(left > k, padded[k : k + n], np.uint64(0)) << (SYMBOL * np.uint64(FIRST - 1 - k))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)

    def ranks(at: np.ndarray, sorted_keys: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Sets the rank of suffixes to the place where their equals begin; gives the places still shared."""
        new = np.ones(len(at), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[suffixes] = at[start]
        alone = new & np.append(new[1:], True)
        return at[~alone]

    open_at = ranks(places, keys[order], order)
    k = FIRST
    while k < depth and len(open_at):
        s = order[open_at]
        then = np.minimum(s + k, n - 1)
        second = np.where(k <= left[s], rank[then] + many, which[s])
        pair = rank[s].astype(np.uint64) * np.uint64(n + many + 1) + second.astype(np.uint64)
        o = np.argsort(pair, kind="stable")
        order[open_at] = s[o]
        open_at = ranks(open_at, pair[o], s[o])
        k *= 2
    return order, keys


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the common prefix of each suffix and the one before it: -1 where it is ``window`` or more."""
    n = len(symbols)
    order, keys = suffix_array(symbols, ends, which, window)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    left = ends - np.arange(n)

    # prefixes below the length of two keys are read off the keys
    begin = 2 * FIRST
    a, b = order[:-1], order[1:]
    x = keys[a] ^ keys[b]
    later = x == 0
    more = np.zeros(n - 1, np.uint64)
    deep = np.flatnonzero(later & (left[a] >= FIRST) & (left[b] >= FIRST))
    more[deep] = keys[a[deep] + FIRST] ^ keys[b[deep] + FIRST]
    word = np.where(later, more, x)
    bits = np.zeros(n - 1, np.int64)  # of the highest bit that differs
    w = word.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = w >> np.uint64(step)
        go = high > 0
        bits[go] += step
        w[go] = high[go]
    shared = np.where(word == 0, FIRST, FIRST - 1 - bits // int(SYMBOL)) + np.where(later, FIRST, 0)
    shared = np.minimum(shared, np.minimum(left[a], left[b]))
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    known = np.flatnonzero(shared < begin)
    lcp[known + 1] = shared[known]

    # where each place's suffix goes when the byte before it is put in front (-1: a stretch begins)
    before = symbols[order - 1].astype(np.int64)
    goes = place[order - 1]
    goes[(order == 0) | (before == 0)] = -1
    bounds = np.flatnonzero(np.concatenate([[True], lcp[1:n] >= 0, [True]]))
    lo, hi = bounds[:-1], bounds[1:] - 1
    go = lcp[hi + 1] == begin - 1
    go[-1:] = False
    lo, hi = lo[go], hi[go]
    for length in range(begin, window):
        if not len(lo):
            break
        one = lo == hi
        to = goes[lo[one]]
        to = to[to >= 0]
        new_lo, new_hi = [to], [to]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo + 1
            part = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            to = goes[at]
            ok = to >= 0
            key, to = (part[ok] << 9) | before[at[ok]], to[ok]
            if len(key):
                o = np.argsort(key, kind="stable")
                key, to = key[o], to[o]
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                new_lo.append(np.minimum.reduceat(to, cuts))
                new_hi.append(np.maximum.reduceat(to, cuts))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        go = lcp[hi + 1] < 0
        lo, hi = lo[go], hi[go]
        lcp[hi + 1] = length
    return order, lcp


def repeats(bodies: list[bytes], n_windows: list[int], copies: list[int], window: int) -> list[np.ndarray]:
    """For each stretch, which of its first windows repeat."""
    sizes = np.array([len(b) + 1 for b in bodies])
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    stops = np.cumsum(sizes) - 1
    symbols = raw.astype(np.uint16) + 1
    symbols[stops] = 0
    which = np.repeat(np.arange(len(bodies)), sizes)
    order, lcp = common_prefixes(symbols, stops[which], which, window)
    shared = lcp < 0
    again = np.empty(len(order), bool)
    again[order] = shared[:-1] | shared[1:]
    again |= (np.array(copies) > 1)[which]
    starts = stops + 1 - sizes
    return [again[s : s + n] for s, n in zip(starts.tolist(), n_windows)]


def solver(window: int):
    def solve(stretches: list[dict]) -> list[list[tuple[int, int, int]]]:
        found = repeats([s["body"] for s in stretches], [s["n"] for s in stretches], [s["copies"] for s in stretches], window)
        out = []
        for s, again in zip(stretches, found):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            out.append([(a, b - 1 + window, s["first"]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
        return out

    return solve


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``id_col, n_bytes, spans, kept`` of each row: the length in UTF-8, the maximal ranges of bytes removed (start, end) and
    the bytes that remain, in order (a range may end inside a character)."""
    base = keyed(docs, id_col, text_col)
    spans = repeated_spans(base, Bytes(), window, gram, solver(window), False, limit, block)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sizes, ranges, kept = [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                    raw, spans = text.encode(), merged(found)
                    sizes.append(len(raw))
                    ranges.append([{"start": s, "end": e} for s, e in spans])
                    at = [0, *(x for se in spans for x in se), len(raw)]
                    kept.append(b"".join([raw[s:e] for s, e in zip(at[::2], at[1::2])]))
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(ranges, span), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    joined = base.join(spans, ["id", "th"], "left").select(F.col("own").alias("_id"), "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")

