"""Removal of repeated passages by phrase automata (operator 8).

Removed is each word covered by ``window`` consecutive words that also stand in a document with a smaller id.
Stretches of text that share an anchor meet in a task (see ``passages``), which is a shard. There

- recurring passages are confirmed: windows are counted over the shard's stretches, and consecutive windows that
  only ever stand together are joined, so that a passage is there as a whole or not at all;
- the passages found in more than one document are compiled into an Aho-Corasick automaton over words, each with
  the smallest id of the documents that have it;
- all stretches of the shard are streamed through the automaton, which locates every occurrence.

Every stretch that could hold a recurring passage passes the automaton of its shard, and no other one, so the work grows
with the corpus and not with the number of shards. Null text has no words; null ids come after all others, and documents of
equal id do not count against each other.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_or_empty
from evalspark.llm.passages import LAST, Words, keyed, merged, repeated_spans

WINDOW = 50
GRAM = 8
LIMIT = 8_000  # different stretches of an anchor in one shard
BLOCK = 1 << 20  # bytes of stretches in a shard, if their groups allow

BASE = np.uint64(0x9FB21C651E98DF25)  # of the polynomial that windows are hashed by
SURROGATES = 0xD800


def _char(k: int) -> str:
    """A character for each word number; the surrogates are left out."""
    return chr(k + 1 if k + 1 < SURROGATES else k + 1 + 0x800)


def _window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each run of ``window`` codes; by doubling."""
    n = len(codes) - window + 1
    total, done, power, size = np.zeros(n, np.uint64), 0, codes.copy(), 1
    weight = BASE
    while True:  # power: hashes of runs of ``size`` codes; weight: BASE ** size
        if window & size:
            total = total * weight + power[done : done + n]
            done += size
        size *= 2
        if size > window:
            return total
        power = power[: len(power) - size // 2] * weight + power[size // 2 :]
        weight = weight * weight


def passages(words: list[list[int]], codes: list[np.ndarray], firsts: np.ndarray, lasts: np.ndarray, window: int):
    """Recurring passages of stretches as (words, smallest id). codes: a 64-bit hash of each word of a stretch."""
    sizes = np.array([len(w) for w in words])
    n_windows = sizes - window + 1
    flat = np.concatenate(codes)
    with np.errstate(over="ignore"):
        all_windows = _window_hashes(flat, window)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(int(n_windows.sum()))
    stretch = np.repeat(np.arange(len(words)), n_windows)
    kinds, kind, count = np.unique(all_windows[at], return_inverse=True, return_counts=True)
    first, last = np.full(len(kinds), LAST), np.full(len(kinds), -LAST - 1)
    np.minimum.at(first, kind, firsts[stretch])
    np.maximum.at(last, kind, lasts[stretch])
    # a window and the next one stand together always if as often as each of them
    inside = np.flatnonzero(stretch[1:] == stretch[:-1])
    pairs, pair, together = np.unique(kind[inside] * np.int64(len(kinds)) + kind[inside + 1], return_inverse=True, return_counts=True)
    joined = np.zeros(len(at), bool)
    joined[inside] = (together[pair] == count[kind[inside]]) & (together[pair] == count[kind[inside + 1]])
    begins = np.flatnonzero(np.concatenate([[True], ~joined[:-1]]))
    stops = np.flatnonzero(~joined)
    seen, out = set(), []
    for b, e in zip(begins.tolist(), stops.tolist()):
        k = int(kind[b])
        if k in seen or first[k] >= last[k]:
            continue
        seen.add(k)
        w, offset = words[stretch[b]], int(at[b] - starts[stretch[b]])
        out.append((w[offset : offset + e - b + window], int(first[k])))
    return out


def solver(window: int):
    def solve(stretches: list[dict]) -> list[list[tuple[int, int, int]]]:
        number: dict[bytes, int] = {}
        bodies = [s["body"].split() for s in stretches]
        words = [[number.setdefault(w, len(number)) for w in b] for b in bodies]
        hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in number], np.uint64)
        firsts, lasts = (np.array([s[c] for s in stretches], np.int64) for c in ("first", "last"))
        found = passages(words, [hashes[w] for w in words], firsts, lasts, window)
        if not found:
            return [[] for _ in stretches]
        chars = [_char(k) for k in range(len(number))]
        automaton = ahocorasick.Automaton()
        for phrase, first in found:
            key = "".join([chars[k] for k in phrase])
            old = automaton.get(key, None)
            automaton.add_word(key, (len(phrase), first if old is None else min(first, old[1])))
        automaton.make_automaton()
        out = []
        for s, w in zip(stretches, words):
            hits = automaton.iter("".join([chars[k] for k in w]))
            out.append([(end + 1 - size, end + 1, first) for end, (size, first) in hits if first < s["last"]])
        return out

    return solve


def spans(base: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    return repeated_spans(base, Words(), window, gram, solver(window), True, limit, block)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``id_col, n_words, spans, kept`` of each row: the number of words, the maximal ranges of words removed (start, end)
    and the words that remain, joined by one space."""
    base = keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    joined = base.join(spans(base, window, gram, limit, block), ["id", "th"], "left").select(F.col("own").alias("_id"), "text", "spans")
    return joined.mapInArrow(_apply(["_id"], [id_col]), f"`{id_col}` {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string")


def _apply(carry: list[str], names: list[str]):
    def run(batches):
        unit = Words()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sizes, ranges, kept = [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                    words, gone = unit.units(text), merged(found)
                    sizes.append(len(words))
                    ranges.append([{"start": s, "end": e} for s, e in gone])
                    at = [0, *(x for se in gone for x in se), len(words)]
                    kept.append(b" ".join([w for s, e in zip(at[::2], at[1::2]) for w in words[s:e]]).decode())
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols = [batch.column(c) for c in carry]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(ranges, span), pa.array(kept, pa.string())], names=[*names, "n_words", "spans", "kept"])

    return run


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **kw) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text_col`` (the words that remain, joined by one space; a text
    that loses nothing stays as it is) and its length in ``size_col``, if there is such a column."""
    found = spans(keyed(docs, id_col, text_col), **kw)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    rows = rows.join(found, ["id", "th"], "left")  # the text crosses the shuffle once, in its row

    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        unit, out = Words(), []
        for t, g in zip(texts, gone):
            if t is None:
                out.append(None)
                continue
            words, at = unit.units(t), 0
            parts = []
            for s, e in merged(list(g)):
                parts.extend(words[at:s])
                at = e
            out.append(b" ".join([*parts, *words[at:]]).decode())
        return pd.Series(out, dtype=object)

    # only texts that lose something go to Python
    lossy = F.when(F.col("spans").isNotNull(), F.col(f"_row.`{text_col}`"))
    rows = rows.withColumn("_new", F.when(F.col("spans").isNotNull(), kept(lossy, "spans")).otherwise(F.col(f"_row.`{text_col}`")))
    cols = [F.col(f"_row.`{c}`") if c != text_col else F.col("_new").alias(c) for c in docs.columns]
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        cols[docs.columns.index(size_col)] = F.when(F.col("spans").isNotNull(), F.char_length("_new").cast(kind)).otherwise(F.col(f"_row.`{size_col}`")).alias(size_col)
    return rows.select(*cols)
