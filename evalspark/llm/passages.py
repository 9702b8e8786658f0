"""Repeated windows of a corpus, dealt to tasks by their content.

Documents are sequences of units (bytes or words). A *window* is ``window`` consecutive units. Each window is
charged to its anchor: among the hashes of the runs of ``gram`` units in it the smallest, leftmost of equals. Equal
windows have equal anchors, and neighbouring windows mostly share theirs, so all windows of a document are
covered by few *stretches* (maximal runs of windows with one anchor), and equal windows meet where stretches are
dealt out by their anchor's hash. Text that repeats within a window has a stretch for each period, all equal and next to one another: those are
one row with their number (``reps``). What is found in one of them is at least a window long, and they are shorter than that, so over all of them it is one range.

``repeated_spans``: stretches whose anchor hash occurs once go. Where all stretches of an anchor are equal, their windows
repeat as often as they do: two windows of one stretch stand at different distances from their common anchor and cannot
be equal. Of the rest, equal stretches are one (with the number, the smallest and the largest id of the documents that have
it), their units are cut from the texts, and a solver gets all stretches of an anchor together, in blocks of bounded size, and says which windows repeat. An anchor with more
than ``limit`` different stretches is dealt out again in pieces: windows of like distance to the anchor, by a hash of
the units that all windows at these distances have in common. Equal windows meet there as well. What is still
crowded is dealt out window by window: those groups hold one content each. What a solver finds is carried back to every stretch and joined to the
texts. Stretches are taken as equal where 128 bits of hashes agree (of the anchor and of all their units); which windows of different
stretches are equal is up to the solver.

Rows of equal id and text are told apart from one another only by their number: their stretches are cut once, and what is
found is joined back to each, so the work grows with the rows and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, n_partitions, text_or_empty

LAST = 2**63 - 1  # stands for a null id: after all others
SLAB = 1 << 16  # units worked on at once; arrays of this size stay in the cache
LONG_SLAB = 1 << 21  # units of one document worked on at once
PIECES = 8  # of the distances to an anchor, where it is crowded
TOP = np.iinfo(np.uint64).max
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers

ROW = "h bigint, c bigint, id bigint, th bigint, at bigint, n int, reps int"
STRETCH = "h bigint, c bigint, n int, copies bigint, first bigint, last bigint, body binary"
FOUND = "h bigint, c bigint, ranges array<struct<s: int, e: int, first: bigint>>"


class Bytes:
    """Units are the bytes of the text in UTF-8."""

    def units(self, text: str) -> bytes:
        return text.encode()

    def hashes(self, docs: list[bytes], gram: int) -> tuple[np.ndarray, list[bytes]]:
        """For each unit of the concatenated documents a hash of the run of ``gram`` units from it (runs beyond a document's
        end are of no use), and what stretches are hashed from."""
        n = sum(map(len, docs))
        data = b"".join(docs) + bytes(-n % 8 + gram + 16)
        words = np.empty(n + gram + 8, np.uint64)
        for k in range(8):
            part = np.frombuffer(data, "<u8", offset=k, count=(len(data) - k) // 8)
            words[k::8] = part[: len(words[k::8])]
        words *= M1
        words ^= words >> np.uint64(32)
        return mixed(words, n, range(0, gram, 8)), docs

    def body(self, units: bytes, start: int, end: int) -> bytes:
        return units[start:end]

    def code(self, hashed: bytes, start: int, end: int) -> int:
        return xxhash.xxh3_64_intdigest(hashed[start:end])


class Words:
    """Units are the runs of anything but ASCII white space."""

    def units(self, text: str) -> list[bytes]:
        return text.encode().split()  # of bytes: splits at 0x20 and 0x09 to 0x0D only

    def hashes(self, docs: list[list[bytes]], gram: int) -> tuple[np.ndarray, list[bytes]]:
        one = xxhash.xxh64_intdigest
        per_doc = [np.array([one(w) for w in d], np.uint64) for d in docs]
        n = sum(map(len, per_doc))
        words = np.concatenate([*per_doc, np.zeros(gram, np.uint64)])
        return mixed(words, n, range(gram)), [d.tobytes() for d in per_doc]

    def body(self, units: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(units[start:end])

    def code(self, hashed: bytes, start: int, end: int) -> int:
        return xxhash.xxh3_64_intdigest(hashed[8 * start : 8 * end])


def mixed(words: np.ndarray, n: int, steps: range) -> np.ndarray:
    """For each place a hash of the words at the distances ``steps`` from it (a power of two of them), by doubling."""
    h, weight, size = words, M2, steps.step
    while size < steps.stop:
        h = h[: len(h) - size] * weight + h[size:]
        weight, size = np.uint64(int(weight) ** 2 % 2**64), 2 * size
    h = h[:n].copy()
    h ^= h >> np.uint64(29)
    h *= M1
    h ^= h >> np.uint64(32)
    return h


def stretches(h: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, anchor's distance from the first window) of each stretch of
    concatenated documents; first windows are counted from the document's start."""
    wide, n = window - gram + 1, len(h)
    if n < window:
        return (np.empty(0, np.int64),) * 5
    low = np.uint64((1 << 24) - 1)
    keys = np.full(-(-n // wide) * wide, TOP, np.uint64)
    keys[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    keys = keys.reshape(-1, wide)
    ahead = np.minimum.accumulate(keys, 1).ravel()
    back = np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
    m = n - wide + 1
    best = np.minimum(back[:m], ahead[wide - 1 : wide - 1 + m])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # runs of one anchor, cut where a document begins and where its windows end
    at = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, begins, np.maximum(ends - window + 1, begins)])
    at = np.unique(at)
    at = at[at < m]
    doc = np.searchsorted(ends, at, "right")
    ok = at + window <= ends[doc]
    count, anchor = np.diff(np.append(at, m)), (best[at] & low).astype(np.int64)
    at, doc, count, anchor = at[ok], doc[ok], count[ok], anchor[ok]
    return doc, at - begins[doc], count, h[anchor].view(np.int64), anchor - at


def _adjoining(doc: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal stretches begin that follow one another in a document without a gap, and how many are in each."""
    new = np.ones(len(doc), bool)
    new[1:] = at[1:] != at[:-1] + n[:-1]
    for x in (doc, n, key, code):
        new[1:] |= x[1:] != x[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(doc)))


def _pieces(kind, hashed: bytes, window: int, at: int, n: int, key: int, ahead: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, key, distance to the anchor) of a stretch's pieces: windows whose distance to the anchor is the
    same when divided by ``width``, keyed by the units common to all windows of such distances."""
    anchor, p, end = at + ahead, at, at + n
    while p < end:
        step = (anchor - p) // width
        stop = min(end, anchor - step * width + 1)  # the last window at the smallest distance of this step
        common = kind.code(hashed, anchor - step * width, anchor - step * width - width + 1 + window)
        new = (common * 0x9E3779B97F4A7C15 + key * 0xC2B2AE3D27D4EB4F + step) % 2**64
        yield p, stop - p, new - 2**64 if new >> 63 else new, anchor - p
        p = stop


def _slabs(texts: list[tuple], kind) -> Iterator[list[tuple]]:
    """Groups of (key, units, offset) of bounded size; very long documents come in overlapping parts."""
    group, size = [], 0
    for key, text in texts:
        units = kind.units(text)
        group.append((key, units))
        size += len(units)
        if size >= SLAB:
            yield group
            group, size = [], 0
    if group:
        yield group


def anchors(kind, window: int, gram: int, levels: tuple = (), whole: bool = True) -> Callable:
    """Batches of id, th, text to rows of ``ROW``: one for each run of equal adjoining stretches (not ``whole``: its h, c, id and reps only). levels: (broadcast sorted keys, width) of crowded
    keys; then a row for each piece of the stretches that have such keys at every level, and no others."""

    def run(batches):
        for batch in batches:
            texts = ((k, batch.column("text")[k].as_py()) for k in range(batch.num_rows))
            ids, ths = batch.column("id"), batch.column("th")
            for group in _slabs(texts, kind):
                parts = []  # (row, offset, units): parts of a long document overlap by a window less one unit
                for k, units in group:
                    for s in range(0, max(1, len(units) - window + 1), LONG_SLAB):
                        parts.append((k, s, units[s : s + LONG_SLAB + window - 1]))
                for one in [parts] if len(group) == len(parts) else [[p] for p in parts]:
                    h, hashed = kind.hashes([u for _, _, u in one], gram)
                    sizes = np.array([len(u) for _, _, u in one])
                    doc, at, n, key, ahead = stretches(h, sizes, window, gram)
                    for keys, width in levels:
                        hot = np.flatnonzero(np.isin(key, keys.value))
                        found = [(d, *piece) for d, *s in zip(*(x[hot].tolist() for x in (doc, at, n, key, ahead))) for piece in _pieces(kind, hashed[d], window, *s, width)]
                        doc, at, n, key, ahead = np.array(found, np.int64).reshape(-1, 5).T.copy()
                    if not len(doc):
                        continue
                    code = [kind.code(hashed[d], a, a + m + window - 1) for d, a, m in zip(doc.tolist(), at.tolist(), n.tolist())]
                    code = np.array(code, np.uint64).view(np.int64)
                    begins, reps = _adjoining(doc, at, n, key, code)
                    doc, at, n, key, code = doc[begins], at[begins], n[begins], pa.array(key[begins]), pa.array(code[begins])
                    rows, reps = pa.array([one[d][0] for d in doc.tolist()]), pa.array(reps.astype(np.int32))
                    if not whole:
                        yield pa.RecordBatch.from_arrays([key, code, ids.take(rows), reps], names=["h", "c", "id", "reps"])
                        continue
                    shift = np.array([s for _, s, _ in one])
                    yield pa.RecordBatch.from_arrays(
                        [key, code, ids.take(rows), ths.take(rows), pa.array(at + shift[doc]), pa.array(n.astype(np.int32)), reps],
                        names=["h", "c", "id", "th", "at", "n", "reps"],
                    )

    return run


def _each(batch: pa.RecordBatch, name: str) -> Iterator[tuple[dict, list[dict]]]:
    for row in batch.to_pylist():
        yield row, row.pop(name) or []


def _rows(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    types = {"l": pa.int64(), "I": pa.int32(), "b": pa.binary()}
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) if k == "u" else pa.array(c, types[k]) for c, k in zip(cols, kinds)], names=names)


def _cut_bodies(kind, window: int) -> Callable:
    """Batches of text and wanted stretches to rows of ``STRETCH``; repeated rows, which a join by id and text leaves side by side,
    are cut once."""

    def run(batches):
        last = None
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                out = []
                for row, wanted in _each(whole.slice(k, 64), "wanted"):
                    if (row["id"], row["th"]) == last:
                        continue
                    last = row["id"], row["th"]
                    units = kind.units(row["text"])
                    for s in wanted:
                        body = kind.body(units, s["at"], s["at"] + s["n"] + window - 1)
                        out.append((s["h"], s["c"], s["n"], s["copies"], s["first"], s["last"], body))
                yield _rows(out, ["h", "c", "n", "copies", "first", "last", "body"], "llIlllb")

    return run


def _solved(solver: Callable, block: int) -> Callable:
    """Batches of ``STRETCH``, sorted by h, to rows of ``FOUND``; the solver gets whole groups, about ``block`` bytes at a time."""

    def run(batches):
        held, size, last = [], 0, None

        def send():
            found = [(s["h"], s["c"], r) for s, r in zip(held, solver(held)) if r]
            cols = list(zip(*found)) or [(), (), ()]
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("first", pa.int64())]))
            ranges = [[{"s": s, "e": e, "first": f} for s, e, f in r] for r in cols[2]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(ranges, kind)], names=["h", "c", "ranges"])

        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                for row in whole.slice(k, 512).to_pylist():
                    if row["h"] != last and size >= block:
                        yield send()
                        held, size = [], 0
                    elif held and row["h"] == last and row["c"] == held[-1]["c"]:
                        continue  # of a repeated row
                    last = row["h"]
                    held.append(row)
                    size += len(row["body"])
        if held:
            yield send()

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: LAST), th (hash of the text), text (null: empty), own (the id as it is). Rows of equal id and text stand for each
    other. Null ids come last, beside LAST itself."""
    text = text_or_empty(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(id_col).alias("own"))


def repeated_spans(base: DataFrame, kind, window: int, gram: int, solver: Callable, across: bool, limit: int, block: int) -> DataFrame:
    """``id, th, spans``: for each text of ``base`` (see ``keyed``) that has any, the ranges of units (start, end; they may
    overlap) that the solver finds. ``across``: windows count only in a document with a larger id than another one that has them,
    and a range is kept where the id is above its ``first``."""
    recurs = (F.min("id") < F.max("id")) if across else (F.sum("reps") > 1)

    base = base.select("id", "th", "text")

    def recurring(levels: tuple = ()) -> DataFrame:
        """Rows of the anchors that recur, with the smallest id of their anchor, and whether all its stretches are equal; written."""
        rows = base.mapInArrow(anchors(kind, window, gram, levels), ROW)
        if levels:  # pieces of a few anchors: written at once; all rows would be as much as the texts, so those are made twice
            rows = seen = cut(rows)
        else:
            seen = base.mapInArrow(anchors(kind, window, gram, levels, False), "h bigint, c bigint, id bigint, reps int")
        again = seen.groupBy("h").agg(recurs.alias("again"), (F.min("c") == F.max("c")).alias("equal"), F.min("id").alias("least")).filter("again")
        # both sides plain, so that a frequent anchor's rows can be split among tasks
        return cut(rows.join(cut(again.drop("again")), "h"))

    def told(rows: DataFrame) -> DataFrame:
        """What is known of rows whose anchor's stretches are all equal."""
        r = F.struct(F.lit(0).alias("s"), (F.col("n") - 1 + window).alias("e"), F.col("least").alias("first")).alias("r")
        return rows.filter("equal").select("id", "th", "at", "n", "reps", r)

    def wanted(rows: DataFrame, *cols: str) -> DataFrame:
        return rows.groupBy("id", "th").agg(F.collect_list(F.struct(*cols)).alias("wanted"))

    def distinct(rows: DataFrame) -> DataFrame:
        one = F.min(F.struct("id", "th", "at", "n")).alias("one")
        return rows.groupBy("h", "c").agg(F.sum("reps").alias("copies"), F.min("id").alias("first"), F.max("id").alias("last"), one)

    found = recurring()
    equal, rows = told(found), found.filter("NOT equal").drop("equal")
    levels: list[tuple] = []
    for width in (max(2, (window - gram + 1) // PIECES), 1):
        crowded = cut(distinct(rows).groupBy("h").count().filter(F.col("count") > limit).select("h"))
        keys = np.sort(np.array([r["h"] for r in crowded.collect()], np.int64))  # 8 bytes for more than ``limit`` stretches
        if not len(keys):
            break
        levels.append((base.sparkSession.sparkContext.broadcast(keys), width))
        finer = recurring(tuple(levels))
        equal = equal.unionByName(told(finer))
        rows = cut(rows.join(F.broadcast(crowded), "h", "left_anti").unionByName(finer.filter("NOT equal").drop("equal")))
    groups = distinct(rows).select("h", "c", "copies", "first", "last", "one.*")
    bodies = base.join(wanted(groups, "h", "c", "at", "n", "copies", "first", "last"), ["id", "th"])
    bodies = bodies.mapInArrow(_cut_bodies(kind, window), STRETCH)
    bodies = bodies.repartition(n_partitions(base.sparkSession), "h").sortWithinPartitions("h", "c")
    found = bodies.mapInArrow(_solved(solver, block), FOUND)
    if across:  # the smallest document of an anchor keeps all
        rows = rows.filter("id > least")
    ranges = rows.join(found, ["h", "c"]).select("id", "th", "at", "n", "reps", F.explode("ranges").alias("r")).unionByName(equal)
    if across:
        ranges = ranges.filter(F.col("r.first") < F.col("id"))
    last = F.col("at") + (F.col("reps") - 1) * F.col("n")  # of the adjoining stretches
    span = F.struct((F.col("at") + F.col("r.s")).alias("s"), (last + F.col("r.e")).alias("e"))
    return ranges.groupBy("id", "th").agg(F.collect_set(span).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
