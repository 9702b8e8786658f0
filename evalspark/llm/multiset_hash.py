"""Document fingerprints by a homomorphic multiset hash (operator 7).

A text is cut into paragraphs; each is hashed to a wide vector of +1 and -1, and a document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo 2**32 (2 GiB of text are at most about 2**30 paragraphs, so neither lanes nor
their differences wrap). The sum does not depend on the order of the paragraphs, and
paragraphs are put in or taken out by adding or subtracting their vectors: the edited text's fingerprint is had
from the first one that way.

Two texts with the same paragraphs, repeats counted, have equal fingerprints, whatever their order. The squared
distance of two fingerprints is near the number of lanes times the number of paragraphs that only one
has, so ``1 - |a - b|^2 / (|a|^2 + |b|^2)`` tells how alike they are: 1 for equal ones, near 0 for texts
without a common paragraph (the error is about 1 / sqrt(lanes)). Two empty texts are alike.

A paragraph ends after a line end or the end of a sentence with the white space that follows, and after ``LONG`` code
points. Null text counts as empty. Documents are in order of id, null ids last, equal ids in order of a hash of
their text; repeated rows follow one another. An empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import n_partitions, text_or_empty

LANES = 256
LONG = 60
RANGES = 4  # of ids, for each shuffle partition
ROWS = 256  # of a batch that is passed on

_PARAGRAPH = re.compile(r"[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*")


def paragraphs(text: str) -> list[str]:
    out = []
    for p in _PARAGRAPH.findall(text):
        out.extend([p] if len(p) <= LONG else [p[k : k + LONG] for k in range(0, len(p), LONG)])
    return out


def vector(parts: list[str]) -> np.ndarray:
    """Sum of the paragraphs' vectors, unsigned 32-bit lanes."""
    total = np.zeros(LANES, np.int64)
    for k in range(0, len(parts), 4096):
        some = parts[k : k + 4096]
        raw = b"".join([hashlib.blake2b(p.encode(), digest_size=LANES // 8).digest() for p in some])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), LANES // 8), axis=1)
        total += 2 * bits.sum(0, dtype=np.int64) - len(some)
    return total.astype(np.uint32)


def text_hex(v: np.ndarray) -> str:
    return v.astype("<u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = a.astype(np.int32).astype(np.float64), b.astype(np.int32).astype(np.float64)
    apart = (a - b).astype(np.int32).astype(np.float64)
    return float(min(1.0, max(0.0, 1.0 - apart @ apart / (x @ x + y @ y))))


def edit(v: np.ndarray, before: list[str], after: list[str]) -> np.ndarray:
    """Fingerprint after an edit: the paragraphs that went are subtracted, those that came are added."""
    same = 0
    for x, y in zip(before, after):
        if x != y:
            break
        same += 1
    return v - vector(before[same:]) + vector(after[same:])


def boundaries(docs: DataFrame) -> list[tuple[int | None, int]]:
    """First (id, th) of each range when ``docs`` (id, th) are dealt out evenly in order; a few numbers for each shuffle partition."""
    order = [F.col("id").asc_nulls_last(), F.col("th")]
    ranged = docs.repartitionByRange(RANGES * n_partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id())
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f")).orderBy("part").collect()
    return [(r["f"]["id"], r["f"]["th"]) for r in firsts]


def _place(key: tuple[int | None, int]) -> tuple[bool, int, int]:
    return key[0] is None, key[0] or 0, key[1]


def _dealt(firsts):
    """Batches of (id, th, text) to rows ``_range, _next, id, th, text, n``: equal rows of a batch as one with their number, and
    the first row of each range (_next 1) also in the range before."""

    def run(batches):
        starts = [_place(k) for k in firsts.value]
        for batch in batches:
            seen: dict = {}
            for k, key in enumerate(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist())):
                seen.setdefault(key, []).append(k)
            rows, ranges, follows, counts = [], [], [], []
            for key, at in seen.items():
                place = _place(key)
                r = bisect.bisect_right(starts, place) - 1
                rows.append(at[0]), ranges.append(r), follows.append(0), counts.append(len(at))
                if starts[r] == place:
                    rows.append(at[0]), ranges.append((r - 1) % len(starts)), follows.append(1), counts.append(0)
            taken = pa.array(rows, pa.int64())
            cols = [pa.array(ranges, pa.int32()), pa.array(follows, pa.int32()), *(batch.column(c).take(taken) for c in ("id", "th", "text")), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["_range", "_next", "id", "th", "text", "n"])

    return run


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``_range, _next, id, th, text, n``: within a range of (id, hash of the text) sorted, and after each range's own rows
    (``_next`` 0) the document that follows its last (``_next`` 1). A range holds many equal rows as a few with their numbers
    ``n``, and rows of one id, or without one, may be in several ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    firsts = spark.sparkContext.broadcast(boundaries(docs.select("id", "th")))
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.mapInArrow(_dealt(firsts), f"_range int, _next int, id {kind}, th bigint, text string, n bigint")
    return rows.repartition(n_partitions(spark), "_range").sortWithinPartitions("_range", "_next", F.col("id").asc_nulls_last(), "th")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row. The
    edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the
    next document; after the last comes the first. Texts are shuffled once."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        rows: list[tuple] = []
        waits = None  # (range, id, text, paragraphs, vector, number) of the document whose next one comes

        def send():
            kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def result(text: str, v: np.ndarray) -> tuple:
            """The row of the document that waits, if the next one has this text."""
            _, key, old, parts, old_v, _ = waits
            keep = len(old) - len(old) // 2
            edited = old[:keep] + text[: len(old) // 2]
            edited_v = edit(old_v, parts, paragraphs(edited))
            return key, len(old), hashlib.sha256(edited.encode()).hexdigest(), text_hex(old_v), text_hex(edited_v), likeness(old_v, edited_v), likeness(old_v, v)

        for batch in batches:
            id_kind = batch.schema.field("id").type
            columns = [batch.column(c) for c in ("_range", "_next", "id", "text", "n")]
            for k in range(batch.num_rows):
                part, follows, key, text, n = (c[k].as_py() for c in columns)
                if waits is not None and waits[0] != part:
                    waits = None  # its next one came already
                if follows and waits is None:
                    continue
                if waits is not None and not follows and (waits[1], waits[2]) == (key, text):
                    waits[5] += n
                    continue
                parts = paragraphs(text)
                v = vector(parts)
                if waits is not None:
                    if waits[5] > 1:  # equal rows are followed by one another
                        same = result(waits[2], waits[4])
                        for _ in range(waits[5] - 1):
                            rows.append(same)
                            if len(rows) >= ROWS:
                                yield send()
                                rows.clear()
                    rows.append(result(text, v))
                    if len(rows) >= ROWS:
                        yield send()
                        rows.clear()
                waits = None if follows else [part, key, text, parts, v, n]
        if rows:
            yield send()

    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
