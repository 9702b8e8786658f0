"""Bag of words without a vocabulary on the driver (TXT-2).

Terms are counted where the documents are read, a row of lists per document. Document frequencies, dense term numbers and sparse
vectors are DataFrames: explode and groupBy, a range sort with one offset per partition, and packed blocks of documents
that meet the vocabulary's part of their own terms: the (document, term) pairs themselves are never joined. Only the number of
documents and of terms reaches the driver. A row of the result holds the terms of its document, never one slot per term of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalspark.operators.packing import ints, joined, packed_ints, split
from evalspark.session import discard, materialize, settings

ROWS = 1024  # documents of a batch counted at once
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BLOCK = 500_000  # (document, term) pairs of a block
POSITION_BITS = 33  # of the row number inside a partition in monotonically_increasing_id


def dense_ids(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order`` (which should not leave ties). A range sort deals the rows to partitions; each
    partition's first number is the count of rows before it, from a table of one row per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered).withColumn("_part", F.shiftright("_at", POSITION_BITS))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", (before - F.col("_first")).alias("_shift"))  # as many rows as partitions
    return ordered.join(sizes, "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def term_counts(df: DataFrame, key: str, tokens: str, stop_words: Sequence[str] = (), normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, term, n``: how often each term stands in a document. A null key is a document as well.

    ``normal`` (a stemmer, say) makes a term of a token. It is applied to each distinct token once and joined back, not to every
    token of the corpus; its terms are then added up, and stop words left out."""
    counts = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    if normal is not None:
        counts = materialize(counts)
        terms = counts.select("term").distinct().select(F.col("term").alias("_token"), normal(F.col("term")).alias("_term"))
        counts = counts.join(terms, F.col("term") == F.col("_token")).groupBy(key, F.col("_term").alias("term")).agg(F.sum("n").alias("n"))
    return counts.filter(~F.col("term").isin(*stop_words)) if stop_words else counts


def _lists(rows: np.ndarray, many: int, *values: pa.Array) -> list[pa.Array]:
    """A list for each of ``many`` rows from values in order of their ``rows``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=many))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _counted(stop_words: Sequence[str]) -> Callable:
    """Batches of _key, _tokens to _key, terms, counts of each row, and a block: neighbouring rows of about ``BLOCK`` terms."""

    def run(batches):
        block, pairs, stop = TaskContext.get().partitionId() << POSITION_BITS, 0, pa.array([*stop_words], pa.string())
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                lists, many = batch.column("_tokens"), batch.num_rows
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                tokens = lists.flatten().dictionary_encode(null_encoding="encode")
                kinds, codes = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                kept = np.ones(len(kinds), bool)
                if stop_words:
                    kept = ~(np.asarray(pc.is_in(kinds, stop), bool) | np.asarray(kinds.is_null(), bool))
                pair = (np.repeat(np.arange(many), sizes) * len(kinds) + codes)[kept[codes]]
                pair, n = np.unique(pair, return_counts=True)
                rows, codes = np.divmod(pair, max(1, len(kinds)))
                terms, counts = _lists(rows, many, kinds.take(pa.array(codes)), pa.array(n.astype(np.int64)))
                blocks = pa.array(np.full(many, block))
                yield pa.RecordBatch.from_arrays([batch.column("_key"), terms, counts, blocks], names=["_key", "terms", "counts", "block"])
                pairs += len(pair)
                if pairs >= BLOCK:
                    block, pairs = block + 1, 0

    return run


def _gathered(counts: DataFrame, key: str) -> DataFrame:
    """Rows (document, term, n) as one row of lists per document, dealt to blocks by the document."""
    counts = materialize(counts)
    blocks = F.lit(max(1, counts.count() // BLOCK))
    rows = counts.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("term", "n")).alias("x"))
    return rows.select("_key", F.col("x.term").alias("terms"), F.col("x.n").alias("counts"), (-1 - F.pmod(F.xxhash64("_key"), blocks)).alias("block"))


def document_terms(df: DataFrame, key: str, tokens: str, stop_words: Sequence[str] = (), normal: Callable[[Column], Column] | None = None,
                   repeated: bool = True) -> DataFrame:
    """``_key, terms, counts, block``, written: a row per document that has terms, with each term and how often it stands there.
    Rows that share a key are added up (``repeated``: whether there can be any); a null key is a document as well."""
    if normal is not None:
        return materialize(_gathered(term_counts(df, key, tokens, stop_words, normal), key))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"))
    rows = rows.mapInArrow(_counted(stop_words), f"_key {kind}, terms array<string>, counts array<bigint>, block bigint").filter(F.size("terms") > 0)
    rows = materialize(rows)
    if not repeated:
        return rows
    again = materialize(rows.groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_again")))
    same = F.col("_key").eqNullSafe(F.col("_again"))
    pairs = rows.join(again, same, "left_semi").select("_key", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    added = pairs.groupBy("_key", F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    return materialize(rows.join(again, same, "left_anti").unionByName(_gathered(added, "_key")))


def bounds(min_df: float, max_df: float, documents: int) -> tuple[float, float]:
    """Document counts; values below 1 of ``min_df`` and up to 1 of ``max_df`` given as floats are fractions of all documents."""
    low = min_df * documents if isinstance(min_df, float) and min_df < 1 else min_df
    high = max_df * documents if isinstance(max_df, float) and max_df <= 1 else max_df
    return low, high


def vocabulary(counts: DataFrame, documents: int, min_df: float = 5, max_df: float = 0.98, many: Column | None = None) -> DataFrame:
    """``term, documents, term_id`` of the terms that are in at least ``min_df`` and at most ``max_df`` documents; ids are
    dense and in the order of the terms. counts: rows (document, term); many: of how many documents a row tells (one, if not given)."""
    low, high = bounds(min_df, max_df, documents)
    frequency = counts.groupBy("term").agg((F.count("*") if many is None else F.sum(many)).alias("documents"))
    kept = frequency.filter((F.col("documents") >= F.lit(low)) & (F.col("documents") <= F.lit(high)))
    kept = materialize(kept)  # the range sort reads its input twice
    ids = materialize(dense_ids(kept, ["term"], "term_id"))
    discard(kept)
    return ids


def _ipc(values: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([values], names=["x"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packer() -> Callable:
    """Batches of _key, terms, counts to blocks: their different terms, in how many documents each is, and the documents in bytes, with
    numbers in place of the terms. Documents without terms are left out."""

    def run(batches):
        part, seq, held, pairs = TaskContext.get().partitionId() << POSITION_BITS, 0, [], 0

        def block():
            keys, sizes, kinds, codes, counts = zip(*held)
            terms = pa.concat_arrays(kinds).dictionary_encode(null_encoding="encode")
            at = np.split(terms.indices.to_numpy(), np.cumsum([len(x) for x in kinds])[:-1])  # places of each piece's terms in the block's
            codes = np.concatenate([x[c] for x, c in zip(at, codes)])
            n = np.bincount(codes, minlength=len(terms.dictionary))  # a term is once in a document's list
            docs = joined(_ipc(pa.concat_arrays(keys)), packed_ints(np.concatenate(sizes)), packed_ints(codes), packed_ints(np.concatenate(counts)))
            offsets = pa.array([0, len(n)], pa.int32())
            row = [pa.array([part + seq]), *(pa.ListArray.from_arrays(offsets, x) for x in (terms.dictionary, pa.array(n, pa.int64())))]
            return pa.RecordBatch.from_arrays([*row, pa.array([docs], pa.binary())], names=["block", "terms", "n", "docs"])

        for whole in batches:
            whole = whole.filter(pc.greater(pc.list_value_length(whole.column("terms")), 0))
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                terms = batch.column("terms").flatten().dictionary_encode(null_encoding="encode")
                sizes, codes = (x.to_numpy(zero_copy_only=False) for x in (batch.column("terms").value_lengths(), terms.indices))
                held.append((batch.column("_key"), sizes, terms.dictionary, codes, batch.column("counts").flatten().to_numpy()))
                pairs += len(codes)
                if pairs >= BLOCK:
                    yield block()
                    seq, held, pairs = seq + 1, [], 0
        if held:
            yield block()

    return run


def packed_documents(df: DataFrame, key: str, tokens: str, stop_words: Sequence[str] = (), normal: Callable[[Column], Column] | None = None,
                     repeated: bool = True) -> DataFrame:
    """What ``document_terms`` gives as blocks, written: ``block, terms`` (the different ones), ``n`` (documents with each), ``docs``."""
    schema, packed = "block bigint, terms array<string>, n array<bigint>, docs binary", _packer()
    if normal is None and not repeated:
        counted = _counted(stop_words)
        rows = df.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens"))
        with settings(df.sparkSession, {BATCH: str(min(ROWS, int(df.sparkSession.conf.get(BATCH, "10000")) or ROWS))}):  # a batch of whole texts is large
            return materialize(rows.mapInArrow(lambda batches: packed(counted(batches)), schema))
    rows = document_terms(df, key, tokens, stop_words, normal, repeated)
    blocks = materialize(rows.select("_key", "terms", "counts").mapInArrow(packed, schema))
    discard(rows)
    return blocks


def _numbered(docs: pa.Table, terms: pa.Table) -> pa.Table:
    """A block's documents with the sorted ids of their terms that ``terms`` (place in the block's terms, id) holds, and their counts."""
    keys, *numbers = split(docs["docs"].combine_chunks()[0].as_buffer())
    sizes, codes, counts = map(ints, numbers)
    known = np.full(codes.max() + 1, -1)
    known[terms["at"].to_numpy()] = terms["term_id"].to_numpy()
    ids = known[codes]
    there = ids >= 0
    rows, ids, counts = np.repeat(np.arange(len(sizes)), sizes)[there], ids[there], counts[there]
    order = np.lexsort((ids, rows))
    lists = _lists(rows, len(sizes), pa.array(ids[order], pa.int64()), pa.array(counts[order], pa.int64()))
    return pa.table({"_key": pa.ipc.open_stream(keys).read_all()["x"], "_ids": lists[0], "_n": lists[1]})


def sparse_rows(df: DataFrame, key: str, blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``df`` with ``terms`` (sorted ids) and ``counts`` of each document; empty arrays where none of its terms is kept. blocks: see
    ``packed_documents``."""
    needs = blocks.select(F.col("block").alias("_block"), F.posexplode("terms").alias("at", "term"))  # far fewer than pairs: a block's documents share terms
    needs = needs.join(terms.select("term", "term_id"), "term").select("_block", "at", "term_id")
    schema = f"_key {df.schema[key].dataType.simpleString()}, _ids array<bigint>, _n array<bigint>"
    found = blocks.select("block", "docs").groupBy("block").cogroup(needs.groupBy("_block")).applyInArrow(_numbered, schema).filter(F.size("_ids") > 0)
    none = F.array().cast("array<bigint>")
    joined = df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("terms", F.coalesce("_ids", none)).withColumn("counts", F.coalesce("_n", none)).drop("_key", "_ids", "_n")


def bag_of_words(df: DataFrame, tokens: str = "tokens", key: str = "doc_id", min_df: float = 5, max_df: float = 0.98,
                 stop_words: Sequence[str] | None = None, normal: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """TXT-2: ``df`` without ``tokens`` and with ``terms, counts``, and the vocabulary (``term, documents, term_id``).

    ``key`` names a document: rows that share it are counted as one. ``stop_words`` default to the English list;
    ``normal`` is as in ``term_counts``. A normal form that takes whole lists (``stemming.stem_words``) is cheaper before this call."""
    if stop_words is None:
        from evalspark.operators.topics import ENGLISH_STOP_WORDS as stop_words  # noqa: N811
    documents = df.select(key).distinct().count()
    blocks = packed_documents(df, key, tokens, stop_words, normal, documents < df.select(key).count())
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "n")).alias("x"))
    terms = vocabulary(pairs.select(F.col("x.terms").alias("term"), "x.n"), documents, min_df, max_df, F.col("n"))
    return sparse_rows(df.drop(tokens), key, blocks, terms), terms
