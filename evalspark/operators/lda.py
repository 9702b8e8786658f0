"""Latent Dirichlet allocation by full passes of variational Bayes (TXT-3).

Every pass reads every document. Documents are packed once into blocks of bounded size. Topic weights are a table of groups of terms
(term ids and k numbers each, as bytes) that neither the driver nor any task holds whole: a group hands each block the weights of the
block's own terms, the block infers its documents' topics and sends a sum per term back to the groups. The blocks of a pass go in
rounds, so what is on its way at once (and on disk) is bounded by the size of the documents; its files go when a round ends. The driver
sees k sums a pass.

The algorithm is batch variational Bayes as of Hoffman, Blei and Bach (2010): symmetric priors 1/k, up to 100 steps for a
document's topics or until their mean change is below 0.001. Starting weights are drawn per (seed, term).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.packing import ints, joined, packed_ints, split
from evalspark.session import discard, materialize, settings

SPREAD = 2  # partitions for each block where Spark picks their places by hash
BLOCK = 1_000_000  # (document, term) pairs of a block; fewer where that leaves cores without a block
FEW = 20_000  # pairs that are worth a block of their own
NUMBERS = 12_000_000  # weights (terms times k) that a block holds: 96 MB, and as many sums
GROUP = 250_000  # weights of a group of terms
EXCHANGE, LEAST = 4, 64 << 20  # bytes of weights on their way at once: for each pair of all documents, and at least
PIECE = 100_000  # pairs packed at once
CELLS, PAIRS = 1 << 18, 1 << 12  # numbers and pairs worked on at once
STEPS, CHANGE = 100, 1e-3
WEIGHTS = "term_id bigint, weights array<double>, packed binary"
BLOCKS = "part int, block bigint, n_terms bigint, terms binary, docs binary"
GROUPS = "g int, ids binary, packed binary"
MESSAGES = "g int, block bigint, kind int, a binary, b binary"  # a: ids, b: what belongs to them
ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}  # messages of a batch: each may have megabytes
DOCS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive x."""
    x = np.asarray(x, np.float64)
    return np.log(x + 6) - _below_log(x)


def _below_log(x: np.ndarray) -> np.ndarray:
    """log(x + 6) less the derivative of log gamma at x: six steps of the recurrence as one fraction, then the asymptotic series."""
    y = x * (x + 5)  # x (x + 1) ... (x + 5) = y (y + 4) (y + 6)
    out = (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6))
    z = 1 / (x + 6)
    y = z * z
    return out + 0.5 * z + y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def start_weights(term_id: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, term_id]).gamma(100.0, 0.01, k)


def _alike(sizes: np.ndarray, k: int):
    """Groups of documents with about as many terms, small enough that their numbers stay in the cache."""
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    ranked, i = sizes[order], 0
    while i < len(order):
        j = int(np.searchsorted(ranked, ranked[i] + ranked[i] // 4 + 2, "right"))
        j = min(j, i + max(1, CELLS // (int(ranked[j - 1]) * k)))
        yield order[i:j]
        i = j


def _theta(gamma: np.ndarray) -> np.ndarray:
    return (gamma + 6) * np.exp(-_below_log(gamma) - digamma(gamma.sum(1, keepdims=True)))


def infer(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, beta: np.ndarray, documents: int, prior: float):
    """Topics of a block's documents, and what its terms send back. rows, cols, counts: (document, term, count), in order of
    documents; beta: exp of the expected log weight (terms x k). Every document stops on its own."""
    k = beta.shape[1]
    gamma = np.ones((documents, k))
    sizes = np.bincount(rows, minlength=documents)
    starts = np.cumsum(sizes) - sizes
    gamma[sizes == 0] = prior
    for which in _alike(sizes, k):
        place = np.arange(sizes[which].max())
        inside = place < sizes[which, None]
        at = np.where(inside, starts[which, None] + place, 0)
        b, n, now = beta[cols[at]], np.where(inside, counts[at], 0), gamma[which]  # the rest of a row counts 0
        live, theta = np.ones(len(which), bool), _theta(now)
        for _ in range(STEPS):
            share = n / (np.matmul(b, theta[:, :, None])[:, :, 0] + 1e-100)
            new = prior + theta * np.matmul(share[:, None, :], b)[:, 0, :]
            still = live & (np.abs(new - now).mean(1) >= CHANGE)
            gamma[which[live]] = new[live]
            if not still.any():
                break
            if still.sum() < 0.75 * len(still):
                b, n, new, which, still = b[still], n[still], new[still], which[still], still[still]
            live, now, theta = still, new, _theta(new)
    theta = _theta(gamma)
    back = np.zeros_like(beta)
    order = np.argsort(cols, kind="stable")
    for i in range(0, len(order), PAIRS):
        part = order[i : i + PAIRS]
        some, first = np.unique(cols[part], return_index=True)
        t = theta[rows[part]]
        t *= (counts[part] / (np.einsum("nk,nk->n", t, beta[cols[part]]) + 1e-100))[:, None]
        back[some] += np.add.reduceat(t, first, axis=0)
    return gamma, back * beta


def _lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat numbers of a list column, and how many each row has."""
    return values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy(zero_copy_only=False)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes: Spark hands them on as they are, not number by number."""
    offsets = np.arange(0, 8 * x.size + 1, 8 * x.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float64))])


def _unpacked(col: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, k)


def _weights(ids: np.ndarray, lam: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _arrays(lam), _packed(lam)], names=["term_id", "weights", "packed"])


def _added(k: int, prior: float):
    """Batches of term_id, packed, sorted by term, to the weights of each term: the sum of its rows and the prior."""

    def run(batches):
        ids, sums = np.zeros(0, np.int64), np.zeros((0, k))  # of the last term seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.append(ids, batch.column("term_id").to_numpy())
            sums = np.concatenate([sums, _unpacked(batch.column("packed"), k)])
            first = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            ids, sums = ids[first], np.add.reduceat(sums, first, axis=0)
            yield _weights(ids[:-1], sums[:-1] + prior)
            ids, sums = ids[-1:], sums[-1:]
        yield _weights(ids, sums + prior)

    return run


def _rows(batches) -> Iterator[tuple]:
    """Rows of batches; bytes are not copied."""
    for batch in batches:
        cols = [c if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
        for i in range(batch.num_rows):
            yield tuple((c[i].as_buffer() if c[i].is_valid else None) if isinstance(c, pa.Array) else c[i] for c in cols)


def _batch(schema: str, *values) -> pa.RecordBatch:
    """One row."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(values, fields)], names=[name for name, _ in fields])


# ------------------------------------------------------------------ documents in blocks


def _packer(k: int, most: int):
    """Batches of _row, terms, counts to blocks (see BLOCKS) of up to ``most`` pairs and ``NUMBERS`` weights; one document is never split."""

    def block(part: int, seq: int, known: np.ndarray, held: list) -> pa.RecordBatch:
        row, sizes, terms, counts = (np.concatenate(x) for x in zip(*held))
        docs = joined(packed_ints(row, True), packed_ints(sizes), packed_ints(np.searchsorted(known, terms), True), packed_ints(counts))
        return _batch(BLOCKS, part, part << 33 | seq, len(known), packed_ints(known, True), docs)

    def run(batches):
        part, seq, known, held, pairs = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), [], 0
        for batch in batches:
            row = batch.column("_row").to_numpy()
            (terms, sizes), (counts, _) = _lists(batch.column("terms")), _lists(batch.column("counts"))
            ends = np.cumsum(sizes)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PIECE, len(terms), PIECE)), len(row)))
            a = 0
            for b in cuts[cuts > 0].tolist():
                x, y = int(ends[a] - sizes[a]), int(ends[b - 1])
                now = np.unique(terms[x:y])
                both = np.union1d(known, now)
                if held and (pairs + y - x > most or len(both) * k > NUMBERS):
                    yield block(part, seq, known, held)
                    seq, held, pairs, both = seq + 1, [], 0, now
                known, pairs = both, pairs + y - x
                held.append((row[a:b], sizes[a:b], terms[x:y], counts[x:y]))
                a = b
        if held:
            yield block(part, seq, known, held)

    return run


@dataclass
class Dealt:
    """blocks: see BLOCKS, written; round and place of a block follow from its part."""

    blocks: DataFrame
    parts: int
    cores: int
    rounds: int

    def round(self, r: int) -> DataFrame:
        return self.blocks.filter((F.floor(F.col("part") / self.cores) % self.rounds) == r)

    def place(self) -> tuple[int, F.Column]:
        """Places of a round, a place for each part."""
        waves = -(-self.parts // self.cores)
        at = F.floor(F.floor(F.col("part") / self.cores) / self.rounds) * self.cores + F.col("part") % self.cores
        return self.cores * -(-waves // self.rounds), at.cast("int")


def numbered(bow: DataFrame) -> DataFrame:
    """``bow`` with a number of each row, written."""
    return materialize(bow.withColumn("_row", F.monotonically_increasing_id()))


def deal(rows: DataFrame, k: int) -> Dealt | None:
    """Blocks of the rows (``_row, terms, counts``) that have terms; None without any."""
    spark = rows.sparkSession
    docs = rows.filter(F.size("terms") > 0).select("_row", "terms", "counts")
    size = docs.agg(F.sum(F.size("terms"))).first()[0]
    if not size:
        return None
    cores = spark.sparkContext.defaultParallelism
    parts = min(cores * -(-size // (cores * BLOCK)), -(-size // min(FEW, BLOCK)))
    with settings(spark, DOCS):
        blocks = materialize(docs.repartition(parts, "_row").mapInArrow(_packer(k, BLOCK + BLOCK // 4), BLOCKS))
    sent = (blocks.agg(F.sum("n_terms")).first()[0] or 0) * (8 * k + 16)
    rounds = min(-(-parts // cores), -(-sent // max(LEAST, EXCHANGE * size)))
    return Dealt(blocks, parts, cores, max(1, rounds))


# ------------------------------------------------------------------ messages between groups of terms and blocks


def _wanted(groups: int):
    """The ids of a block's terms, a message to each group."""

    def run(batches):
        for block, terms in _rows(batches):
            ids = ints(terms)
            for g, at in _by_group(ids, groups):
                yield _batch(MESSAGES, g, block, 1, packed_ints(ids[at], True), b"")

    return run


def _by_group(ids: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups and the places of their ids, in order."""
    g = ids % groups
    order = np.argsort(g, kind="stable")
    some, first = np.unique(g[order], return_index=True)
    yield from zip(some.tolist(), np.split(order, first[1:]))


def _at(ids: np.ndarray, want: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ids, want)
    if len(want) and (at[-1] >= len(ids) or (ids[at] != want).any()):
        raise ValueError("a document has a term without weights")
    return at


def _handed(k: int):
    """Rows of a group, its weights (kind 0) first, to the weights that each block wants."""

    def run(batches):
        group, ids, lam = None, np.zeros(0, np.int64), np.zeros((0, k))
        for g, block, kind, a, b in _rows(batches):
            if kind == 0:
                group, ids, lam = g, ints(a), np.frombuffer(b, np.float64).reshape(-1, k)
                continue
            at = _at(ids if group == g else ids[:0], ints(a))
            yield _batch(MESSAGES, g, block, 1, b"", lam[at].tobytes())

    return run


def _inferred(totals: np.ndarray, k: int, prior: float, groups: int, out: Callable):
    """Rows of a block, its documents (kind 0) first, then the weights from each group in order; ``out`` makes batches of what is found."""
    less = digamma(totals)[None, :]

    def found(block: int, terms: np.ndarray, docs, beta: np.ndarray, places: dict):
        if places:
            raise ValueError("a document has a term without weights")
        row, sizes, cols, counts = map(ints, split(docs))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return out(block, terms, row, *infer(rows, cols, counts.astype(np.float64), beta, len(sizes), prior))

    def run(batches):
        state = None
        for g, block, kind, a, b in _rows(batches):
            if kind == 0:
                if state:
                    yield from found(*state)
                terms = ints(a)
                state = block, terms, b, np.empty((len(terms), k)), dict(_by_group(terms, groups))
                continue
            state[3][state[4].pop(g)] = np.exp(digamma(np.frombuffer(b, np.float64).reshape(-1, k)) - less)
        if state:
            yield from found(*state)

    return run


def _sums_back(groups: int):
    def out(block, terms, row, gamma, back):
        for g, at in _by_group(terms, groups):
            yield _batch(MESSAGES, g, block, 1, packed_ints(terms[at], True), back[at].tobytes())

    return out


def _topics_back(block, terms, row, gamma, back):
    for i in range(0, len(row), 4096):
        part, total = gamma[i : i + 4096], gamma[i : i + 4096].sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(row[i : i + 4096]), _arrays(part / total[:, None]), pa.array(total)], names=["_row", "_topics", "_total"])


def _gathered(k: int, more: float):
    """Rows of a group to one row: its terms and the sum of what came back for each of them, and ``more``."""

    def run(batches):
        group, ids, sums = None, np.zeros(0, np.int64), np.zeros((0, k))
        for g, _, _, a, b in _rows(batches):
            if g != group and group is not None:
                yield _batch(GROUPS, group, packed_ints(ids, True), (sums + more).tobytes())
            if g != group:
                group, ids, sums = g, np.zeros(0, np.int64), np.zeros((0, k))
            now, x = ints(a), np.frombuffer(b, np.float64).reshape(-1, k)
            both = np.union1d(ids, now)
            if len(both) > len(ids):
                wider = np.zeros((len(both), k))
                wider[np.searchsorted(both, ids)] = sums
                ids, sums = both, wider
            sums[np.searchsorted(ids, now)] += x
        if group is not None:
            yield _batch(GROUPS, group, packed_ints(ids, True), (sums + more).tobytes())

    return run


def _drawn(k: int, seed: int, groups: int):
    def run(batches):
        ids = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column("term_id").to_numpy() for b in batches)]))
        for g, at in _by_group(ids, groups):
            lam = np.stack([start_weights(t, k, seed) for t in ids[at].tolist()])
            yield _batch(GROUPS, g, packed_ints(ids[at], True), lam.tobytes())

    return run


def _messages(groups: DataFrame, kind: int = 0) -> DataFrame:
    return groups.select("g", F.lit(-1).cast("bigint").alias("block"), F.lit(kind).alias("kind"), F.col("ids").alias("a"), F.col("packed").alias("b"))


def _met(dealt: Dealt, r: int, model: Topics, out: Callable, schema: str) -> DataFrame:
    """Blocks of a round with the weights of their terms."""
    blocks, (places, place) = dealt.round(r), dealt.place()
    wanted = blocks.select("block", "terms").mapInArrow(_wanted(model.many), MESSAGES)
    both = _messages(model.groups).unionByName(wanted).repartition(model.many, "g").sortWithinPartitions("g", "kind", "block")
    handed = both.mapInArrow(_handed(model.k), MESSAGES).withColumn("part", F.shiftright("block", 33).cast("int"))
    docs = blocks.select(F.lit(-1).alias("g"), "block", F.lit(0).alias("kind"), F.col("terms").alias("a"), F.col("docs").alias("b"), "part")
    met = docs.unionByName(handed).withColumn("part", place)
    met = met.repartitionById(places, F.col("part")) if hasattr(met, "repartitionById") else met.repartition(SPREAD * places, "block")
    met = met.sortWithinPartitions("block", "kind", "g").drop("part")
    return met.mapInArrow(_inferred(model.totals, model.k, model.prior, model.many, out), schema)


@dataclass
class Topics:
    """groups: rows of GROUPS, written, a term in group ``term_id % many``; totals: the sums of all weights."""

    groups: DataFrame
    totals: np.ndarray
    k: int
    prior: float
    many: int

    @property
    def weights(self) -> DataFrame:
        """``term_id, weights`` (k numbers, prior included) and ``packed`` (the same as bytes)."""
        k = self.k

        def rows(batches):
            for ids, packed in _rows(batches):
                yield from _added(k, 0.0)([pa.RecordBatch.from_arrays([pa.array(ints(ids)), _packed(np.frombuffer(packed, np.float64).reshape(-1, k))], names=["term_id", "packed"])])

        return self.groups.select("ids", "packed").mapInArrow(rows, WEIGHTS)


def _totals(groups: DataFrame, k: int) -> np.ndarray:
    def added(batches):
        sums = [np.frombuffer(b, np.float64).reshape(-1, k).sum(0) for (b,) in _rows(batches)]
        yield pa.RecordBatch.from_arrays([_packed(np.sum([np.zeros(k), *sums], axis=0)[None, :])], names=["packed"])

    with settings(groups.sparkSession, ROWS):
        row = groups.select("packed").mapInArrow(added, "packed binary").repartition(1).mapInArrow(added, "packed binary").first()
    return np.frombuffer(row[0], np.float64)


def fit(bow: DataFrame, vocabulary: DataFrame, k: int = 50, passes: int = 10, seed: int = 42, dealt: Dealt | None = None) -> Topics:
    """Topic weights after ``passes`` passes over all rows of ``bow`` (``terms, counts``). Raises without any kept term. dealt: the
    blocks of ``bow``, if there are any yet."""
    spark, own = bow.sparkSession, dealt is None
    dealt = dealt or deal(bow.withColumn("_row", F.monotonically_increasing_id()), k)
    if dealt is None:
        raise ValueError("no document has a term of the vocabulary")
    prior = 1.0 / k
    many = max(2 * dealt.cores, -(-vocabulary.count() * k // GROUP))
    terms = vocabulary.select(F.col("term_id").cast("bigint").alias("term_id")).repartition(many, F.pmod("term_id", F.lit(many)))
    groups = materialize(terms.mapInArrow(_drawn(k, seed, many), GROUPS))
    model = Topics(groups, _totals(groups, k), k, prior, many)
    for _ in range(passes):
        sums = None
        for r in range(dealt.rounds):
            back = _met(dealt, r, model, _sums_back(many), MESSAGES)
            back = back if sums is None else back.unionByName(_messages(sums))
            added = back.repartition(many, "g").sortWithinPartitions("g", "block").mapInArrow(_gathered(k, prior if r == dealt.rounds - 1 else 0.0), GROUPS)
            with settings(spark, ROWS):
                added = materialize(added)
            if sums is not None:
                discard(sums)
            sums = added
        discard(model.groups)
        model = Topics(sums, _totals(sums, k), k, prior, many)
    if own:
        discard(dealt.blocks)
    return model


def transform(bow: DataFrame, model: Topics, out: str = "topic_vec", mass: str | None = None, dealt: Dealt | None = None) -> DataFrame:
    """``bow`` with the topic distribution of each row (array of k numbers that add up to 1; without kept terms: uniform). mass: a
    column for the sum of the unnormalised distribution without the prior: as many as the row has kept tokens. dealt: the blocks of
    ``bow``, which then is ``numbered``."""
    spark, rows, own = bow.sparkSession, bow if dealt else numbered(bow), dealt is None
    dealt = dealt or deal(rows, model.k)
    schema = "_row bigint, _topics array<double>, _total double"
    found = [spark.createDataFrame([], schema)]
    for r in range(dealt.rounds if dealt else 0):
        with settings(spark, ROWS):
            found.append(materialize(_met(dealt, r, model, _topics_back, schema)))
    if own and dealt:
        discard(dealt.blocks)
    joined = rows.join(reduce(DataFrame.unionByName, found[1:] or found), "_row", "left")
    joined = joined.withColumn(out, F.coalesce("_topics", F.array_repeat(F.lit(1.0 / model.k), model.k)))
    if mass:
        joined = joined.withColumn(mass, F.coalesce(F.col("_total") - model.prior * model.k, F.lit(0.0)))
    return joined.drop("_row", "_topics", "_total")
