"""Paired comparison of runs scored on the same examples (JOIN-4) and the sample size it implies (SMP-5).

The self-join ``a.example_id = b.example_id AND a.run_id < b.run_id`` would emit (runs choose 2) rows
per example before aggregating. Instead each example becomes one row of bit vectors, a bit for each run (one shuffle on
``example_id``, with partial ORs before it). A batch of them is a 0/1 matrix, whose products with itself count all pairs
of runs at once; the tasks' products are added per pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.sampling import required_sample_size

BITS = 62  # runs in a word of a bit vector
FEW = 8  # runs whose pairs are counted by one JVM aggregate; longer lists by matrix products
ROWS = 1024  # examples multiplied at once: their counts are exact in single precision


def correctness(pred: DataFrame, truth: str = "true_label", label: str = "label") -> DataFrame:
    """``ok`` = 1 when the predicted label equals the truth (failed rows, -1, count as wrong)."""
    return pred.withColumn("ok", F.coalesce((F.col(label) == F.col(truth)).cast("int"), F.lit(0)))


def _bit_vectors(scored: DataFrame, named: DataFrame, runs: int, run_col: str, key: str, ok: str) -> DataFrame:
    """One row per example: words of bits that say which runs have scored it (p0, p1, ...) and which were right (r0, ...)."""
    rows = scored.filter(F.col(ok).isNotNull()).join(F.broadcast(named), F.col(run_col) == F.col("_run"))  # as long as the list of runs
    bit = F.expr(f"shiftleft(1L, _at % {BITS})")
    word = F.floor(F.col("_at") / BITS)
    cols = []
    for w in range(-(-runs // BITS)):
        mine = F.when(word == w, bit)
        cols += [F.bit_or(mine).alias(f"p{w}"), F.bit_or(F.when(F.col(ok) == 1, mine)).alias(f"r{w}")]
    return rows.groupBy(key).agg(*cols).drop(key).fillna(0)


def _counted(wide: DataFrame, runs: int) -> DataFrame:
    """Counts of the few pairs of a short list of runs, as columns of one aggregate over the bit vectors."""

    def bit(name: str, run: int):
        return F.shiftright(f"{name}{run // BITS}", run % BITS).bitwiseAND(F.lit(1).cast("bigint"))

    pairs = list(combinations(range(runs), 2))
    cols = []
    for k, (a, b) in enumerate(pairs):
        both = (bit("p", a) == 1) & (bit("p", b) == 1)
        cols += [F.count_if(both).alias(f"n{k}"), F.count_if(both & (bit("r", a) > bit("r", b))).alias(f"ab{k}"), F.count_if(both & (bit("r", a) < bit("r", b))).alias(f"ba{k}")]
    if not pairs:
        return wide.sparkSession.createDataFrame([], "a int, b int, n bigint, a_not_b bigint, b_not_a bigint")
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{k}").alias("n"), F.col(f"ab{k}").alias("a_not_b"), F.col(f"ba{k}").alias("b_not_a")) for k, (a, b) in enumerate(pairs)]
    return wide.agg(*cols).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _gram(runs: int):
    """Batches of bit vectors to counts per pair of runs: products of 0/1 matrices, added up over the task."""

    def matrix(batch, name: str) -> np.ndarray:
        words = [batch.column(f"{name}{w}").to_numpy(zero_copy_only=False) for w in range(-(-runs // BITS))]
        bits = np.concatenate([(x[:, None] >> np.arange(BITS)) & 1 for x in words], axis=1)
        return bits[:, :runs].astype(np.float32)

    def run(batches):
        both, right = np.zeros((runs, runs), np.int64), np.zeros((runs, runs), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                p, r = matrix(batch, "p"), matrix(batch, "r")
                both += (p.T @ p).astype(np.int64)
                right += (r.T @ (p - r)).astype(np.int64)  # the first right, the second wrong
        a, b = np.nonzero(np.triu(both, 1))
        cols = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(x) for x in (both[a, b], right[a, b], right[b, a]))]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n", "a_not_b", "b_not_a"])

    return run


def paired_comparison(
    scored: DataFrame,
    runs: Sequence[str],
    run_col: str = "run_id",
    key: str = "example_id",
    ok: str = "ok",
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Per pair of runs (run_a < run_b): examples scored by both (``n``), p(A right, B wrong),
    p(B right, A wrong), the accuracy difference and the variance of the per-example difference
    as the reference defines it (``p_a_not_b + p_b_not_a``). Undefined ratios are NULL.

    ``runs`` is the explicit run list; ``pairs`` restricts the output to chosen pairs. Several rows of one run and
    example count once, as right if any is; rows without ``ok`` do not count. The list may hold thousands of runs: one
    pass over the data serves all pairs, and a task holds two matrices of runs by runs.
    """
    runs = sorted(set(runs))
    spark = scored.sparkSession
    named = spark.createDataFrame(list(enumerate(runs)), f"_at int, _run {scored.schema[run_col].dataType.simpleString()}")
    wide = _bit_vectors(scored, named, len(runs), run_col, key, ok)
    if len(runs) <= FEW:
        sums = _counted(wide, len(runs))
    else:
        sums = wide.mapInArrow(_gram(len(runs)), "a int, b int, n bigint, a_not_b bigint, b_not_a bigint")
        sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "a_not_b", "b_not_a")])
    if pairs is None:
        every = spark.range(len(runs)).select(F.col("id").cast("int").alias("a"))
        every = every.filter(F.col("a") < len(runs) - 1).select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(len(runs) - 1))).alias("b"))
    else:
        at = {r: k for k, r in enumerate(runs)}
        every = spark.createDataFrame([tuple(sorted((at[x], at[y]))) for x, y in pairs], "a int, b int")
    out = every.join(sums, ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(F.broadcast(named.select(F.col("_at").alias(side), F.col("_run").alias(f"run_{side}"))), side)
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n", "a_not_b", "b_not_a")})
    p_ab = F.try_divide(F.col("a_not_b"), F.col("n")).cast("double")
    p_ba = F.try_divide(F.col("b_not_a"), F.col("n")).cast("double")
    return out.select(
        "run_a",
        "run_b",
        "n",
        p_ab.alias("p_a_not_b"),
        p_ba.alias("p_b_not_a"),
        F.try_divide(F.col("a_not_b") - F.col("b_not_a"), F.col("n")).cast("double").alias("accuracy_diff"),
        (p_ab + p_ba).alias("variance"),
    )


def with_required_n(pairs: DataFrame, mu: float = 0.03, alpha: float = 0.05, power: float = 0.9) -> DataFrame:
    """SMP-5 per pair: examples needed to detect ``mu`` with the pair's variance."""
    return pairs.withColumn("required_n", required_sample_size(mu, F.col("variance"), alpha, power))
