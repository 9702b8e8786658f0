"""Exact median per group with bounded memory per task (for continuous values at scale).

Spark's exact ``median``/``percentile`` keeps a value -> count map per group and merges it in one task:
fine for token counts (few distinct values), unbounded for elapsed seconds or tokens/s of a run with
billions of rows. Here the median is found by histogram refinement:

1. per group ``n, min, max``; the wanted 0-based ranks are ``floor((n-1)/2)`` and ``ceil((n-1)/2)``;
2. each level counts the rows of the current value interval in ``buckets`` equal-width buckets
   (map-side partial aggregation, at most ``buckets`` rows per group and rank), keeps the bucket that
   holds the rank and narrows the interval to that bucket's observed [min, max];
3. once an interval holds at most ``cell_limit`` rows (or one distinct value) those rows are ranked
   with a window partitioned by (group, rank), bounded by ``cell_limit``.

Bucket assignment is monotone in the value, so a bucket's rows are exactly the rows inside its
observed [min, max]. The result equals Spark's ``median`` (same interpolation: 0.5 * a + 0.5 * b).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def distributed_median(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str] = (),
    out: str = "median",
    buckets: int = 1 << 16,
    cell_limit: int = 100_000,
    max_levels: int = 12,
    checkpoint: bool = True,
    keep_empty_groups: bool = True,
) -> DataFrame:
    """One row per group: ``by..., out`` (NULL for a group without values, unless
    ``keep_empty_groups=False`` drops such groups and saves a pass). NaN counts as missing."""
    return distributed_quantiles(df, value, by, [0.5], [out], buckets, cell_limit, max_levels, checkpoint,
                                 keep_empty_groups)


def distributed_quantiles(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.5,),
    outs: Sequence[str] | None = None,
    buckets: int = 1 << 16,
    cell_limit: int = 100_000,
    max_levels: int = 12,
    checkpoint: bool = True,
    keep_empty_groups: bool = True,
) -> DataFrame:
    """Exact interpolated quantiles (Spark ``percentile`` semantics: position ``(n - 1) * p``, linear
    between the neighbouring ranks, no interpolation between equal values), one column per ``p``."""
    by = list(by)
    probs = [float(p) for p in probs]
    outs = list(outs or [f"q{p}" for p in probs])
    if any(not 0.0 <= p <= 1.0 for p in probs) or len(outs) != len(probs):
        raise ValueError("probabilities must lie in [0, 1], one output name each")
    v = F.col(value) if isinstance(value, str) else value
    whole = not by
    if whole:  # one group: a constant key keeps every step an equi-join (no cross join)
        df, by = df.withColumn("_all", F.lit(0)), ["_all"]
    x = df.select(*by, F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias("_x")).filter(F.col("_x").isNotNull())
    if checkpoint:
        from evalspark.session import materialize

        x = materialize(x)  # narrow (keys, value); scanned once per level
    keys = by + ["_rank"]
    total = x.count()
    biggest = total if total <= cell_limit else x.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if biggest <= cell_limit:
        # every group is small: Spark's exact percentile (a value -> count map of at most cell_limit
        # entries per group) is bounded, and it is the definition this operator reproduces
        grp = x.groupBy(*by).agg(F.percentile("_x", F.array(*[F.lit(p) for p in probs])).alias("_q"))
        res = grp.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(outs)])
        result = df.select(*by).distinct().join(res, by, "left") if keep_empty_groups or whole else res
        if whole:
            result = df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(result, ["_all"], "left").drop("_all")
        return result
    finite = ~F.col("_x").isin(float("inf"), float("-inf"))
    stats = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
                               F.min(F.when(finite, F.col("_x"))).alias("_flo"),
                               F.max(F.when(finite, F.col("_x"))).alias("_fhi"))
    pos = [(F.col("_n") - 1).cast("double") * F.lit(p) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q), F.ceil(q)) for q in pos])).cast("array<bigint>"))
    state = stats.select(*by, "_n", F.explode(ranks).alias("_rank"), "_lo", "_hi", "_flo", "_fhi",
                         F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_cnt"))
    state = _small(state)
    for _ in range(max_levels):
        open_ = state.filter((F.col("_cnt") > cell_limit) & (F.col("_hi") > F.col("_lo")))
        if open_.limit(1).count() == 0:
            break
        done = state.filter(~((F.col("_cnt") > cell_limit) & (F.col("_hi") > F.col("_lo"))))
        # ranks of one group usually share their interval (always at the first level): histogram each
        # distinct interval once, then attach the ranks to the small histogram
        iv_cols = [*by, "_lo", "_hi", "_flo", "_fhi", "_below"]
        intervals = open_.select(*iv_cols).distinct()
        j = x.join(intervals, by).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        # infinities get the end buckets; finite values spread over the finite [min, max] in between
        flo, fhi = F.col("_flo"), F.col("_fhi")
        wide = fhi - flo == float("inf")  # the range exceeds the largest double: halved values keep their order
        share = F.when(wide, (F.col("_x") / 2 - flo / 2) / (fhi / 2 - flo / 2)).otherwise((F.col("_x") - flo) / (fhi - flo))
        inner = F.least(F.floor(share * F.lit(buckets - 2)).cast("long") + 1, F.lit(buckets - 2))
        b = (
            F.when(F.col("_x") == float("-inf"), F.lit(0).cast("long"))
            .when(F.col("_x") == float("inf"), F.lit(buckets - 1).cast("long"))
            .when(fhi > flo, inner)
            .otherwise(F.lit(1).cast("long"))
        )
        hist = j.groupBy(*iv_cols, b.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_blo"), F.max("_x").alias("_bhi"),
            F.min(F.when(finite, F.col("_x"))).alias("_bflo"), F.max(F.when(finite, F.col("_x"))).alias("_bfhi"))
        # null-safe: a group holding only infinities has no finite bounds (NULL _flo/_fhi)
        ranks_of = open_.select(*[F.col(c).alias(f"_o{c}") for c in iv_cols], "_rank", "_n")
        cond = None
        for c in iv_cols:
            eq = F.col(c).eqNullSafe(F.col(f"_o{c}"))
            cond = eq if cond is None else cond & eq
        hist = hist.join(ranks_of, cond).drop(*[f"_o{c}" for c in iv_cols])
        w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = hist.withColumn("_cum", F.sum("_c").over(w))
        rel = F.col("_rank") - F.col("_below")
        hit = run.filter((F.col("_cum") - F.col("_c") <= rel) & (rel < F.col("_cum")))
        nxt = hit.select(*by, "_n", "_rank", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
                         F.col("_bflo").alias("_flo"), F.col("_bfhi").alias("_fhi"),
                         (F.col("_below") + F.col("_cum") - F.col("_c")).alias("_below"), F.col("_c").alias("_cnt"))
        state = _small(done.unionByName(nxt))
    # final: one distinct value -> it is the answer; otherwise rank the (bounded) rows of the interval
    single = state.filter(F.col("_hi") == F.col("_lo")).select(*keys, "_n", F.col("_lo").alias("_v"))
    multi = state.filter(F.col("_hi") > F.col("_lo"))
    cells = x.join(multi, by).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    rn = F.row_number().over(W.partitionBy(*keys).orderBy("_x")) - 1
    picked = cells.withColumn("_i", rn).filter(F.col("_i") == F.col("_rank") - F.col("_below")).select(
        *keys, "_n", F.col("_x").alias("_v"))
    vals = single.unionByName(picked)
    # value at each rank -> one map per group, then Spark's interpolation per probability
    per_group = vals.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    cols = []
    for p, name in zip(probs, outs):
        q = (F.col("_n") - 1).cast("double") * F.lit(p)
        lo_r, hi_r = F.floor(q).cast("bigint"), F.ceil(q).cast("bigint")
        a, b = F.element_at("_m", lo_r), F.element_at("_m", hi_r)
        interp = (hi_r.cast("double") - q) * a + (q - lo_r.cast("double")) * b
        cols.append(F.when((lo_r == hi_r) | (a == b), a).otherwise(interp).alias(name))
    res = per_group.select(*by, *cols)
    result = df.select(*by).distinct().join(res, by, "left") if keep_empty_groups or whole else res
    if whole:
        result = df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(result, ["_all"], "left").drop("_all")
    return result


def _small(state: DataFrame) -> DataFrame:
    """The per-(group, rank) state (at most two rows per group) is checkpointed after each level so a
    level never re-derives the previous ones (lineage stays one level deep, nothing goes through the
    driver)."""
    from evalspark.session import materialize

    return materialize(state)
