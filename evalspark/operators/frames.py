"""Reshaping the run table for side-by-side comparison (WIN-1, RSH-1..3, SRT-1, AGG-20).

These operate on the wide run frame (one row per run). Windows are partitioned by the comparison
criterion (a model name), so each partition holds the runs of one model: the run table is small by
nature (one row per experiment run, not per example).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def cumcount(df: DataFrame, by: str, order: Sequence[Column], out: str = "group_id", method: str = "sorted") -> DataFrame:
    """WIN-1: 0-based position of each row inside its ``by`` group, in an explicit order (pandas
    ``cumcount`` uses row position; Spark rows have none).

    ``method="sorted"`` never puts a whole group in one task: a global range-partitioned sort, then
    ``monotonically_increasing_id`` (partition index in the high bits, position in the low bits), the
    row count of every (group, partition) pair (a small table) turned into offsets, and a join back.
    ``method="window"`` is ``row_number() OVER (PARTITION BY by ...)`` for small tables.
    """
    if method == "window":
        return df.withColumn(out, F.row_number().over(W.partitionBy(c(by)).orderBy(*order)) - 1)
    from evalspark.session import materialize

    low = (1 << 33) - 1
    s = materialize(df.orderBy(c(by), *order).withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(low)))
    counts = s.groupBy(c(by).alias("_key"), "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_p0"))
    w = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = counts.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).drop("_c")
    j = s.join(offsets, c(by).eqNullSafe(F.col("_key")) & (s["_part"] == offsets["_part"]))
    rank = (F.col("_before") + F.col("_pos") - F.col("_p0")).cast("int")
    return j.select(*[s[f"`{x}`"] for x in df.columns], rank.alias(out))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric", value: str = "value") -> DataFrame:
    """RSH-1: wide -> long; id columns repeated, NULL values kept."""
    return df.unpivot([c(i) for i in ids], [c(v) for v in values], var, value)


def long_runs(
    runs: DataFrame,
    criterion: str,
    label: str,
    line_cols: Sequence[str],
    bar_cols: Sequence[str],
    order: str = "aabb",
    run_order: Sequence[Column] | None = None,
    group_col: str = "group_id",
    var: str = "metric",
    value: str = "value",
) -> DataFrame:
    """RSH-3: cumcount within the criterion, melt the bar columns, sort by (criterion, label, group,
    metric). ``order='abab'`` swaps criterion and label first, as the reference does."""
    if order not in ("aabb", "abab"):
        raise ValueError("order must be 'aabb' or 'abab'")
    if order == "abab":
        criterion, label = label, criterion
    run_order = list(run_order) if run_order is not None else [F.col("start_time").desc(), F.col("run_id")]
    numbered = cumcount(runs, criterion, run_order, group_col)
    ids = [criterion, group_col, label, *line_cols]
    long = melt(numbered.select(*[c(x) for x in dict.fromkeys([*ids, *bar_cols])]), ids, bar_cols, var, value)
    return long.orderBy(c(criterion), c(label), F.col(group_col), F.col(var))


def metric_pairs(runs: DataFrame, by: str, x: str, others: Sequence[str], keep: Sequence[str] = ("run_id",)) -> DataFrame:
    """AGG-20: per group, the (x, metric) points for every other metric, long format."""
    base = runs.select(c(by), *[c(k) for k in keep], c(x).alias("x"), *[c(o) for o in others])
    return base.unpivot([c(by), *[c(k) for k in keep], F.col("x")], [c(o) for o in others], "metric", "y")


def metric_correlations(pairs: DataFrame, by: str) -> DataFrame:
    """Pearson correlation of x with each metric per group (the relations read off the reference's plots).

    ``covar_samp / (stddev_samp * stddev_samp)`` under ``try_divide``: a constant series gives NULL
    (ANSI ``corr`` raises DIVIDE_BY_ZERO instead)."""
    r = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    return pairs.groupBy(c(by), "metric").agg(F.count("y").alias("n"), r.alias("corr"))
