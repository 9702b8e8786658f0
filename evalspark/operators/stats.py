"""Corpus and run statistics (AGG-13..21, SMP-1, FLT-8).

Global statistics need at most one tiny driver round trip (a one-row min/max), never the data itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_counts(df: DataFrame, *cols: str, name: str = "count") -> DataFrame:
    """AGG-13: frequency of each value (map-side partial counts, one small shuffle)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """AGG-14: counts by ``row`` unstacked on ``col`` (explicit values: no extra distinct job).

    Missing combinations are NULL, as pandas ``unstack`` gives NaN.
    """
    prefix = f"{col}_" if prefix is None else prefix
    # conditional counts: one shuffle on the row key (pivot adds a second aggregate on (row, col))
    cells = [F.count_if(F.col(col) == F.lit(v)) for v in values]
    return df.groupBy(row).agg(*[F.when(c > 0, c).alias(f"{prefix}{v}") for c, v in zip(cells, values)])


MAX_PIVOT_VALUES = 10_000


def pivot_values(df: DataFrame, col: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """Distinct values of ``col`` for an explicit pivot list, refusing more than ``limit`` (the list
    becomes columns, so it must be bounded)."""
    rows = df.select(col).distinct().orderBy(col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct values in {col!r}; pivot on a coarser column")
    return [r[0] for r in rows]


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def _use_distributed(df: DataFrame, c: str | Column, mode: str) -> bool:
    """``"auto"``: Spark's exact percentile (a value -> count map per group) for integral inputs, whose
    distinct values are few; the bounded-memory distributed quantiles for fractional inputs."""
    if mode not in ("auto", "map", "distributed"):
        raise ValueError("mode must be 'auto', 'map' or 'distributed'")
    if mode != "auto":
        return mode == "distributed"
    from pyspark.sql.types import IntegralType

    return not isinstance(df.select(_col(c).alias("_q")).schema["_q"].dataType, IntegralType)


def _quartiles(df: DataFrame, c: str | Column, by: Sequence[str], names: Sequence[str], mode: str) -> DataFrame:
    probs = [0.25, 0.5, 0.75]
    if _use_distributed(df, c, mode):
        from evalspark.operators.quantiles import distributed_quantiles

        return distributed_quantiles(df, c, by, probs, names)
    x = nan_to_null(c)
    grouped = df.groupBy(*by) if by else df.groupBy()
    q = grouped.agg(F.percentile(x, F.array(*[F.lit(p) for p in probs])).alias("_q"))
    return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def quantile_summary(df: DataFrame, c: str | Column, by: Sequence[str] = (), name: str = "x",
                     mode: str = "auto") -> DataFrame:
    """AGG-15: n, min, max, quartiles (interpolated, exact) of one numeric expression per group."""
    x = nan_to_null(c)
    grouped = df.groupBy(*by) if by else df.groupBy()
    base = grouped.agg(F.count(x).alias(f"n_{name}"), F.min(x).alias(f"min_{name}"), F.max(x).alias(f"max_{name}"))
    qs = _quartiles(df, c, by, [f"q1_{name}", f"median_{name}", f"q3_{name}"], mode)
    if by:
        out = base.join(qs, list(by), "left")
    else:
        row = qs.first()
        out = base
        for n in (f"q1_{name}", f"median_{name}", f"q3_{name}"):
            out = out.withColumn(n, F.lit(row[n]).cast("double"))
    return out.select(*by, f"n_{name}", f"min_{name}", f"q1_{name}", f"median_{name}", f"q3_{name}", f"max_{name}")


# ------------------------------------------------------------------ histogram (numpy-exact equal width)


def histogram_range(df: DataFrame, c: str | Column) -> tuple[float, float]:
    """Outer edges as numpy does: [min, max], widened by 0.5 on each side when min == max."""
    x = nan_to_null(c)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row.lo is None:
        raise ValueError("histogram of an empty column")
    lo, hi = float(row.lo), float(row.hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return lo, hi


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """``numpy.linspace(lo, hi, bins + 1)``: i * step + lo, last edge exactly hi."""
    step = (hi - lo) / bins
    return [i * step + lo for i in range(bins)] + [hi]


def with_bin(df: DataFrame, c: str | Column, lo: float, hi: float, bins: int, out: str = "bin") -> DataFrame:
    """Add the 0-based ``numpy.histogram`` bin of ``c`` (equal width, last bin closed; NULL outside
    [lo, hi]). Staged projections: the value is computed once, each numpy correction step reads columns."""
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    x, i = F.col("_hx"), F.col("_hi")
    staged = df.withColumn("_hx", nan_to_null(c))
    staged = staged.withColumn("_hi", (((x - F.lit(lo)) / F.lit(hi - lo)) * F.lit(bins)).cast("int"))
    staged = staged.withColumn("_hi", F.when(i == bins, F.lit(bins - 1)).otherwise(i))
    staged = staged.withColumn("_hi", F.when(x < edge(i), i - 1).otherwise(i))
    staged = staged.withColumn("_hi", F.when((x >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i))
    return staged.withColumn(out, F.when((x >= lo) & (x <= hi), i)).drop("_hx", "_hi")


def _non_null_bin(df: DataFrame, c: str | Column, lo: float, hi: float, bins: int) -> DataFrame:
    # -1 marks "outside / NULL". A non-nullable key keeps the optimizer from inferring an IS NOT NULL
    # filter for the join below and pushing it (with the whole staged expression) under the projections.
    return with_bin(df, c, lo, hi, bins, "_bin").withColumn("bin", F.coalesce(F.col("_bin"), F.lit(-1))).drop("_bin")


def histogram(
    df: DataFrame,
    c: str | Column,
    bins: int = 100,
    by: Sequence[str] = (),
    value_range: tuple[float, float] | None = None,
) -> DataFrame:
    """AGG-16: ``bin, bin_lo, bin_hi, count`` with empty bins kept (count 0).

    With ``by`` the same edges are reused for every group (the per-class histogram). Empty bins come
    from a ``sequence`` exploded over the distinct groups (a small table), not from a cross join.
    """
    lo, hi = value_range or histogram_range(df, c)
    step = (hi - lo) / bins
    binned = _non_null_bin(df.select(*by, _col(c).alias("_v")), "_v", lo, hi, bins)
    counts = binned.groupBy(*by, "bin").count()
    if by:
        frame = df.select(*by).distinct()
    else:
        frame = df.sparkSession.range(1).select()
    frame = frame.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = frame.join(counts, [*by, "bin"], "left")
    edge_lo = F.col("bin").cast("double") * F.lit(step) + F.lit(lo)
    edge_hi = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(
        (F.col("bin") + 1).cast("double") * F.lit(step) + F.lit(lo)
    )
    return out.select(
        *by,
        "bin",
        edge_lo.alias("bin_lo"),
        edge_hi.alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def populous_edges(hist_rows: Sequence, min_count: int) -> list[float]:
    """FLT-8: right edges of bins holding more than ``min_count`` rows, then the last edge."""
    rows = sorted(hist_rows, key=lambda r: r["bin"])
    edges = [float(r["bin_hi"]) for r in rows if r["count"] > min_count]
    return edges + [float(rows[-1]["bin_hi"])]


def digitize(c: str | Column, edges: Sequence[float]) -> Column:
    """SMP-1: ``numpy.digitize(x, edges, right=True)`` = number of edges strictly below x."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    x = _col(c).cast("double")
    return F.size(F.filter(arr, lambda e: e < x))


def size_groups(df: DataFrame, c: str | Column, bins: int = 100, min_count: int | float = 100) -> tuple[Column, list]:
    """Histogram -> populous edges -> digitize column (the corpus size groups of the sample design).

    ``min_count`` as a float is a fraction of all rows (100 of 40,000 in the reference = 0.0025).
    Returns the group column and the edge list (at most ``bins + 1`` values reach the driver).
    """
    hist = histogram(df, c, bins).collect()
    total = sum(r["count"] for r in hist)
    thr = min_count * total if isinstance(min_count, float) else min_count
    edges = populous_edges(hist, thr)
    return digitize(c, edges), edges


# ------------------------------------------------------------------ per-group extremes and box plots


def best_worst(df: DataFrame, by: str, score: str, keep: Sequence[str], tiebreak: str, mode: str = "auto",
               cell_limit: int = 100_000) -> DataFrame:
    """AGG-18: the row with max and with min ``score`` per group; ties go to the smallest ``tiebreak``
    (pandas ``argmax`` takes the first row; rows carry an explicit order column instead of a position).

    One aggregate, no window: ``min_by`` over ``struct(-score, tiebreak)`` picks the best row. The
    per-group median follows ``mode`` (see ``quantile_summary``; ``cell_limit``: see ``distributed_quantiles``).
    """
    s = nan_to_null(score)
    payload = F.struct(s.alias(score), *[F.col(k) for k in keep])
    rows = df.filter(s.isNotNull())
    g = rows.groupBy(by).agg(
        F.min_by(payload, F.struct(-s, F.col(tiebreak))).alias("best"),
        F.min_by(payload, F.struct(s, F.col(tiebreak))).alias("worst"),
    )
    med_name = f"median_{score}"
    if _use_distributed(rows, score, mode):
        from evalspark.operators.quantiles import distributed_quantiles

        med = distributed_quantiles(rows, score, [by], [0.5], [med_name], cell_limit=cell_limit)
    else:
        med = rows.groupBy(by).agg(F.median(s).alias(med_name))
    return g.join(med, by, "left").select(
        by,
        *[F.col("best")[c].alias(f"best_{c}") for c in [score, *keep]],
        *[F.col("worst")[c].alias(f"worst_{c}") for c in [score, *keep]],
        med_name,
    )


def boxplot_table(df: DataFrame, by: str, value: str, whisker: float = 1.5, mode: str = "auto") -> DataFrame:
    """AGG-19: per group Q1, median, Q3, whisker ends (furthest points inside Q +- 1.5 IQR) and the
    number of fliers. Quartiles per ``mode`` (see ``quantile_summary``), then one aggregate over the
    values joined to the one-row-per-group fence table."""
    x = nan_to_null(value)
    n = df.groupBy(by).agg(F.count(x).alias("n"))
    q = n.join(_quartiles(df, value, [by], ["q1", "median", "q3"], mode), by, "left")
    fences = _fences(q, by, whisker)
    j = df.select(by, x.alias("_x")).join(fences, by)
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    w = j.groupBy(by).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_fliers"),
    )
    return q.select(by, "n", "q1", "median", "q3").join(w, by)


def _fences(quartiles: DataFrame, by: str, whisker: float) -> DataFrame:
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    return quartiles.select(by, (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi"))


def boxplot_fliers(df: DataFrame, by: str, value: str, keys: Sequence[str] = (), whisker: float = 1.5, mode: str = "auto") -> DataFrame:
    """AGG-19, the points beyond the whiskers: ``by, *keys, value`` of every row whose value is outside Q +- ``whisker`` IQR of its
    group. Rows stream past the fence table (one row per group); no list is made, so a group may have any number of fliers.
    Null and NaN values are no fliers."""
    fences = _fences(_quartiles(df, value, [by], ["q1", "median", "q3"], mode), by, whisker)
    rows = df.select(by, *keys, nan_to_null(value).alias(value)).join(fences.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return rows.filter((F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))).select(by, *keys, value)
