"""Exact stratified sampling and experimental design (SMP-2..5, SET-1, SRT-3).

Order key: ``md5(concat(seed, ':', id))`` then ``id``: seeded, repeatable under any partitioning and
portable to DuckDB. A stratum takes its ``quota`` smallest keys.

Scale: strata are few and large (one may hold a third of all rows), so the plain
``row_number() OVER (PARTITION BY stratum ...)`` would sort a whole stratum inside one task. Instead
the selection threshold is found with two small histograms over the hash prefix (map-side aggregated;
per stratum ``b`` bits per level with 2^b about size^(1/3), at most 16), and only the rows of one hash
cell per stratum (about size^(1/3) rows) are ever ranked together. The result equals the window plan
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SHOWN = 10  # strata named in an error


def order_key(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """SRT-3: seeded, repeatable shuffle (range-partitioned sort on the hash key)."""
    return df.orderBy(order_key(id_col, seed), F.col(id_col))


def largest_remainder(sizes: Mapping[tuple, int], n: int, min_stratum: int = 2) -> dict[tuple, int]:
    """Proportional integer quotas summing to ``n``: floors of ``n * size / total``, then +1 for the
    largest remainders (ties by stratum key). Integer arithmetic only, so it is exact."""
    total = sum(sizes.values())
    if n < 0 or n > total:
        raise ValueError(f"sample size {n} outside [0, {total}]")
    small = sorted(k for k, v in sizes.items() if v < min_stratum)
    if small:
        raise ValueError(f"strata with fewer than {min_stratum} rows: {small[:10]}")
    if 0 < n < len(sizes) and min_stratum > 1:
        raise ValueError(f"sample size {n} is smaller than the number of strata {len(sizes)}")
    floors = {k: (n * v) // total for k, v in sizes.items()}
    rem = {k: (n * v) % total for k, v in sizes.items()}
    extra = n - sum(floors.values())
    order = sorted(sizes, key=lambda k: (-rem[k], _sort_key(k)))
    quotas = dict(floors)
    for k in order[:extra]:
        quotas[k] += 1
    return quotas


def _sort_key(k: tuple) -> tuple:
    return tuple((v is None, v) for v in k)


def _n_for(n: int | float, total: int) -> int:
    """An int is a row count; a float a fraction, rounded up as scikit-learn does for a test size."""
    if isinstance(n, float):
        return int(math.ceil(n * total))
    return int(n)


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> dict[tuple, int]:
    """Stratum sizes on the driver, for tables known to hold few strata; ``quotas`` works on the table."""
    rows = df.groupBy(*strata).count().collect()
    out = {tuple(r[s] for s in strata): r["count"] for r in rows}
    if any(v is None for k in out for v in k):
        raise ValueError(f"NULL in stratum columns {list(strata)}; fill or filter them first")
    return out


def _bits(size: int) -> int:
    """Bucket bits per level for a stratum of ``size`` rows: about size^(1/3) buckets, so both
    histograms and the final ranked cell hold about size^(1/3) rows (1..16 bits per level)."""
    return max(1, min(16, math.ceil(math.log2(max(size, 2)) / 3)))


def quotas(sizes: DataFrame, strata: Sequence[str], n: int | float, within: Sequence[str] = (),
           min_stratum: int = 2) -> DataFrame:
    """``strata, _quota, _bits``: the same proportional quotas as ``largest_remainder``, for a table of any number of strata
    (``strata, count``, one row each). ``n`` holds for every group of the ``within`` columns; strata of quota 0 are left out.

    Floors and remainders are columns (in decimals: their products pass 64 bits); the strata that get one more are those
    whose rank by remainder is below what the floors leave, and ranks come from a range sort and partition offsets.
    """
    from evalspark.operators.frames import cumcount
    from evalspark.session import materialize

    strata, within = list(strata), list(within)
    rows = sizes.withColumn("_g", F.struct(*within) if within else F.lit(0))
    wide = "decimal(38,0)"
    want = F.ceil(F.lit(n) * F.sum("count")) if isinstance(n, float) else F.lit(int(n))
    null = F.greatest(*[F.col(s).isNull().cast("int") for s in strata], F.lit(0))
    totals = rows.groupBy("_g").agg(
        F.sum("count").alias("_total"), F.count("*").alias("_strata"), want.cast("bigint").alias("_n"), F.max(null).alias("_null"), F.min("count").alias("_least"))
    outside = (F.col("_n") < 0) | (F.col("_n") > F.col("_total"))
    few = (F.col("_n") > 0) & (F.col("_n") < F.col("_strata")) if min_stratum > 1 else F.lit(False)
    totals = materialize(totals.withColumns({"_outside": outside, "_few": few, "_small": F.col("_least") < min_stratum}))
    bad = totals.filter("_null > 0 OR _small OR _outside OR _few").orderBy(F.desc("_null"), F.desc("_small"), F.desc("_outside")).limit(1).collect()
    for b in bad:
        if b["_null"]:
            raise ValueError(f"NULL in stratum columns {strata}; fill or filter them first")
        if b["_small"]:
            small = [tuple(r) for r in sizes.filter(F.col("count") < min_stratum).select(*strata).orderBy(*strata).limit(SHOWN).collect()]
            raise ValueError(f"strata with fewer than {min_stratum} rows: {small}")
        if b["_outside"]:
            raise ValueError(f"sample size {b['_n']} outside [0, {b['_total']}]")
        raise ValueError(f"sample size {b['_n']} is smaller than the number of strata {b['_strata']}")
    rows = rows.join(totals.select("_g", "_total", "_n"), "_g")
    share = F.col("count").cast(wide) * F.col("_n")
    rows = rows.withColumn("_floor", F.floor(F.expr("(cast(count as decimal(19,0)) * cast(_n as decimal(19,0))) div _total")).cast("bigint"))
    rows = rows.withColumn("_rem", (share % F.col("_total")).cast("bigint"))
    left = rows.groupBy("_g").agg((F.max("_n") - F.sum("_floor")).alias("_left"))
    ranked = cumcount(rows.join(left, "_g"), "_g", [F.col("_rem").desc(), *map(F.col, strata)], "_rank")
    quota = F.col("_floor") + (F.col("_rank") < F.col("_left")).cast("bigint")
    bits = F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest("count", F.lit(2))) / 3))).cast("int")
    return ranked.select(*strata, quota.alias("_quota"), bits.alias("_bits")).filter("_quota > 0")


def _quota_frame(df: DataFrame, strata: Sequence[str], quotas: Mapping[tuple, int],
                 sizes: Mapping[tuple, int]) -> DataFrame:
    schema = df.select(*strata).schema
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    qschema = StructType(list(schema.fields) + [StructField("_quota", LongType(), False),
                                                StructField("_bits", IntegerType(), False)])
    rows = [tuple(k) + (int(v), _bits(sizes[k])) for k, v in quotas.items() if v > 0]
    return df.sparkSession.createDataFrame(rows, qschema)


def _threshold(hist: DataFrame, strata: Sequence[str], bucket: str, need: str) -> DataFrame:
    """First bucket per stratum where the running count reaches ``need``; rows still needed inside it."""
    w = W.partitionBy(*strata).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hist.withColumn("_cum", F.sum("count").over(w))
    hit = run.filter((F.col("_cum") - F.col("count") < F.col(need)) & (F.col("_cum") >= F.col(need)))
    return hit.select(*strata, "_bits", F.col(bucket).alias(bucket + "_star"),
                      (F.col(need) - (F.col("_cum") - F.col("count"))).alias(need + "_in"))


def keyed_frame(df: DataFrame, strata: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """``strata, _id, _k`` (the order key) and ``_h``, its first 32 bits as a number."""
    k = order_key(id_col, seed)
    return df.select(*strata, F.col(id_col).alias("_id"), k.alias("_k")).select(
        *strata, "_id", "_k", F.conv(F.substring("_k", 1, 8), 16, 10).cast("bigint").alias("_h"))


def _level1(h: str = "_h", bits: str = "_bits") -> Column:
    """The first ``bits`` bits of the 32-bit prefix (the level-1 bucket)."""
    return F.expr(f"shiftright({h}, 32 - {bits})")


def _top(h: str = "_h", bits: str = "_bits") -> Column:
    """The first ``2 * bits`` bits of the 32-bit prefix: (level-1 bucket, level-2 bucket) as one number."""
    return F.expr(f"shiftright({h}, 32 - 2 * {bits})")


def sample_thresholds(keyed: DataFrame, strata: Sequence[str], quotas: DataFrame | Mapping[tuple, int],
                      sizes: Mapping[tuple, int] | None = None) -> DataFrame:
    """Per stratum the threshold cell (``_bits``, ``_top_star``) and the key of its last sampled row;
    at most one row per stratum. ``keyed`` comes from ``keyed_frame`` (hash computed once), ``quotas`` from the function
    of that name (or as a mapping with ``sizes``). Joins carry no hint: Spark broadcasts the small side by its size."""
    qdf = quotas if isinstance(quotas, DataFrame) else _quota_frame(keyed, strata, quotas, sizes)
    k1 = keyed.join(qdf, list(strata)).withColumn("_b1", _level1())
    h1 = k1.groupBy(*strata, "_bits", "_quota", "_b1").count()
    t1 = _threshold(h1, strata, "_b1", "_quota")
    cell1 = keyed.join(t1, list(strata)).filter(_level1() == F.col("_b1_star"))
    cell1 = cell1.withColumn("_t", _top())
    h2 = cell1.groupBy(*strata, "_bits", "_quota_in", "_t").count()
    t2 = _threshold(h2, strata, "_t", "_quota_in")
    cell2 = cell1.join(t2.drop("_bits"), list(strata)).filter(F.col("_t") == F.col("_t_star"))
    rn = F.row_number().over(W.partitionBy(*strata).orderBy("_k", "_id"))
    last = cell2.withColumn("_rn", rn).filter(F.col("_rn") == F.col("_quota_in_in"))
    return last.select(*strata, "_bits", F.col("_t_star").alias("_top_star"), F.col("_k").alias("_k_star"),
                       F.col("_id").alias("_id_star"))


def _window_thresholds(keyed: DataFrame, strata: Sequence[str], quotas: Mapping[tuple, int],
                       sizes: Mapping[tuple, int]) -> DataFrame:
    """Same threshold rows as ``sample_thresholds`` by the plain plan, one window per stratum, to hold it against in tests
    (``_bits`` = 16 makes the cell the full 32-bit prefix)."""
    qdf = F.broadcast(_quota_frame(keyed, strata, quotas, sizes))
    rn = F.row_number().over(W.partitionBy(*strata).orderBy("_k", "_id"))
    last = keyed.join(qdf, list(strata)).withColumn("_rn", rn).filter(F.col("_rn") == F.col("_quota"))
    return last.select(*strata, F.lit(16).alias("_bits"), F.col("_h").alias("_top_star"),
                       F.col("_k").alias("_k_star"), F.col("_id").alias("_id_star"))


def _membership(df: DataFrame, strata: Sequence[str], id_col: str, seed: int, thresholds: DataFrame) -> DataFrame:
    k = order_key(id_col, seed)
    h = F.conv(F.substring(k, 1, 8), 16, 10).cast("bigint")
    j = df.join(thresholds, list(strata), "left").withColumn("_hh", h)
    top = _top("_hh")
    ts = F.col("_top_star")
    inside = (top < ts) | ((top == ts) & ((k < F.col("_k_star")) | ((k == F.col("_k_star")) & (F.col(id_col) <= F.col("_id_star")))))
    return j.withColumn("_in_sample", F.coalesce(inside, F.lit(False))).drop(
        "_bits", "_top_star", "_k_star", "_id_star", "_hh")


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    n: int | float,
    id_col: str = "example_id",
    seed: int = 42,
    within: Sequence[str] | None = None,
    min_stratum: int = 2,
    checkpoint: bool = True,
) -> DataFrame:
    """Mark every row with ``_in_sample``: exact proportional quotas per stratum.

    ``within`` (some of ``strata``) applies ``n`` separately inside each of its groups (the
    balanced per-class sample). Strata columns must not hold NULL (checked).
    """
    from evalspark.session import materialize

    strata = list(strata)
    # The threshold search scans its input several times; it only needs (strata, id, hash key, prefix
    # buckets), so that narrow projection is derived once (md5 computed once) and cut from its lineage
    # (reliable checkpoint in the shared folder).
    keyed = keyed_frame(df, strata, id_col, seed)
    if checkpoint:
        keyed = materialize(keyed)
    sizes = materialize(keyed.groupBy(*strata).count())
    wanted = quotas(sizes, strata, n, within or (), min_stratum)
    thresholds = materialize(sample_thresholds(keyed, strata, wanted))  # at most one row per stratum
    return _membership(df, strata, id_col, seed, thresholds)


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int | float, id_col: str = "example_id",
                      seed: int = 42, within: Sequence[str] | None = None, min_stratum: int = 2) -> DataFrame:
    """SMP-2: exactly ``n`` rows (per ``within`` group), proportional to stratum sizes."""
    s = stratified_split(df, strata, n, id_col, seed, within, min_stratum)
    return s.filter("_in_sample").drop("_in_sample")


def sample_complement(df: DataFrame, strata: Sequence[str], n: int | float, id_col: str = "example_id",
                      seed: int = 42, within: Sequence[str] | None = None, min_stratum: int = 2) -> DataFrame:
    """SMP-3: the rows the same sample leaves out."""
    s = stratified_split(df, strata, n, id_col, seed, within, min_stratum)
    return s.filter(~F.col("_in_sample")).drop("_in_sample")


def balanced_sample(df: DataFrame, label: str, per_class: int, strata: Sequence[str] = (),
                    id_col: str = "example_id", seed: int = 42, columns: Sequence[str] | None = None,
                    min_stratum: int = 2) -> DataFrame:
    """SMP-4 + SET-1: ``per_class`` rows of every class, stratified by ``strata`` inside each class,
    projected to ``columns``. One plan for all classes (quotas computed per class). ``min_stratum=1`` allows strata of one row
    and more strata than rows wanted: the largest remainders then say which strata get a row."""
    s = stratified_sample(df, [label, *strata], per_class, id_col, seed, within=[label], min_stratum=min_stratum)
    return s.select(*(columns or s.columns))


def required_sample_size(mu: float, variance: Column | float, alpha: float = 0.05, power: float = 0.9) -> Column:
    """SMP-5: n = ((z(1 - alpha/2) + z(power)) * sigma / mu)^2, rounded up. z values are driver literals."""
    if mu <= 0:
        raise ValueError("mu (minimum detectable difference) must be positive")
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    var = F.lit(variance) if isinstance(variance, (int, float)) else variance
    return F.ceil(F.lit(z * z / (mu * mu)) * var).cast("bigint")


def required_sample_size_value(mu: float, variance: float, alpha: float = 0.05, power: float = 0.9) -> int:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return int(math.ceil((z * math.sqrt(variance) / mu) ** 2))
