import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import sampling, stats
from evalspark.plans.queries import _doc_words


def test_histogram_matches_numpy(spark):
    w = _doc_words(spark, "/root/testdata/sf0.01")
    xs = [r.n_words for r in w.select("n_words").collect()]
    for bins in (100, 200, 7):
        counts, edges = np.histogram(xs, bins=bins)
        h = sorted(stats.histogram(w, "n_words", bins).collect(), key=lambda r: r.bin)
        assert [r["count"] for r in h] == counts.tolist()
        assert [r.bin_lo for r in h] == edges[:-1].tolist()
        assert h[-1].bin_hi == edges[-1]


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5,), (5,)], "x int")
    counts, edges = np.histogram([5, 5], bins=4)
    h = sorted(stats.histogram(df, "x", 4).collect(), key=lambda r: r.bin)
    assert [r["count"] for r in h] == counts.tolist()


def test_digitize_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [10, 11, 20, 21, 31]], "x int")
    got = [r.d for r in df.select(stats.digitize("x", [10, 20, 20, 30]).alias("d")).collect()]
    assert got == [0, 1, 1, 3, 4] == np.digitize([10, 11, 20, 21, 31], [10, 20, 20, 30], right=True).tolist()


def test_largest_remainder():
    q = sampling.largest_remainder({("a",): 50, ("b",): 30, ("c",): 20}, 7)
    assert q == {("a",): 4, ("b",): 2, ("c",): 1}
    with pytest.raises(ValueError):
        sampling.largest_remainder({("a",): 1, ("b",): 3}, 2)
    with pytest.raises(ValueError):
        sampling.largest_remainder({("a",): 5, ("b",): 5, ("c",): 5}, 2)


def _base(spark, n=5000):
    return spark.range(n).select(
        F.col("id").alias("example_id"), (F.col("id") % 3).cast("int").alias("s"), (F.col("id") % 2).cast("int").alias("t")
    )


def _window_sample(df, strata, quotas, seed):
    from pyspark.sql import Window as W

    q = df.sparkSession.createDataFrame([(*k, v) for k, v in quotas.items()], [*strata, "_q"])
    rn = F.row_number().over(W.partitionBy(*strata).orderBy(sampling.order_key("example_id", seed), "example_id"))
    return df.join(q, strata).withColumn("_rn", rn).filter(F.col("_rn") <= F.col("_q"))


def test_stratified_sample_exact_and_equal_to_window_plan(spark):
    df = _base(spark)
    s = sampling.stratified_sample(df, ["s", "t"], 1234, seed=7)
    ids = {r.example_id for r in s.collect()}
    assert len(ids) == 1234
    sizes = sampling.stratum_sizes(df, ["s", "t"])
    quotas = sampling.largest_remainder(sizes, 1234)
    ref = {r.example_id for r in _window_sample(df, ["s", "t"], quotas, 7).collect()}
    assert ids == ref
    comp = {r.example_id for r in sampling.sample_complement(df, ["s", "t"], 1234, seed=7).collect()}
    assert not ids & comp and len(ids | comp) == 5000


def test_sample_independent_of_partitioning(spark):
    a = {r.example_id for r in sampling.stratified_sample(_base(spark).repartition(1), ["s"], 0.1).collect()}
    b = {r.example_id for r in sampling.stratified_sample(_base(spark).repartition(13), ["s"], 0.1).collect()}
    assert a == b and len(a) == 500


def test_balanced_sample(spark):
    df = _base(spark)
    s = sampling.balanced_sample(df, "t", 100, ["s"], seed=3)
    counts = {r.t: r["count"] for r in s.groupBy("t").count().collect()}
    assert counts == {0: 100, 1: 100}


def test_required_sample_size():
    assert sampling.required_sample_size_value(0.03, 0.10) == 1168
    assert sampling.required_sample_size_value(0.02, 0.10) == 2627


def test_best_worst_and_boxplot(spark):
    df = spark.createDataFrame(
        [("m", "r1", 0.5), ("m", "r2", 0.9), ("m", "r3", 0.9), ("m", "r4", 0.1), ("m", "r5", None)],
        "model string, run_id string, acc double",
    )
    r = stats.best_worst(df, "model", "acc", ["run_id"], tiebreak="run_id").first()
    assert (r.best_acc, r.best_run_id, r.worst_acc, r.worst_run_id) == (0.9, "r2", 0.1, "r4")
    b = stats.boxplot_table(df, "model", "acc").first()
    assert b.n == 4 and b.median == pytest.approx(0.7)


def test_quotas_of_many_strata_equal_the_driver_side_form(spark):
    rng = random.Random(4)
    sizes = {(c, s): rng.choice([2, 3, 5, 7, 40, 10**15]) for c in range(3) for s in range(700)}
    df = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "c int, s int, count long")
    for n in (5000, 10**16, 0.25):
        total = sum(sizes.values())
        want = sampling.largest_remainder(sizes, sampling._n_for(n, total))
        got = {(r.c, r.s): r._quota for r in sampling.quotas(df, ["c", "s"], n).collect()}
        if isinstance(n, int):
            assert got == {k: v for k, v in want.items() if v}
        else:  # a fraction of a total beyond 2**53 is rounded as a double
            assert abs(sum(got.values()) - total * n) <= 2
    per = {(r.c, r.s): r._quota for r in sampling.quotas(df, ["c", "s"], 3000, within=["c"]).collect()}
    for c in range(3):
        want = sampling.largest_remainder({k: v for k, v in sizes.items() if k[0] == c}, 3000)
        assert {k: v for k, v in per.items() if k[0] == c} == {k: v for k, v in want.items() if v}


def test_quota_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9)], "s string, count long")
    for bad, kw in ((df, {"n": 3}), (df, {"n": 11, "min_stratum": 1}), (df.filter("s = 'b'").unionByName(df.filter("s = 'b'").withColumn("s", F.lit("c"))), {"n": 1})):
        with pytest.raises(ValueError):
            sampling.quotas(bad, ["s"], **kw)
    with pytest.raises(ValueError):
        sampling.quotas(spark.createDataFrame([(None, 5)], "s string, count long"), ["s"], 2)


def test_balanced_sample_with_more_strata_than_rows(spark):
    rows = [(100 * t + k, t, k // 3 if k < 27 else 9 + k) for t in (0, 1) for k in range(40)]  # 9 strata of 3 rows, 13 of one
    df = spark.createDataFrame(rows, "example_id bigint, t int, s int")
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, "t", 5, ["s"])
    got = sampling.balanced_sample(df, "t", 5, ["s"], min_stratum=1).collect()
    # floors are 0; the largest remainders are those of the strata of 3 rows, the smallest numbers first
    assert sorted((r.t, r.s) for r in got) == [(t, s) for t in (0, 1) for s in range(5)]
