"""Hot keys: one stratum / group holds a third of all rows; results must equal the plain plans."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalspark.operators import sampling
from evalspark.operators.quantiles import distributed_quantiles


def _skewed(spark, n=60_000):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 7) + 1)
    return spark.range(n).select(
        F.col("id").alias("example_id"), hot.cast("int").alias("s"),
        (F.sin(F.col("id")) * 1000 + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 13)).alias("v"),
    ).repartition(11)


def test_hot_stratum_sample_equals_window_plan(spark):
    df = _skewed(spark)
    got = {r.example_id for r in sampling.stratified_sample(df, ["s"], 0.05, seed=9).collect()}
    quotas = sampling.largest_remainder(sampling.stratum_sizes(df, ["s"]), 3000)
    q = spark.createDataFrame([(k[0], v) for k, v in quotas.items()], "s int, _q long")
    rn = F.row_number().over(W.partitionBy("s").orderBy(sampling.order_key("example_id", 9), "example_id"))
    want = {r.example_id for r in df.join(q, "s").withColumn("_rn", rn).filter("_rn <= _q").collect()}
    assert got == want and len(got) == 3000


def test_hot_group_quantiles_equal_percentile(spark):
    df = _skewed(spark)
    probs = [0.1, 0.5, 0.9]
    want = {r.s: [float(x) for x in r.q] for r in df.groupBy("s").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = {r.s: [r.a, r.b, r.c] for r in distributed_quantiles(
        df, "v", ["s"], probs, ["a", "b", "c"], buckets=64, cell_limit=500).collect()}
    assert got == want


def test_histogram_thresholds_equal_window_thresholds(spark):
    """Both threshold paths select the same rows (the histogram path is the one used above 100k)."""
    from evalspark.session import materialize

    df = _skewed(spark, 20_000)
    keyed = materialize(sampling.keyed_frame(df, ["s"], "example_id", 4))
    sizes = sampling.stratum_sizes(keyed, ["s"])
    quotas = sampling.largest_remainder(sizes, 777)

    def members(th):
        small = spark.createDataFrame(th.collect(), th.schema)
        return {r.example_id for r in sampling._membership(df, ["s"], "example_id", 4, small).filter("_in_sample").collect()}

    a = members(sampling.sample_thresholds(keyed, ["s"], quotas, sizes))
    b = members(sampling._window_thresholds(keyed, ["s"], quotas, sizes))
    assert a == b and len(a) == 777


def test_sample_edges_zero_and_everything(spark):
    df = _skewed(spark, 3000)
    assert sampling.stratified_sample(df, ["s"], 0, seed=1, min_stratum=1).count() == 0
    assert sampling.stratified_sample(df, ["s"], 3000, seed=1).count() == 3000
    assert sampling.sample_complement(df, ["s"], 3000, seed=1).count() == 0
    # the histogram path with the same edges
    from evalspark.session import materialize

    keyed = materialize(sampling.keyed_frame(df, ["s"], "example_id", 1))
    sizes = sampling.stratum_sizes(keyed, ["s"])
    full = sampling.largest_remainder(sizes, 3000)
    th = sampling.sample_thresholds(keyed, ["s"], full, sizes)
    small = spark.createDataFrame(th.collect(), th.schema)
    assert sampling._membership(df, ["s"], "example_id", 1, small).filter("_in_sample").count() == 3000
