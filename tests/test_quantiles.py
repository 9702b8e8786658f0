import pytest
from pyspark.sql import functions as F

from evalspark.operators.metrics import MetricInputs, evaluate
from evalspark.operators.quantiles import distributed_median


@pytest.mark.parametrize("buckets,cell_limit", [(4, 3), (16, 50), (1 << 16, 100_000)])
def test_distributed_median_equals_spark_median(spark, buckets, cell_limit):
    df = spark.range(2001).select(
        (F.col("id") % 3).cast("string").alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(5.0)).otherwise(F.pow(F.col("id") * 1.37 % 97, 1.5)).alias("v"),
    ).union(spark.createDataFrame([("3", 1.0), ("4", None), ("5", float("nan")), ("5", 2.0), ("5", 4.0)], "g string, v double"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median(F.nanvl("v", F.lit(None).cast("double"))).alias("m")).collect()}
    got = {r.g: r.median for r in distributed_median(df, "v", ["g"], buckets=buckets, cell_limit=cell_limit).collect()}
    assert got == want


def test_distributed_median_ungrouped(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 3]], "v double")
    assert distributed_median(df, "v", buckets=2, cell_limit=1).first().median == 3.0


def test_evaluate_distributed_mode_matches_map_mode(spark):
    from evalspark.plans.queries import stub_predictions

    p = stub_predictions(spark, "/root/testdata/sf0.01")
    a = {r.source: r.asDict() for r in evaluate(p, by=["source"]).collect()}
    b = {r.source: r.asDict() for r in evaluate(p, by=["source"], inputs=MetricInputs(median_mode="distributed")).collect()}
    assert a == b
    one = evaluate(p, inputs=MetricInputs(median_mode="distributed")).first().asDict()
    assert one == evaluate(p).first().asDict()


@pytest.mark.parametrize("buckets,cell_limit", [(3, 2), (1 << 16, 100_000)])
def test_distributed_quantiles_equal_percentile(spark, buckets, cell_limit):
    from evalspark.operators.quantiles import distributed_quantiles

    df = spark.range(777).select((F.col("id") % 4).alias("g"), (F.sin(F.col("id")) * 10).alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {r.g: [float(x) for x in r.q] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = {r.g: [r[f"p{i}"] for i in range(len(probs))]
           for r in distributed_quantiles(df, "v", ["g"], probs, [f"p{i}" for i in range(len(probs))],
                                          buckets=buckets, cell_limit=cell_limit).collect()}
    assert got == want


@pytest.mark.parametrize("buckets,cell_limit", [(4, 2), (1 << 16, 100_000)])
def test_distributed_quantiles_with_infinities(spark, buckets, cell_limit):
    from evalspark.operators.quantiles import distributed_quantiles

    inf = float("inf")
    rows = [("a", v) for v in [1.0, 2.0, 3.0, inf, inf, -inf, 5.0, 7.0, 11.0]] + \
           [("b", v) for v in [inf, inf, inf]] + [("c", v) for v in [-inf, 0.5, 0.25, 0.75, 100.0, 1e300, -1e300]]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    want = {r.g: [float(x) for x in r.q] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = {r.g: [r[n] for n in names] for r in distributed_quantiles(
        df, "v", ["g"], probs, names, buckets=buckets, cell_limit=cell_limit).collect()}
    assert got == want


def test_evaluate_forced_refinement_matches_map_mode(spark):
    from evalspark.plans.queries import stub_predictions

    p = stub_predictions(spark, "/root/testdata/sf0.01")
    a = {r.source: r.asDict() for r in evaluate(p, by=["source"], inputs=MetricInputs(median_mode="map")).collect()}
    forced = MetricInputs(median_mode="distributed", cell_limit=5)
    b = {r.source: r.asDict() for r in evaluate(p, by=["source"], inputs=forced).collect()}
    assert a == b


def test_group_of_only_infinities_with_refinement(spark):
    from evalspark.operators.quantiles import distributed_quantiles

    inf = float("inf")
    df = spark.createDataFrame([("z", v) for v in [-inf, inf, inf, -inf, inf]] + [("y", 1.0), ("y", 2.0), ("y", 3.0)],
                               "g string, v double")
    probs = [0.0, 0.5, 1.0]
    want = {r.g: [float(x) for x in r.q] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    got = {r.g: [r.a, r.b, r.c] for r in distributed_quantiles(df, "v", ["g"], probs, ["a", "b", "c"],
                                                               buckets=4, cell_limit=1).collect()}
    assert got == want
