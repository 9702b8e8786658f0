import math

import pytest
from pyspark.sql import functions as F

from evalspark.operators.metrics import (
    METRICS,
    MetricInputs,
    alignment_report,
    assert_aligned,
    evaluate,
    metric,
    resolve,
)


def preds(spark, truth, pred, flags=None):
    rows = []
    for i, (y, p) in enumerate(zip(truth, pred)):
        h = p == -1 and (flags or {}).get(i) == "h"
        w = p == -1 and not h
        rows.append((i, y, p, h, w, 10 + i, 1, 0.5 + i))
    return spark.createDataFrame(
        rows,
        "example_id long, true_label int, label int, is_hallucination boolean, is_wrong_format boolean, "
        "input_token_count long, output_token_count long, elapsed_time double",
    )


def test_fixture_metrics(spark):
    r = evaluate(preds(spark, [0, 0, 1, 1, 0], [0, -1, 0, 1, 0])).first()
    assert r.accuracy_score == pytest.approx(3 / 5)
    assert r.precision == pytest.approx(2 / 3)
    assert r.recall == pytest.approx(2 / 3)
    assert r.false_negative_rate == pytest.approx(1 / 3)
    assert r.false_positive_rate == pytest.approx(1 / 2)
    assert r.median_query_token_count == 12.0
    assert r.median_tokens_per_second == pytest.approx(2 / (2.5 + 1e-9))
    assert r.n == 5


def test_undefined_precision_is_null(spark):
    r = evaluate(preds(spark, [0, 1], [1, 1])).first()
    assert r.precision is None and r.recall == 0.0


def test_grouped_evaluation_matches_per_group(spark):
    df = preds(spark, [0, 1, 0, 1, 1, 0], [0, 1, 1, 1, -1, 0]).withColumn("run_id", (F.col("example_id") % 2).cast("string"))
    by = {r.run_id: r for r in evaluate(df, by=["run_id"]).collect()}
    for rid in ("0", "1"):
        single = evaluate(df.filter(F.col("run_id") == rid)).first()
        assert by[rid].accuracy_score == single.accuracy_score


def test_median_ignores_nan_and_approx_mode(spark):
    df = preds(spark, [0, 0, 0], [0, 0, 0]).withColumn(
        "elapsed_time", F.when(F.col("example_id") == 2, F.lit(float("nan"))).otherwise(F.col("elapsed_time")))
    r = evaluate(df, ["median_processing_time"]).first()
    assert r.median_processing_time == pytest.approx(1.0)
    r2 = evaluate(df, ["median_query_token_count"], inputs=MetricInputs(exact=False)).first()
    assert r2.median_query_token_count in (10.0, 11.0, 12.0)


def test_user_metric_and_duplicates(spark):
    m = metric("n_negative_truth", lambda y, p: F.count_if(y == 1))
    r = evaluate(preds(spark, [0, 1, 1], [0, 0, 0]), [m, "accuracy_score"]).first()
    assert r.n_negative_truth == 2
    with pytest.raises(ValueError):
        resolve(["accuracy_score", METRICS["accuracy_score"]])


def test_alignment(spark):
    p = spark.createDataFrame([(1,), (2,)], "example_id long")
    t = spark.createDataFrame([(2,), (3,)], "example_id long")
    r = alignment_report(p, t).first()
    assert (r.predictions_without_truth, r.truth_without_prediction) == (1, 1)
    with pytest.raises(ValueError):
        assert_aligned(p, t)


def test_known_stub_figures_sf001(spark):
    from evalspark.plans.queries import QUERIES

    r = QUERIES["eval_metrics"](spark, "/root/testdata/sf0.01").first()
    assert r.n == 399
    assert round(r.accuracy_score, 4) == 0.2456
    assert round(r.precision, 4) == 0.8571
    assert round(r.recall, 4) == 0.2463
    assert round(r.hallucination_rate, 4) == 0.3810
    assert round(r.bad_output_format_rate, 4) == 0.0952
    assert math.isclose(r.false_negative_rate, 1 - r.recall)
    assert abs(r.accuracy_score * r.n - round(r.accuracy_score * r.n)) < 1e-9


def test_materialize_and_drop_scratch(spark):
    import os

    from evalspark import session

    df = spark.range(10).withColumnRenamed("id", "x")
    before = len(session._CREATED)
    m = session.materialize(df)
    path = session._CREATED[-1]
    assert m.count() == 10 and os.path.exists(path) and len(session._CREATED) == before + 1
    assert session.drop_scratch(spark) >= 1
    assert not os.path.exists(path) and session._CREATED == []


def test_median_overrides(spark):
    df = preds(spark, [0, 0, 0, 1], [0, 0, 1, 1])
    exact = evaluate(df).first()
    mixed = evaluate(df, inputs=MetricInputs(median_overrides=(("median_processing_time", "approx"),
                                                                ("median_query_token_count", "distributed")))).first()
    assert mixed.median_query_token_count == exact.median_query_token_count == 11.5
    assert mixed.median_processing_time in (1.5, 2.5)  # approx returns an observed value
    assert mixed.accuracy_score == exact.accuracy_score
    with pytest.raises(ValueError):
        evaluate(df, inputs=MetricInputs(median_overrides=(("median_processing_time", "bogus"),)))


def test_scratch_scope_drops_only_its_tables(spark):
    import os

    from evalspark import session

    keep = session.materialize(spark.range(3))
    kept_path = session._CREATED[-1]
    with session.scratch_scope(spark):
        inner = session.materialize(spark.range(5))
        inner_path = session._CREATED[-1]
        assert inner.count() == 5
    assert not os.path.exists(inner_path) and os.path.exists(kept_path)
    assert keep.count() == 3
    session.drop_scratch(spark)
