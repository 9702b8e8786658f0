"""A run log derived from the driver tables, and the run-log queries over it.

One run per ``documents.source`` (its metrics = the stub evaluation of that source), model by the
parity of the source number. Roles by source number: 0-15 comparable prompt runs (8 prompts x 2
models), 14-15 non-default temperature, 16-17 grid-search names, 18 a full-data run, 19 deleted,
12 logged no metrics, 11 logged precision as NaN, 10 logged an older accuracy that a later value
replaces; one orphan run has metrics but no run record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.metrics import METRIC_NAMES, evaluate
from evalspark.sources import runlog

EXPERIMENT = "1"
T0 = 1_700_000_000_000


def _runs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.queries import stub_predictions

    ev = evaluate(stub_predictions(spark, sf_dir), by=["source"])
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return ev.withColumn("_n", n).withColumn("run_id", F.md5(F.concat(F.lit("run:"), F.col("source"))))


def derived_run_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from evalspark.session import materialize

    base = materialize(_runs_base(spark, sf_dir))  # one row per run, read by every table below
    nn = F.col("_n")
    run_name = (
        F.when(nn < 16, F.concat(F.lit("prompt-"), (nn / 2).cast("int").cast("string")))
        .when(nn < 18, F.concat(F.lit("grid-t0."), (nn - 11).cast("string"), F.lit("-k40")))
        .when(nn == 18, F.lit("prompt-0 FULL_DATA"))
        .otherwise(F.lit("prompt-deleted"))
    )
    base = base.withColumn("run_name", run_name).withColumn("experiment_id", F.lit(EXPERIMENT))
    runs = base.select(
        "experiment_id",
        "run_id",
        "run_name",
        F.when(nn == 19, "deleted").otherwise("active").alias("lifecycle_stage"),
        F.lit(3).alias("status"),
        F.lit(T0).cast("bigint").alias("start_time"),
        (F.lit(T0) + nn * 1000).cast("bigint").alias("end_time"),
    )
    long = base.filter(nn != 12).unpivot(["experiment_id", "run_id", "_n"], METRIC_NAMES, "key", "value")
    value = F.when((F.col("_n") == 11) & (F.col("key") == "precision"), F.lit(float("nan"))).otherwise(F.col("value"))
    metrics = long.select(
        "experiment_id", "run_id", "key", value.alias("value"), F.lit(0).cast("bigint").alias("step"),
        (F.lit(T0) + F.col("_n") * 1000).cast("bigint").alias("timestamp"),
    )
    stale = long.filter((F.col("_n") == 10) & (F.col("key") == "accuracy_score")).select(
        "experiment_id", "run_id", "key", F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("step"),
        F.lit(T0).cast("bigint").alias("timestamp"),
    )
    orphan = long.filter(F.col("_n") == 0).join(base.select("run_id", "source"), "run_id").select(
        "experiment_id", F.md5(F.concat(F.lit("run:orphan-"), F.col("source"))).alias("run_id"), "key", "value",
        F.lit(0).cast("bigint").alias("step"), F.lit(T0).cast("bigint").alias("timestamp"),
    )
    metrics = metrics.unionByName(stale).unionByName(orphan)
    model = F.when(nn % 2 == 0, "model-a").otherwise("model-b")
    temperature = F.when(nn.isin(14, 15), "0.7").otherwise("0.2")
    params = base.select(
        "experiment_id", "run_id",
        F.explode(F.array(
            F.struct(F.lit("model_name").alias("key"), model.alias("value")),
            F.struct(F.lit("temperature").alias("key"), temperature.alias("value")),
            F.struct(F.lit("top_k").alias("key"), F.lit("40").alias("value")),
            F.struct(F.lit("top_p").alias("key"), F.lit("0.95").alias("value")),
        )).alias("p"),
    ).select("experiment_id", "run_id", "p.*")
    tags = base.select(
        "experiment_id", "run_id",
        F.explode(F.array(
            F.struct(F.lit("mlflow.runName").alias("key"), F.col("run_name").alias("value")),
            F.struct(F.lit("justification").alias("key"), F.concat(F.lit("derived from "), F.col("source")).alias("value")),
        )).alias("t"),
    ).select("experiment_id", "run_id", "t.*")
    return {"runs": runs, "metrics": metrics, "params": params, "tags": tags}


def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide run frame, checkpointed: one row per run, read by several passes downstream."""
    from evalspark.session import materialize

    keys = {"metric_keys": METRIC_NAMES, "param_keys": runlog.PARAM_KEYS, "tag_keys": runlog.TAG_KEYS}
    return materialize(runlog.cast_run_columns(runlog.search_runs(derived_run_tables(spark, sf_dir), **keys)))


def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.comparable_runs(wide_runs(spark, sf_dir))


LINE_COLS = ["metrics.precision", "metrics.recall", "metrics.bad_output_format_rate", "metrics.hallucination_rate"]
BAR_COLS = ["metrics.accuracy_score"]
PAIR_COLS = [
    "metrics.precision",
    "metrics.recall",
    "metrics.median_query_token_count",
    "metrics.median_response_token_count",
    "metrics.hallucination_rate",
    "metrics.bad_output_format_rate",
]
