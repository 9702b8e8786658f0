"""STR-1: score reviews as they arrive (Structured Streaming).

``readStream`` of JSONL files -> the same stateless render/predict/parse plan as the batch job ->
file sink with a checkpoint (exactly-once file output). ``availableNow`` processes the backlog in
bounded micro-batches and stops. Metrics are computed in batch over the sink (exact medians are not a
streaming aggregate).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators import infer
from evalspark.operators.infer import PREDICTION_COLUMNS
from evalspark.sources.tables import REVIEW_SCHEMA


def score_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    predictor_factory: Callable,
    template: str = infer.DEFAULT_TEMPLATE,
    max_files_per_trigger: int = 100,
    fmt: str = "parquet",
) -> StreamingQuery:
    """A malformed line or a review without ``example_id`` fails the query, as in the batch job."""
    stream = (
        spark.readStream.schema(REVIEW_SCHEMA)
        .option("mode", "FAILFAST")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(in_dir)
    )
    known = F.coalesce(F.col("example_id"), F.raise_error(F.lit("review without example_id")).cast("bigint"))
    stream = stream.withColumn("example_id", known).withColumnRenamed("label", "true_label")
    scored = infer.score(stream, predictor_factory, template, keys=("example_id",), keep=("true_label",))
    out = scored.select("example_id", "true_label", *PREDICTION_COLUMNS)
    return (
        out.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .option("path", out_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_table_stream(spark: SparkSession, sf_dir: str, out_dir: str, checkpoint: str,
                       files_per_trigger: int = 100) -> StreamingQuery:
    """The stub scoring plan over ``documents`` (one file or a folder of files) read as a file stream, joined to the
    static ``labels`` table (stream-static inner join on the narrow scored rows), written to a parquet sink with a
    checkpoint. Every micro-batch reads the static side again, so it takes many files."""
    from evalspark.sources.tables import table

    docs = (
        spark.readStream.schema(table(spark, sf_dir, "documents").schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(os.path.join(sf_dir, "documents.parque[t]"))  # a pattern: a plain path would have to be a folder
    )
    from evalspark.sources.tables import truth_table

    corpus = docs.select(F.col("doc_id").alias("example_id"), F.col("text").alias("review"), "n_chars")
    scored = infer.score_stub(corpus, fields={"review": F.col("review")}, keep=()).join(
        truth_table(spark, sf_dir), "example_id")
    return (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
