"""Queries over sources, sinks and jobs: each writes the driver tables in the job's own format into the shared folder,
runs the job there and returns what it reads back."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import infer
from evalspark.operators.metrics import attach_truth, evaluate
from evalspark.operators.python_metrics import PythonMetric
from evalspark.plans import jobs
from evalspark.plans.queries import SAMPLE_SEED, register, stub_predictions
from evalspark.session import materialize, new_scratch
from evalspark.sources import runlog, sinks
from evalspark.sources.tables import (
    REVIEW_SCHEMA,
    corpus_docs,
    labelled_corpus,
    read_prompt,
    read_reviews,
    truth_table,
    validate_binary_label,
    validate_columns,
)

LONG_ANSWER = 100  # tokens in all, of the example metric


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_corpus(spark, sf_dir, ()).select("example_id", "review", F.col("true_label").alias("label"))


def _prompt_file(spark: SparkSession, base: str) -> str:
    path = os.path.join(base, "prompt")
    spark.createDataFrame([(infer.DEFAULT_TEMPLATE,)], "value string").coalesce(1).write.text(path)  # ends in a line feed
    return path


# ------------------------------------------------------------------ sources and sinks


@register("sample_file")
def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, SRC-1, SRC-3, SRC-4: labelled reviews written as JSON lines in the seeded order, read without ids: a row's id is its
    position in that order."""
    path = os.path.join(new_scratch(spark), "sample.jsonl")
    sinks.write_sample(_reviews(spark, sf_dir), path, seed=SAMPLE_SEED)
    back = read_reviews(spark, path)
    validate_columns(back, ["review", "label"])
    validate_binary_label(back)
    return back.select("example_id", F.md5("review").alias("review_md5"), "label")


@register("prompt_file")
def prompt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, PRJ-1: a template read from its file, over the content columns it names."""
    template = read_prompt(spark, _prompt_file(spark, new_scratch(spark)))
    content = infer.select_content(corpus_docs(spark, sf_dir), template)
    from evalspark.functions.text import render_prompt

    return content.select("example_id", F.md5(render_prompt(template, {})).alias("prompt_md5"))


@register("first_reviews")
def first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-2: the first rows by id (a top-k report)."""
    return _reviews(spark, sf_dir).orderBy("example_id").limit(10).select("example_id", "label", F.length("review").alias("n_chars"))


@register("shuffled_positions")
def shuffled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-3 as an order: the position of each labelled example in the seeded shuffle."""
    from evalspark.operators.sampling import order_key
    from evalspark.operators.vocabulary import dense_ids

    rows = truth_table(spark, sf_dir).select("example_id", order_key("example_id", SAMPLE_SEED).alias("k"))
    return dense_ids(rows, ["k", "example_id"], "position").select("example_id", "position")


@register("attached_truth")
def attached_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14, PRJ-17: predictions with their truth by key, both named."""
    from evalspark.functions.parse import label_name

    scored = infer.score_stub(corpus_docs(spark, sf_dir), fields={"review": F.col("review")}, keep=())
    both = attach_truth(scored.select("example_id", "label"), truth_table(spark, sf_dir))
    return both.select("example_id", "label", "true_label", label_name("label").alias("label_name"), label_name("true_label").alias("true_name"))


# ------------------------------------------------------------------ jobs


def _batch(spark: SparkSession, sf_dir: str) -> str:
    base = new_scratch(spark)
    source, out = os.path.join(base, "reviews.jsonl"), os.path.join(base, "preds.jsonl")
    _reviews(spark, sf_dir).write.json(source)
    jobs.batch_job(spark, source, out, _prompt_file(spark, base), jobs.keyword_predictor_factory)
    return out


@register("batch_predictions")
def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-4, SNK-1: the batch job from file to file; its predictions as read back (without the measured time)."""
    schema = ("example_id bigint, output_string string, label int, is_hallucination boolean, is_wrong_format boolean, "
              "input_token_count bigint, output_token_count bigint")
    return spark.read.schema(schema).json(_batch(spark, sf_dir))


@register("batch_evaluation")
def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-4, SNK-2: the evaluation that the batch job writes beside its predictions (metrics that do not measure time)."""
    names = [m for m in COUNTED if m != "n"]
    schema = ", ".join([*(f"{m} double" for m in names), "n bigint"])
    return spark.read.schema(schema).json(sinks.evaluation_path(_batch(spark, sf_dir)))


#: The metrics of a run that do not measure time, and the number of rows.
COUNTED = ["accuracy_score", "precision", "recall", "false_negative_rate", "false_positive_rate", "median_response_token_count",
           "median_query_token_count", "hallucination_rate", "bad_output_format_rate", "n"]


@register("experiment_log")
def experiment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-3, SNK-4, SRC-6: a tracked experiment, as its run is found in the run log."""
    root = new_scratch(spark)
    jobs.run_experiment(spark, labelled_corpus(spark, sf_dir, ()), jobs.keyword_predictor_factory, run_name="keywords", model_name="cues",
                        params={"temperature": 0.2, "top_k": 40}, log_root=root)
    found = runlog.search_runs(runlog.read_run_tables(spark, root))
    cols = [F.col(f"`metrics.{m}`").alias(m) for m in COUNTED if m != "n"]
    return found.select(F.col("`params.model_name`").alias("model"), F.col("`params.top_k`").alias("top_k"), F.col("`tags.mlflow.runName`").alias("name"), *cols)


@register("file_store_search")
def file_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5, SRC-6: the run log written as a file-store tree, scanned and searched."""
    from evalspark.operators.metrics import METRIC_NAMES
    from evalspark.plans.runs import derived_run_tables

    root = new_scratch(spark)
    runlog.write_file_store(root, {k: materialize(v) for k, v in derived_run_tables(spark, sf_dir).items()})
    keys = {"metric_keys": METRIC_NAMES, "param_keys": runlog.PARAM_KEYS, "tag_keys": runlog.TAG_KEYS}
    return runlog.cast_run_columns(runlog.search_runs(runlog.read_file_store(spark, root), **keys))


@register("run_log_retry")
def run_log_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4: the run log after a write that stopped half way, its retry, and a repeated call: each fact once."""
    from evalspark.operators.metrics import METRIC_NAMES
    from evalspark.plans.runs import derived_run_tables

    root, t = new_scratch(spark), derived_run_tables(spark, sf_dir)
    t = {k: materialize(v) for k, v in t.items()}
    stopped = t["metrics"].withColumn("attempt", F.lit("stopped"))  # as an attempt leaves them that got no further
    stopped.write.mode("append").partitionBy("experiment_id").parquet(os.path.join(root, "metrics"))
    for _ in range(2):
        runlog.log_runs(root, t["runs"], t["metrics"], t["params"], t["tags"], commit_id="load-1")
    tables = runlog.read_run_tables(spark, root)
    facts = [tables[k].select(F.lit(k).alias("kind"), "run_id", "key") for k in ("metrics", "params", "tags")]
    rows = facts[0].unionByName(facts[1]).unionByName(facts[2]).filter(F.col("key").isin(*METRIC_NAMES, *runlog.PARAM_KEYS, *runlog.TAG_KEYS))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("facts"), F.countDistinct("run_id").alias("runs"))


@register("resumed_scores")
def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-2: scoring that was stopped after a part of the corpus (one class) and started again; the rows of both."""
    corpus, path = materialize(labelled_corpus(spark, sf_dir, ())), new_scratch(spark)
    kw = {"keep": ("true_label",)}
    infer.score_resumable(corpus.filter("true_label = 0"), jobs.keyword_predictor_factory, path, chunks=2, **kw)
    return infer.score_resumable(corpus, jobs.keyword_predictor_factory, path, chunks=3, **kw).drop("elapsed_time")


@register("json_stream_scores")
def json_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: reviews arriving as JSON files, scored by a Python predictor in a stream (measured time left out)."""
    from evalspark.streaming.score_stream import score_stream

    base = new_scratch(spark)
    source, out = os.path.join(base, "in"), os.path.join(base, "out")
    _reviews(spark, sf_dir).select(*REVIEW_SCHEMA.names).repartition(4, "example_id").write.json(source)
    q = score_stream(spark, source, out, os.path.join(base, "checkpoint"), jobs.keyword_predictor_factory, max_files_per_trigger=2)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    return spark.read.parquet(out).drop("elapsed_time")


SWEEP = infer.parameter_grid(temperature=[0.2, 0.8], top_k=[20, 40])
CUES = ("bad", "worst", "terrible", "boring", "awful")


def tempered_predictor_factory():
    """A predictor whose answers depend on its parameters: it looks for negative cue words at low temperatures only."""

    def predict(prompts: pd.Series, params) -> pd.DataFrame:
        cold = params["temperature"] < 0.5
        content = prompts.str.lower().apply(lambda s: "negative" if cold and any(c in s for c in CUES) else "positive")
        return pd.DataFrame({"content": content, "prompt_tokens": prompts.str.split().str.len().astype("int64") + params["top_k"], "completion_tokens": 1})

    return predict


@register("sweep_runs")
def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-5: a sweep over a parameter grid with a Python predictor that gets each row's parameters."""
    _, evaluation = jobs.sweep(labelled_corpus(spark, sf_dir, ()), SWEEP, tempered_predictor_factory)
    return evaluation.select("run_id", "temperature", "top_k", *COUNTED)


@register("best_score")
def best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-6: the choice of the best of many numbered scores, the smallest number on ties (here the share of good documents of each
    source, in steps of a tenth)."""
    from evalspark.operators.topics import best_k
    from evalspark.sources.tables import table

    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    scores = rows.groupBy(number.alias("k")).agg(F.floor(F.avg("quality") * 10).cast("double").alias("silhouette"))
    return best_k(scores)


# ------------------------------------------------------------------ extension points


def _long_answers(pdf: pd.DataFrame) -> tuple[int, int]:
    long = (pdf["input_token_count"] + pdf["output_token_count"]) > LONG_ANSWER
    return int(long.sum()), int((long & (pdf["label"] != pdf["true_label"])).sum())


def _slowest(pdf: pd.DataFrame) -> float | None:
    top = pdf["elapsed_time"].max()
    return None if pd.isna(top) else float(top)


#: Examples of metrics over tokens and time.
PYTHON_METRICS = (
    PythonMetric("long_error_rate", ("input_token_count", "output_token_count", "label", "true_label"), _long_answers,
                 lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None),
    PythonMetric("slowest", ("elapsed_time",), _slowest, lambda a, b: max((x for x in (a, b) if x is not None), default=None), lambda s: s),
)


@register("python_metrics")
def python_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-1: metrics written in Python beside built-in ones, per source."""
    return evaluate(stub_predictions(spark, sf_dir), ["accuracy_score", *PYTHON_METRICS], by=["source"])


@register("built_prompts")
def built_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-3: a prompt builder (a function from the frame to a Column) in place of a template."""

    def build(df: DataFrame):
        return F.concat(F.lit("["), F.upper("lang"), F.lit("] "), "review")

    scored = infer.score(labelled_corpus(spark, sf_dir), jobs.keyword_predictor_factory, build)
    return scored.select("example_id", "output_string", "input_token_count")


@register("boxplot_fliers")
def boxplot_fliers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: documents whose length lies beyond the whiskers of their language."""
    from evalspark.operators.stats import boxplot_fliers

    docs = corpus_docs(spark, sf_dir).select("example_id", "lang", "n_chars")
    return boxplot_fliers(docs, "lang", "n_chars", ["example_id"])
