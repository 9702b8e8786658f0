"""Metrics written in Python, resumable scoring, the atomic run log, row positions and fliers."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import infer, python_metrics, stats
from evalspark.operators.metrics import evaluate
from evalspark.operators.python_metrics import PythonMetric, evaluate_python
from evalspark.plans import jobs
from evalspark.sources import runlog
from evalspark.sources.tables import numbered_lines, read_reviews

MEDIAN = PythonMetric("middle", ("x",), lambda pdf: sorted(pdf["x"].dropna()), lambda a, b: sorted(a + b), lambda s: float(np.median(s)) if s else None)
ROWS = PythonMetric("rows", ("x", "run"), len, lambda a, b: a + b, float)


# ------------------------------------------------------------------ UDF-1


@pytest.mark.parametrize("held", [python_metrics.HELD, 1])
def test_python_metrics_of_a_hot_run(spark, monkeypatch, held):
    monkeypatch.setattr(python_metrics, "HELD", held)
    rng = np.random.default_rng(0)
    rows = [("hot" if k % 3 else (None, "a", "b")[k % 9 // 3], float(rng.normal()) if k % 50 else None, 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "run string, x double, _states int").repartition(16)
    got = {r.run: (r.middle, r.rows) for r in evaluate_python(df, [MEDIAN, ROWS], ["run"]).collect()}
    for run in ("hot", "a", "b", None):
        values = [x for r, x, _ in rows if r == run]
        assert got[run] == (pytest.approx(np.median([x for x in values if x is not None])), len(values))
    assert len(got) == 4


def test_python_metrics_without_rows_or_groups(spark):
    df = spark.createDataFrame([], "run string, x double")
    assert evaluate_python(df, [MEDIAN], ["run"]).collect() == []
    assert [r.middle for r in evaluate_python(df, [MEDIAN]).collect()] == [None]
    some = spark.createDataFrame([("a", 1.0), ("b", 4.0)], "run string, x double")
    assert [(r.rows, r.middle) for r in evaluate_python(some, [ROWS, MEDIAN]).collect()] == [(2.0, 2.5)]
    with pytest.raises(ValueError):
        evaluate_python(some, [ROWS, ROWS])
    with pytest.raises(ValueError):
        evaluate_python(some.drop("x"), [ROWS])


def test_python_metrics_beside_built_in_ones(spark):
    rows = [("a", 0, 0, 1.0), ("a", 1, 0, 3.0), (None, 1, 1, 5.0)]
    df = spark.createDataFrame(rows, "run string, label int, true_label int, x double")
    got = {r.run: r for r in evaluate(df, ["accuracy_score", MEDIAN], by=["run"]).collect()}
    assert (got["a"].accuracy_score, got["a"].middle, got["a"].n) == (0.5, 2.0, 2) and got[None].middle == 5.0
    one = evaluate(df, [ROWS, "accuracy_score"]).first()
    assert one.rows == 3.0 and one.accuracy_score == pytest.approx(2 / 3) and one.n == 3
    assert evaluate(df, [ROWS], with_count=False).columns == ["rows"]
    with pytest.raises(ValueError):
        evaluate(df, [PythonMetric("accuracy_score", ("x",), len, max, float), "accuracy_score"])


# ------------------------------------------------------------------ INF-2, UDF-3


def asking(log: str, fail_after: int | None = None):
    """A predictor that notes each prompt in a file and stops the job after a number of them."""

    def factory():
        def predict(prompts: pd.Series, params) -> pd.DataFrame:
            for p in prompts:
                if fail_after is not None and len(os.listdir(log)) >= fail_after:
                    raise RuntimeError("stopped")
                open(os.path.join(log, f"{hash(p)}-{os.getpid()}-{len(os.listdir(log))}"), "w").write(p)
            return pd.DataFrame({"content": ["positive"] * len(prompts), "prompt_tokens": [1] * len(prompts), "completion_tokens": [1] * len(prompts)})

        return predict

    return factory


def test_a_stopped_job_goes_on_where_it_stopped(spark, tmp_path):
    log, out = tmp_path / "asked", str(tmp_path / "out")
    log.mkdir()
    df = spark.createDataFrame([(k, f"review {k}") for k in range(40)], "example_id long, review string").coalesce(1)
    with pytest.raises(Exception):
        infer.score_resumable(df, asking(str(log), 25), out, template="{review}", chunks=40)
    done = spark.read.parquet(out).count()
    assert 0 < done <= 25
    got = infer.score_resumable(df, asking(str(log)), out, template="{review}", chunks=7)
    assert sorted(r.example_id for r in got.collect()) == list(range(40))
    asked = sorted(open(f).read() for f in log.iterdir())
    assert asked == sorted(f"review {k}" for k in range(40))  # each prompt once in all
    again = infer.score_resumable(df.limit(10), asking(str(log), 0), out, template="{review}")  # asks nothing
    assert again.count() == 10
    assert infer.score_resumable(df.limit(0), asking(str(log), 0), str(tmp_path / "none"), template="{review}").collect() == []


def test_prompt_builder(spark):
    df = spark.createDataFrame([(1, "bad film", "en")], "example_id long, review string, lang string")
    got = infer.score(df, jobs.keyword_predictor_factory, lambda d: F.concat("lang", F.lit(": "), "review")).first()
    assert (got.label, got.input_token_count) == (1, 3)
    with pytest.raises(ValueError):
        infer.score(df, jobs.keyword_predictor_factory, lambda d: F.col("review"), fields={"review": "review"})


# ------------------------------------------------------------------ SNK-4


def tables(spark, run: str, value: float):
    key = "experiment_id string, run_id string, key string, "
    return (
        spark.createDataFrame([("1", run, run, "active", 3, 1, 2)], "experiment_id string, run_id string, run_name string, lifecycle_stage string, status int, start_time bigint, end_time bigint"),
        spark.createDataFrame([("1", run, "accuracy_score", value, 0, 1)], key + "value double, step bigint, timestamp bigint"),
        spark.createDataFrame([("1", run, "top_k", "40")], key + "value string"),
        spark.createDataFrame([("1", run, "mlflow.runName", run)], key + "value string"),
    )


def test_a_write_that_was_killed_leaves_nothing_and_its_retry_each_fact_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    assert runlog.read_run_tables(spark, root) == {}
    assert runlog.log_runs(root, *tables(spark, "r1", 0.5), commit_id="one")
    t = tables(spark, "r2", 0.75)

    class Killed(Exception):
        pass

    for stop in ("params", "metrics", "runs", "commits"):  # killed before each of the tables

        real, at = os.path.join, stop

        def join(*parts, real=real, at=at):
            if parts[-1] == at:
                raise Killed
            return real(*parts)

        with monkeypatch.context() as m:
            commits = runlog._commits(spark, root)
            m.setattr(runlog, "_commits", lambda *a, commits=commits: commits)
            m.setattr(runlog.os.path, "join", join)
            with pytest.raises(Killed):
                runlog.log_runs(root, *t, commit_id="two")
        seen = runlog.read_run_tables(spark, root)
        assert all(seen[k].count() == 1 for k in ("runs", "metrics", "params", "tags"))
    assert runlog.log_runs(root, *t, commit_id="two")
    assert not runlog.log_runs(root, *t, commit_id="two")
    seen = runlog.read_run_tables(spark, root)
    assert all(sorted(r.run_id for r in seen[k].collect()) == ["r1", "r2"] for k in ("runs", "metrics", "params", "tags"))
    found = {r["run_id"]: r["metrics.accuracy_score"] for r in runlog.search_runs(seen).collect()}
    assert found == {"r1": 0.5, "r2": 0.75}


def test_tables_without_attempts_are_read_as_they_are(spark, tmp_path):
    root = str(tmp_path / "log")
    for name, df in zip(("runs", "metrics", "params", "tags"), tables(spark, "old", 0.1)):
        df.write.partitionBy("experiment_id").parquet(os.path.join(root, name))
    runlog.log_runs(root, *tables(spark, "new", 0.2))
    seen = runlog.read_run_tables(spark, root)
    assert sorted(r.run_id for r in seen["metrics"].collect()) == ["new", "old"]


# ------------------------------------------------------------------ SRC-1


@pytest.mark.parametrize("size", ["64", "1000", "134217728"])
def test_row_positions_do_not_depend_on_splits(spark, tmp_path, size):
    want = []
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        lines = [f'{{"review": "{name} {k} {"x" * (k % 40)}", "label": {k % 2}}}' for k in range(57)]
        (tmp_path / name).write_text("\n".join(lines[:20]) + "\n\n  \n" + "\n".join(lines[20:]) + ("\n" if name != "c.jsonl" else ""))
        want.append((name, [f'{name} {k} {"x" * (k % 40)}' for k in range(57)]))
    want = [x for _, xs in sorted(want) for x in xs]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {r.example_id: r.review for r in read_reviews(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(want))


def test_row_positions_of_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("\n\n")
    assert numbered_lines(spark, str(tmp_path)).collect() == []


# ------------------------------------------------------------------ AGG-19


def test_fliers_are_the_points_beyond_the_whiskers(spark):
    rows = [("a", k, float(k)) for k in range(20)] + [("a", 90, 90.0), ("a", 91, -50.0), ("a", 92, None), ("a", 93, float("nan")), ("b", 1, 5.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    for mode in ("map", "distributed"):
        got = sorted((r.g, r.id, r.x) for r in stats.boxplot_fliers(df, "g", "x", ["id"], mode=mode).collect())
        assert got == [("a", 90, 90.0), ("a", 91, -50.0)]
    assert {r.g: r.n_fliers for r in stats.boxplot_table(df, "g", "x").collect()}["a"] == 2
