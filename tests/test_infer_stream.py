import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import infer
from evalspark.plans import jobs
from evalspark.sources import runlog
from evalspark.streaming.score_stream import score_stream


def _write_reviews(path, n=60):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        for i in range(n):
            text = "a terrible boring film" if i % 3 == 0 else "a lovely warm film"
            f.write(json.dumps({"example_id": i, "review": text, "label": 1 if i % 3 == 0 else 0}) + "\n")


def test_score_with_python_predictor(spark):
    df = spark.createDataFrame([(i, "bad movie" if i % 2 else "fine movie", i % 2) for i in range(20)],
                               "example_id long, review string, true_label int")
    out = infer.score(df, jobs.keyword_predictor_factory, keep=("true_label",), partitions=4)
    rows = out.collect()
    assert len(rows) == 20
    assert all(r.label == r.true_label for r in rows)
    assert all(r.input_token_count > 3 and r.elapsed_time >= 0 for r in rows)


def test_params_reach_predictor(spark):
    seen = []

    def factory():
        def predict(prompts: pd.Series, params):
            return pd.DataFrame({"content": [str(params.get("temperature"))] * len(prompts),
                                 "prompt_tokens": [1] * len(prompts), "completion_tokens": [1] * len(prompts)})
        return predict

    df = spark.createDataFrame([(1, "x")], "example_id long, review string")
    r = infer.score(df, factory, params={"temperature": 0.7}).first()
    assert r.output_string == "0.7"


def test_explode_grid(spark):
    grid = infer.parameter_grid(temperature=[0.2, 0.5], top_k=[20, 40, 80])
    df = spark.range(5).withColumnRenamed("id", "example_id")
    out = infer.explode_grid(df, grid)
    assert out.count() == 30 and out.select("run_id").distinct().count() == 6


def test_run_experiment_logs_a_run(spark, tmpdir_path):
    df = spark.createDataFrame([(i, "bad" if i % 2 else "good", i % 2) for i in range(10)],
                               "example_id long, review string, true_label int")
    root = os.path.join(tmpdir_path, "log")
    preds, ev = jobs.run_experiment(spark, df, jobs.keyword_predictor_factory, run_name="kw", model_name="kw-1",
                                    params={"temperature": 0.2}, log_root=root, experiment_id="e1",
                                    description="keyword baseline", experiment_name="keywords-demo")
    assert ev.first().accuracy_score == 1.0
    wide = runlog.search_runs(runlog.read_run_tables(spark, root), tag_keys=["mlflow.runName", "description"]).collect()
    assert len(wide) == 1 and wide[0]["metrics.accuracy_score"] == 1.0 and wide[0]["params.model_name"] == "kw-1"
    assert wide[0]["tags.description"] == "keyword baseline" and wide[0]["tags.mlflow.runName"] == "kw"
    assert runlog.search_runs(runlog.read_run_tables(spark, root), experiment_names=["keywords-demo"]).count() == 1


def test_batch_job(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    _write_reviews(src)
    prompt = os.path.join(tmpdir_path, "prompt.txt")
    with open(prompt, "w") as f:
        f.write("Review: {review}\nAnswer positive or negative.")
    out = os.path.join(tmpdir_path, "out", "preds.jsonl")
    ev = jobs.batch_job(spark, src, out, prompt, jobs.keyword_predictor_factory).first()
    assert ev.accuracy_score == 1.0 and ev.n == 60
    assert spark.read.json(out).count() == 60
    assert spark.read.json(os.path.join(tmpdir_path, "out", "preds_evaluations.json")).count() == 1


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    _write_reviews(src, 45)
    out = os.path.join(tmpdir_path, "stream_out")
    q = score_stream(spark, src, out, os.path.join(tmpdir_path, "ckpt"), jobs.keyword_predictor_factory)
    q.awaitTermination(120)
    streamed = spark.read.parquet(out)
    batch = infer.score(spark.read.json(src).withColumnRenamed("label", "true_label"), jobs.keyword_predictor_factory,
                        keep=("true_label",))
    cols = ["example_id", "true_label", "output_string", "label", "is_hallucination", "is_wrong_format"]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*[F.col(c).cast("long") if c == "true_label" else c for c in cols]).collect())
    assert a == b and len(a) == 45


def test_read_reviews_without_ids(spark, tmpdir_path):
    from evalspark.sources.tables import read_prompt, read_reviews, validate_binary_label

    path = os.path.join(tmpdir_path, "noid.json")
    with open(path, "w") as f:
        for i in range(5):
            f.write(json.dumps({"review": f"r{i}", "label": i % 2}) + "\n")
    df = read_reviews(spark, path)
    ids = [r.example_id for r in df.collect()]
    assert None not in ids and len(set(ids)) == 5
    validate_binary_label(df)
    bad = spark.createDataFrame([(1,), (2,)], "label int")
    with pytest.raises(ValueError):
        validate_binary_label(bad)
    p = os.path.join(tmpdir_path, "p.txt")
    with open(p, "w") as f:
        f.write("line one {review}\nline two\n")
    assert read_prompt(spark, p) == "line one {review}\nline two\n"


def test_sweep_passes_params_and_groups_by_run(spark):
    from evalspark.plans import jobs

    def factory():
        def predict(prompts: pd.Series, params):
            word = "negative" if params.get("top_k", 0) > 30 else "positive"
            return pd.DataFrame({"content": [word] * len(prompts), "prompt_tokens": [3] * len(prompts),
                                 "completion_tokens": [1] * len(prompts)})
        return predict

    df = spark.createDataFrame([(i, f"review {i}", 1 if i < 9 else 0) for i in range(12)],
                               "example_id long, review string, true_label int")
    grid = infer.parameter_grid(top_k=[20, 40])
    # each row's grid parameters reach the predictor: top_k=40 answers negative, top_k=20 positive
    preds, ev = jobs.sweep(df, grid, factory)
    assert preds.count() == 24
    got = {r.run_id: r.accuracy_score for r in ev.collect()}
    assert got == {"top_k=20": 0.25, "top_k=40": 0.75}


def test_validate_unique(spark):
    import pytest

    from evalspark.sources.tables import validate_unique

    validate_unique(spark.createDataFrame([(1,), (2,)], "example_id long"))
    with pytest.raises(ValueError, match="duplicate"):
        validate_unique(spark.createDataFrame([(1,), (1,)], "example_id long"))


def test_read_reviews_fails_on_malformed_line(spark, tmpdir_path):
    import pytest

    from evalspark.sources.tables import read_reviews

    path = os.path.join(tmpdir_path, "bad.json")
    with open(path, "w") as f:
        f.write('{"example_id": 1, "review": "ok", "label": 0}\n{"example_id": 2, "review": broken\n')
    with pytest.raises(Exception):
        read_reviews(spark, path).collect()


def test_system_prompt_reaches_the_predictor_and_null_prompts_do_not(spark):
    def _echo_system():
        def predict(prompts, params):
            assert prompts.notna().all()
            return pd.DataFrame({"content": [params["system_prompt"]] * len(prompts), "prompt_tokens": 1, "completion_tokens": 1})

        return predict

    df = spark.createDataFrame([(1, "good"), (2, None)], "example_id bigint, review string")
    rows = {r["example_id"]: r for r in infer.score(df, _echo_system, system_prompt="positive").collect()}
    assert rows[1]["output_string"] == "positive" and rows[1]["label"] == 0
    assert rows[2]["output_string"] is None and rows[2]["is_wrong_format"] and rows[2]["input_token_count"] == 0
    with pytest.raises(Exception):
        infer.score(df, _echo_system, fields={"review": F.col("review"), "other": F.lit("x")})


def test_ids_on_some_reviews_only_raise(spark, tmp_path):
    from evalspark.sources.tables import read_reviews

    (tmp_path / "some.jsonl").write_text('{"example_id": 1, "review": "a"}\n{"review": "b"}\n')
    (tmp_path / "none.jsonl").write_text('{"review": "a"}\n{"review": "b"}\n')
    with pytest.raises(ValueError):
        read_reviews(spark, str(tmp_path / "some.jsonl"))
    assert read_reviews(spark, str(tmp_path / "none.jsonl")).select("example_id").distinct().count() == 2


@pytest.mark.parametrize("line", ['{"example_id": 1, "review"', '{"review": "no id"}'])
def test_stream_fails_on_bad_lines(spark, tmp_path, line):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line + "\n")
    q = score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), jobs.keyword_predictor_factory)
    with pytest.raises(Exception):
        q.awaitTermination()


def test_no_private_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from evalspark.session import ensure_checkpoint_dir

    conf = {"spark.master": "spark://host:7077"}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)),
                            sparkContext=SimpleNamespace(getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(spark)


def test_table_stream_reads_one_file_and_a_folder_of_files(spark, tmp_path):
    from evalspark.plans.queries import QUERIES

    docs = spark.createDataFrame([(k, f"word {k}", 7) for k in range(50)], "doc_id bigint, text string, n_chars int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 50, 2)], "doc_id bigint, quality int")
    found = []
    for name in ("folder", "file"):
        docs.repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    (tmp_path / "file" / "documents.parquet").rename(tmp_path / "file" / "other")
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for name in ("folder", "file"):
        found.append(sorted(tuple(r) for r in QUERIES["stream_scores"](spark, str(tmp_path / name)).collect()))
    assert len(found[0]) == 25 and found[0] == found[1]


def test_a_predictor_is_asked_in_calls_of_bounded_size(spark):
    most = infer.CALL

    def factory():
        def predict(prompts, params):
            return pd.DataFrame({"content": [str(len(prompts))] * len(prompts), "prompt_tokens": 1, "completion_tokens": 1})

        return predict

    df = spark.range(2 * most + 10).select(F.col("id").alias("example_id"), F.col("id").cast("string").alias("review")).coalesce(1)
    calls = [int(r.output_string) for r in infer.score(df, factory).collect()]
    assert len(calls) == 2 * most + 10 and max(calls) <= most


def test_keys_beside_nulls_come_back_exact(spark):
    """Kept columns do not pass through pandas, where a null made floats of whole numbers."""
    from evalspark.plans.jobs import keyword_predictor_factory

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "bad film", 1), (None, "fine film", None), (7, None, 0)], "example_id bigint, review string, true_label int")
    got = infer.score(df, keyword_predictor_factory, keep=("true_label",)).collect()
    assert {(r.example_id, r.true_label, r.output_string) for r in got} == {(big, 1, "negative"), (None, None, "positive"), (7, 0, None)}
