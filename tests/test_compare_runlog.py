import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators import compare
from evalspark.operators.compare import paired_comparison, with_required_n
from evalspark.sources import runlog


@pytest.mark.parametrize("few", [8, 0])
def test_paired_comparison_equals_self_join(spark, monkeypatch, few):
    monkeypatch.setattr(compare, "FEW", few)
    rows = [(r, e, (e * (i + 2)) % 3 == 0 and 1 or 0) for i, r in enumerate(["a", "b", "c"]) for e in range(40)]
    rows = [x for x in rows if not (x[0] == "c" and x[1] < 5)]  # run c skipped some examples
    df = spark.createDataFrame(rows, "run_id string, example_id long, ok int")
    got = {(r.run_a, r.run_b): r for r in paired_comparison(df, ["a", "b", "c"]).collect()}
    a, b = df.alias("a"), df.alias("b")
    ref = (
        a.join(b, (F.col("a.example_id") == F.col("b.example_id")) & (F.col("a.run_id") < F.col("b.run_id")))
        .groupBy(F.col("a.run_id").alias("ra"), F.col("b.run_id").alias("rb"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a.ok") == 1) & (F.col("b.ok") == 0)).alias("ab"))
        .collect()
    )
    assert len(ref) == len(got) == 3
    for r in ref:
        g = got[(r.ra, r.rb)]
        assert g.n == r.n and abs(g.p_a_not_b - r.ab / r.n) < 1e-12
    req = with_required_n(paired_comparison(df, ["a", "b", "c"])).collect()
    assert all(r.required_n >= 0 for r in req)


def _write_store(root):
    exp = os.path.join(root, "123")
    os.makedirs(exp)
    with open(os.path.join(exp, "meta.yaml"), "w") as f:
        f.write("experiment_id: '123'\nlifecycle_stage: active\nname: demo\n")
    runs = {
        "r1": ("active", {"accuracy_score": ["1 0.5 0", "2 0.7 0"], "precision": ["1 nan 0"]},
               {"model_name": "m-a", "temperature": "0.2", "top_k": "40", "top_p": "0.95"}, "base"),
        "r2": ("active", {"accuracy_score": ["1 0.8 0"]},
               {"model_name": "m-b", "temperature": "0.2", "top_k": "40", "top_p": "0.95"}, "base"),
        "r3": ("deleted", {"accuracy_score": ["1 0.1 0"]}, {"model_name": "m-a"}, "old"),
    }
    for rid, (stage, metrics, params, name) in runs.items():
        d = os.path.join(exp, rid)
        for sub in ("metrics", "params", "tags", "artifacts"):
            os.makedirs(os.path.join(d, sub))
        with open(os.path.join(d, "meta.yaml"), "w") as f:
            f.write(f"experiment_id: '123'\nlifecycle_stage: {stage}\nrun_id: {rid}\nrun_name: {name}\n"
                    f"run_uuid: {rid}\nstart_time: 1000\nend_time: 2000\nstatus: 3\n")
        for k, lines in metrics.items():
            with open(os.path.join(d, "metrics", k), "w") as f:
                f.write("\n".join(lines) + "\n")
        for k, v in params.items():
            with open(os.path.join(d, "params", k), "w") as f:
                f.write(v)
        with open(os.path.join(d, "tags", "mlflow.runName"), "w") as f:
            f.write(name)
        with open(os.path.join(d, "artifacts", "user_prompt.txt"), "w") as f:
            f.write("Rate {review}")
    orphan = os.path.join(exp, "r9", "artifacts")
    os.makedirs(orphan)
    with open(os.path.join(orphan, "user_prompt.txt"), "w") as f:
        f.write("x")


def test_file_store_roundtrip(spark, tmpdir_path):
    _write_store(tmpdir_path)
    tables = runlog.read_file_store(spark, tmpdir_path)
    wide = runlog.cast_run_columns(runlog.search_runs(tables))
    rows = {r.run_id: r for r in wide.collect()}
    assert set(rows) == {"r1", "r2"}
    assert rows["r1"]["metrics.accuracy_score"] == 0.7  # the last step/timestamp wins
    assert rows["r1"]["metrics.precision"] is None  # nan -> NULL
    assert rows["r1"]["params.temperature"] == 0.2 and rows["r1"]["params.model_name"] == "m-a"
    assert [r.run_id for r in runlog.find_orphan_runs(tables).collect()] == ["r9"]
    assert [tuple(r) for r in tables["experiments"].collect()] == [("123", "demo", "active")]
    assert runlog.search_runs(tables, experiment_names=["demo"]).count() == 2
    assert runlog.search_runs(tables, experiment_names=["other"]).count() == 0
    sizes = runlog.group_sizes(runlog.comparable_runs(wide)).collect()
    assert sorted(r["count"] for r in sizes) == [1, 1]


def test_parquet_run_log_roundtrip(spark, tmpdir_path):
    from evalspark.plans.runs import derived_run_tables

    t = derived_run_tables(spark, "/root/testdata/sf0.001")
    runlog.log_runs(tmpdir_path, t["runs"], t["metrics"], t["params"], t["tags"])
    back = runlog.read_run_tables(spark, tmpdir_path)
    wide = runlog.search_runs(back)
    assert wide.count() == 19  # 20 sources, one deleted
    comp = runlog.comparable_runs(runlog.cast_run_columns(wide))
    assert comp.count() == 14
    runlog.assert_complete_grid(comp)


def test_strip_prefix_and_write_sample(spark, tmpdir_path):
    from evalspark.sources.sinks import write_sample

    df = spark.createDataFrame([("metrics.recall",), ("params.top_k",)], "name string")
    assert [r.s for r in df.select(runlog.strip_prefix("name").alias("s")).collect()] == ["recall", "params.top_k"]
    rows = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(30)], "example_id long, review string, label int")
    out = os.path.join(tmpdir_path, "sample")
    write_sample(rows, out, seed=5)
    back = spark.read.json(out)
    assert back.count() == 30 and set(back.columns) == {"review", "label"}


def test_cumcount_sorted_equals_window(spark):
    from evalspark.operators.frames import cumcount

    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.lit("b")).otherwise(F.lit(None)).alias("g"),
        (F.col("id") * 7919 % 3001).alias("k"),
    ).repartition(7)
    a = {(r.g, r.k): r.group_id for r in cumcount(df, "g", [F.col("k")], method="window").collect()}
    b = {(r.g, r.k): r.group_id for r in cumcount(df, "g", [F.col("k")]).collect()}
    assert a == b and len(b) == 3000


def test_file_store_odd_paths_and_lines(spark, tmp_path):
    from evalspark.sources.runlog import find_orphan_runs, read_file_store

    run = tmp_path / "7" / "r1"
    for path, text in {"../tags/owner": "me", "../meta.yaml": "experiment_id: '7'\nname: exp\nlifecycle_stage: active\n",
                       "meta.yaml": "experiment_id: '7'\nrun_uuid: r1\nrun_name: n\nlifecycle_stage: active\nstatus: 3\n",
                       "metrics/loss": "5 0.5\n6 0.25 1\n", "params/top k": "40", "params/a+b": "1",
                       "artifacts/metrics/report.txt": "whole report"}.items():
        f = run / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    t = read_file_store(spark, str(tmp_path))
    assert [tuple(r) for r in t["runs"].select("experiment_id", "run_id").collect()] == [("7", "r1")]
    assert [r["name"] for r in t["experiments"].collect()] == ["exp"]
    assert sorted((r["key"], r["value"], r["step"]) for r in t["metrics"].collect()) == [("loss", 0.25, 1), ("loss", 0.5, 0)]
    assert sorted(r["key"] for r in t["params"].collect()) == ["a+b", "top k"]
    assert [(r["run_id"], r["path"]) for r in t["artifacts"].collect()] == [("r1", "metrics/report.txt")]
    assert find_orphan_runs(t).count() == 0 and t["tags"].count() == 0


def test_search_runs_returns_every_key(spark):
    kv = "experiment_id string, run_id string, key string, value string"
    tables = {
        "runs": spark.createDataFrame([("0", "a", "r", "active", 3, 1, 2)], "experiment_id string, run_id string, run_name string, lifecycle_stage string, status int, start_time bigint, end_time bigint"),
        "metrics": spark.createDataFrame([("0", "a", "my_metric", 0.5, 0, 1)], "experiment_id string, run_id string, key string, value double, step bigint, timestamp bigint"),
        "params": spark.createDataFrame([("0", "a", "top_k", "40"), ("0", "a", "note", "free text")], kv),
        "tags": spark.createDataFrame([("0", "a", "user.name", "x")], kv),
    }
    row = runlog.cast_run_columns(runlog.search_runs(tables)).first()
    assert row["metrics.my_metric"] == 0.5 and row["params.top_k"] == 40.0 and row["params.note"] == "free text"
    assert row["tags.user.name"] == "x" and row["metrics.recall"] is None
    assert "params.note" not in runlog.search_runs(tables, param_keys=["top_k"]).columns


def test_paired_comparison_of_a_thousand_runs_in_one_pass(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    runs, examples = 1000, 40
    ok = rng.integers(0, 2, (runs, examples))
    there = rng.random((runs, examples)) < 0.7
    rows = [(f"r{i:04d}", e, int(ok[i, e])) for i in range(runs) for e in range(examples) if there[i, e]]
    rows += [("r0001", 0, 0), ("other", 3, 1)]  # a second row of one run and example, and a run that is not asked for
    ok[1, 0], there[1, 0] = ok[1, 0] if there[1, 0] else 0, True
    df = spark.createDataFrame(rows, "run_id string, example_id long, ok int")
    df = df.unionByName(spark.createDataFrame([("r0002", 1, None)], df.schema))
    got = paired_comparison(df, [f"r{i:04d}" for i in range(runs)])
    assert got.count() == runs * (runs - 1) // 2
    both = there.astype(int) @ there.T.astype(int)
    right = (ok * there) @ ((1 - ok) * there).T
    for r in got.sample(0.01, seed=1).collect():
        a, b = int(r.run_a[1:]), int(r.run_b[1:])
        assert a < b and r.n == both[a, b]
        assert abs(r.p_a_not_b - right[a, b] / r.n) < 1e-12 and abs(r.p_b_not_a - right[b, a] / r.n) < 1e-12


@pytest.mark.parametrize("few", [8, 0])
def test_paired_comparison_of_chosen_pairs_and_of_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(compare, "FEW", few)
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 2, 1)], "run_id string, example_id long, ok int")
    got = {(r.run_a, r.run_b): r for r in paired_comparison(df, ["a", "b", "c"], pairs=[("c", "a"), ("a", "b")]).collect()}
    assert got["a", "b"].n == 1 and got["a", "b"].accuracy_diff == 1.0
    assert got["a", "c"].n == 0 and got["a", "c"].accuracy_diff is None and len(got) == 2
    assert [r.n for r in paired_comparison(df.limit(0), ["a", "b"]).collect()] == [0]
