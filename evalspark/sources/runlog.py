"""The run log as ordinary tables (D10/D11, SRC-5..7, SNK-4, PRJ-15/16, FLT-2..5, AGG-17).

Long tables (one row per fact): ``runs``, ``metrics``, ``params``, ``tags``, ``artifacts``, all keyed by
``(experiment_id, run_id)``. ``search_runs`` assembles the wide frame (one row per active run, columns
``metrics.*``, ``params.*``, ``tags.*``) with pivots over explicit key lists.

Two physical forms are read: parquet tables written by ``log_runs`` (partitioned by experiment) and
the reference's file store (``<root>/<experiment>/<run>/{meta.yaml, metrics/*, params/*, tags/*}``).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.metrics import METRIC_NAMES

KINDS = ("runs", "metrics", "params", "tags", "artifacts", "experiments")
COMMIT = "commit_id string, attempt string"
# The keys every run logs (params, tags) and the numeric params.
PARAM_KEYS = ["model_name", "temperature", "top_k", "top_p"]
TAG_KEYS = ["justification", "mlflow.runName"]
NUMERIC_PARAMS = ("temperature", "top_k", "top_p")
MAX_RUN_KEYS = 10_000  # a run log with more different keys of a kind is refused, none is dropped


def c(name: str) -> Column:
    """Column reference for names with dots (``metrics.recall``)."""
    return F.col(f"`{name}`")


# ------------------------------------------------------------------ writing (SNK-4)


def log_runs(root: str, runs: DataFrame, metrics: DataFrame, params: DataFrame, tags: DataFrame,
             artifacts: DataFrame | None = None, experiments: DataFrame | None = None, commit_id: str | None = None) -> bool:
    """SNK-4: append runs to the parquet run log, all tables or none.

    Every write is an attempt with an id of its own, which its rows carry. Readers take the rows of attempts that have a
    commit record, and that is one small file, written last: what an attempt that was killed has left behind stays
    unseen, also after a retry. ``commit_id`` names the write: if it is committed already, nothing is written (False), so a
    caller that does not know whether it succeeded may call again.
    """
    spark = runs.sparkSession
    if commit_id is not None and not _commits(spark, root).filter(F.col("commit_id") == commit_id).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for name, df in (("experiments", experiments), ("tags", tags), ("artifacts", artifacts), ("params", params),
                     ("metrics", metrics), ("runs", runs)):
        if df is not None:
            marked = df.withColumn("attempt", F.lit(attempt))
            marked.write.mode("append").partitionBy("experiment_id").parquet(os.path.join(root, name))
    record = spark.createDataFrame([(commit_id or attempt, attempt)], COMMIT)
    record.coalesce(1).write.mode("append").parquet(os.path.join(root, "commits"))
    return True


def _parquet(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the run log; None if it was never written."""
    from pyspark.errors import AnalysisException

    path = os.path.join(root, name)
    if "://" not in root and not os.path.exists(path):
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:  # path does not exist on a remote file system, or holds no file yet
        return None


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """``commit_id, attempt``: the first attempt of each commit, should two writers have raced."""
    found = _parquet(spark, root, "commits")
    if found is None:
        return spark.createDataFrame([], COMMIT)
    return found.groupBy("commit_id").agg(F.min("attempt").alias("attempt"))


def read_run_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The committed rows of the parquet run log; a kind never written (e.g. no artifacts yet) is simply absent. Rows without
    an attempt (of tables written by other means) are taken as they are."""
    done = _commits(spark, root).select(F.col("attempt").alias("_done"))
    out = {}
    for name in KINDS:
        df = _parquet(spark, root, name)
        if df is None:
            continue
        if "attempt" in df.columns:
            df = df.join(done, F.col("attempt") == F.col("_done"), "left").filter(F.col("attempt").isNull() | F.col("_done").isNotNull())
            df = df.drop("attempt", "_done")
        out[name] = df
    return out


# ------------------------------------------------------------------ the file store


def write_file_store(root: str, tables: Mapping[str, DataFrame]) -> None:
    """The long tables as a file-store tree (``<root>/<experiment>/<run>/{meta.yaml, metrics/*, params/*, tags/*, artifacts/*}``),
    one file for each fact, a metric's values as its lines. Tasks write the files themselves, each under a name of its own first,
    so a task that is repeated leaves whole files; ``root`` must be a path that all executors mount. Null values are left out.
    """
    if re.match(r"^[a-zA-Z][\w+.-]*://", root) and not root.startswith("file://"):
        raise ValueError(f"file stores are written to mounted paths, not to {root!r}")
    top = re.sub(r"^file://", "", root)
    place = lambda *parts: F.concat_ws("/", "experiment_id", "run_id", *parts)
    line = F.concat_ws(" ", F.col("timestamp").cast("string"), F.col("value").cast("string"), F.col("step").cast("string"))
    metrics = tables["metrics"].filter(F.col("value").isNotNull()).select("experiment_id", "run_id", "key", F.struct("step", "timestamp", line.alias("line")).alias("x"))
    metrics = metrics.groupBy("experiment_id", "run_id", "key").agg(F.sort_array(F.collect_list("x")).alias("x"))  # as long as a metric was logged
    files = [metrics.select(place(F.lit("metrics"), "key").alias("path"), F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("content"))]
    for kind, key, value in (("params", "key", "value"), ("tags", "key", "value"), ("artifacts", "path", "text")):
        if kind in tables:
            files.append(tables[kind].filter(F.col(value).isNotNull()).select(place(F.lit(kind), key).alias("path"), F.col(value).alias("content")))
    meta = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in (
        ("experiment_id", F.concat(F.lit("'"), F.col("experiment_id"), F.lit("'"))), ("lifecycle_stage", F.col("lifecycle_stage")), ("run_id", F.col("run_id")),
        ("run_name", F.col("run_name")), ("run_uuid", F.col("run_id")), ("start_time", F.col("start_time")), ("end_time", F.col("end_time")), ("status", F.col("status")))]
    files.append(tables["runs"].select(place(F.lit("meta.yaml")).alias("path"), F.concat(F.concat_ws("\n", *meta), F.lit("\n")).alias("content")))

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(top, r["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["content"])
            os.replace(part, path)

    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    every.foreachPartition(write)


# reading (SRC-5)

# relative to the root, from the left: experiment, run (absent for what belongs to the experiment), kind, key
_PATH = r"^([^/]+)/(?:([^/]+)/)?(meta\.yaml|metrics|params|tags|artifacts)(?:/(.+))?$"
_SCHEME = r"^[^:/]+:(?://[^/]*)?"


def _root_path(spark: SparkSession, root: str) -> str:
    """``root`` as an absolute path without scheme and host."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(_SCHEME, "", fs.makeQualified(path).toString()).rstrip("/")


def read_file_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SRC-5: scan a file-store tree into the long tables; the path below ``root`` (percent-decoded) gives
    experiment, run, kind, key.

    Each file is one row (``wholetext``); metric files hold ``epoch_ms value [step]`` lines (no step: 0) and
    the last ``(step, epoch_ms)`` wins; a line without a value raises. ``meta.yaml`` files are ``key: value``
    lines pivoted to run columns; one directly in an experiment describes the experiment. Other facts directly
    in an experiment (its tags) belong to no run and are left out.
    """
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    )
    full = F.url_decode(F.replace(F.regexp_replace("path", _SCHEME, ""), F.lit("+"), F.lit("%2B")))
    rel = F.substr(full, F.lit(len(_root_path(spark, root)) + 2))
    parts = files.select(
        "content",
        F.regexp_extract(rel, _PATH, 1).alias("experiment_id"),
        F.regexp_extract(rel, _PATH, 2).alias("run_id"),
        F.regexp_extract(rel, _PATH, 3).alias("kind"),
        F.regexp_extract(rel, _PATH, 4).alias("key"),
        rel.alias("path"),
    ).filter(F.col("kind") != "")
    # an experiment's own meta.yaml sits at <root>/<experiment>/meta.yaml: its run part is empty
    run_meta = parts.filter((F.col("kind") == "meta.yaml") & (F.col("key") == ""))
    parts = parts.filter(F.col("run_id") != "")
    lines = run_meta.select(
        F.col("experiment_id").alias("_dir"), "run_id", F.explode(F.split(F.col("content"), "\n")).alias("line")
    ).filter(F.col("line").contains(":"))
    kv = lines.select(
        "_dir",
        "run_id",
        F.trim(F.substring_index("line", ":", 1)).alias("k"),
        F.regexp_replace(F.trim(F.expr("substring(line, instr(line, ':') + 1)")), r"^'(.*)'$", "$1").alias("v"),
    )
    meta_keys = ["experiment_id", "run_name", "lifecycle_stage", "status", "start_time", "end_time", "run_uuid", "name"]
    meta = kv.groupBy("_dir", "run_id").pivot("k", meta_keys).agg(F.first("v"))
    experiments = meta.filter((F.col("run_id") == "") & F.col("name").isNotNull()).select(
        "experiment_id", "name", "lifecycle_stage")
    runs = meta.filter((F.col("run_id") != "") & F.col("run_uuid").isNotNull()).select(
        F.col("experiment_id"),
        "run_id",
        "run_name",
        "lifecycle_stage",
        F.col("status").cast("int").alias("status"),
        F.col("start_time").cast("bigint").alias("start_time"),
        F.col("end_time").cast("bigint").alias("end_time"),
    )
    mlines = parts.filter(F.col("kind") == "metrics").select(
        "experiment_id", "run_id", "key", F.explode(F.split(F.trim("content"), "\n")).alias("line")
    )
    mf = mlines.filter(F.trim("line") != "").select(
        "experiment_id", "run_id", "key", "line", F.split(F.trim("line"), r"\s+").alias("f"))
    value = F.when(F.size("f") >= 2, F.get("f", F.lit(1))).otherwise(
        F.raise_error(F.concat(F.lit("metric line without a value: "), F.col("line"))))
    metrics = mf.select(
        "experiment_id",
        "run_id",
        "key",
        value.cast("double").alias("value"),
        F.coalesce(F.get("f", F.lit(2)).cast("bigint"), F.lit(0)).alias("step"),
        F.get("f", F.lit(0)).cast("bigint").alias("timestamp"),
    )
    params = parts.filter(F.col("kind") == "params").select("experiment_id", "run_id", "key", F.col("content").alias("value"))
    tags = parts.filter(F.col("kind") == "tags").select("experiment_id", "run_id", "key", F.col("content").alias("value"))
    artifacts = parts.filter(F.col("kind") == "artifacts").select(
        "experiment_id", "run_id", F.col("key").alias("path"), F.col("content").alias("text")
    )
    dirs = parts.filter(F.col("kind") != "meta.yaml").select("experiment_id", "run_id").distinct()
    return {"runs": runs, "metrics": metrics, "params": params, "tags": tags, "artifacts": artifacts, "dirs": dirs,
            "experiments": experiments}


def find_orphan_runs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """SRC-7: run directories (or facts) without a run record; ``search_runs`` ignores them."""
    dirs = tables.get("dirs")
    if dirs is None:
        dirs = tables["metrics"].select("experiment_id", "run_id").unionByName(
            tables["params"].select("experiment_id", "run_id")).unionByName(
            tables["tags"].select("experiment_id", "run_id")).distinct()
    return dirs.join(tables["runs"].select("run_id"), "run_id", "left_anti")


# ------------------------------------------------------------------ the wide frame (SRC-6, PRJ-15)


def last_metric_values(metrics: DataFrame) -> DataFrame:
    """The latest value per (run, key): largest ``(step, timestamp)``; NaN becomes NULL."""
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return metrics.groupBy("run_id", "key").agg(
        F.max_by(v, F.struct(F.col("step"), F.col("timestamp"))).alias("value")
    )


def _pivot(df: DataFrame, keys: Sequence[str], prefix: str, value: Column) -> DataFrame:
    out = df.groupBy("run_id").pivot("key", list(keys)).agg(F.first(value))
    return out.select("run_id", *[c(k).alias(f"{prefix}.{k}") for k in keys])


def _keys(facts: DataFrame, usual: Sequence[str]) -> list[str]:
    """The usual keys, then all others of a fact table in order."""
    others = facts.select("key").filter(F.col("key").isNotNull() & ~F.col("key").isin(list(usual))).distinct()
    found = [r["key"] for r in others.limit(MAX_RUN_KEYS + 1).collect()]
    if len(found) > MAX_RUN_KEYS:
        raise ValueError(f"more than {MAX_RUN_KEYS} keys in the run log; name those that are wanted")
    return [*usual, *sorted(found)]


def search_runs(
    tables: Mapping[str, DataFrame],
    view: str = "ACTIVE_ONLY",
    metric_keys: Sequence[str] | None = None,
    param_keys: Sequence[str] | None = None,
    tag_keys: Sequence[str] | None = None,
    experiment_ids: Iterable[str] | None = None,
    experiment_names: Iterable[str] | None = None,
) -> DataFrame:
    """SRC-6: one row per run with a run record (active only by default); columns ``metrics.*``,
    ``params.*`` (text), ``tags.*``; a key a run never logged is NULL. Without a list, all keys that the
    log holds are columns, besides those every run logs; explicit lists save the job that finds them."""
    runs = tables["runs"]
    if experiment_names is not None:
        if "experiments" not in tables:
            raise ValueError("experiment names need the experiments table")
        named = tables["experiments"].filter(F.col("name").isin(list(experiment_names))).select("experiment_id").distinct()
        runs = runs.join(named, "experiment_id", "left_semi")
    if experiment_ids is not None:
        runs = runs.filter(F.col("experiment_id").isin(list(experiment_ids)))
    if view == "ACTIVE_ONLY":
        runs = runs.filter(F.col("lifecycle_stage") == "active")
    elif view == "DELETED_ONLY":
        runs = runs.filter(F.col("lifecycle_stage") == "deleted")
    mk = _keys(tables["metrics"], METRIC_NAMES) if metric_keys is None else list(metric_keys)
    pk = _keys(tables["params"], PARAM_KEYS) if param_keys is None else list(param_keys)
    tk = _keys(tables["tags"], TAG_KEYS) if tag_keys is None else list(tag_keys)
    m = _pivot(last_metric_values(tables["metrics"]), mk, "metrics", F.col("value"))
    p = _pivot(tables["params"], pk, "params", F.col("value"))
    t = _pivot(tables["tags"], tk, "tags", F.col("value"))
    wide = runs.select("run_id", "experiment_id", "run_name", "lifecycle_stage", "status", "start_time")
    for part in (m, p, t):
        wide = wide.join(part, "run_id", "left")
    return wide


def cast_run_columns(wide: DataFrame, numeric_params: Iterable[str] = NUMERIC_PARAMS) -> DataFrame:
    """PRJ-15: numeric params to double (``try_cast``; text ``nan`` -> NULL), other params unchanged."""
    numeric = {f"params.{p}" for p in numeric_params}
    cols = []
    for name in wide.columns:
        if name in numeric:
            x = F.expr(f"try_cast(`{name}` AS double)")
            cols.append(F.nanvl(x, F.lit(None).cast("double")).alias(name))
        elif name.startswith("metrics."):
            cols.append(F.nanvl(c(name).cast("double"), F.lit(None).cast("double")).alias(name))
        else:
            cols.append(c(name))
    return wide.select(*cols)


def strip_prefix(name: str | Column, prefix: str = "metrics.") -> Column:
    """PRJ-16: display name without the ``metrics.`` prefix."""
    col = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(col, "^" + re.escape(prefix), "")


# ------------------------------------------------------------------ run filters (FLT-2..5)

RUN_NAME = "tags.mlflow.runName"
MODEL = "params.model_name"


def default_params_mask(temperature: float = 0.2, top_p: float = 0.95, top_k: float = 40) -> Column:
    """FLT-2 (NULL compares false, as pandas' NaN does)."""
    cond = (c("params.temperature") == temperature) & (c("params.top_p") == top_p) & (c("params.top_k") == top_k)
    return F.coalesce(cond, F.lit(False))


def full_data_mask(marker: str = "FULL_DATA") -> Column:
    """FLT-3."""
    return F.coalesce(c(RUN_NAME).contains(marker), F.lit(False))


def grid_search_mask(pattern: str = r"t\d") -> Column:
    """FLT-4 (the reference's ``t\\d`` also matches names like ``int20``; pass ``-t\\d`` to tighten)."""
    return F.coalesce(c(RUN_NAME).rlike(pattern), F.lit(False))


def comparable_runs(wide: DataFrame, grid_pattern: str = r"t\d") -> DataFrame:
    """FLT-5: not grid search, not full data, default sampling parameters."""
    return wide.filter(~grid_search_mask(grid_pattern) & ~full_data_mask() & default_params_mask())


def group_sizes(wide: DataFrame, keys: Sequence[str] = (RUN_NAME, MODEL)) -> DataFrame:
    """AGG-17: runs per (run name, model); rows with a NULL key are dropped (pandas groupby)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & c(k).isNotNull()
    return wide.filter(cond).groupBy(*[c(k) for k in keys]).count()


def assert_complete_grid(wide: DataFrame, keys: Sequence[str] = (RUN_NAME, MODEL)) -> None:
    """The stronger check the reference meant: every (name, model) pair exists exactly once."""
    a, b = keys
    sizes = group_sizes(wide, keys)
    n_a = wide.select(c(a)).distinct().count()
    n_b = wide.select(c(b)).distinct().count()
    stats = sizes.agg(F.count(F.lit(1)).alias("pairs"), F.max("count").alias("maxc")).first()
    if stats.pairs != n_a * n_b or (stats.maxc or 0) > 1:
        raise AssertionError(f"incomplete grid: {stats.pairs} pairs for {n_a} x {n_b}, max repeats {stats.maxc}")
