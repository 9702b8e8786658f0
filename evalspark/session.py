"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark 4.1; older ones do not know it
_CREATED: list[str | None] = []  # scratch tables written by this process (see drop_scratch)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "evalspark",
                  extra_conf: dict | None = None) -> SparkSession:
    """Local session used by tests and the benchmark (never on a cluster)."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster in ``spark.checkpoint.dir`` (None when unset)."""
    value = spark.conf.get(CHECKPOINT_CONF, None)
    if not value:
        try:
            value = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
        except Exception:  # Spark Connect: no SparkContext; the session conf is all there is
            value = None
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; create a private one only where none is configured and the session is
    local (tests). Executors of a cluster would not see a folder of the driver, so there it raises."""
    value = checkpoint_dir(spark)
    if value is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors of {master or 'the cluster'} can read")
        value = tempfile.mkdtemp(prefix="evalspark-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, value)
    try:
        spark.sparkContext.setCheckpointDir(value)  # for fmt="checkpoint"; parquet tables do not need it
    except Exception:  # Spark Connect sessions have no SparkContext
        pass
    return value


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "evalspark-tables", name)


def new_scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder for files of a job; ``drop_scratch`` knows it."""
    path = scratch_path(spark, uuid.uuid4().hex)
    _CREATED.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's conf with ``values`` inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df, spark: SparkSession | None = None, fmt: str = "parquet"):
    """Cut lineage in the shared folder (survives executor loss; never executor-local).

    Default: write the frame as a parquet table under ``spark.checkpoint.dir`` and read it back, so
    the passes that follow get columnar, vectorised, column-pruned scans. ``fmt="checkpoint"`` uses
    ``DataFrame.checkpoint()`` instead (row files, removed with the query when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on).

    The shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    if fmt == "checkpoint":
        return df.checkpoint(eager=True)
    path = new_scratch(spark)
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        df.write.mode("errorifexists").parquet(path)
    table = spark.read.parquet(path)
    table._scratch = path  # for discard
    return table


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path and path in _CREATED:
            try:
                _delete(table.sparkSession, path)
            except Exception:  # Spark Connect: stays for drop_scratch
                continue
            _CREATED[_CREATED.index(path)] = None  # the places of the others stay


def spread(df):
    """``df`` over all cores, where it is read from fewer files than there are cores (a file may be one row group, and so one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch tables this process wrote (all, or those after the first ``since``); call it
    once the results are consumed. Uses the Hadoop FileSystem of each path, so it works on shared
    storage as well. Returns how many went."""
    dropped = 0
    while len(_CREATED) > since:
        path = _CREATED.pop()
        dropped += bool(path) and _delete(spark, path)
    return dropped


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """``with scratch_scope(spark): rows = query(...).collect()`` deletes the scratch tables written
    inside the block when it ends (results must be consumed inside it)."""
    start = len(_CREATED)
    try:
        yield
    finally:
        drop_scratch(spark, since=start)
