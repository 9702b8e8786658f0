"""Readers and input validation (SRC-1..4)."""

from __future__ import annotations

import os
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.LongType(), True),
        T.StructField("review", T.StringType(), True),
        T.StructField("label", T.IntegerType(), True),
    ]
)

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver parquet table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA, id_col: str = "example_id"):
    """SRC-1: JSON-lines corpus with a fixed schema; a malformed line fails the job (FAILFAST).

    A corpus without ids gets row positions (see ``numbered_lines``): they depend on the files and their lines only, not on
    split sizes or partitions. Ids on some rows only raise: made-up ones could equal given ones.
    """
    if id_col in schema.names:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        n = df.agg(F.count(id_col).alias("with_id"), F.count(F.lit(1)).alias("rows")).first()
        if n["with_id"] == n["rows"]:
            return df
        if n["with_id"]:
            raise ValueError(f"{n['rows'] - n['with_id']} of {n['rows']} rows have no {id_col!r}")
    rest = T.StructType([f for f in schema.fields if f.name != id_col])
    lines = numbered_lines(spark, path, id_col).withColumn("_row", F.from_json("value", rest, {"mode": "FAILFAST"}))
    first = [id_col] if id_col in schema.names else []
    return lines.select(*first, "_row.*", *([] if first else [id_col]))


def numbered_lines(spark: SparkSession, path: str, out: str = "line_id") -> DataFrame:
    """``value`` and ``out``: the lines of text files that are not blank, numbered from 0 in the order of (path, line).

    Each split numbers its own lines; a split's first number is the count of lines before it, which comes from a table with a
    row per split: sums over a file's splits, and over the files. Splits may be of any size.
    """
    from evalspark.session import materialize

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))

    def count(batches):
        at, n = None, 0
        for batch in batches:
            numbers = []
            for key in zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist()):
                at, n = (at, n + 1) if key == at else (key, 0)
                numbers.append(n)
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(numbers, pa.int64())], names=[*names, "_n"])

    # a task reads its splits one after another, each from its start
    rows = lines.filter(F.trim(F.translate("value", "\t\r", "  ")) != "").mapInArrow(count, "value string, _file string, _start bigint, _n bigint")
    rows = materialize(rows)
    splits = rows.groupBy("_file", "_start").agg((F.max("_n") + 1).alias("_c"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_c").alias("_c"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # over one row per file
    files = files.select("_file", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_files"))
    splits = splits.select("_file", "_start", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_splits")).join(files, "_file")
    return rows.join(splits, ["_file", "_start"]).select((F.col("_files") + F.col("_splits") + F.col("_n")).alias(out), "value")


def read_prompt(spark: SparkSession, path: str) -> str:
    """SRC-2: whole file as one template string (a plan-time constant)."""
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise ValueError(f"empty prompt file: {path}")
    return row[0]


def validate_columns(df: DataFrame, required: Iterable[str]) -> None:
    """SRC-3: raise naming every missing column (schema only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; present: {df.columns}")


def validate_unique(df: DataFrame, keys: Iterable[str] = ("example_id",)) -> None:
    """Identity check: the example key is unique (pandas had row positions; every alignment here is a
    join on the key, so a duplicate would silently double-count). One aggregate over the key columns
    only; at most one offending key reaches the driver."""
    keys = list(keys)
    validate_columns(df, keys)
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {[dup[0][k] for k in keys]} ({dup[0]['count']} rows) in {keys}")


def validate_binary_label(df: DataFrame, label: str = "label") -> None:
    """SRC-4: the label column exists and holds only 0 and 1 (NULL counts as bad). One short job."""
    validate_columns(df, [label])
    bad = df.filter(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).select(label).limit(1).collect()
    if bad:
        raise ValueError(f"column {label!r} must hold only 0 and 1; found {bad[0][0]!r}")


def truth_table(spark: SparkSession, sf_dir: str):
    """``(example_id, true_label)`` from ``labels``: ``1 - quality`` (good text = class 0). Narrow."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"), (F.lit(1) - F.col("quality")).cast("int").alias("true_label")
    )


def corpus_docs(spark: SparkSession, sf_dir: str, extra: Iterable[str] = ("lang", "source", "n_chars")):
    """``documents`` as the review corpus (``example_id``, ``review``, extras), not yet joined to truth."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), F.col("text").alias("review"), *extra
    )


def docs_for_truth(spark: SparkSession, sf_dir: str, extra: Iterable[str] = ("lang", "source", "n_chars")):
    """The documents worth scoring for an evaluation: those with a labelled id, at every size.

    A semi-join on the id alone, without a hint: the keys are broadcast where their measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and the text then stays where it is read.
    """
    keys = truth_table(spark, sf_dir).select("example_id")
    return corpus_docs(spark, sf_dir, extra).join(keys, "example_id", "left_semi")


def labelled_corpus(spark: SparkSession, sf_dir: str, extra: Iterable[str] = ("lang", "source", "n_chars")):
    """Driver stand-in for the review corpus: ``documents`` joined to ``labels``.

    ``example_id = doc_id``, ``review = text``, truth ``true_label = 1 - quality`` (good text = class 0).
    This join carries the text: when the text is only needed to compute narrow columns (prompt token
    counts, stub answers), compute them on ``corpus_docs`` first and join ``truth_table`` to the narrow
    result, so a shuffle join never moves the text.
    """
    return corpus_docs(spark, sf_dir, extra).join(truth_table(spark, sf_dir), "example_id", "inner")
