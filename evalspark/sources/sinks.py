"""Sinks (SNK-1..3). Spark writes directories of part files; order inside them is not promised."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.infer import PREDICTION_COLUMNS
from evalspark.operators.sampling import order_key
from evalspark.sources.tables import validate_columns


def write_predictions(df: DataFrame, path: str, keys: tuple[str, ...] = ("example_id",), mode: str = "errorifexists") -> None:
    """SNK-1: one JSON line per prediction (the 7 prediction columns, always validated, plus keys)."""
    validate_columns(df, [*keys, *PREDICTION_COLUMNS])
    df.select(*keys, *PREDICTION_COLUMNS).write.mode(mode).json(path)


def evaluation_path(output_path: str) -> str:
    stem, _ = os.path.splitext(output_path.rstrip("/"))
    return f"{stem}_evaluations.json"


def write_evaluation(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-2: the evaluation row(s) as JSON; the single row of an ungrouped evaluation is one part file."""
    df.write.mode(mode).json(path)


def write_sample(df: DataFrame, path: str, id_col: str = "example_id", seed: int = 42,
                 columns: tuple[str, ...] = ("review", "label"), mode: str = "errorifexists") -> None:
    """SNK-3: the sample in a seeded shuffled order (range-partitioned sort on the hash key)."""
    out = df.orderBy(order_key(id_col, seed), F.col(id_col)).select(*columns)
    out.write.mode(mode).json(path)
