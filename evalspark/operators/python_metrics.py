"""Metrics written in Python over the whole prediction frame (UDF-1), as mergeable aggregates.

A metric turns a batch of rows into a state, merges states and finishes one into a number. States are made per Arrow
batch and merged inside each task, so what is shuffled is one state per task and group, never rows. A group's states
are merged in two steps, first by a number of shares, so that neither a run with a third of all rows nor a group with
many states is the work of one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 32  # of a group's states in the first merge
HELD = 10_000  # groups that a task keeps states of; beyond, it sends them and starts anew


@dataclass(frozen=True)
class PythonMetric:
    """``partial``: a frame with ``columns`` (not empty) to a state; ``merge``: two states to one; ``finish``: a state to a number
    (None: undefined). Merging must not depend on the order of the rows. States are pickled."""

    name: str
    columns: tuple[str, ...]
    partial: Callable[[pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def _key(values) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (values if isinstance(values, tuple) else (values,)))


def _merged(metrics: Sequence[PythonMetric], a: list | None, b: list) -> list:
    return b if a is None else [m.merge(x, y) for m, x, y in zip(metrics, a, b)]


def _frame(held: dict, by: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.Series([k[i] for k in held], dtype="object") for i, c in enumerate(by)}, index=range(len(held)))
    out["_states"] = [pickle.dumps(s) for s in held.values()]
    return out


def evaluate_python(joined: DataFrame, metrics: Sequence[PythonMetric], by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` group (null is a group; without ``by`` one row, with nulls for an empty frame) with a double per metric."""
    by, metrics = list(by), list(metrics)
    names = [m.name for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError(f"duplicate metric names: {sorted({n for n in names if names.count(n) > 1})}")
    wanted = list(dict.fromkeys([*by, *(c for m in metrics for c in m.columns)]))
    if missing := [c for c in wanted if c not in joined.columns]:
        raise ValueError(f"missing columns: {missing}")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def states(batches):
        held: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for values, part in groups:
                if not len(part):
                    continue
                key = _key(values) if by else ()
                held[key] = _merged(metrics, held.get(key), [m.partial(part[list(m.columns)]) for m in metrics])
            if len(held) > HELD:
                yield _frame(held, by)
                held = {}
        if held:
            yield _frame(held, by)

    def one(values, pdf: pd.DataFrame) -> list:
        state = None
        for s in pdf["_states"]:
            state = _merged(metrics, state, pickle.loads(s))
        return state

    def share(values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame({_key(values[: len(by)]): one(values, pdf)}, by)

    def finish(values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = one(values, pdf)
        row = {c: pd.Series([v], dtype="object") for c, v in zip(by, _key(values[: len(by)]) if by else ())}
        return pd.DataFrame(row | {m.name: pd.Series([None if (v := m.finish(s)) is None else float(v)], dtype="float64") for m, s in zip(metrics, state)})

    parts = joined.select(*wanted).mapInPandas(states, f"{keys}_states binary")
    parts = parts.withColumn("_share", F.pmod(F.xxhash64("_states"), F.lit(SHARES)))
    parts = parts.groupBy(*by, "_share").applyInPandas(share, f"{keys}_states binary")
    group = parts.groupBy(*by) if by else parts.groupBy(F.lit(0).alias("_all"))
    out = group.applyInPandas(finish, keys + ", ".join(f"`{n}` double" for n in names))
    if not by:  # an empty frame has one row of nulls, as an aggregate without groups has
        out = out.agg(*[F.max(f"`{n}`").alias(n) for n in names])
    return out
