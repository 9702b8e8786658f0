"""Scoring (INF-1..5): render -> predict -> parse, keyed by ``example_id`` (and ``run_id``).

Rendering and parsing are Column expressions and stay outside the Python boundary; only the predictor
itself runs in Python (``mapInArrow``: Arrow batches, the predictor is built once per Python worker and
reused for every batch of the partition). A predictor that is a SQL expression (the stub) never leaves
the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.parse import parse_label
from evalspark.functions.stub import stub_outputs
from evalspark.functions.text import render_prompt, validate_prompt_fields, word_count

# Fixed value: default user prompt of this package (one slot, ``review``).
DEFAULT_TEMPLATE = (
    "Here is a review: {review}\n"
    "Is the overall sentiment of the review positive or negative? "
    'Answer with exactly one word: "positive" or "negative".'
)
DEFAULT_SYSTEM_PROMPT = "You are a careful sentiment classifier."

PREDICTION_COLUMNS = [
    "output_string",
    "label",
    "is_hallucination",
    "is_wrong_format",
    "input_token_count",
    "output_token_count",
    "elapsed_time",
]

CALL = 512  # prompts of a call at most: what a predictor makes of them (word lists, copies) stays small

ANSWER = {"output_string": pa.string(), "input_token_count": pa.int64(), "output_token_count": pa.int64(), "elapsed_time": pa.float64()}

# Predictor contract: (prompts, params) -> (content, prompt_tokens, completion_tokens) per prompt.
Predictor = Callable[[pd.Series, Mapping], pd.DataFrame]


def select_content(df: DataFrame, template: str, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """PRJ-1: keep the key and the prompt content columns the template uses (checked at plan time)."""
    from evalspark.functions.text import template_fields

    fields = template_fields(template)
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise KeyError(f"template fields missing from the frame: {missing}")
    return df.select(*keys, *fields)


def with_parsed(df: DataFrame, parser: Column | None = None, raw: str = "output_string") -> DataFrame:
    """Attach ``label, is_hallucination, is_wrong_format`` from a parser struct (default: ``parse_label``)."""
    parsed = parser if parser is not None else parse_label(raw)
    return df.withColumn("_parsed", parsed).select("*", "_parsed.*").drop("_parsed")


def score_stub(
    df: DataFrame,
    template: str = DEFAULT_TEMPLATE,
    fields: Mapping[str, str | Column] | None = None,
    key: str = "example_id",
    shift: int | Column = 0,
    keep: Sequence[str] = ("true_label",),
    parser: Column | None = None,
    input_tokens: Column | None = None,
) -> DataFrame:
    """INF-1 with the SQL-expressible stub predictor (tests, oracle queries, benchmark).

    ``input_tokens`` replaces the prompt word count with a column computed upstream."""
    fields = dict(fields or {})
    if input_tokens is None:
        validate_prompt_fields(template, [f for f in fields] or [c for c in df.columns if c in ("review",)])
        input_tokens = word_count(render_prompt(template, fields))
    shift = F.lit(shift) if isinstance(shift, int) else shift
    out = df.select(key, *keep, F.col("n_chars").alias("_n_chars"), input_tokens.alias("_tokens"), shift.alias("_shift"))
    out = out.select(key, *keep, *stub_outputs(key, F.col("_tokens"), F.col("_n_chars"), F.col("_shift")))
    return with_parsed(out, parser)


def _predict_batches(
    predictor_factory: Callable[[], Predictor], params: Mapping, prompt_col: str, passthrough: Sequence[str],
    param_cols: Sequence[str] = (),
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(predictor, part: pa.RecordBatch, call_params: Mapping) -> pa.RecordBatch:
        prompts = pd.Series(part.column(prompt_col).to_pylist(), dtype=object)
        asked = prompts.notna()
        # a NULL prompt is not sent; its response is NULL, with no tokens and no time
        res = pd.DataFrame({"output_string": None, "input_token_count": 0, "output_token_count": 0, "elapsed_time": 0.0}, index=prompts.index)
        if asked.any():
            start = time.perf_counter()
            out = predictor(prompts[asked].reset_index(drop=True), call_params)
            per_row = (time.perf_counter() - start) / int(asked.sum())
            res["output_string"] = res["output_string"].astype("object")
            res.loc[asked, "output_string"] = out["content"].astype("object").values
            res.loc[asked, "input_token_count"] = out["prompt_tokens"].astype("int64").values
            res.loc[asked, "output_token_count"] = out["completion_tokens"].astype("int64").values
            res.loc[asked, "elapsed_time"] = out["elapsed_time"].astype("float64").values if "elapsed_time" in out else per_row
        answers = [pa.array(res[c], kind, from_pandas=True) for c, kind in ANSWER.items()]
        return pa.RecordBatch.from_arrays([*map(part.column, passthrough), *answers], names=[*passthrough, *ANSWER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = predictor_factory()  # once per task / Python worker, not per row
        # of an Arrow batch, only the prompts of one call are Python strings at a time
        for part in (whole.slice(k, CALL) for whole in batches for k in range(0, whole.num_rows, CALL)):
            if not param_cols:
                yield predict(predictor, part, params)
                continue
            # per-row sampling parameters (a grid): one predictor call per parameter combination
            points = part.select(list(param_cols)).to_pandas().groupby(list(param_cols), sort=False, dropna=False)
            for values, rows in points:
                values = values if isinstance(values, tuple) else (values,)
                row_params = {k: (v.item() if hasattr(v, "item") else v) for k, v in zip(param_cols, values)}
                yield predict(predictor, part.take(pa.array(rows.index)), {**params, **row_params})

    return run


def score(
    df: DataFrame,
    predictor_factory: Callable[[], Predictor],
    template: str | Callable[[DataFrame], Column] = DEFAULT_TEMPLATE,
    fields: Mapping[str, str | Column] | None = None,
    keys: Sequence[str] = ("example_id",),
    keep: Sequence[str] = (),
    params: Mapping | None = None,
    parser: Column | None = None,
    partitions: int | None = None,
    param_cols: Sequence[str] = (),
    system_prompt: str | None = None,
) -> DataFrame:
    """INF-1: score every row with a Python predictor through ``mapInArrow``.

    ``system_prompt``, where given, reaches the predictor as ``params["system_prompt"]``. Fields that the
    template does not use raise. A NULL prompt is not sent: its response is NULL (a wrong format).

    ``template`` may also be a prompt builder (UDF-3): a function from the frame to the prompt's Column; ``fields`` do not
    apply then. A predictor that returns no ``elapsed_time`` gets its call's time shared evenly among the call's rows.

    ``params`` go to every call; ``param_cols`` (kept columns, e.g. a grid's temperature / top_k) are
    passed per row: each Arrow batch is split by their values and the predictor receives them.

    Only the key, kept columns and the rendered prompt cross into Python (``mapInArrow`` is opaque to
    column pruning, so inputs are selected by hand). Filters must be applied before this call.
    ``partitions`` repartitions first (a single JSON file arrives as one partition).
    The result may be non-deterministic: persist it (``session.materialize``) before evaluating twice.
    """
    fields = dict(fields or {})
    if callable(template):
        if fields:
            raise ValueError("fields belong to a template, not to a prompt builder")
        prompt = template(df)
    else:
        if fields:
            validate_prompt_fields(template, list(fields))
        prompt = render_prompt(template, fields)
    if system_prompt is not None:
        params = {**(params or {}), "system_prompt": system_prompt}
    passthrough = list(keys) + list(keep)
    inp = df.select(*passthrough, prompt.alias("_prompt"))
    if partitions:
        inp = inp.repartition(partitions, *keys)
    in_schema = {f.name: f.dataType.simpleString() for f in inp.schema.fields}
    out_schema = ", ".join(
        [f"`{c}` {in_schema[c]}" for c in passthrough]
        + [
            "output_string string",
            "input_token_count bigint",
            "output_token_count bigint",
            "elapsed_time double",
        ]
    )
    missing = [c for c in param_cols if c not in passthrough]
    if missing:
        raise ValueError(f"param_cols must be kept columns: {missing}")
    fn = _predict_batches(predictor_factory, dict(params or {}), "_prompt", passthrough, list(param_cols))
    scored = inp.mapInArrow(fn, out_schema)
    return with_parsed(scored, parser)


def score_resumable(df: DataFrame, predictor_factory: Callable[[], Predictor], path: str, keys: Sequence[str] = ("example_id",),
                    chunks: int = 16, **kw) -> DataFrame:
    """INF-2: as ``score``, output by output: rows are dealt to ``chunks`` by a hash of their keys, and the predictions of each
    chunk are written under ``path`` before the next chunk is asked. A write is there as a whole or not at all, so a job
    that was stopped and starts again asks only for rows without a written prediction. Returns what ``path`` holds of ``df``.

    Every chunk starts with an anti-join of its keys against the ones already there. Keys must be unique and not null, and
    ``chunks`` may differ between attempts; other settings (template, model) must be the same ones.
    """
    spark, keys = df.sparkSession, list(keys)
    chunk = F.pmod(F.xxhash64(*keys), F.lit(chunks))
    for k in range(chunks):
        rows, there = df.filter(chunk == k), _written(spark, path)
        if there is not None:
            rows = rows.join(there.select(*keys).filter(chunk == k), keys, "left_anti")
        if rows.select(*keys).isEmpty():
            continue
        score(rows, predictor_factory, keys=keys, **kw).write.mode("append").parquet(path)
    there = _written(spark, path)
    if there is None:
        return score(df.limit(0), predictor_factory, keys=keys, **kw)
    return there.join(df.select(*keys), keys, "left_semi")


def _written(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def prompt_tokens(df: DataFrame, template: str = DEFAULT_TEMPLATE, fields: Mapping[str, str | Column] | None = None,
                  out: str = "input_token_count") -> DataFrame:
    """Word count of the rendered prompt, once per example (the prompt does not depend on run params)."""
    fields = dict(fields or {})
    validate_prompt_fields(template, list(fields) or ["review"])
    return df.withColumn(out, word_count(render_prompt(template, fields)))


def parameter_grid(**axes: Iterable) -> list[dict]:
    """``itertools.product`` of named parameter lists, each point with a stable ``run_id``."""
    import itertools

    names = list(axes)
    grid = []
    for values in itertools.product(*[list(axes[n]) for n in names]):
        point = dict(zip(names, values))
        point["run_id"] = "-".join(f"{n}={point[n]}" for n in names)
        grid.append(point)
    return grid


def explode_grid(df: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    """JOIN-3: every example under every grid point, key ``(run_id, example_id)``.

    The grid is a small driver-side parameter list, so it is inlined as a literal array and exploded
    inside the same stage: no join, no shuffle, no broadcast.
    """
    if not grid:
        raise ValueError("empty parameter grid")
    names = list(grid[0])
    structs = [F.struct(*[F.lit(p[n]).alias(n) for n in names]) for p in grid]
    return df.withColumn("_g", F.explode(F.array(*structs))).select("*", "_g.*").drop("_g")
