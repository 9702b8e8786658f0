"""Classification, efficiency and failure metrics as aggregate Columns, evaluated in ONE aggregate pass.

The reference computes each metric in its own pass over one run. Here every metric is an aggregate
expression; ``evaluate`` puts all of them in a single ``groupBy(*by).agg(...)`` so any number of runs
(``by=["run_id"]``) is scored in one shuffle with map-side partial aggregation.

Positive class of precision / recall / FPR is label 0. Undefined ratios (0/0) are NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.python_metrics import PythonMetric, evaluate_python

@dataclass(frozen=True)
class MetricInputs:
    """Column names a metric may read."""

    truth: str = "true_label"
    label: str = "label"
    is_hallucination: str = "is_hallucination"
    is_wrong_format: str = "is_wrong_format"
    input_tokens: str = "input_token_count"
    output_tokens: str = "output_token_count"
    elapsed: str = "elapsed_time"
    exact: bool = True
    accuracy: int = 10000  # percentile_approx accuracy when exact=False
    # "map": Spark's exact median (a value -> count map per group, merged in one task: bounded only when
    #        the input has few distinct values, e.g. token counts);
    # "distributed": exact with bounded memory per task (continuous values of huge runs), extra passes;
    # "auto": "map" for integral inputs, "distributed" for fractional ones.
    median_mode: str = "auto"
    # per-metric policy: metric name -> "auto" | "map" | "distributed" | "approx"
    median_overrides: tuple[tuple[str, str], ...] = ()
    # groups of at most this many rows keep Spark's map median even for continuous inputs: the map then
    # holds at most this many entries (the same bound as the distributed plan's final ranked cell)
    cell_limit: int = 100_000

    @property
    def y(self) -> Column:
        return F.col(self.truth)

    @property
    def p(self) -> Column:
        return F.col(self.label)

    def median(self, c: Column, approx: bool | None = None) -> Column:
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))  # NaN is "missing", as pandas skips it
        use_approx = (not self.exact) if approx is None else approx
        if use_approx:
            return F.percentile_approx(c, 0.5, self.accuracy).cast("double")
        return F.median(c)

    def mode_for(self, name: str) -> str:
        """The median policy of one metric: an override, else "approx" when exact=False, else the default."""
        overrides = dict(self.median_overrides)
        if name in overrides:
            return overrides[name]
        return self.median_mode if self.exact else "approx"


@dataclass(frozen=True)
class Metric:
    """A named aggregate: ``build(MetricInputs) -> Column``; medians also name their input expression."""

    name: str
    build: Callable[[MetricInputs], Column]
    median_of: Callable[[MetricInputs], Column] | None = None


def _median_metric(name: str, expr: Callable[[MetricInputs], Column]) -> Metric:
    return Metric(name, lambda m: m.median(expr(m)), expr)


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den).cast("double")


def _recall(m: MetricInputs) -> Column:
    return _ratio(F.count_if((m.p == 0) & (m.y == 0)), F.count_if(m.y == 0))


# The eleven metrics of the reference's evaluation, under the names it logs.
accuracy_score = Metric("accuracy_score", lambda m: _ratio(F.count_if(m.p == m.y), F.count(F.lit(1))))
false_positive_rate = Metric(
    "false_positive_rate", lambda m: _ratio(F.count_if((m.p == 0) & (m.y == 1)), F.count_if(m.y == 1))
)
precision = Metric("precision", lambda m: _ratio(F.count_if((m.p == 0) & (m.y == 0)), F.count_if(m.p == 0)))
recall = Metric("recall", _recall)
false_negative_rate = Metric("false_negative_rate", lambda m: F.lit(1.0) - _recall(m))
median_query_token_count = _median_metric("median_query_token_count", lambda m: F.col(m.input_tokens))
median_response_token_count = _median_metric("median_response_token_count", lambda m: F.col(m.output_tokens))
median_processing_time = _median_metric("median_processing_time", lambda m: F.col(m.elapsed))
# Reference quirk kept under its name: output tokens are counted twice and input tokens not at all.
median_tokens_per_second = _median_metric(
    "median_tokens_per_second",
    lambda m: (F.col(m.output_tokens) + F.col(m.output_tokens)) / (F.col(m.elapsed) + F.lit(1e-9)),
)
median_total_tokens_per_second = _median_metric(
    "median_total_tokens_per_second",
    lambda m: (F.col(m.input_tokens) + F.col(m.output_tokens)) / (F.col(m.elapsed) + F.lit(1e-9)),
)
hallucination_rate = Metric(
    "hallucination_rate", lambda m: _ratio(F.count_if(F.col(m.is_hallucination)), F.count(F.lit(1)))
)
bad_output_format_rate = Metric(
    "bad_output_format_rate", lambda m: _ratio(F.count_if(F.col(m.is_wrong_format)), F.count(F.lit(1)))
)

DEFAULT_METRICS: tuple[Metric, ...] = (
    accuracy_score,
    precision,
    recall,
    false_negative_rate,
    false_positive_rate,
    median_response_token_count,
    median_query_token_count,
    median_processing_time,
    median_tokens_per_second,
    hallucination_rate,
    bad_output_format_rate,
)
METRICS: dict[str, Metric] = {m.name: m for m in DEFAULT_METRICS + (median_total_tokens_per_second,)}
METRIC_NAMES: list[str] = [m.name for m in DEFAULT_METRICS]


def metric(name: str, fn: Callable[[Column, Column], Column], inputs: MetricInputs | None = None) -> Metric:
    """User metric from ``fn(truth, predicted_label) -> aggregate Column`` (UDF-1)."""
    return Metric(name, lambda m: fn(m.y, m.p))


def resolve(metrics: Iterable[Metric | str] | None) -> list[Metric]:
    out: list[Metric] = []
    for m in metrics if metrics is not None else DEFAULT_METRICS:
        out.append(METRICS[m] if isinstance(m, str) else m)
    names = [m.name for m in out]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"duplicate metric names: {dup}")
    return out


def metric_columns(metrics: Iterable[Metric | str] | None = None, inputs: MetricInputs | None = None) -> list[Column]:
    inputs = inputs or MetricInputs()
    return [m.build(inputs).alias(m.name) for m in resolve(metrics)]


def evaluate(
    joined: DataFrame,
    metrics: Iterable[Metric | PythonMetric | str] | None = None,
    by: Sequence[str] = (),
    inputs: MetricInputs | None = None,
    with_count: bool = True,
) -> DataFrame:
    """All metrics in one aggregate; one row per ``by`` group (one row overall when ``by`` is empty).

    ``n`` (rows evaluated) is kept so runs over different sample sizes are never compared silently.
    Metrics may also be ``PythonMetric`` (mergeable aggregates written in Python over any columns of ``joined``).
    With ``MetricInputs(median_mode="distributed")`` the medians come from ``distributed_median``
    (bounded memory per task, a few extra passes) and are joined to the one-pass aggregate on ``by``.
    """
    inputs = inputs or MetricInputs()
    written = [m for m in metrics or () if isinstance(m, PythonMetric)]
    if written:
        return _with_python(joined, metrics, written, list(by), inputs, with_count)
    chosen = resolve(metrics)
    names = [m.name for m in chosen]
    separate = [m for m in chosen if m.median_of is not None and _distributed(joined, m, inputs)]
    source = joined
    if separate:
        # several passes follow (aggregate + median levels): derive the narrow metric inputs once
        from evalspark.session import materialize

        wanted = [*by, inputs.truth, inputs.label, inputs.is_hallucination, inputs.is_wrong_format,
                  inputs.input_tokens, inputs.output_tokens, inputs.elapsed]
        source = materialize(joined.select(*[c for c in dict.fromkeys(wanted) if c in joined.columns]))
        if _max_group_rows(source, by, inputs.cell_limit) <= inputs.cell_limit:
            separate = []  # every group is small: the exact map median is bounded, one pass suffices
    one_pass = [m for m in chosen if m not in separate]
    cols = [_one_pass_column(m, inputs).alias(m.name) for m in one_pass]
    if with_count:
        cols.append(F.count(F.lit(1)).alias("n"))
    grouped = source.groupBy(*by) if by else source.groupBy()
    out = grouped.agg(*cols) if cols else source.select(*by).distinct()
    if separate:
        from evalspark.operators.quantiles import distributed_median

        # all continuous medians in one refinement: the metric name is one more group key
        sep = [m.name for m in separate]
        wide = source.select(*by, *[m.median_of(inputs).cast("double").alias(m.name) for m in separate])
        long = wide.unpivot(list(by), sep, "_metric", "_v")
        med = distributed_median(long, "_v", [*by, "_metric"], out="_med", checkpoint=False,
                                 keep_empty_groups=False, cell_limit=inputs.cell_limit)
        if by:
            med = med.groupBy(*by).pivot("_metric", sep).agg(F.first("_med"))
            out = out.join(med, list(by), "left")
        else:  # one row per metric: attach the values as literals (bounded round trip, no cross join)
            vals = {r["_metric"]: r["_med"] for r in med.collect()}
            for name in sep:
                out = out.withColumn(name, F.lit(vals.get(name)).cast("double"))
        out = out.select(*by, *names, *(["n"] if with_count else []))
    return out


def _with_python(joined: DataFrame, metrics: Sequence, written: Sequence[PythonMetric], by: list[str], inputs: MetricInputs,
                 with_count: bool) -> DataFrame:
    """The column metrics and the Python ones, put side by side per group."""
    names = [m if isinstance(m, str) else m.name for m in metrics]
    if dup := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"duplicate metric names: {dup}")
    others = [m for m in metrics if not isinstance(m, PythonMetric)]
    right = evaluate_python(joined, written, by)
    count = ["n"] if with_count else []
    if not others and not with_count:
        return right.select(*by, *names)
    left = evaluate(joined, others, by, inputs, with_count) if others else joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if not by:  # one row each: values go over as literals
        row = right.first()
        return left.withColumns({m.name: F.lit(row[m.name]).cast("double") for m in written}).select(*names, *count)
    keys = [F.col(c).alias(f"_r_{c}") for c in by]
    right = right.select(*keys, *[m.name for m in written])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, same, "left").select(*by, *names, *count)


def _one_pass_column(m: Metric, inputs: MetricInputs) -> Column:
    if m.median_of is None:
        return m.build(inputs)
    return inputs.median(m.median_of(inputs), approx=inputs.mode_for(m.name) == "approx")


def _max_group_rows(df: DataFrame, by: Sequence[str], limit: int) -> int:
    """Rows in the largest group; the total row count (parquet metadata) settles it when already small."""
    total = df.count()
    if total <= limit or not by:
        return total
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _distributed(df: DataFrame, m: Metric, inputs: MetricInputs) -> bool:
    mode = inputs.mode_for(m.name)
    if mode not in ("auto", "map", "distributed", "approx"):
        raise ValueError(f"unknown median mode {mode!r} for {m.name}")
    if mode in ("map", "approx"):
        return False
    if mode == "distributed":
        return True
    from pyspark.sql.types import IntegralType

    dtype = df.select(m.median_of(inputs).alias("_m")).schema["_m"].dataType
    return not isinstance(dtype, IntegralType)


def attach_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """JOIN-1: truth x prediction on the explicit example key (replaces pandas' positional alignment).

    No broadcast hint: both sides grow with the data; AQE switches to a broadcast join at run time when
    the measured size of one side is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return pred.join(truth, list(keys), "inner")


def alignment_report(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("example_id",)) -> DataFrame:
    """One row: predictions without truth and truth without prediction (one full-outer shuffle, not two
    anti joins)."""
    p = pred.select(*keys).withColumn("_p", F.lit(True))
    t = truth.select(*keys).withColumn("_t", F.lit(True))
    j = p.join(t, list(keys), "full_outer")
    return j.agg(
        F.count_if(F.col("_t").isNull()).alias("predictions_without_truth"),
        F.count_if(F.col("_p").isNull()).alias("truth_without_prediction"),
    )


def assert_aligned(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("example_id",)) -> None:
    row = alignment_report(pred, truth, keys).first()
    if row.predictions_without_truth or row.truth_without_prediction:
        raise ValueError(
            f"predictions and truth do not align on {list(keys)}: "
            f"{row.predictions_without_truth} predictions without truth, "
            f"{row.truth_without_prediction} truth rows without prediction"
        )


def error_slice(joined: DataFrame, truth: str = "true_label", label: str = "label") -> DataFrame:
    """FLT-6: predicted label differs from the truth (failed rows, label -1, included)."""
    return joined.filter(~F.col(label).eqNullSafe(F.col(truth)))


def failure_slice(joined: DataFrame, flag: str | None = None) -> DataFrame:
    """FLT-7: rows with the hallucination flag, the wrong-format flag, or either (``flag=None``)."""
    if flag is None:
        return joined.filter(F.col("is_hallucination") | F.col("is_wrong_format"))
    return joined.filter(F.col(flag))
