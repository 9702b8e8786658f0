"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables.

Each query here has a DuckDB twin in ``plans.oracle`` with the same column names. The stub predictor
stands in for a language model so both engines can compute the same predictions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import crop_middle, word_count
from evalspark.operators import infer
from evalspark.operators.metrics import MetricInputs, evaluate
from evalspark.sources.tables import docs_for_truth, labelled_corpus, truth_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def stub_predictions(spark: SparkSession, sf_dir: str, shift: int = 0, keep=("true_label", "source", "lang")):
    """Labelled corpus scored by the stub predictor with the default template.

    The text-heavy part (render, token counts, answer, parse) runs on the documents side; only the
    narrow prediction rows meet the truth table, so a shuffle join never carries the text."""
    doc_keep = [k for k in keep if k != "true_label"]
    scored = infer.score_stub(docs_for_truth(spark, sf_dir), fields={"review": F.col("review")}, shift=shift,
                              keep=doc_keep)
    return scored.join(truth_table(spark, sf_dir), "example_id", "inner")


# ------------------------------------------------------------------ evaluation


@register("eval_metrics")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: render -> stub -> parse -> join truth -> the 11 metrics in one aggregate."""
    return evaluate(stub_predictions(spark, sf_dir))


@register("eval_metrics_split")
def eval_metrics_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics with every median refined by histograms, as for groups of any size."""
    return evaluate(stub_predictions(spark, sf_dir), inputs=MetricInputs(median_mode="distributed", cell_limit=16))


@register("eval_by_source")
def eval_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same metrics for every group in one pass (``by=[source]``)."""
    return evaluate(stub_predictions(spark, sf_dir), by=["source"])


# ------------------------------------------------------------------ text


@register("word_counts")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", word_count("text").alias("n_words"))


@register("crop_int")
def crop_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.sources.tables import table

    c = crop_middle("text", 30, 30)
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("cropped"))


@register("crop_fraction")
def crop_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.sources.tables import table

    c = crop_middle("text", 0.2, 0.2)
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("cropped"), word_count(c).alias("n_words"))


# ------------------------------------------------------------------ parsers over stub responses

COT_MARKER = "FINAL LABEL ="
JSON_FIELDS = ("k",)


def cot_response(doc_id: str = "doc_id", text: str = "text"):
    """Chain-of-thought style answers over the whole document as reasoning: marker + answer, two
    markers, marker last, no marker."""
    from evalspark.functions.stub import stub_response

    resp = stub_response(doc_id, word_count(text))
    lead = F.col(text)
    m = F.col(doc_id) % 4
    return (
        F.when(m == 0, F.concat(lead, F.lit(f" {COT_MARKER} "), resp))
        .when(m == 1, F.concat(lead, F.lit(f" {COT_MARKER} negative, but then {COT_MARKER} "), resp))
        .when(m == 2, F.concat(lead, F.lit(f" {COT_MARKER}")))
        .otherwise(lead)
    )


def json_response(event_id: str = "event_id", props: str = "props"):
    """JSON answers: bare, wrapped in prose, single-quoted (invalid), two objects (invalid)."""
    m = F.col(event_id) % 4
    p = F.col(props)
    return (
        F.when(m == 0, p)
        .when(m == 1, F.concat(F.lit("The answer is "), p, F.lit(" as requested.")))
        .when(m == 2, F.regexp_replace(p, '"', "'"))
        .otherwise(F.concat(p, F.lit(' and {"k": "late"}')))
    )


@register("parse_basic")
def parse_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.functions.parse import parse_label
    from evalspark.functions.stub import stub_response
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", stub_response("doc_id", word_count("text")).alias("output_string"))
    return docs.withColumn("_p", parse_label("output_string")).select("doc_id", "output_string", "_p.*")


@register("parse_cot")
def parse_cot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.functions.parse import parse_cot_label
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", cot_response().alias("output_string"))
    return docs.withColumn("_p", parse_cot_label("output_string", COT_MARKER)).select("doc_id", "output_string", "_p.*")


@register("parse_json")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.functions.parse import parse_json_label
    from evalspark.sources.tables import table

    ev = table(spark, sf_dir, "events").select("event_id", json_response().alias("output_string"))
    return ev.withColumn("_j", parse_json_label("output_string", JSON_FIELDS)).select("event_id", "output_string", "_j.*")


@register("parse_json_jvm")
def parse_json_jvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same strict JSON parsing without Python: the slice parsed as a one-element JSON array."""
    from evalspark.functions.parse import parse_json_label
    from evalspark.sources.tables import table

    ev = table(spark, sf_dir, "events").select("event_id", json_response().alias("output_string"))
    return ev.withColumn("_j", parse_json_label("output_string", JSON_FIELDS, engine="jvm")).select(
        "event_id", "output_string", "_j.*")


# ------------------------------------------------------------------ prompts and chat requests

FEW_SHOT_SEED = 7


def few_shot_examples(spark: SparkSession, sf_dir: str, per_class: int = 1):
    """(name, cropped text) of ``per_class`` examples of each class, chosen by seeded hash order.

    Only ``2 * per_class`` rows reach the driver (a bounded take of the smallest keys per class).
    """
    from evalspark.operators.sampling import order_key

    from evalspark.sources.tables import table

    keyed = truth_table(spark, sf_dir).select("example_id", "true_label", order_key("example_id", FEW_SHOT_SEED).alias("_k"))
    # per class a bounded top-k over the narrow truth table (each task keeps k rows), one job
    parts = [keyed.filter(F.col("true_label") == cls).orderBy("_k", "example_id").limit(per_class) for cls in (1, 0)]
    chosen = parts[0].unionByName(parts[1]).collect()
    ids = [r["example_id"] for r in chosen]
    # fetch only those texts: an IN filter pushed into the parquet scan, no join, no shuffle
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(ids))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", crop_middle("text", 20, 20).alias("text")).collect()}
    by_class = {cls: sorted([r for r in chosen if r["true_label"] == cls], key=lambda r: (r["_k"], r["example_id"]))
                for cls in (1, 0)}
    names = {1: "negative", 0: "positive"}
    # interleave: NEGATIVE, POSITIVE, NEGATIVE, ...
    out = []
    for i in range(per_class):
        for cls in (1, 0):
            if i < len(by_class[cls]):
                out.append((names[cls], texts[by_class[cls][i]["example_id"]]))
    return out


FEW_SHOT_BASE = "Labelled texts:\n{examples}\n\nText to label:\n{review}\n\nLabel:"


def few_shot_template(examples) -> str:
    from evalspark.functions.text import few_shot_template as build

    return build(FEW_SHOT_BASE, examples)


@register("prompt_render")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.functions.text import render_prompt, validate_prompt_fields
    from evalspark.sources.tables import table

    template = few_shot_template(few_shot_examples(spark, sf_dir))
    validate_prompt_fields(template, ["review"])
    prompt = render_prompt(template, {"review": F.col("text")})
    docs = table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))
    return docs.select(
        "doc_id",
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        word_count("prompt").alias("prompt_words"),
        F.md5("prompt").alias("prompt_md5"),
    )


@register("chat_messages")
def chat_messages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.functions.text import chat_messages, render_chat
    from evalspark.sources.tables import table

    conv = table(spark, sf_dir, "conversations")  # each turn as a request of its own
    req = chat_messages(infer.DEFAULT_SYSTEM_PROMPT, F.col("text"))
    return conv.select("conv_id", "turn", F.size(req).alias("n_messages"), render_chat(req).alias("chat"))


# ------------------------------------------------------------------ corpus statistics


@register("label_counts")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import value_counts

    return value_counts(labelled_corpus(spark, sf_dir, extra=()), "true_label")


@register("label_crosstab")
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import crosstab

    return crosstab(labelled_corpus(spark, sf_dir, extra=("lang",)), "lang", "true_label", [0, 1], prefix="label_")


@register("errors")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.metrics import error_slice
    from evalspark.operators.stats import value_counts

    return value_counts(error_slice(stub_predictions(spark, sf_dir)), "label")


@register("error_rows")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.metrics import error_slice

    return error_slice(stub_predictions(spark, sf_dir)).select("example_id", "true_label", "label", "output_string")


@register("failures")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.metrics import failure_slice

    return failure_slice(stub_predictions(spark, sf_dir)).select(
        "example_id", "output_string", "is_hallucination", "is_wrong_format"
    )


def _doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.sources.tables import table

    return table(spark, sf_dir, "documents").select("doc_id", "lang", word_count("text").alias("n_words"))


def _words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, n_words)`` derived once (one regex pass over the text) and checkpointed: the
    histogram needs two passes (range, counts) and the sample design several; they read this narrow
    table instead of re-splitting every document."""
    from evalspark.session import materialize

    return materialize(_doc_words(spark, sf_dir))


@register("length_histogram")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import histogram

    return histogram(_words_table(spark, sf_dir), "n_words", bins=100)


@register("length_histogram_by_class")
def length_histogram_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class counts over the edges of the whole corpus (the side-by-side class histogram). Word
    counts come from the narrow materialized table, joined to the narrow truth table (no text moves)."""
    from evalspark.operators.stats import histogram, histogram_range

    words = _words_table(spark, sf_dir)
    rng = histogram_range(words, "n_words")
    per_doc = words.select(F.col("doc_id").alias("example_id"), "n_words")
    corpus = per_doc.join(truth_table(spark, sf_dir), "example_id").select("true_label", "n_words")
    return histogram(corpus, "n_words", bins=100, by=["true_label"], value_range=rng)


SIZE_BINS = 100
SIZE_MIN_COUNT = 100  # populous bin = more than 100 rows (the reference's threshold)


def with_size_groups(spark: SparkSession, sf_dir: str, df: DataFrame, words_col: str,
                     words_table: DataFrame | None = None) -> DataFrame:
    from evalspark.operators.stats import size_groups

    words = words_table if words_table is not None else _words_table(spark, sf_dir)
    col, _ = size_groups(words, "n_words", SIZE_BINS, SIZE_MIN_COUNT)
    # ``col`` digitizes the named column ``n_words`` against the corpus edges.
    return df.withColumn("n_words", F.col(words_col)).withColumn("size_group", col)


@register("size_groups")
def size_groups_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words_table(spark, sf_dir)
    return with_size_groups(spark, sf_dir, words, "n_words", words).select("doc_id", "n_words", "size_group")


@register("length_quantiles")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import quantile_summary

    return quantile_summary(_doc_words(spark, sf_dir), "n_words", by=["lang"], name="words")


# ------------------------------------------------------------------ sampling

SAMPLE_SEED = 42
SAMPLE_FRACTION = 0.25  # the reference drew 10,000 of 40,000 rows
PER_CLASS = 25  # rows per class in the balanced sample (the smallest class of sf0.01 holds 58)


def _sample_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples with their size group. Word counts come from the checkpointed narrow table
    (no second pass over the text)."""
    from evalspark.sources.tables import table

    words = _words_table(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"), (F.lit(1) - F.col("quality")).cast("int").alias("true_label"))
    base = labels.join(words.select(F.col("doc_id").alias("example_id"), F.col("n_words").alias("_w")), "example_id")
    return with_size_groups(spark, sf_dir, base, "_w", words).drop("_w", "n_words")


@register("stratified_sample")
def stratified_sample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.sampling import stratified_sample

    base = _sample_base(spark, sf_dir).select("example_id", "true_label", "size_group")
    return stratified_sample(base, ["true_label", "size_group"], SAMPLE_FRACTION, seed=SAMPLE_SEED)


@register("stratified_sample_split")
def stratified_sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample with every threshold found by histograms, as for strata of any size."""
    from evalspark.operators.sampling import stratified_sample

    base = _sample_base(spark, sf_dir).select("example_id", "true_label", "size_group")
    return stratified_sample(base, ["true_label", "size_group"], SAMPLE_FRACTION, seed=SAMPLE_SEED)


@register("sample_complement")
def sample_complement_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.sampling import sample_complement

    base = _sample_base(spark, sf_dir).select("example_id", "true_label", "size_group")
    return sample_complement(base, ["true_label", "size_group"], SAMPLE_FRACTION, seed=SAMPLE_SEED)


@register("balanced_sample")
def balanced_sample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.sampling import balanced_sample

    from evalspark.sources.tables import table

    base = _sample_base(spark, sf_dir)
    # the larger the corpus, the more size groups there are: more than PER_CLASS, and some with one row of a class
    picked = balanced_sample(base, "true_label", PER_CLASS, ["size_group"], seed=SAMPLE_SEED,
                             columns=["example_id", "true_label"], min_stratum=1)
    # at most PER_CLASS x classes rows (a parameter bound): broadcast them to the documents scan
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("review"))
    return docs.join(F.broadcast(picked), "example_id").select("example_id", "review", "true_label")


# ------------------------------------------------------------------ run log (derived from documents)


@register("run_search")
def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import wide_runs

    return wide_runs(spark, sf_dir)


@register("orphan_runs")
def orphan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import derived_run_tables
    from evalspark.sources.runlog import find_orphan_runs

    return find_orphan_runs(derived_run_tables(spark, sf_dir))


@register("comparable_runs")
def comparable_runs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import comparable
    from evalspark.sources.runlog import c

    return comparable(spark, sf_dir).select(
        "run_id", c("tags.mlflow.runName"), c("params.model_name"), c("metrics.accuracy_score")
    )


@register("run_completeness")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import comparable
    from evalspark.sources.runlog import group_sizes

    return group_sizes(comparable(spark, sf_dir))


@register("run_models")
def run_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import wide_runs
    from evalspark.sources.runlog import MODEL, RUN_NAME, c

    return wide_runs(spark, sf_dir).groupBy(c(MODEL)).agg(
        F.count(F.lit(1)).alias("n_runs"), F.countDistinct(c(RUN_NAME)).alias("n_run_names")
    )


def _scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.plans.runs import comparable

    return comparable(spark, sf_dir).select(
        "run_id",
        F.col("`params.model_name`").alias("model"),
        F.col("`tags.mlflow.runName`").alias("run_name"),
        F.col("`metrics.accuracy_score`").alias("accuracy"),
        F.col("`metrics.median_processing_time`").alias("median_processing_time"),
    )


@register("best_worst")
def best_worst_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import best_worst

    runs = _scored_runs(spark, sf_dir)
    return best_worst(runs, "model", "accuracy", ["run_name", "median_processing_time"], tiebreak="run_id")


@register("best_worst_split")
def best_worst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the medians refined by histograms, as for groups of any size."""
    from evalspark.operators.stats import best_worst

    runs = _scored_runs(spark, sf_dir)
    return best_worst(runs, "model", "accuracy", ["run_name", "median_processing_time"], tiebreak="run_id",
                      mode="distributed", cell_limit=2)


@register("boxplot")
def boxplot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.stats import boxplot_table
    from evalspark.plans.runs import comparable

    runs = comparable(spark, sf_dir).select(
        F.col("`params.model_name`").alias("model"), F.col("`metrics.accuracy_score`").alias("accuracy")
    )
    return boxplot_table(runs, "model", "accuracy")


@register("metric_pairs")
def metric_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.frames import metric_pairs
    from evalspark.plans.runs import PAIR_COLS, comparable

    return metric_pairs(comparable(spark, sf_dir), "params.model_name", "metrics.accuracy_score", PAIR_COLS)


@register("metric_correlations")
def metric_correlations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.frames import metric_correlations, metric_pairs
    from evalspark.plans.runs import PAIR_COLS, comparable

    pairs = metric_pairs(comparable(spark, sf_dir), "params.model_name", "metrics.accuracy_score", PAIR_COLS)
    out = metric_correlations(pairs, "params.model_name")
    return out.withColumn("corr", F.round("corr", 10))


def _long(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    from evalspark.operators.frames import long_runs
    from evalspark.plans.runs import BAR_COLS, LINE_COLS, comparable

    return long_runs(comparable(spark, sf_dir), "params.model_name", "tags.mlflow.runName", LINE_COLS, BAR_COLS, order)


@register("long_runs_aabb")
def long_runs_aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, "aabb")


@register("long_runs_abab")
def long_runs_abab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, "abab")


# ------------------------------------------------------------------ comparing runs

PAIR_SHIFTS = (0, 1, 3)  # three stub "models" over the same labelled examples


def _per_example_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt token count per labelled example: computed on the documents side, then the narrow rows
    are joined to the truth table (the text never crosses a shuffle)."""
    docs = infer.prompt_tokens(docs_for_truth(spark, sf_dir, extra=("n_chars",)), fields={"review": F.col("review")})
    narrow = docs.select("example_id", "n_chars", "input_token_count")
    return narrow.join(truth_table(spark, sf_dir), "example_id").select(
        "example_id", "true_label", "n_chars", "input_token_count")


def _multi_run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus scored by several stub runs in ONE pass: the run list is exploded in place
    (no join), key ``(run_id, example_id)``."""
    per_example = _per_example_tokens(spark, sf_dir)
    runs = infer.explode_grid(per_example, [{"run_id": f"stub-shift{s}", "shift": s} for s in PAIR_SHIFTS])
    return infer.score_stub(runs, shift=F.col("shift"), keep=("run_id", "true_label"),
                            input_tokens=F.col("input_token_count"))


@register("paired_comparison")
def paired_comparison_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.compare import correctness, paired_comparison

    scored = correctness(_multi_run_predictions(spark, sf_dir))
    return paired_comparison(scored, [f"stub-shift{s}" for s in PAIR_SHIFTS])


@register("required_n")
def required_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.compare import correctness, paired_comparison, with_required_n

    scored = correctness(_multi_run_predictions(spark, sf_dir))
    pairs = paired_comparison(scored, [f"stub-shift{s}" for s in PAIR_SHIFTS])
    return with_required_n(pairs, mu=0.03, alpha=0.05, power=0.9).select("run_a", "run_b", "variance", "required_n")


GRID = infer.parameter_grid(temperature=[0.2, 0.5, 0.8], top_k=[20, 40, 80], top_p=[0.9, 0.95, 1.0])


def grid_shift():
    """The stub's answer depends on the sampling parameters (they reach the predictor, unlike Q4)."""
    return F.col("top_k") + F.round(F.col("temperature") * 10).cast("int") + F.round(F.col("top_p") * 100).cast("int")


@register("grid_eval")
def grid_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-3 + INF-5: every labelled example under each of 27 parameter points, evaluated per run in
    one aggregate (``by=[run_id, ...]``)."""
    per_example = _per_example_tokens(spark, sf_dir)
    runs = infer.explode_grid(per_example, GRID)
    scored = infer.score_stub(
        runs, shift=grid_shift(), keep=("run_id", "temperature", "top_k", "top_p", "true_label"),
        input_tokens=F.col("input_token_count"),
    )
    return evaluate(scored, by=["run_id", "temperature", "top_k", "top_p"])


# ------------------------------------------------------------------ topic exploration

K_VALUES = list(range(5, 201, 5))  # the reference's sweep
N_TOPICS = 50


@register("token_normalize")
def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.topics import normalize_tokens
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(normalize_tokens("text"), " ").alias("tokens"))


@register("token_stems")
def token_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.topics import normalize_tokens
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(normalize_tokens("text", stems=True), " ").alias("stems"))


def _bow(spark: SparkSession, sf_dir: str, stem: bool = False):
    from evalspark.operators.topics import bag_of_words, normalize_tokens
    from evalspark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", normalize_tokens("text", stems=stem).alias("tokens"))
    return bag_of_words(docs, "tokens", min_df=5, max_df=0.98)


@register("bag_of_words")
def bag_of_words_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    bow, terms = _bow(spark, sf_dir)
    return bow.select(
        "doc_id",
        F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_terms"),
        F.size("terms").cast("bigint").alias("n_distinct_terms"),
        F.lit(terms.count()).cast("bigint").alias("vocabulary_size"),
    )


@register("vocabulary")
def vocabulary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems' vocabulary: document frequencies and dense ids in the order of the terms."""
    return _bow(spark, sf_dir, stem=True)[1].select("term", "documents", "term_id")


@register("sparse_counts")
def sparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag of words as rows (document, term id, count)."""
    bow, _ = _bow(spark, sf_dir, stem=True)
    return bow.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("doc_id", "x.terms", "x.counts")


@register("topics")
def topics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.topics import topics

    out, _ = topics(*_bow(spark, sf_dir, stem=True), k=N_TOPICS, seed=42)
    return out.select(
        "doc_id",
        F.array_position("topic_vec", F.array_max("topic_vec")).cast("int").alias("top_topic"),
        F.aggregate("topic_vec", F.lit(0.0), lambda acc, x: acc + x).alias("topic_mass"),
    )


@register("topic_tokens")
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each document its topics account for: all that the vocabulary holds, in every pass."""
    from evalspark.operators.topics import topics

    out, _ = topics(*_bow(spark, sf_dir, stem=True), k=8, seed=42, passes=2, mass="mass")
    return out.select("doc_id", F.round("mass").cast("bigint").alias("n_tokens"))


@register("topic_passes")
def topic_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pass the tokens that the topic weights hold beyond their prior: each pass counts every token of every row."""
    from evalspark.operators import lda
    from evalspark.session import materialize

    bow, terms = _bow(spark, sf_dir, stem=True)
    bow, size = materialize(bow), terms.count()
    rows = [(p, round(float(lda.fit(bow, terms, 8, p, 42).totals.sum()) - size)) for p in (1, 2)]  # 8 priors of 1/8 a term
    return spark.createDataFrame(rows, "pass int, tokens bigint")


def _embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.sources.tables import table

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


@register("k_sweep")
def k_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.topics import k_sweep

    return k_sweep(_embedding_vectors(spark, sf_dir), "features", K_VALUES)


@register("sweep_sizes")
def sweep_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that the sweep assigned under each k, whether its clusters are at most k, and whether its silhouette is in range."""
    from evalspark.operators import clusters

    found = clusters.sweep(_embedding_vectors(spark, sf_dir), "features", K_VALUES)
    sizes = found.table(spark).groupBy("k").agg(F.sum("size").alias("vectors"), (F.count_if(F.col("size") > 0) <= F.col("k")).alias("at_most_k"))
    return sizes.join(found.silhouettes(spark), "k").select("k", "vectors", "at_most_k", F.col("silhouette").between(-1, 1).alias("in_range"))


@register("cluster_crosstab")
def cluster_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best k of the sweep, its centres taken over, then counts by (cluster, label) unstacked on label."""
    from evalspark.operators import clusters
    from evalspark.operators.stats import crosstab, pivot_values
    from evalspark.operators.topics import assign_clusters, best_k

    vecs = _embedding_vectors(spark, sf_dir)
    found = clusters.sweep(vecs, "features", K_VALUES)
    k = best_k(found.silhouettes(spark)).first()["best_k"]
    labels = pivot_values(vecs, "label")  # class labels: a checked, bounded list
    return crosstab(assign_clusters(vecs, "features", found.table(spark), k), "cluster", "label", labels, prefix="label_")


@register("topic_crosstab")
def topic_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on text: stems, bag of words, topics, sweep, clusters of the best k, counted by truth label."""
    from evalspark.operators.stats import crosstab
    from evalspark.operators.topics import topic_clusters
    from evalspark.sources.tables import table

    clustered, _, _ = topic_clusters(table(spark, sf_dir, "documents"), K_VALUES, k_topics=N_TOPICS)
    labelled = clustered.select(F.col("doc_id").alias("example_id"), "cluster").join(truth_table(spark, sf_dir), "example_id")
    return crosstab(labelled, "cluster", "true_label", [0, 1], prefix="label_")


@register("topic_cluster_labels")
def topic_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crosstab summed over the clusters: every labelled document is in one of them."""
    return topic_crosstab(spark, sf_dir).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("label_0", "label_1")])


# ------------------------------------------------------------------ scoring paths: Python predictor, stream


@register("score_python")
def score_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INF-1 through ``mapInArrow`` with a Python keyword predictor (elapsed time is measured, so it is
    left out of the compared columns)."""
    from evalspark.plans.jobs import keyword_predictor_factory

    corpus = labelled_corpus(spark, sf_dir)
    scored = infer.score(corpus, keyword_predictor_factory, fields={"review": F.col("review")}, keep=("true_label",))
    return scored.drop("elapsed_time")


@register("stream_scores")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: the stub scoring plan run as a Structured Streaming query (availableNow) over the
    documents file; returns the sink's contents."""
    import os

    from evalspark.session import new_scratch
    from evalspark.streaming.score_stream import score_table_stream

    base = new_scratch(spark)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    q = score_table_stream(spark, sf_dir, out, ckpt)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    return spark.read.parquet(out)


from evalspark.plans import roundtrips  # noqa: E402, F401  (registers the queries that write and read back)
