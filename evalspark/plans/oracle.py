"""DuckDB SQL twins of the registered queries (same column names, same semantics).

Shared fragments are built by small functions so the stub predictor, template rendering and parser are
written once. DuckDB specifics: regexp_replace needs 'g'; x / nullif(y, 0) for NULL-on-zero;
quantile_cont for the interpolated median; lists are 1-based.
"""

from __future__ import annotations

from evalspark.functions.parse import DEFAULT_MAPPING
from evalspark.functions.stub import STUB_RESPONSES
from evalspark.functions.text import WORD_PATTERN, _parse_template
from evalspark.operators.infer import DEFAULT_TEMPLATE
from evalspark.operators.metrics import METRIC_NAMES
from evalspark.plans.queries import COT_MARKER, FEW_SHOT_BASE

ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, {q(WORD_PATTERN)})"


def word_count_sql(expr: str) -> str:
    return f"len({words_sql(expr)})"


def render_sql(template: str, fields: dict[str, str]) -> str:
    pieces = []
    for literal, field in _parse_template(template):
        if literal:
            pieces.append(q(literal))
        if field is not None:
            pieces.append(f"CAST({fields.get(field, field)} AS VARCHAR)")
    return "(" + " || ".join(pieces) + ")"


def stub_response_sql(key: str, words: str, shift: str = "0") -> str:
    arr = "[" + ", ".join(q(r) for r in STUB_RESPONSES) + "]"
    return f"({arr})[CAST(({key} + coalesce({words}, 0) + {shift}) % {len(STUB_RESPONSES)} + 1 AS INTEGER)]"


def parse_sql(raw: str, mapping: dict[str, int] | None = None, prefix: str = "") -> str:
    """label / is_hallucination / is_wrong_format select-list for the default prune pattern."""
    mapping = DEFAULT_MAPPING if mapping is None else mapping
    s = f"trim(regexp_replace({raw}, '[^a-zA-Z0-9]', ' ', 'g'))"
    multi = f"position(' ' IN {s}) > 0"
    keys = ", ".join(q(k) for k in mapping)
    label_case = " ".join(f"WHEN {s} = {q(k)} THEN {v}" for k, v in mapping.items())
    return (
        f"CAST(CASE WHEN {raw} IS NULL OR {multi} THEN -1 {label_case} ELSE -1 END AS INTEGER) AS {prefix}label, "
        f"CASE WHEN {raw} IS NULL OR {multi} THEN false WHEN {s} IN ({keys}) THEN false ELSE true END "
        f"AS {prefix}is_hallucination, "
        f"CASE WHEN {raw} IS NULL OR {multi} THEN true ELSE false END AS {prefix}is_wrong_format"
    )


CORPUS_CTE = (
    "corpus AS (SELECT d.doc_id AS example_id, d.text AS review, d.lang, d.source, d.n_chars, "
    "CAST(1 - l.quality AS INTEGER) AS true_label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def preds_cte(name: str = "preds", shift: str = "0", source: str = "corpus", review: str = "review",
              template: str = DEFAULT_TEMPLATE, extra: str = "") -> str:
    """Stub predictions over ``source`` (needs example_id, review, n_chars)."""
    prompt = render_sql(template, {"review": review})
    return (
        f"{name}_raw AS (SELECT *{extra}, {word_count_sql(prompt)} AS input_token_count, "
        f"n_chars / CAST(1000.0 AS DOUBLE) AS elapsed_time FROM {source}), "
        f"{name}_said AS (SELECT *, {stub_response_sql('example_id', 'input_token_count', shift)} AS output_string FROM {name}_raw), "
        f"{name} AS (SELECT *, {word_count_sql('output_string')} AS output_token_count, {parse_sql('output_string')} FROM {name}_said)"
    )


def ratio(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif({den}, 0)"


def median_sql(expr: str) -> str:
    return f"quantile_cont(CAST({expr} AS DOUBLE), 0.5)"


def metrics_sql(y: str = "true_label", p: str = "label") -> str:
    recall = ratio(f"count(*) FILTER (WHERE {p} = 0 AND {y} = 0)", f"count(*) FILTER (WHERE {y} = 0)")
    return ", ".join(
        [
            f"{ratio(f'count(*) FILTER (WHERE {p} = {y})', 'count(*)')} AS accuracy_score",
            f"{ratio(f'count(*) FILTER (WHERE {p} = 0 AND {y} = 0)', f'count(*) FILTER (WHERE {p} = 0)')} AS precision",
            f"{recall} AS recall",
            f"1.0 - {recall} AS false_negative_rate",
            f"{ratio(f'count(*) FILTER (WHERE {p} = 0 AND {y} = 1)', f'count(*) FILTER (WHERE {y} = 1)')} "
            "AS false_positive_rate",
            f"{median_sql('output_token_count')} AS median_response_token_count",
            f"{median_sql('input_token_count')} AS median_query_token_count",
            f"{median_sql('elapsed_time')} AS median_processing_time",
            f"{median_sql('(output_token_count + output_token_count) / (elapsed_time + 1e-9)')} "
            "AS median_tokens_per_second",
            f"{ratio('count(*) FILTER (WHERE is_hallucination)', 'count(*)')} AS hallucination_rate",
            f"{ratio('count(*) FILTER (WHERE is_wrong_format)', 'count(*)')} AS bad_output_format_rate",
            "count(*) AS n",
        ]
    )


ORACLE["eval_metrics"] = f"WITH {CORPUS_CTE}, {preds_cte()} SELECT {metrics_sql()} FROM preds"
ORACLE["eval_by_source"] = f"WITH {CORPUS_CTE}, {preds_cte()} SELECT source, {metrics_sql()} FROM preds GROUP BY source"

ORACLE["word_counts"] = f"SELECT doc_id, {word_count_sql('text')} AS n_words FROM documents"


def crop_sql(text: str, head: int | float, tail: int | float) -> str:
    toks = words_sql(text)
    n = f"len({toks})"
    h = f"CAST(floor({n} * {head!r}) AS INTEGER)" if isinstance(head, float) else str(int(head))
    t = f"CAST(floor({n} * {tail!r}) AS INTEGER)" if isinstance(tail, float) else str(int(tail))
    head_part = f"{toks}[1:{h}]"
    tail_part = f"CASE WHEN {t} = 0 OR {t} >= {n} THEN {toks} ELSE {toks}[{n} - {t} + 1:] END"
    return f"CASE WHEN {text} IS NULL THEN NULL ELSE array_to_string(list_concat({head_part}, {tail_part}), ' ') END"


ORACLE["crop_int"] = f"SELECT doc_id, {crop_sql('text', 30, 30)} AS cropped FROM documents"
ORACLE["crop_fraction"] = (
    f"SELECT doc_id, cropped, {word_count_sql('cropped')} AS n_words "
    f"FROM (SELECT doc_id, {crop_sql('text', 0.2, 0.2)} AS cropped FROM documents)"
)


# ------------------------------------------------------------------ parsers

def cot_response_sql() -> str:
    M = COT_MARKER
    resp = stub_response_sql("doc_id", word_count_sql("text"))
    lead = "text"
    return (
        f"CASE doc_id % 4 WHEN 0 THEN {lead} || {q(' ' + M + ' ')} || {resp} "
        f"WHEN 1 THEN {lead} || {q(f' {M} negative, but then {M} ')} || {resp} "
        f"WHEN 2 THEN {lead} || {q(' ' + M)} ELSE {lead} END"
    )


def parse_cot_sql(raw: str, marker: str) -> str:
    import re as _re

    tail = f"{q(marker[-1])} || regexp_extract({raw}, {q('(?s).*' + _re.escape(marker) + '(.*)$')}, 1)"
    inner = parse_sql("_tail")
    return (
        f"SELECT * EXCLUDE (_tail, label, is_hallucination, is_wrong_format), "
        f"CASE WHEN _has THEN label ELSE -1 END AS label, "
        f"CASE WHEN _has THEN is_hallucination ELSE false END AS is_hallucination, "
        f"CASE WHEN _has THEN is_wrong_format ELSE true END AS is_wrong_format "
        f"FROM (SELECT *, {inner} FROM (SELECT *, {tail} AS _tail FROM src))"
    )


ORACLE["parse_basic"] = (
    f"SELECT doc_id, output_string, {parse_sql('output_string')} "
    f"FROM (SELECT doc_id, {stub_response_sql('doc_id', word_count_sql('text'))} AS output_string FROM documents)"
)

ORACLE["parse_cot"] = (
    "WITH src AS (SELECT doc_id, output_string, output_string IS NOT NULL AND strpos(output_string, "
    + q(COT_MARKER) + ") > 0 AS _has FROM (SELECT doc_id, " + cot_response_sql() + " AS output_string "
    "FROM documents)) SELECT doc_id, output_string, label, is_hallucination, is_wrong_format FROM ("
    + parse_cot_sql("output_string", COT_MARKER) + ")"
)

_JSON_RESP = (
    "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'The answer is ' || props || ' as requested.' "
    "WHEN 2 THEN replace(props, '\"', '''') ELSE props || ' and {\"k\": \"late\"}' END"
)
_JSON_SLICE = (
    "CASE WHEN strpos(output_string, '{') > 0 AND strpos(output_string, '}') > 0 "
    "AND length(output_string) - strpos(reverse(output_string), '}') + 1 >= strpos(output_string, '{') "
    "THEN substring(output_string, strpos(output_string, '{'), length(output_string) - strpos(reverse(output_string), '}') "
    "+ 1 - strpos(output_string, '{') + 1) ELSE '' END"
)
ORACLE["parse_json"] = (
    f"SELECT event_id, output_string, CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' "
    f"THEN json_extract_string(s, '$.k') END AS k "
    f"FROM (SELECT *, {_JSON_SLICE} AS s FROM (SELECT event_id, {_JSON_RESP} AS output_string FROM events))"
)

ORACLE["parse_json_jvm"] = ORACLE["parse_json"]


# ------------------------------------------------------------------ prompts and chat

def _few_shot_sql(seed: int = 7, per_class: int = 1) -> str:
    """The rendered few-shot prompt (examples inlined verbatim) as a SQL expression over ``text``."""
    ex = (
        f"(SELECT string_agg('- ' || upper(name) || ' (' || name || '): \"' || t || '\"', chr(10) "
        f"ORDER BY rn, true_label DESC) FROM (SELECT true_label, "
        f"CASE WHEN true_label = 1 THEN 'negative' ELSE 'positive' END AS name, {crop_sql('review', 20, 20)} AS t, "
        f"row_number() OVER (PARTITION BY true_label ORDER BY md5('{seed}:' || CAST(example_id AS VARCHAR)), example_id) AS rn "
        f"FROM corpus) WHERE rn <= {per_class})"
    )
    return render_sql(FEW_SHOT_BASE, {"review": "text", "examples": ex})


ORACLE["prompt_render"] = (
    f"WITH {CORPUS_CTE}, p AS (SELECT doc_id, {_few_shot_sql()} AS prompt FROM documents) "
    f"SELECT doc_id, length(prompt) AS prompt_chars, {word_count_sql('prompt')} AS prompt_words, "
    f"md5(prompt) AS prompt_md5 FROM p"
)


def _system_prompt() -> str:
    from evalspark.operators.infer import DEFAULT_SYSTEM_PROMPT

    return DEFAULT_SYSTEM_PROMPT


ORACLE["chat_messages"] = (
    f"SELECT conv_id, turn, 2 AS n_messages, 'system: ' || {q(_system_prompt())} || chr(10) || 'user: ' || text AS chat "
    "FROM conversations"
)


# ------------------------------------------------------------------ statistics

ORACLE["label_counts"] = f"WITH {CORPUS_CTE} SELECT true_label, count(*) AS count FROM corpus GROUP BY true_label"
ORACLE["label_crosstab"] = (
    f"WITH {CORPUS_CTE} SELECT lang, "
    "CASE WHEN count(*) FILTER (WHERE true_label = 0) > 0 THEN count(*) FILTER (WHERE true_label = 0) END AS label_0, "
    "CASE WHEN count(*) FILTER (WHERE true_label = 1) > 0 THEN count(*) FILTER (WHERE true_label = 1) END AS label_1 "
    "FROM corpus GROUP BY lang"
)
ORACLE["errors"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()} SELECT label, count(*) AS count FROM preds "
    "WHERE label IS DISTINCT FROM true_label GROUP BY label"
)
ORACLE["error_rows"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()} SELECT example_id, true_label, label, output_string FROM preds "
    "WHERE label IS DISTINCT FROM true_label"
)
ORACLE["failures"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()} SELECT example_id, output_string, is_hallucination, is_wrong_format "
    "FROM preds WHERE is_hallucination OR is_wrong_format"
)

WORDS_CTE = f"wc AS (SELECT doc_id, lang, {word_count_sql('text')} AS n_words FROM documents)"


def hist_ctes(src: str = "wc", x: str = "n_words", bins: int = 100, by: str = "", rng_src: str | None = None) -> str:
    """numpy-exact equal-width binning; defines rng(lo, hi, step), binned(*, bin), hist(by.., bin, bin_lo, bin_hi, count)."""
    rng_src = rng_src or src
    by_sel = f"{by}, " if by else ""
    frame = f"(SELECT DISTINCT {by} FROM {src}) g, " if by else ""
    join_on = " AND ".join([f"f.{c} = c.{c}" for c in by.split(", ")] + ["f.bin = c.bin"]) if by else "f.bin = c.bin"
    by_f = ", ".join(f"f.{c}" for c in by.split(", ")) + ", " if by else ""
    edge = "CASE WHEN {i} >= %d THEN hi ELSE CAST({i} AS DOUBLE) * step + lo END" % bins
    return (
        f"rng0 AS (SELECT CAST(min({x}) AS DOUBLE) AS mn, CAST(max({x}) AS DOUBLE) AS mx FROM {rng_src}), "
        f"rng AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, "
        f"(CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END - CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END) / {bins}.0 AS step FROM rng0), "
        f"b0 AS (SELECT s.*, rng.*, CAST(floor(((CAST({x} AS DOUBLE) - lo) / (hi - lo)) * {bins}) AS INTEGER) AS i0 "
        f"FROM {src} s, rng WHERE {x} >= lo AND {x} <= hi), "
        f"b1 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM b0), "
        f"b2 AS (SELECT *, CASE WHEN {x} < {edge.format(i='i1')} THEN i1 - 1 ELSE i1 END AS i2 FROM b1), "
        f"binned AS (SELECT * EXCLUDE (i0, i1, i2, lo, hi, step), CASE WHEN {x} >= {edge.format(i='(i2 + 1)')} AND i2 <> {bins - 1} "
        f"THEN i2 + 1 ELSE i2 END AS bin FROM b2), "
        f"hcnt AS (SELECT {by_sel}bin, count(*) AS count FROM binned GROUP BY ALL), "
        f"hist AS (SELECT {by_f}CAST(f.bin AS INTEGER) AS bin, CAST(f.bin AS DOUBLE) * step + lo AS bin_lo, "
        f"CASE WHEN f.bin = {bins - 1} THEN hi ELSE CAST(f.bin + 1 AS DOUBLE) * step + lo END AS bin_hi, "
        f"coalesce(c.count, 0) AS count FROM (SELECT {by_sel}range AS bin FROM {frame}range(0, {bins})) f "
        f"CROSS JOIN rng LEFT JOIN hcnt c ON {join_on})"
    )


ORACLE["length_histogram"] = f"WITH {WORDS_CTE}, {hist_ctes()} SELECT * FROM hist"
ORACLE["length_histogram_by_class"] = (
    f"WITH {WORDS_CTE}, {CORPUS_CTE}, cw AS (SELECT true_label, {word_count_sql('review')} AS n_words FROM corpus), "
    f"{hist_ctes(src='cw', by='true_label', rng_src='wc')} SELECT * FROM hist"
)

SIZE_GROUP_CTES = (
    f"{WORDS_CTE}, {hist_ctes()}, "
    "edges AS (SELECT bin_hi AS e FROM hist WHERE count > 100 UNION ALL SELECT hi FROM rng), "
    "sg AS (SELECT doc_id, n_words, CAST((SELECT count(*) FROM edges WHERE e < CAST(wc.n_words AS DOUBLE)) AS INTEGER) "
    "AS size_group FROM wc)"
)
ORACLE["size_groups"] = f"WITH {SIZE_GROUP_CTES} SELECT doc_id, n_words, size_group FROM sg"

ORACLE["length_quantiles"] = (
    f"WITH {WORDS_CTE} SELECT lang, count(n_words) AS n_words, CAST(min(n_words) AS DOUBLE) AS min_words, "
    "quantile_cont(CAST(n_words AS DOUBLE), 0.25) AS q1_words, quantile_cont(CAST(n_words AS DOUBLE), 0.5) AS median_words, "
    "quantile_cont(CAST(n_words AS DOUBLE), 0.75) AS q3_words, CAST(max(n_words) AS DOUBLE) AS max_words FROM wc GROUP BY lang"
)


# ------------------------------------------------------------------ sampling

def sample_sql(n_expr: str, within: bool, seed: int = 42) -> str:
    """CTEs base/q/ranked for the exact proportional sample (largest remainder, ties by stratum key)."""
    part = "PARTITION BY true_label " if within else ""
    return (
        f"{CORPUS_CTE}, {SIZE_GROUP_CTES}, "
        "base AS (SELECT c.example_id, c.review, c.true_label, sg.size_group FROM corpus c JOIN sg ON sg.doc_id = c.example_id), "
        "cnt AS (SELECT true_label, size_group, count(*) AS size FROM base GROUP BY ALL), "
        f"tot AS (SELECT *, sum(size) OVER ({part}) AS total FROM cnt), "
        f"q0 AS (SELECT *, {n_expr} AS n FROM tot), "
        "q1 AS (SELECT *, (n * size) // total AS fl, (n * size) % total AS rem FROM q0), "
        f"q AS (SELECT true_label, size_group, fl + CASE WHEN row_number() OVER ({part}ORDER BY rem DESC, true_label, size_group) "
        f"<= n - sum(fl) OVER ({part}) THEN 1 ELSE 0 END AS quota FROM q1), "
        "ranked AS (SELECT base.*, row_number() OVER (PARTITION BY true_label, size_group "
        f"ORDER BY md5('{seed}:' || CAST(example_id AS VARCHAR)), example_id) AS rn FROM base)"
    )


ORACLE["stratified_sample"] = (
    f"WITH {sample_sql('CAST(ceil(0.25 * total) AS BIGINT)', False)} "
    "SELECT example_id, true_label, size_group FROM ranked JOIN q USING (true_label, size_group) WHERE rn <= quota"
)
ORACLE["sample_complement"] = (
    f"WITH {sample_sql('CAST(ceil(0.25 * total) AS BIGINT)', False)} "
    "SELECT example_id, true_label, size_group FROM ranked JOIN q USING (true_label, size_group) WHERE rn > quota"
)
ORACLE["balanced_sample"] = (
    f"WITH {sample_sql('25', True)} "
    "SELECT example_id, review, true_label FROM ranked JOIN q USING (true_label, size_group) WHERE rn <= quota"
)


# ------------------------------------------------------------------ run log

def _runs_sql() -> str:
    from evalspark.operators.metrics import METRIC_NAMES
    from evalspark.plans.runs import T0

    mcols = []
    for m in METRIC_NAMES:
        null_for = "(11, 12)" if m == "precision" else "(12)"
        mcols.append(f'CASE WHEN _n IN {null_for} THEN NULL ELSE {m} END AS "metrics.{m}"')
    return (
        f"{CORPUS_CTE}, {preds_cte()}, "
        f"ev AS (SELECT source, {metrics_sql()} FROM preds GROUP BY source), "
        "evn AS (SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS _n, md5('run:' || source) AS run_id FROM ev), "
        "named AS (SELECT *, CASE WHEN _n < 16 THEN 'prompt-' || CAST(_n // 2 AS VARCHAR) "
        "WHEN _n < 18 THEN 'grid-t0.' || CAST(_n - 11 AS VARCHAR) || '-k40' WHEN _n = 18 THEN 'prompt-0 FULL_DATA' "
        "ELSE 'prompt-deleted' END AS run_name FROM evn), "
        f"wide AS (SELECT run_id, '1' AS experiment_id, run_name, 'active' AS lifecycle_stage, 3 AS status, "
        f"CAST({T0} AS BIGINT) AS start_time, {', '.join(mcols)}, "
        "CASE WHEN _n % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS \"params.model_name\", "
        "CASE WHEN _n IN (14, 15) THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS \"params.temperature\", "
        "CAST(40 AS DOUBLE) AS \"params.top_k\", CAST(0.95 AS DOUBLE) AS \"params.top_p\", "
        "run_name AS \"tags.mlflow.runName\", 'derived from ' || source AS \"tags.justification\" "
        "FROM named WHERE _n <> 19), "
        "comp AS (SELECT * FROM wide WHERE NOT regexp_matches(\"tags.mlflow.runName\", 't\\d') "
        "AND NOT contains(\"tags.mlflow.runName\", 'FULL_DATA') AND \"params.temperature\" = CAST(0.2 AS DOUBLE) "
        "AND \"params.top_p\" = CAST(0.95 AS DOUBLE) AND \"params.top_k\" = CAST(40 AS DOUBLE))"
    )


RUNS_SQL = _runs_sql()
ORACLE["run_search"] = f"WITH {RUNS_SQL} SELECT * FROM wide"
ORACLE["orphan_runs"] = (
    f"WITH {RUNS_SQL} SELECT '1' AS experiment_id, md5('run:orphan-' || source) AS run_id FROM evn WHERE _n = 0 "
    "AND _n <> 12"
)
ORACLE["comparable_runs"] = (
    f'WITH {RUNS_SQL} SELECT run_id, "tags.mlflow.runName", "params.model_name", "metrics.accuracy_score" FROM comp'
)
ORACLE["run_completeness"] = (
    f'WITH {RUNS_SQL} SELECT "tags.mlflow.runName", "params.model_name", count(*) AS count FROM comp '
    'WHERE "tags.mlflow.runName" IS NOT NULL AND "params.model_name" IS NOT NULL GROUP BY ALL'
)
ORACLE["run_models"] = (
    f'WITH {RUNS_SQL} SELECT "params.model_name", count(*) AS n_runs, count(DISTINCT "tags.mlflow.runName") '
    "AS n_run_names FROM wide GROUP BY ALL"
)
ORACLE["best_worst"] = (
    f"WITH {RUNS_SQL}, cr AS (SELECT run_id, \"params.model_name\" AS model, \"tags.mlflow.runName\" AS run_name, "
    "\"metrics.accuracy_score\" AS accuracy, \"metrics.median_processing_time\" AS median_processing_time FROM comp "
    "WHERE \"metrics.accuracy_score\" IS NOT NULL), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, run_id) AS rb, "
    "row_number() OVER (PARTITION BY model ORDER BY accuracy ASC, run_id) AS rw FROM cr) "
    "SELECT model, max(CASE WHEN rb = 1 THEN accuracy END) AS best_accuracy, max(CASE WHEN rb = 1 THEN run_name END) AS best_run_name, "
    "max(CASE WHEN rb = 1 THEN median_processing_time END) AS best_median_processing_time, "
    "max(CASE WHEN rw = 1 THEN accuracy END) AS worst_accuracy, max(CASE WHEN rw = 1 THEN run_name END) AS worst_run_name, "
    "max(CASE WHEN rw = 1 THEN median_processing_time END) AS worst_median_processing_time, "
    "quantile_cont(accuracy, 0.5) AS median_accuracy FROM b GROUP BY model"
)
ORACLE["boxplot"] = (
    f"WITH {RUNS_SQL}, x AS (SELECT \"params.model_name\" AS model, \"metrics.accuracy_score\" AS v FROM comp), "
    "qq AS (SELECT model, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
    "quantile_cont(v, 0.75) AS q3 FROM x GROUP BY model), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qq) "
    "SELECT f.model, n, q1, median, q3, min(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_lo, "
    "max(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_hi, count(*) FILTER (WHERE NOT (v >= lo AND v <= hi)) AS n_fliers "
    "FROM f JOIN x ON f.model = x.model GROUP BY f.model, n, q1, median, q3"
)


def _pairs_sql() -> str:
    from evalspark.plans.runs import PAIR_COLS

    parts = [
        f'SELECT "params.model_name", run_id, "metrics.accuracy_score" AS x, {q(m)} AS metric, "{m}" AS y FROM comp'
        for m in PAIR_COLS
    ]
    return " UNION ALL ".join(parts)


ORACLE["metric_pairs"] = f"WITH {RUNS_SQL} {_pairs_sql()}"
ORACLE["metric_correlations"] = (
    f'WITH {RUNS_SQL}, p AS ({_pairs_sql()}) SELECT "params.model_name", metric, count(y) AS n, '
    "round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 10) AS corr FROM p GROUP BY ALL"
)


def _long_sql(criterion: str, label: str) -> str:
    from evalspark.plans.runs import LINE_COLS

    lines = ", ".join(f'"{c}"' for c in LINE_COLS)
    return (
        f"WITH {RUNS_SQL}, g AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"{criterion}\" "
        "ORDER BY start_time DESC, run_id) - 1 AS INTEGER) AS group_id FROM comp) "
        f"SELECT \"{criterion}\", group_id, \"{label}\", {lines}, 'metrics.accuracy_score' AS metric, "
        "\"metrics.accuracy_score\" AS value FROM g"
    )


ORACLE["long_runs_aabb"] = _long_sql("params.model_name", "tags.mlflow.runName")
ORACLE["long_runs_abab"] = _long_sql("tags.mlflow.runName", "params.model_name")


# ------------------------------------------------------------------ comparing runs

def _multi_preds_sql() -> str:
    from evalspark.plans.queries import PAIR_SHIFTS

    runs = " UNION ALL ".join(f"SELECT 'stub-shift{s}' AS run_id, {s} AS shift" for s in PAIR_SHIFTS)
    return (
        f"{CORPUS_CTE}, grid AS ({runs}), cg AS (SELECT corpus.*, grid.* FROM corpus, grid), "
        f"{preds_cte(shift='shift', source='cg')}, "
        "c AS (SELECT run_id, example_id, CAST(coalesce(label = true_label, false) AS INTEGER) AS ok FROM preds), "
        "pairs AS (SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) AS n, "
        "count(*) FILTER (WHERE a.ok = 1 AND b.ok = 0) AS ab, count(*) FILTER (WHERE a.ok = 0 AND b.ok = 1) AS ba "
        "FROM c a JOIN c b ON a.example_id = b.example_id AND a.run_id < b.run_id GROUP BY 1, 2), "
        "pc AS (SELECT run_a, run_b, n, CAST(ab AS DOUBLE) / nullif(n, 0) AS p_a_not_b, CAST(ba AS DOUBLE) / nullif(n, 0) "
        "AS p_b_not_a, CAST(ab - ba AS DOUBLE) / nullif(n, 0) AS accuracy_diff FROM pairs)"
    )


ORACLE["paired_comparison"] = (
    f"WITH {_multi_preds_sql()} SELECT *, p_a_not_b + p_b_not_a AS variance FROM pc"
)


def _required_n_sql() -> str:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - 0.05 / 2) + NormalDist().inv_cdf(0.9)
    k = z * z / (0.03 * 0.03)
    return (
        f"WITH {_multi_preds_sql()} SELECT run_a, run_b, p_a_not_b + p_b_not_a AS variance, "
        f"CAST(ceil(CAST({k!r} AS DOUBLE) * (p_a_not_b + p_b_not_a)) AS BIGINT) AS required_n FROM pc"
    )


ORACLE["required_n"] = _required_n_sql()


def _grid_sql() -> str:
    from evalspark.plans.queries import GRID

    rows = " UNION ALL ".join(
        f"SELECT {q(p['run_id'])} AS run_id, CAST({p['temperature']!r} AS DOUBLE) AS temperature, "
        f"{int(p['top_k'])} AS top_k, CAST({p['top_p']!r} AS DOUBLE) AS top_p"
        for p in GRID
    )
    shift = "(top_k + CAST(round(temperature * 10) AS INTEGER) + CAST(round(top_p * 100) AS INTEGER))"
    return (
        f"WITH {CORPUS_CTE}, grid AS ({rows}), cg AS (SELECT corpus.*, grid.* FROM corpus, grid), "
        f"{preds_cte(shift=shift, source='cg')} "
        f"SELECT run_id, temperature, top_k, top_p, {metrics_sql()} FROM preds GROUP BY ALL"
    )


ORACLE["grid_eval"] = _grid_sql()


# ------------------------------------------------------------------ topic exploration

ORACLE["token_normalize"] = (
    "SELECT doc_id, array_to_string(list_transform(list_filter(list_transform("
    f"{words_sql('text')}, lambda x: regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')), "
    "lambda x: regexp_full_match(x, '\\p{L}+')), lambda x: lower(x)), ' ') AS tokens FROM documents"
)


# ------------------------------------------------------------------ scoring paths

def _score_python_sql() -> str:
    cues = ("bad", "worst", "terrible", "boring", "awful")
    prompt = render_sql(DEFAULT_TEMPLATE, {"review": "review"})
    cond = " OR ".join(f"contains(lower(prompt), {q(c)})" for c in cues)
    return (
        f"WITH {CORPUS_CTE}, p AS (SELECT example_id, true_label, {prompt} AS prompt FROM corpus), "
        f"r AS (SELECT example_id, true_label, CASE WHEN {cond} THEN 'negative' ELSE 'positive' END AS output_string, "
        f"{word_count_sql('prompt')} AS input_token_count FROM p) "
        f"SELECT example_id, true_label, output_string, input_token_count, CAST(1 AS BIGINT) AS output_token_count, "
        f"{parse_sql('output_string')} FROM r"
    )


ORACLE["score_python"] = _score_python_sql()
ORACLE["stream_scores"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()} SELECT example_id, true_label, output_string, input_token_count, "
    "output_token_count, elapsed_time, label, is_hallucination, is_wrong_format FROM preds"
)

TOKENS_SQL = (
    "list_transform(list_filter(list_transform("
    f"{words_sql('text')}, lambda x: regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')), "
    "lambda x: regexp_full_match(x, '\\p{L}+')), lambda x: lower(x))"
)


def _stem_ctes(words: str) -> str:
    """CTEs that end in ``stems`` (w, stem) over the distinct words w of the relation ``words``."""
    from evalspark.operators import stemming as st

    def cases(values: dict[str, str], of: str) -> str:
        return f"CASE {of} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"

    def step(name: str, before: str, suffixes, word: str, done: str = "false") -> str:
        pattern = q("^.*?(" + "|".join(suffixes) + ")$")
        return (
            f"{name}_s AS (SELECT *, regexp_extract(t, {pattern}, 1) AS s FROM {before}), "
            f"{name}_b AS (SELECT *, left(t, length(t) - length(s)) AS b FROM {name}_s), "
            f"{name} AS (SELECT w, r1, r2, CASE WHEN done OR s = '' THEN t ELSE {word} END AS t, done OR {done} AS done FROM {name}_b)"
        )

    vowel, short = "'[aeiouy]'", q("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
    region = "'^.*?[aeiouy][^aeiouy]'"
    in1, in2 = "length(b) >= r1", "length(b) >= r2"
    cut = (
        "CASE WHEN regexp_matches(b, '(?:at|bl|iz)$') THEN b || 'e' "
        "WHEN regexp_matches(b, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, length(b) - 1) "
        f"WHEN regexp_matches(b, {short}) AND length(b) <= r1 THEN b || 'e' ELSE b END"
    )
    stay = "[" + ", ".join(map(q, st.UNCHANGED_AFTER_1A)) + "]"
    word_1a = (
        "CASE WHEN s = 'sses' THEN b || 'ss' WHEN s IN ('ied', 'ies') THEN b || CASE WHEN length(b) > 1 THEN 'i' ELSE 'ie' END "
        "WHEN s = 's' AND regexp_matches(b, '[aeiouy].+$') THEN b ELSE t END"
    )
    return ", ".join(
        [
            f"x0 AS (SELECT DISTINCT w, {cases(st.EXCEPTIONS, 'w')} AS fixed, regexp_replace(w, '(^|[aeiouy])y', '\\1Y', 'g') AS m FROM {words})",
            f"x1 AS (SELECT *, CASE WHEN regexp_matches(m, '^({'|'.join(st.R1_PREFIXES)})') THEN regexp_extract(m, '^({'|'.join(st.R1_PREFIXES)})') "
            f"ELSE regexp_extract(m, {region}) END AS head FROM x0)",
            "x2 AS (SELECT *, CASE WHEN head <> '' THEN length(head) ELSE length(w) END AS r1 FROM x1)",
            f"x3 AS (SELECT *, regexp_extract(substr(m, r1 + 1), {region}) AS rest FROM x2)",
            "x4 AS (SELECT w, r1, CASE WHEN head <> '' AND rest <> '' THEN r1 + length(rest) ELSE length(w) END AS r2, "
            "coalesce(fixed, CASE WHEN length(w) <= 2 THEN w ELSE m END) AS t, fixed IS NOT NULL OR length(w) <= 2 AS done FROM x3)",
            step("y1a", "x4", ["sses", "ied", "ies", "us", "ss", "s"], word_1a, f"(s <> '' AND list_contains({stay}, {word_1a}) OR list_contains({stay}, t))"),
            step("y1b", "y1a", ["eed", "eedly", "ed", "edly", "ing", "ingly"],
                 f"CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {in1} THEN b || 'ee' ELSE t END WHEN regexp_matches(b, {vowel}) THEN {cut} ELSE t END"),
            step("y1c", "y1b", ["y", "Y"], "CASE WHEN regexp_matches(b, '.[^aeiouy]$') THEN b || 'i' ELSE t END"),
            step("y2", "y1c", list(st.STEP_2),
                 f"CASE WHEN {in1} AND CASE s WHEN 'ogi' THEN suffix(b, 'l') WHEN 'li' THEN regexp_matches(b, '[cdeghkmnrt]$') ELSE true END "
                 f"THEN b || {cases(st.STEP_2, 's')} ELSE t END"),
            step("y3", "y2", list(st.STEP_3), f"CASE WHEN CASE s WHEN 'ative' THEN {in2} ELSE {in1} END THEN b || {cases(st.STEP_3, 's')} ELSE t END"),
            step("y4", "y3", st.STEP_4, f"CASE WHEN {in2} AND (s <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE t END"),
            step("y5", "y4", ["e", "l"],
                 f"CASE WHEN CASE s WHEN 'e' THEN {in2} OR ({in1} AND NOT regexp_matches(b, {short})) ELSE {in2} AND suffix(b, 'l') END THEN b ELSE t END"),
            "stems AS (SELECT w, CASE WHEN done THEN t ELSE replace(t, 'Y', 'y') END AS stem FROM y5)",
        ]
    )


def _tokens_cte(stem: bool) -> str:
    """``docs`` (doc_id) and ``u`` (doc_id, pos, term), a row for each token."""
    base = f"toks AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), "
    base += "v AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM toks)"
    if not stem:
        return base + ", u AS (SELECT doc_id, pos, w AS term FROM v)"
    return f"{base}, {_stem_ctes('v')}, u AS (SELECT doc_id, pos, stem AS term FROM v JOIN stems USING (w))"


def _vocabulary_ctes(stem: bool) -> str:
    from evalspark.operators.topics import ENGLISH_STOP_WORDS

    stop = ", ".join(q(w) for w in ENGLISH_STOP_WORDS)
    return (
        f"{_tokens_cte(stem)}, nd AS (SELECT count(*) AS n FROM documents), "
        f"tf AS (SELECT doc_id, term, count(*) AS n FROM u WHERE term NOT IN ({stop}) GROUP BY ALL), "
        "dfreq AS (SELECT term, count(*) AS documents FROM tf GROUP BY term), "
        "vocab AS (SELECT term, documents, row_number() OVER (ORDER BY term) - 1 AS term_id FROM dfreq, nd "
        "WHERE documents >= 5 AND documents <= CAST(0.98 AS DOUBLE) * nd.n)"
    )


ORACLE["token_stems"] = (
    f"WITH {_tokens_cte(True)}, s AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS stems FROM u GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(stems, '') END AS stems FROM documents LEFT JOIN s USING (doc_id)"
)
ORACLE["bag_of_words"] = (
    f"WITH {_vocabulary_ctes(False)}, per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_distinct_terms "
    "FROM tf JOIN vocab USING (term) GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_distinct_terms, 0) AS n_distinct_terms, "
    "(SELECT count(*) FROM vocab) AS vocabulary_size FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"
)
ORACLE["vocabulary"] = f"WITH {_vocabulary_ctes(True)} SELECT term, documents, term_id FROM vocab"
ORACLE["sparse_counts"] = f"WITH {_vocabulary_ctes(True)} SELECT doc_id, term_id AS terms, n AS counts FROM tf JOIN vocab USING (term)"
ORACLE["topic_tokens"] = (
    f"WITH {_vocabulary_ctes(True)}, per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM tf JOIN vocab USING (term) GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(per.n, 0) AS n_tokens FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"
)
ORACLE["topic_passes"] = (
    f"WITH {_vocabulary_ctes(True)} SELECT CAST(p AS INTEGER) AS pass, (SELECT CAST(sum(n) AS BIGINT) FROM tf JOIN vocab USING (term)) AS tokens "
    "FROM range(1, 3) r(p)"
)
ORACLE["sweep_sizes"] = (
    "SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors, true AS at_most_k, "
    "true AS in_range FROM range(5, 201, 5) r(k)"
)
ORACLE["topic_cluster_labels"] = (
    "SELECT count(*) FILTER (WHERE quality = 1) AS label_0, count(*) FILTER (WHERE quality = 0) AS label_1 "
    "FROM labels JOIN documents USING (doc_id)"
)

# The same results by the paths for groups of any size
for _name in ("stratified_sample", "eval_metrics", "best_worst"):
    ORACLE[f"{_name}_split"] = ORACLE[_name]


# ------------------------------------------------------------------ sources, sinks and jobs

_ORDER_KEY = "md5('42:' || CAST(example_id AS VARCHAR))"
_KEYWORD_PREDS = f"kp AS ({_score_python_sql()})"
ORACLE["sample_file"] = (
    f"WITH {CORPUS_CTE} SELECT row_number() OVER (ORDER BY {_ORDER_KEY}, example_id) - 1 AS example_id, md5(review) AS review_md5, "
    "true_label AS label FROM corpus"
)
ORACLE["prompt_file"] = (
    f"SELECT doc_id AS example_id, md5({render_sql(DEFAULT_TEMPLATE, {'review': 'text'})} || chr(10)) AS prompt_md5 FROM documents"
)
ORACLE["first_reviews"] = (
    f"WITH {CORPUS_CTE} SELECT example_id, true_label AS label, CAST(length(review) AS INTEGER) AS n_chars FROM corpus ORDER BY example_id LIMIT 10"
)
ORACLE["shuffled_positions"] = (
    f"WITH t AS (SELECT doc_id AS example_id FROM labels) SELECT example_id, row_number() OVER (ORDER BY {_ORDER_KEY}, example_id) - 1 AS position FROM t"
)
_NAMED = "CASE {0} WHEN 1 THEN 'negative' WHEN 0 THEN 'positive' END"
ORACLE["attached_truth"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()} SELECT example_id, label, true_label, {_NAMED.format('label')} AS label_name, "
    f"{_NAMED.format('true_label')} AS true_name FROM preds"
)
ORACLE["batch_predictions"] = f"WITH {_KEYWORD_PREDS} SELECT * EXCLUDE (true_label) FROM kp"
ORACLE["resumed_scores"] = ORACLE["json_stream_scores"] = ORACLE["score_python"]
METRIC_LIST = "[" + ", ".join(map(q, METRIC_NAMES)) + "]"
_EVALUATED = f"ev AS (SELECT {metrics_sql()} FROM (SELECT *, CAST(0 AS DOUBLE) AS elapsed_time FROM kp))"
_TIMED = "median_processing_time, median_tokens_per_second"
ORACLE["batch_evaluation"] = f"WITH {_KEYWORD_PREDS}, {_EVALUATED} SELECT * EXCLUDE ({_TIMED}) FROM ev"
ORACLE["experiment_log"] = (
    f"WITH {_KEYWORD_PREDS}, {_EVALUATED} SELECT 'cues' AS model, '40' AS top_k, 'keywords' AS name, * EXCLUDE ({_TIMED}, n) FROM ev"
)
ORACLE["file_store_search"] = ORACLE["run_search"]
ORACLE["run_log_retry"] = (
    "WITH s AS (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents JOIN labels USING (doc_id)), "
    f"m AS (SELECT 'metrics' AS kind, unnest({METRIC_LIST}) AS key), "
    "p AS (SELECT 'params' AS kind, unnest(['model_name', 'temperature', 'top_k', 'top_p']) AS key), "
    "t AS (SELECT 'tags' AS kind, unnest(['mlflow.runName', 'justification']) AS key), "
    # one run without metrics, one orphan, and one older accuracy
    "c AS (SELECT count(*) AS runs, count(*) FILTER (WHERE n <> 12) + count(*) FILTER (WHERE n = 0) AS with_metrics, "
    "count(*) FILTER (WHERE n = 10) AS stale FROM s) "
    "SELECT kind, key, with_metrics + CASE WHEN key = 'accuracy_score' THEN stale ELSE 0 END AS facts, with_metrics AS runs FROM m, c "
    "UNION ALL SELECT kind, key, runs, runs FROM (SELECT * FROM p UNION ALL SELECT * FROM t), c"
)
ORACLE["python_metrics"] = (
    f"WITH {CORPUS_CTE}, {preds_cte()}, x AS (SELECT *, input_token_count + output_token_count > 100 AS long FROM preds) "
    f"SELECT source, {ratio('count(*) FILTER (WHERE label = true_label)', 'count(*)')} AS accuracy_score, "
    f"{ratio('count(*) FILTER (WHERE long AND label <> true_label)', 'count(*) FILTER (WHERE long)')} AS long_error_rate, "
    "max(elapsed_time) AS slowest, count(*) AS n FROM x GROUP BY source"
)
ORACLE["built_prompts"] = (
    "WITH p AS (SELECT d.doc_id AS example_id, '[' || upper(lang) || '] ' || text AS prompt FROM documents d JOIN labels l USING (doc_id)) "
    "SELECT example_id, CASE WHEN " + " OR ".join(f"contains(lower(prompt), {q(c)})" for c in ("bad", "worst", "terrible", "boring", "awful"))
    + f" THEN 'negative' ELSE 'positive' END AS output_string, {word_count_sql('prompt')} AS input_token_count FROM p"
)
ORACLE["boxplot_fliers"] = (
    "WITH qq AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang) "
    "SELECT d.lang, d.doc_id AS example_id, CAST(d.n_chars AS DOUBLE) AS n_chars FROM documents d JOIN qq ON d.lang IS NOT DISTINCT FROM qq.lang "
    "WHERE d.n_chars < q1 - 1.5 * (q3 - q1) OR d.n_chars > q3 + 1.5 * (q3 - q1)"
)


def _sweep_sql() -> str:
    from evalspark.plans.roundtrips import CUES, SWEEP

    grid = " UNION ALL ".join(f"SELECT {q(p['run_id'])} AS run_id, CAST({p['temperature']!r} AS DOUBLE) AS temperature, {p['top_k']} AS top_k" for p in SWEEP)
    cue = " OR ".join(f"contains(lower(prompt), {q(c)})" for c in CUES)
    prompt = render_sql(DEFAULT_TEMPLATE, {"review": "review"})
    return (
        f"WITH {CORPUS_CTE}, grid AS ({grid}), p AS (SELECT corpus.true_label, {prompt} AS prompt, grid.* FROM corpus, grid), "
        f"r AS (SELECT *, CASE WHEN temperature < 0.5 AND ({cue}) THEN 'negative' ELSE 'positive' END AS output_string, "
        f"{word_count_sql('prompt')} + top_k AS input_token_count, CAST(1 AS BIGINT) AS output_token_count, CAST(0 AS DOUBLE) AS elapsed_time FROM p), "
        f"s AS (SELECT *, {parse_sql('output_string')} FROM r), ev AS (SELECT run_id, temperature, top_k, {metrics_sql()} FROM s GROUP BY ALL) "
        f"SELECT * EXCLUDE ({_TIMED}) FROM ev"
    )


ORACLE["sweep_runs"] = _sweep_sql()
ORACLE["best_score"] = (
    "WITH s AS (SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k, floor(avg(quality) * 10) AS silhouette "
    "FROM documents JOIN labels USING (doc_id) GROUP BY ALL) "
    "SELECT k AS best_k, silhouette FROM s ORDER BY silhouette DESC, k LIMIT 1"
)
