"""Response parsers: raw model text -> (label, is_hallucination, is_wrong_format), all as JVM expressions.

Label convention: 0 = positive, 1 = negative, -1 = could not be parsed. At most one flag is true and the
label is -1 exactly when a flag is set.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import SPARK_WHITESPACE, SPARK_WORD

# The answer words of the sentiment task and the default pruning pattern.
DEFAULT_MAPPING: dict[str, int] = {"negative": 1, "positive": 0}
DEFAULT_PRUNE = "[^a-zA-Z0-9]"

PARSED_TYPE = "struct<label:int,is_hallucination:boolean,is_wrong_format:boolean>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_values(c: str | Column, mapping: Mapping, value_type: str | None = None) -> Column:
    """Literal dictionary lookup; NULL on a miss."""
    if not mapping:
        return F.lit(None)
    kv: list[Column] = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    out = F.try_element_at(F.create_map(*kv), _col(c))
    return out.cast(value_type) if value_type else out


def label_name(c: str | Column) -> Column:
    """1 -> 'negative', 0 -> 'positive', anything else NULL."""
    c = _col(c)
    return F.when(c == 1, "negative").when(c == 0, "positive")


def _result(label: Column, halluc: Column, wrong: Column) -> Column:
    return F.struct(
        label.cast("int").alias("label"),
        halluc.alias("is_hallucination"),
        wrong.alias("is_wrong_format"),
    )


def _failed(hallucination: bool) -> Column:
    return _result(F.lit(-1), F.lit(hallucination), F.lit(not hallucination))


def _parse_pruned(raw: Column, mapping: Mapping[str, int], prune: str, ignore_case: bool) -> Column:
    pruned = F.regexp_replace(raw, F.lit(prune), F.lit(" "))
    if prune == DEFAULT_PRUNE:
        # After the default prune only ASCII letters, digits and spaces remain.
        stripped = F.trim(pruned)
        multi = F.instr(stripped, " ") > 0
    else:
        stripped = F.regexp_replace(pruned, F.lit(f"^[{SPARK_WHITESPACE}]+|[{SPARK_WHITESPACE}]+$"), F.lit(""))
        multi = F.regexp_count(stripped, F.lit(SPARK_WORD)) > 1
    key = F.lower(stripped) if ignore_case else stripped
    table = {(k.lower() if ignore_case else k): v for k, v in mapping.items()}
    mapped = map_values(key, table, "int")
    return (
        F.when(multi, _failed(False))
        .when(mapped.isNull(), _failed(True))
        .otherwise(_result(mapped, F.lit(False), F.lit(False)))
    )


def parse_label(
    raw: str | Column,
    mapping: Mapping[str, int] | None = None,
    prune: str = DEFAULT_PRUNE,
    ignore_case: bool = False,
) -> Column:
    """Prune every pattern match to a space and strip; more than one token -> wrong format; a token
    outside ``mapping`` (case-sensitive, empty included) -> hallucination; else the mapped label.
    A NULL response is a wrong format."""
    raw = _col(raw)
    mapping = DEFAULT_MAPPING if mapping is None else mapping
    return F.when(raw.isNull(), _failed(False)).otherwise(_parse_pruned(raw, mapping, prune, ignore_case))


def parse_cot_label(
    raw: str | Column,
    marker: str = "---",
    mapping: Mapping[str, int] | None = None,
    prune: str = DEFAULT_PRUNE,
    ignore_case: bool = False,
) -> Column:
    """Chain-of-thought answer: text after the last ``marker`` (its last character kept, as the
    reference does), then ``parse_label``; no marker -> wrong format."""
    if not marker:
        raise ValueError("marker must not be empty")
    raw = _col(raw)
    mapping = DEFAULT_MAPPING if mapping is None else mapping
    tail = F.concat(F.lit(marker[-1]), F.substring_index(raw, marker, -1))
    return (
        F.when(raw.isNull() | ~raw.contains(marker), _failed(False))
        .otherwise(_parse_pruned(tail, mapping, prune, ignore_case))
    )


def python_parser(fn) -> "Callable[[str | Column], Column]":
    """UDF-2 for arbitrary Python: ``fn(text) -> (label, is_hallucination, is_wrong_format)`` (or a dict
    with those keys) becomes a Column function returning the parsed struct, evaluated in Arrow batches.
    Prefer the Column parsers above when the rule can be written with expressions."""

    @F.pandas_udf(PARSED_TYPE)
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for text in raw:
            out = fn(None if text is None or (isinstance(text, float) and text != text) else text)
            if isinstance(out, dict):
                out = (out["label"], out["is_hallucination"], out["is_wrong_format"])
            rows.append((int(out[0]), bool(out[1]), bool(out[2])))
        return pd.DataFrame(rows, columns=["label", "is_hallucination", "is_wrong_format"])

    def apply(raw: str | Column) -> Column:
        return run(_col(raw))

    return apply


def json_slice(raw: str | Column) -> Column:
    """From the first '{' to the last '}' (Python slice semantics; empty when they do not bracket)."""
    raw = _col(raw)
    start = F.instr(raw, "{")  # 1-based, 0 when absent
    end = F.length(raw) - F.instr(F.reverse(raw), "}") + 1  # 1-based position of the last '}'
    has_both = (start > 0) & (F.instr(raw, "}") > 0) & (end >= start)
    return F.when(has_both, F.substring(raw, start, end - start + 1)).otherwise(F.lit(""))


def _json_fields_udf(fields: tuple[str, ...]):
    import json

    ddl = ", ".join(f"`{f}` string" for f in fields)

    def value(v):
        if v is None:
            return None
        if isinstance(v, str):
            return v
        return json.dumps(v, separators=(",", ":"))

    @F.pandas_udf(ddl)
    def extract(s: pd.Series) -> pd.DataFrame:
        out = {f: [] for f in fields}
        for text in s:
            obj = None
            if isinstance(text, str) and text:
                try:
                    obj = json.loads(text)
                except ValueError:
                    obj = None
            if not isinstance(obj, dict):
                obj = {}
            for f in fields:
                out[f].append(value(obj.get(f)))
        return pd.DataFrame(out, columns=list(fields))

    return extract


def parse_json_label(raw: str | Column, fields: Iterable[str], strict: bool = True, engine: str = "jvm") -> Column:
    """Strict JSON object between the first '{' and the last '}'; each requested field as a string
    (non-string values in compact JSON form); any failure or an absent field gives NULL.

    ``engine="jvm"`` (default) stays in the JVM: the slice is parsed as the one
    element of a JSON array (``[slice]``), so trailing text after the object (``{..} and {..}``,
    ``{..}}``, ``{..},{..}``, ``{..}, null, {..}``) is rejected as strict JSON requires. It differs from
    Python's ``json`` on duplicate keys and NaN literals (both NULL here), and in how it writes integers of more than
    38 digits, large floats, and non-ASCII text inside arrays. ``engine="python"`` parses with that module in an
    Arrow-batched pandas UDF, for those who need its answers in these cases. ``strict=False`` uses Spark's lenient
    ``try_parse_json`` on the bare slice (it ignores trailing text).
    """
    fields = tuple(fields)
    if not fields:
        raise ValueError("fields must not be empty")
    for f in fields:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f):
            raise ValueError(f"unsupported field name {f!r}")
    sliced = json_slice(raw)
    if not strict:
        v = F.try_parse_json(sliced)
        return F.struct(*[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in fields])
    if engine == "python":
        return _json_fields_udf(fields)(sliced)
    if engine != "jvm":
        raise ValueError("engine must be 'python' or 'jvm'")
    arr = F.try_parse_json(F.concat(F.lit("["), sliced, F.lit("]")))
    one = F.size(F.try_variant_get(arr, "$", "array<variant>")) == 1
    obj_ok = F.startswith(F.schema_of_variant(F.try_variant_get(arr, "$[0]", "variant")), F.lit("OBJECT"))
    cols = []
    for f in fields:
        val = F.try_variant_get(arr, f"$[0].{f}", "string")
        cols.append(F.when(one & obj_ok, val).alias(f))
    return F.struct(*cols)
