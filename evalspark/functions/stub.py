"""A deterministic, SQL-expressible predictor used by tests, the registered queries and the benchmark.

It stands in for a language model: the answer is drawn from a fixed list of responses that covers every
parser branch, by the example id and the number of words of what was asked, so no plan can leave the text out. Because it
is a plain expression it runs JVM-side and the same expression is written in DuckDB SQL by ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import word_count

# The stub's responses (index = id + words, modulo 8).
STUB_RESPONSES = [
    "positive",
    "negative",
    "positive.",
    '"negative"',
    "Positive",
    "I think positive",
    "",
    "neutral",
]


def stub_response(key: str | Column, words: Column, shift: int | Column = 0) -> Column:
    """``element_at(responses, int((key + words + shift) % 8 + 1))``; null words count as none."""
    key = F.col(key) if isinstance(key, str) else key
    shift = F.lit(shift) if isinstance(shift, int) else shift
    idx = ((key + F.coalesce(words, F.lit(0)) + shift) % len(STUB_RESPONSES) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(r) for r in STUB_RESPONSES]), idx)


def stub_outputs(key: str | Column, tokens: Column, n_chars: Column, shift: int | Column = 0) -> list[Column]:
    """The predictor output columns: response, input/output token counts and elapsed seconds. ``tokens``: the prompt's word
    count, best a column computed once before."""
    response = stub_response(key, tokens, shift)
    return [
        response.alias("output_string"),
        tokens.alias("input_token_count"),
        word_count(response).alias("output_token_count"),
        (n_chars / F.lit(1000.0)).alias("elapsed_time"),
    ]
