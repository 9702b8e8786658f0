"""Quality classifier by Bradley-Terry pairwise ranking (operator 5).

The score of a text is a weighted sum of features of the text alone. The weights come from preference pairs (a
document labelled good is preferred to one labelled bad) by logistic loss on the difference of the two
documents' features. The threshold is a quantile of the scores of the labelled documents, that with the fewest
errors among them; scores are moved so that it lies at ``CUT`` and pass through a logistic function into 0 to 1.

The fit uses at most ``SAMPLE`` labelled documents (those with the smallest hashes of their ids), whose features are
sent to the driver: a bound that does not depend on the input. Scores then cover all documents in one pass.

Null text counts as empty and gets the score of its features like any other. Rows with a null label or id are not learned from;
repeated rows are scored alike. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
PAIRS = 4  # for each document of the more frequent label
CUT = 0.3
RIDGE = 1e-3

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:?"
_HIGH = bytes(range(128, 256))
_SYMBOLS = bytes(sorted(set(range(33, 127)) - set(_LETTERS + _DIGITS + _STOPS)))
_AGAIN = re.compile(rb"(\S+)(?:\s+\1(?=\s|\Z))+")

NAMES = (
    "words", "word_length", "distinct", "adjacent", "top", "upper", "all_upper", "digit", "stop", "symbol", "symbol_words", "high",
    "lines", "line_length", "line_repeats", "short", "long", "sentences", "compressed", "shouts", "bars", "runs",
)


def features(text: str | None) -> list[float]:
    """Numbers of order one that depend on the text alone."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(NAMES)
    part = lambda some: (len(raw) - len(raw.translate(None, some))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    length = sum(map(len, words)) / n
    again = sum(x == y for x, y in zip(words, words[1:]))
    symbol_end = sum(w[-1] in _SYMBOLS for w in words)
    upper = sum(w.isupper() for w in words)
    log = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log1p(n)),
        length / 10,
        len(counts) / n**0.9,
        log(again / n),
        counts.most_common(1)[0][1] / n,
        log(part(_UPPER)),
        log(upper / n),
        log(part(_DIGITS)),
        log(part(_STOPS)),
        log(part(_SYMBOLS)),
        log(symbol_end / n),
        log(part(_HIGH)),
        float(np.log1p(len(lines))),
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 2 for w in words) / n,
        sum(len(w) >= 16 for w in words) / n,
        log((raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n),
        len(zlib.compress(raw, 1)) / size,
        log(raw.count(b"!!") / n),
        log(words.count(b"|") / n),
        log(max(counts.values()) / n * again / n),
    ]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 30) -> dict:
    """Weights, mean and scale of the features, and the threshold. y: 0 or 1."""
    mean = x.mean(0) if len(x) else np.zeros(len(NAMES))
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(NAMES))
    model = {"mean": mean, "scale": scale, "w": np.zeros(len(mean)), "at": 0.0, "fitted": False}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = (x - mean) / scale
    rng = np.random.default_rng(0)
    n = pairs * max(len(good), len(bad))
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):  # Newton's method on the mean of log(1 + exp(-w.d))
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        slope = RIDGE * w - diff.T @ p / n
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    order = np.argsort(scores, kind="stable")
    # errors if the k lowest are rejected; the threshold lies between the k-th and the next score
    errors = np.concatenate([[0], np.cumsum(y[order])]) + (len(bad) - np.concatenate([[0], np.cumsum(1 - y[order])]))
    k = int(errors.argmin())
    q = k / len(scores)
    return model | {"w": w, "at": float(np.quantile(scores, q, method="midpoint")) if k else float(scores.min() - 1), "quantile": q, "fitted": True}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if not model["fitted"]:
        return np.full(len(x), 0.5)
    s = (x - model["mean"]) / model["scale"] @ model["w"] - model["at"]
    return 1 / (1 + np.exp(-np.clip(s + np.log(CUT / (1 - CUT)), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """A model from the labelled documents that are not held out. An id labelled twice counts with its larger label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = found.join(F.broadcast(known), "_id")  # at most ``sample`` rows
    found = found.select("_id", "_label", numbers("_text").alias("x"), F.xxhash64("_text").alias("h"))
    rows = sorted(found.orderBy("h", "_id").limit(2 * sample).collect(), key=lambda r: (r["_id"], r["h"]))
    return fit(np.array([r["x"] for r in rows], float).reshape(-1, len(NAMES)), np.array([r["_label"] for r in rows], int))


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 if the score is at least ``CUT``). No shuffle."""

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))))

    df = docs.withColumns({"held_out": held_out(F.col(id_col)), "score": value(F.col(text_col))})
    return df.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = learn(docs, labels, id_col, text_col)
    df = scored(docs.select(F.struct("*").alias("_row")), model, f"_row.`{id_col}`", f"_row.`{text_col}`")
    return df.filter("predicted = 1").select("_row.*")
