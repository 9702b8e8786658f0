"""URL filter: a weighted vocabulary beside host rules (operator 10).

An Aho-Corasick automaton finds strict and soft terms in the lower-cased URL; a term counts where neither
neighbour is an ASCII letter or digit. A URL is blocked by one strict term or by ``soft_limit`` distinct soft
terms. Host rules go before: a rule ``host/path`` fits its host and all subdomains when the URL's path starts
with the rule's path; the longest rule that fits decides.

Null URLs and those without ``://`` have an empty host and path and fit no rule; a null URL holds no term. Repeated rows give
repeated results.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "porno", "xxx", "hentai", "milf", "camgirls", "viagra", "phishing", "warez", "keygen")
SOFT = ("adult", "sex", "nude", "casino", "poker", "betting", "escort", "dating", "torrent", "crack", "hack", "pills", "loan", "gore")
SOFT_LIMIT = 2
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str) -> Column:
    return F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))


def fitting_rule(rules: dict[str, str], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits (of equally long ones the first by name), else null. Rules are a parameter."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, _, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(f"/{rest}")
        found = F.when(fits, rule).otherwise(found)
    return found


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        a.add_word(term, (term, term in strict))
    if len(a):
        a.make_automaton()
    return a


def hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Number of strict hits and of distinct soft terms between boundaries."""
    if not url or not (strict or soft):
        return 0, 0
    text = url.translate(_ASCII_LOWER)
    edge = lambda k: not 0 <= k < len(text) or not (text[k].isascii() and text[k].isalnum())
    hard, found = 0, set()
    for end, (term, is_strict) in _automaton(strict, soft).iter(text):
        if edge(end + 1) and edge(end - len(term)):
            if is_strict:
                hard += 1
            else:
                found.add(term)
    return hard, len(found)


_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, strict=STRICT, soft=SOFT,
          soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``id_col, host, path, rule, verdict, strict_hits, soft_hits`` for each row of ``pages``. No shuffle."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict_hits int, soft_hits int")
    def count(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(u, strict, soft) for u in urls], columns=["strict_hits", "soft_hits"])

    df = pages.select(F.col(id_col), host(url_col).alias("host"), path(url_col).alias("path"), count(url_col).alias("_hits"))
    df = df.withColumn("rule", fitting_rule(rules)).select(id_col, "host", "path", "rule", "_hits.strict_hits", "_hits.soft_hits")
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_terms = F.when((F.col("strict_hits") >= 1) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    return df.withColumn("verdict", F.coalesce(by_rule, by_terms)).select(id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits")
