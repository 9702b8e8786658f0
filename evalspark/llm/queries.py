"""The corpus operators as registered queries, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import ann, bpe, html_text, mixture, multiset_hash, phrase_dedup, prefix_trie, quality, simhash, structure_repair, suffix_dedup, superminhash, url_rules
from evalspark.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {WORD_SQL})), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), a AS (SELECT 1.5::DOUBLE * sum(source_size) AS total FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, 2.0::DOUBLE * source_size AS lim FROM s
), l AS (
  SELECT *, ((SELECT total FROM a) - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), g AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN lim
    ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l
), o AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each,
    CAST(('0x' || substr(md5('0:' || CASE WHEN d.source IS NULL THEN 'null' ELSE '=' || d.source END), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(floor(off + each * k) - floor(off + each * (k - 1)), 2) AS BIGINT) AS taken FROM o
"""


@query("op2_mix", OP2_SQL)
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixture.plan(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_ann")
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def covered(spans: str):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_multiset_hash")
def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_phrase_dedup")
def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", covered("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _term_sql(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t in terms)


OP10_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(url, '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS u,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, u, coalesce(translate(regexp_extract(rest, '\A[^/?#]*', 0), '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    CASE WHEN regexp_matches(u, '(^|[^a-z0-9])({"|".join(url_rules.STRICT)})($|[^a-z0-9])') OR {_term_sql(url_rules.SOFT)} >= {url_rules.SOFT_LIMIT}
      THEN 'block' ELSE 'allow' END AS by_terms FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE by_terms END AS verdict FROM r
"""


@query("op10_url_rules", OP10_SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = url_rules.judge(table(spark, sf_dir, "pages"))
    return df.select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), k) AS i, k, words FROM (
    SELECT conv_id, turn, role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
      len(regexp_extract_all(coalesce(text, ''), {WORD_SQL})) AS words FROM conversations WHERE conv_id IS NOT NULL)
), z AS (
  SELECT c, n, c - c % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda v, b: list_reduce([xor(v, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END),
    4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), m AS (
  SELECT z.c, t.i AS d, t.k, t.words FROM z JOIN t ON t.c = z.base AND t.i <= z.h
  UNION ALL
  SELECT z.c, t.i - z.h + least(z.h, coalesce(b.n, 0)), t.k, t.words FROM z LEFT JOIN z b ON b.c = z.base JOIN t ON t.c = z.c AND t.i > z.h
), p AS (
  SELECT c, d, string_agg(k, ',') OVER (PARTITION BY c ORDER BY d) AS p, words FROM m
  UNION ALL SELECT c, 0, '', 0 FROM z
), e AS (SELECT c, max(d) AS d FROM p GROUP BY c
), n AS (
  SELECT p, p.d, min(p.c) AS conv, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c), '') AS ends
  FROM p LEFT JOIN e ON e.c = p.c AND e.d = p.d GROUP BY p, p.d
), f AS (
  SELECT u.p, count(*) FILTER (WHERE v.d = u.d + 1) AS n_children,
    CAST(sum((v.n_convs - 1) * v.words) AS BIGINT) AS saved,
    count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM n w WHERE w.d = v.d + 1 AND starts_with(w.p, v.p))) AS n_leaves
  FROM n u JOIN n v ON starts_with(v.p, u.p) GROUP BY u.p
)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, q.conv AS parent_conv_id, n.n_convs, f.n_children, f.n_leaves, f.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN f USING (p) LEFT JOIN n q ON n.d > 0 AND q.p = (CASE WHEN n.d = 1 THEN '' ELSE left(n.p, length(n.p) - 65) END)
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_structure_repair")
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(structure_repair.damaged(table(spark, sf_dir, "conversations")))


OP13_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[]
    ELSE regexp_extract_all(translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}'), {WORD_SQL}) END AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS shingles FROM w
), n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s
), e AS (SELECT doc_id, unnest(shingles) AS sh FROM s
), f AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM f JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@query("op13_superminhash", OP13_SQL)
def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))
