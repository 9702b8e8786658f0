"""Repeated rows, clashing columns, near copies and depth: cases that the given tables do not hold."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark import session
from evalspark.llm import ann, bpe, html_text, mixture, multiset_hash, passages, phrase_dedup, quality, simhash, suffix_dedup, superminhash, url_rules

WORDS = [f"w{k}" for k in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


# ------------------------------------------------------------------ repeated rows


def many_rows():
    """A text that stands 5,000 times under one id, 300 times under ids of its own, and in part in others."""
    rng = np.random.default_rng(8)
    hot = text(rng, 120)
    rows = [(7, hot)] * 5000 + [(100 + k, hot) for k in range(300)]
    rows += [(3, text(rng, 20) + " " + " ".join(hot.split()[:80])), (9, " ".join(hot.split()[30:]) + " " + text(rng, 30)), (None, hot), (2**63 - 1, hot), (8, text(rng, 90)), (8, text(rng, 90))]
    return rows


def test_repeated_rows_of_suffix_dedup(spark):
    rows = many_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, own int, th string").repartition(8)
    got = suffix_dedup.dedup(df).select("doc_id", "n_bytes", "spans").distinct().collect()
    distinct = list(dict.fromkeys(rows))
    raw = [t.encode() for _, t in distinct]
    copies = [rows.count(r) for r in distinct] if len(distinct) < 20 else [5000 if i == 7 else 1 for i, _ in distinct]
    count: dict = {}
    for r, c in zip(raw, copies):
        for k in range(len(r) - 199):
            count[r[k : k + 200]] = count.get(r[k : k + 200], 0) + c
    want = set()
    for (i, _), r in zip(distinct, raw):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if count[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        want.add((i, len(r), tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    assert {(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans)) for r in got} == want


def test_repeated_rows_of_phrase_dedup(spark):
    rows = many_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, own int, th string").repartition(8)
    out = phrase_dedup.dedup(df)
    assert out.filter("doc_id = 7").count() == 5000 and out.filter(f"doc_id = {2**63 - 1}").count() == 1
    distinct = list(dict.fromkeys(rows))
    order = lambda i: (i is None, i or 0)
    least: dict = {}
    for i, t in distinct:
        w = t.split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, (True, 2**63)), order(i))
    want = set()
    for i, t in distinct:
        if i is None:
            continue
        w = t.split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < order(i):
                gone[k : k + 50] = True
        want.add((i, " ".join(x for x, g in zip(w, gone) if not g)))
    assert {(r.doc_id, r.kept) for r in out.filter("doc_id IS NOT NULL").select("doc_id", "kept").distinct().collect()} == want
    cleaned = phrase_dedup.cleaned(df.withColumn("n_chars", F.length("text")))
    assert {(r.doc_id, r.text) for r in cleaned.filter("doc_id IS NOT NULL").select("doc_id", "text").distinct().collect()} == want
    assert cleaned.count() == len(rows)


def test_time_grows_with_repeated_rows_and_not_with_their_square(spark):
    rng = np.random.default_rng(1)
    hot = text(rng, 300)

    def seconds(ids):
        df = spark.createDataFrame([(i, hot) for i in ids], "doc_id bigint, text string").repartition(8)
        start = time.perf_counter()
        suffix_dedup.dedup(df).agg(F.sum(F.size("spans"))).collect()
        return time.perf_counter() - start

    seconds(range(50))
    own, same = seconds(range(3200)), seconds([5] * 3200)
    assert same < 2 * own + 2


# ------------------------------------------------------------------ clashing columns

HELPERS = "id own th at h c n e s row key first sum rows size source_size target copies copy number task text_hash c_id c_hash root fp doc_hash spans kept bucket node class part".split()


def test_every_stage_keeps_columns_of_any_name(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = [text(rng, 90) + "." for _ in range(30)]
    texts[11] = texts[10]
    texts += ["BUY!! NOW!! " * (10 + k) for k in range(12)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *HELPERS]
    rows = [(k, t, "en", f"s{k % 2}", len(t), *(f"{h}{k}" for h in HELPERS)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"`{h}` string" for h in HELPERS)]))
    spark.createDataFrame([(k, int(k < 30), 0) for k in range(42)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[h] == f"{h}{r['doc_id']}" for h in HELPERS), name
        assert sum(1 for r in got if r["doc_id"] >= 30) == 0 if name == "quality" else True
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_operators_take_extra_columns_of_any_name(spark):
    extra = ", ".join(f"`{h}` string" for h in HELPERS if h not in ("source",))
    rows = [(k, f"some text number {k % 3} here and there", "s", f"http://a.org/{k}", *([f"x{k}"] * (len(HELPERS)))) for k in range(9)]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, url string, {extra}")
    for out in (mixture.plan(df), simhash.near_duplicates(df), suffix_dedup.dedup(df), phrase_dedup.dedup(df), multiset_hash.fingerprints(df), superminhash.near_duplicates(df),
                html_text.extract(df, "doc_id", "text")):
        assert out.count() == 9
    assert url_rules.judge(df.withColumnRenamed("doc_id", "page_id")).count() == 9


def test_mix_deals_copies_to_repeated_rows_one_by_one(spark):
    rows = [(1, "a b c", "s", k) for k in range(1000)] + [(k, "d " * (k % 7), "s", k) for k in range(2, 60)] + [(5, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(6)
    plan = {(r.doc_id, r.text_hash): r.n for r in mixture.plan(df).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("n")).collect()}
    out = mixture.mix(df)
    got = {(r.doc_id, r.h): r.n for r in out.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in plan.items() if n}
    each = [r.n for r in out.filter("doc_id = 1").groupBy("extra").agg(F.count("*").alias("n")).collect()]
    assert max(each) - min(each + [0] * (1000 - len(each))) <= 1  # dealt out evenly


def test_scratch_tables_can_be_dropped(spark):
    start = len(session._CREATED)
    mixture.plan(spark.createDataFrame([(1, "a", "s")], "doc_id bigint, text string, source string")).collect()
    assert session.drop_scratch(spark, start) > 0


# ------------------------------------------------------------------ near copies


@pytest.mark.parametrize("noise", [1e-2, 1e-4, 1e-6])
def test_nearest_neighbours_inside_a_group_of_near_copies(spark, noise):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=32) + noise * rng.normal(size=(400, 32)), rng.normal(size=(700, 32))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 8 == 0, shard=600).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = []
    for q, ids in found.items():
        s = ann.cosine(np.repeat(x[q : q + 1], len(x), 0), x)
        s[q] = -2
        hits.append(len(set(ids) & set(np.argsort(-s, kind="stable")[:5].tolist())) / 5)
    assert len(found) == 138 and np.mean(hits) >= 0.9


# ------------------------------------------------------------------ HTML


@pytest.mark.parametrize(
    "html,want",
    [
        ("<pre>\na\n  b</pre>", "a\n  b"),
        ("<pre>\n\na</pre>x", "\na\n\nx"),
        ("a<svg><title>t</title><desc>d</desc><text>seen</text></svg> b", "aseen b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<desc>shown</desc>", "shown"),
    ],
)
def test_html_drawings_and_preformatted_text(html, want):
    assert html_text.html_text(html).lstrip("\n") == want.lstrip("\n")


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<ul><li>a" * 50_000, "<div><p>x" * 50_000, "<table><tr><td>x" * 20_000, "<blockquote>q" * 50_000, "<b><p>" * 50_000])
def test_html_depth_costs_in_proportion(html):
    start = time.perf_counter()
    out = html_text.html_text(html)
    assert time.perf_counter() - start < 20
    assert sum(out.count(c) for c in "axq") == sum(html.replace("table", "").replace("blockquote", "").count(c) for c in "axq")


def plain(html):
    """A naive renderer: the visible words in order, by recursion over a parse with the standard library."""
    from html.parser import HTMLParser

    words, hidden = [], []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if hidden or tag in ("script", "style", "template", "title", "head"):
                if tag not in html_text.VOID:
                    hidden.append(tag)

        def handle_endtag(self, tag):
            if tag in hidden:
                while hidden and hidden.pop() != tag:
                    pass

        def handle_data(self, data):
            if not hidden:
                words.extend(data.split())

    P().feed(html)
    return words


def test_words_of_pages_equal_those_of_a_naive_renderer(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    odd = 0
    for (html,) in pages:
        got = [w for w in html_text.html_text(html).split() if w not in ("-",) and not w.rstrip(".").isdigit()]
        want = [w for w in plain(html) if w not in ("-",) and not w.rstrip(".").isdigit()]
        odd += "".join(got) != "".join(want)
    assert odd == 0


# ------------------------------------------------------------------ likeness, quality


def test_likeness_is_near_that_of_the_multisets():
    from collections import Counter

    rng = np.random.default_rng(6)
    for share in (0.0, 0.3, 0.7, 1.0):
        same = [text(rng, 6) + "." for _ in range(int(60 * share))]
        a, b = (same + [text(rng, 6) + "." for _ in range(60 - len(same))] for _ in range(2))
        x, y = Counter(a), Counter(b)
        true = 1 - sum((x[p] - y[p]) ** 2 for p in x | y) / (sum(n * n for n in x.values()) + sum(n * n for n in y.values()))
        assert multiset_hash.likeness(multiset_hash.vector(a), multiset_hash.vector(b)) == pytest.approx(true, abs=0.2)
        assert np.array_equal(multiset_hash.vector(a), multiset_hash.vector(a[::-1]))


def test_remembered_words_survive_generations():
    r = bpe.Remembered(3 * (bpe.ENTRY + 2))
    for k in range(10):
        r.put("a", b"x") if r.get("a") is None else None
        r.put(str(k), b"y")
    assert r.get("a") == b"x" and r.get("0") is None and len(r.young) + len(r.old) <= 8


def test_hashing_by_doubling_equals_the_sum():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, 64).astype(np.uint64)
    got = passages.mixed(words, 40, range(0, 16, 8))
    for p in range(40):
        h = 0
        for k in range(0, 16, 8):
            h = (h * int(passages.M2) + int(words[p + k])) % 2**64
        h ^= h >> 29
        h = h * int(passages.M1) % 2**64
        assert int(got[p]) == h ^ (h >> 32)


def test_quality_separates_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.scored(docs, quality.learn(docs, labels)).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95


def test_fingerprints_of_hot_ids_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(5, "same. text. here.")] * 700 + [(5, text(rng, 5) + ".") for _ in range(60)] + [(None, text(rng, 4)) for _ in range(40)] + [(None, None)] * 30 + [(k, text(rng, 9)) for k in range(20)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, th int, n int").repartition(7)
    hashed = {r.text: r.th for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (multiset_hash.vector(multiset_hash.paragraphs(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), multiset_hash.text_hex(a), multiset_hash.text_hex(b), multiset_hash.likeness(a, b), multiset_hash.likeness(a, c)))
    assert sorted(map(repr, map(tuple, multiset_hash.fingerprints(df).collect()))) == sorted(map(repr, want))
