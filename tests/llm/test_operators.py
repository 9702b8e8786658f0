"""The corpus operators against brute force on small fixtures."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalspark.llm import ann, bpe, components, html_text, mixture, multiset_hash, passages, phrase_dedup, quality, simhash, suffix_dedup, url_rules

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a", "<|endoftext|>x<|endoftext|>", "é☃😀 \x85　z", "x" * 5000, "ab " * 2000, "don't we'll 123 45\t\t6", "\x00\x01"]


def docs_of(spark, rows):
    """Documents with a null id and text, repeated rows and extra columns whose names clash with the operators' own."""
    full = [(*r, "s", 1, "extra", 7) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, source string, n_chars bigint, spans string, h int")


def some_texts(n=60, seed=1, long=120):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, long))) for _ in range(n)]
    for k in range(0, n, 5):  # passages and copies
        texts[k] += " " + " ".join(texts[0].split()[:70]) + " end" * int(rng.integers(0, 4))
    texts[7] = texts[3]
    return texts


# ------------------------------------------------------------------ 1: BPE


@pytest.fixture(scope="module")
def vocabulary():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_tokenizers_library(spark, vocabulary):
    rng = np.random.default_rng(0)
    letters = list("eeetttaoinshr dlu  '\n.,!?ABé1234☃")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 300))) for _ in range(300)]
    df = docs_of(spark, [*enumerate(texts), (None, None), (3, "a")])
    out = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        ids = vocabulary.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids
        assert r["decoded"] == vocabulary.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    for r in bpe.digests(df, VOCABULARY).filter("doc_id < 10").collect():
        if r["doc_id"] != 3:
            ids = vocabulary.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_pairs_are_compatible_as_merging_says():
    with open(VOCABULARY, "rb") as f:
        b = bpe.Bpe(f.read())
    rng = np.random.default_rng(2)
    some = rng.integers(0, 50_000, (3000, 2))
    some = some[[all(b.merged(b.bytes[t]) == [t] for t in p) for p in some.tolist()]]
    expected = [b.merged(b.bytes[x] + b.bytes[y]) == [x, y] for x, y in some.tolist()]
    assert b.compatible(some[:, 0], some[:, 1]).tolist() == expected
    long = b"thequickbrownfox" * 8
    assert b.encode_words([long, b"the", b"a"])[0] == b.merged(long)


def test_bpe_decodes_broken_bytes_and_empty_tables(spark, vocabulary):
    df = spark.createDataFrame([(1, [128, 50256, 3]), (2, None), (3, [])], "doc_id int, ids array<int>")
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, VOCABULARY).collect()}
    assert out[1] == vocabulary.decode([128, 50256, 3], skip_special_tokens=False) and out[2] is None and out[3] == ""
    assert bpe.digests(docs_of(spark, []), VOCABULARY).count() == 0


# ------------------------------------------------------------------ 2: mixing


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join("x" * int(rng.integers(1, 80))), f"s{min(int(rng.integers(0, 9)), 5)}") for k in range(900)]
    rows += [(900, None, "s0"), (901, "a b", None), (902, "c " * 40, None), (None, "d e f", "s1"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash"))
    out = mixture.plan(df).collect()
    assert len(out) == len(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in out:
        s = r["source"]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["copies"] <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sorted(map(str, out)) == sorted(map(str, mixture.plan(df.repartition(5)).collect()))
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixture.plan(df).count() == 0 and mixture.mix(df).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert {r["copies"] for r in mixture.plan(df).collect()} == {0}


# ------------------------------------------------------------------ 3: nearest neighbours


def exact_nearest(ids, x, q, top):
    x = np.asarray(x, float)
    s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
    keep = [k for k in range(len(ids)) if ids[k] != ids[q]]
    return [(ids[k], s[k]) for k in sorted(keep, key=lambda k: (-s[k], ids[k]))[:top]]


def test_nearest_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:2000] = x[1000]  # a third are copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [float("inf")] + [1.0] * 15), (3200, [None] + [1.0] * 15), (3250, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("node", F.lit(1))
    out = ann.nearest(df, F.col("vec_id") % 50 == 0, shard=700).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 50))
    hits = 0
    for q, got in found.items():
        best = exact_nearest(range(3000), x, q, 5)
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hits += len({g[1] for g in got} & {b[0] for b in best})
        if 1000 <= q < 2000:  # ties among copies: the smallest ids
            assert [g[1] for g in got] == [b[0] for b in best]
        for _, v, s in got:
            assert s == pytest.approx((x[q].astype(float) @ x[v]) / np.linalg.norm(x[q].astype(float)) / np.linalg.norm(x[v].astype(float)), abs=1e-12)
    assert hits / (5 * len(found)) >= 0.95


def test_nearest_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)).tolist()
    rows = [(50, x[50])] * 10 + [(51, x[50])] * 2 + [(k, x[k]) for k in range(60) if k not in (50, 51)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = sorted(ann.nearest(df, F.col("vec_id").isin(50, 51)).collect(), key=lambda r: (r["query_id"], r["rank"]))
    got = {q: [(r["vec_id"], r["score"]) for r in out if r["query_id"] == q] for q in (50, 51)}
    ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
    for q in (50, 51):
        best = exact_nearest(ids, vectors, ids.index(q), 5)
        assert [g[0] for g in got[q]] == [b[0] for b in best]
        assert [g[1] for g in got[q]] == pytest.approx([b[1] for b in best])
    assert [g[0] for g in got[50]][:2] == [51, 51] and [g[0] for g in got[51]] == [50] * 5


def test_nearest_neighbours_of_few(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (2, [1e200, 1e200]), (7, [1.0])], schema)
    out = ann.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], round(r["score"], 12)) for r in sorted(out, key=lambda r: r["rank"])][0] == (2, 1.0) and len(out) == 3


# ------------------------------------------------------------------ 4 and 8: substring dedup


def brute_bytes(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + window] for r in raws for k in range(len(r) - window + 1))
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if seen[raw[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(raw), sum(gone), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def brute_words(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (2**63 - 1 if i is None else i):
                gone[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def rows_with_repeats():
    texts = some_texts() + ["é☃" * 90 + "abc", "zz" + "é☃" * 90, "q" * 700, "\x00" * 450, "x y z"]
    rows = list(enumerate(texts)) + [(None, None), (None, texts[2]), (4, texts[4]), (4, texts[4] + " tail"), (90, ""), (91, texts[0][40:] + " " + texts[5])]
    line = " ".join(f"common{k}" for k in range(60))
    return rows + [(100 + k, f"a{k} b{k} {line} c{k} d{k} " + texts[k % 9]) for k in range(40)]


@pytest.mark.parametrize("limit,block", [(6000, 1 << 20), (5, 3000), (1, 500)])
def test_suffix_dedup_equals_brute_force(spark, limit, block):
    rows = rows_with_repeats()
    out = suffix_dedup.dedup(docs_of(spark, rows), limit=limit, block=block).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in out), key=str)
    assert got == brute_bytes(rows, 200)
    for r in out:  # maximal runs
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("limit,block", [(8000, 1 << 20), (5, 3000), (1, 500)])
def test_phrase_dedup_equals_brute_force(spark, limit, block):
    rows = rows_with_repeats()
    out = phrase_dedup.dedup(docs_of(spark, rows), limit=limit, block=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in out), key=str)
    assert got == brute_words(rows, 50)


def rows_with_periods():
    """Texts that repeat after 1 to 60 words, between unlike heads and tails; some of them next to another one, or under one id."""
    rows = []
    for k, period in enumerate((1, 2, 2, 7, 42, 43, 44, 60)):
        cycle = [f"p{period}w{j}" for j in range(period)]
        for copy in range(3):
            body = (cycle * 200)[copy : copy + 180 + 7 * copy]
            rows.append((10 * k + copy, " ".join([f"head{k}x{copy}", *body, f"tail{copy}"])))
    rows += [(200, rows[3][1] + " " + rows[4][1] + " " + rows[21][1]), (200, rows[0][1]), (None, rows[6][1]), (201, "lone two " * 90), (202, "only"), (203, None)]
    return rows


@pytest.mark.parametrize("limit,block", [(6000, 1 << 20), (5, 3000), (1, 500)])
def test_dedup_of_periodic_texts_equals_brute_force(spark, limit, block):
    rows = rows_with_periods()
    out = suffix_dedup.dedup(docs_of(spark, rows), limit=limit, block=block).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in out), key=str)
    assert got == brute_bytes(rows, 200)
    out = phrase_dedup.dedup(docs_of(spark, rows), limit=limit, block=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in out), key=str)
    assert got == brute_words(rows, 50)


@pytest.mark.parametrize("whole", [True, False])
def test_periods_of_a_text_make_one_row_and_not_one_each(whole):
    texts = ["it is " * 300, "a " * 20 + "b c d " * 1000, "x y"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "th": [4, 5, 6], "text": texts})
    rows = [r for out in passages.anchors(passages.Words(), 50, 8, whole=whole)(iter([batch])) for r in out.to_pylist()]
    per_doc = Counter(r["id"] for r in rows)
    assert per_doc[1] <= 2 and per_doc[2] <= 50 and per_doc[3] == 0
    assert max(r["reps"] for r in rows if r["id"] == 1) >= 275 and max(r["reps"] for r in rows if r["id"] == 2) >= 960
    if whole:  # all windows are there
        assert [sum(r["n"] * r["reps"] for r in rows if r["id"] == i) for i in (1, 2)] == [551, 2971]


def test_common_prefixes_equal_those_of_sorted_suffixes():
    rng = np.random.default_rng(5)
    bodies = [bytes(rng.choice(list(b"ab\0\xff"), rng.integers(20, 60)).tolist()) * 2 for _ in range(30)]
    bodies += [bodies[0][3:], b"a" * 80]
    again = suffix_dedup.repeats(bodies, [len(b) - 19 for b in bodies], [1] * len(bodies), 20)
    seen = Counter(b[k : k + 20] for b in bodies for k in range(len(b) - 19))
    assert [a.tolist() for a in again] == [[seen[b[k : k + 20]] > 1 for k in range(len(b) - 19)] for b in bodies]


def test_substring_dedup_of_nothing(spark):
    for module in (suffix_dedup, phrase_dedup):
        assert module.dedup(docs_of(spark, [])).count() == 0
    out = phrase_dedup.cleaned(docs_of(spark, rows_with_repeats()))
    assert out.columns == docs_of(spark, []).columns
    kept = {i: (n, k) for i, _, n, k in brute_words(rows_with_repeats(), 50)}
    for r in out.filter("doc_id >= 100").collect():
        assert r["n_chars"] == (len(r["text"]) if kept[r["doc_id"]][0] else 1)
        assert r["text"].split() == kept[r["doc_id"]][1].split()


# ------------------------------------------------------------------ 5: quality


def test_quality_learns_from_pairs(spark):
    good = some_texts(200, 7)
    bad = [("spam!! " * (3 + k % 20)) + f"z{k}" for k in range(100)]
    rows = list(enumerate(good + bad)) + [(None, None), (1000, ""), (1001, "x" * 100_000), (3, good[3])]
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(300)] + [(None, 1), (5, None), (7, 1)], "doc_id bigint, quality int")
    df = docs_of(spark, rows)
    model = quality.learn(df, labels)
    out = {r["doc_id"]: r for r in quality.scored(df, model).collect()}
    held = [r for r in out.values() if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] < 200) for r in held if r["doc_id"] < 300)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    shuffled = quality.learn(df.repartition(7), labels)
    assert np.array_equal(model["w"], shuffled["w"])  # the same at any partitioning


def test_quality_without_labels(spark):
    df = docs_of(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.scored(df, quality.learn(df, none)).collect()} == {0.5}
    assert quality.keep_good(docs_of(spark, []), none).count() == 0


# ------------------------------------------------------------------ 6: SimHash


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, near):
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(values))]


def test_simhash_equals_brute_force(spark):
    texts = some_texts(80, 9) + ODD + [some_texts(80, 9)[1].upper() + " x", " ".join(some_texts(80, 9)[2].split()) + "\n"]
    rows = list(enumerate(texts)) + [(None, None), (500, None), (501, ""), (3, texts[3])]
    out = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [brute_simhash(t) for _, t in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, 10**9), 10**9 if i is None else i)
    expected = sorted((str(i), p, least[r]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in out) == expected
    kept = simhash.keep_one(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns == docs_of(spark, []).columns
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_keep_one_of_each_group_when_unlike_texts_share_an_id(spark):
    texts = some_texts(12, 31)
    a, b, c, d = texts[1], texts[2], texts[4], texts[6]
    rows = [(5, a), (5, b), (7, b), (7, b), (None, c), (None, d), (None, d), (9, d), (5, None), (None, "")]
    prints = {t: brute_simhash(t) for t in (a, b, c, d)}
    assert all((x ^ y).bit_count() > 2 for s, x in prints.items() for t, y in prints.items() if s != t)
    kept = simhash.keep_one(docs_of(spark, rows)).select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, a), (5, b), (None, c), (9, d), (5, "")], key=str)
    hot = [(1, f"{t} only{k}") for k, t in enumerate(some_texts(40, 32)[::3])] + [(2, "x y z")]
    groups = len(set(brute_components([brute_simhash(t) for _, t in hot], lambda x, y: (x ^ y).bit_count() <= 2)))
    assert simhash.keep_one(docs_of(spark, hot)).count() == groups


@pytest.mark.parametrize("bucket", [1, 100_000])
def test_links_find_all_components_in_large_and_small_buckets(spark, bucket):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = {int(b) for b in base} | {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (6, 2))}
    prints |= {int(base[0]) ^ ((1 << k) - 1) for k in range(40)}  # a chain
    values = sorted(prints)
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp bigint")
    found = components.components(simhash.links(df, bucket=bucket)).collect()
    groups = {r["node"] % 2**64: r["root"] for r in found}
    roots = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    ours = {}
    for v, r in zip(values, roots):
        ours.setdefault(r, set()).add(groups.get(v, v))
    assert all(len(s) == 1 for s in ours.values()) and len({*map(str, ours.values())}) == len(ours)


def test_plan_thresholds_obey_the_pigeonhole(spark):
    rng = np.random.default_rng(12)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**6, 10**10):
        parts = simhash.plan(sample, n)
        for _ in range(300):
            flips = rng.choice(64, 2, replace=False)
            assert any(sum(int(b) in bits for b in flips) <= t for _, bits, t in parts)


# ------------------------------------------------------------------ 7: multiset hash


def test_multiset_hash(spark):
    texts = ["One. Two. Three.\n", "Three.\nOne. Two. ", "", "x" * 500, "a b c. d e f! g?", "é☃ " * 300]
    rows = list(enumerate(texts)) + [(10, None), (11, texts[4]), (None, "last"), (11, texts[4])]
    out = multiset_hash.fingerprints(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        got = [r for r in out if r["doc_id"] == i]
        assert any(r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() for r in got)
        for r in got:
            prints[i] = r["fingerprint"]
            assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
            assert r["edited_fingerprint"] == multiset_hash.text_hex(multiset_hash.vector(multiset_hash.paragraphs(edited))) or len(got) > 1
    assert prints[2] == prints[10] and prints[4] == prints[11] and prints[0] != prints[4]
    parts = multiset_hash.paragraphs(texts[4])
    assert "".join(parts) == texts[4]
    v = multiset_hash.vector(parts)
    assert np.array_equal(v, multiset_hash.vector(parts[::-1]))  # in any order
    assert np.array_equal(multiset_hash.edit(v, parts, [*parts, "new"]) - multiset_hash.vector(["new"]), v)
    assert multiset_hash.fingerprints(docs_of(spark, [])).count() == 0
    one = multiset_hash.fingerprints(docs_of(spark, [(1, "ab. cd. ")])).first()
    assert one["near_next"] == 1.0  # its own next


@pytest.mark.parametrize("n", [16_384, 32_768, 65_536])
def test_multiset_hash_of_many_equal_paragraphs(n):
    a, b = (multiset_hash.vector(multiset_hash.paragraphs(x * n)) for x in ("a. ", "b. "))
    empty = multiset_hash.vector([])
    assert len({multiset_hash.text_hex(v) for v in (a, b, empty)}) == 3
    assert multiset_hash.likeness(a, b) < 0.3 and multiset_hash.likeness(a, empty) == 0.0
    half = multiset_hash.vector(["a. "] * (n // 2))
    assert multiset_hash.likeness(a, half) == pytest.approx(1 - 0.25 / 1.25)
    assert np.array_equal(multiset_hash.edit(a, ["a. "] * n, ["b. "] * n), b)


# ------------------------------------------------------------------ 9: HTML


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>One<p>Two <b>bold</b>  x", "One\n\nTwo bold x"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<head><title>t</title><style>x</style></head><body>seen<script>if (a<b) {}</script><p hidden>no<p style='display: none'>no</body>", "seen"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a &amp; b &lt;c&gt; &copy; d&nbsp;e", "a & b <c> © d e"),
        ("<!-- <p>x</p> -->y<!doctype html><p", "y"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<blockquote>q</blockquote>z", "  q\n\nz"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("", ""),
    ],
)
def test_html_text(html, text):
    assert html_text.html_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ('<a href="x"">hello</a> rest', "hello rest"),
        ("<a title=Bob's>hello</a> rest", "hello rest"),
        ('<a href="x"">hello</a> <b title="y">z</b>', "hello z"),  # a later quote on the page
        ('<p title = "a>b"hidden>no</p>seen<p x= >a<p =y>b', "seen\n\na\n\nb"),
        ("a</é>b<p title='open>c", "ab"),
    ],
)
def test_html_quotes_in_tags(html, text):
    assert html_text.html_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><title>T</title>Hello <b>world</b>", "Hello world"),
        ("<head><title>T</title><a href=x><p>text</p>more", "text\n\nmore"),
        ("<head> <meta x><link y>\n<script>s</script><template>no <b>no</b></template><noscript>no</noscript> <style>s</style><i>seen", "seen"),
        ("<head><template>no <p>no", ""),
        ("<head><title>T</title></head>a<head>b", "ab"),
        ("<head>&#32;<title>T</title>&nbsp;x", "x"),
    ],
)
def test_html_implied_end_of_head(html, text):
    assert html_text.html_text(html) == text


def test_html_query_form(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y"), (2, "<p>a", "y"), (None, "", "z")], "page_id bigint, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, ""), (2, "a"), (2, "a"), (None, "")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 10: URLs


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://b.net/x#y", "b.net", "/x", "net/", "block"),
        ("http://xnet/", "xnet", "/", None, "allow"),
        ("http://net", "net", "", None, "allow"),
        ("https://w.example.com/de/", "w.example.com", "/de/", "example.com/de/", "block"),
        ("https://a.org/fr/porn", "a.org", "/fr/porn", "org/fr/", "allow"),
        ("https://a.org/porn", "a.org", "/porn", None, "block"),
        ("https://a.org/pornography", "a.org", "/pornography", None, "allow"),
        ("https://a.org/casino-casino", "a.org", "/casino-casino", None, "allow"),
        ("https://a.org/casino-POKER", "a.org", "/casino-POKER", None, "block"),
        (None, "", "", None, "allow"),
        ("no-scheme/xxx", "", "", None, "block"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "clash")], "page_id bigint, url string, host string")
    r = url_rules.judge(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_url_rules_of_nothing(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


# ------------------------------------------------------------------ components


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (None, 3), (7000, 6999)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {out[k] for k in range(301)} == {0} and {out[k] for k in range(1000, 1200)} == {1000} and out[7000] == out[6999] == 6999
    assert 5000 not in out and None not in out
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
