import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import clusters, lda, stemming
from evalspark.operators.stemming import stem
from evalspark.operators.topics import assign_clusters, best_k, k_sweep, normalize_tokens, topic_clusters
from evalspark.operators.vocabulary import bag_of_words, dense_ids, document_terms
from evalspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

# Public examples of the Snowball "English" stemmer: word and stem.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist
consistently consist consolation consol consolatory consolatori console consol consolidate consolid consoling consol
consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl
constancy constanc constant constant knack knack knackeries knackeri knave knave knavish knavish kneaded knead knee knee
kneeling kneel knees knee knelt knelt knif knif knife knife knightly knight knitted knit knives knive knocker knocker
knocking knock knots knot cry cri by by say say ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop
hoping hope luxuriated luxuri generate generat generously generous communism communism proceed proceed skies sky dying die
news news happy happi relational relat conditional condit rational ration feed feed agreed agre motoring motor""".split()


def test_token_normalize_core(spark):
    df = spark.createDataFrame([("The Movie, was GREAT! 42 times (really) don't",)], "t string")
    r = df.select(normalize_tokens("t").alias("x"), normalize_tokens("t", stems=True).alias("y")).first()
    assert r.x == ["the", "movie", "was", "great", "times", "really"]
    assert r.y == ["the", "movi", "was", "great", "time", "realli"]


def test_stems_equal_the_public_examples(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2])), "word string, want string")
    assert df.withColumn("got", stem("word")).filter("got != want").collect() == []
    odd = spark.createDataFrame([(None,), ("",), ("é",), ("schön",), ("y",)], "word string")
    assert [r[0] for r in odd.select(stem("word")).collect()] == [None, "", "é", "schön", "y"]


def test_each_different_word_of_a_batch_is_stemmed_once(spark, monkeypatch):
    import pyarrow as pa

    seen, real = [], stemming.stemmed
    monkeypatch.setattr(stemming, "stemmed", lambda w: seen.append(w) or real(w))
    got = stemming._stems(pa.array(["hopping", None, "skies", "hopping"] * 1000))
    assert got.to_pylist() == ["hop", None, "sky", "hop"] * 1000 and sorted(seen) == ["hopping", "skies"]
    rows = [(k, None if k % 7 == 0 else ["hopping", None, "relational"][: k % 4]) for k in range(3000)]  # more than are held at once
    df = spark.createDataFrame(rows, "id int, t array<string>").coalesce(1)
    want = {k: None if t is None else [{"hopping": "hop", "relational": "relat"}.get(w) for w in t] for k, t in rows}
    assert {r.id: r.x for r in df.select("id", stemming.stem_words(F.col("t")).alias("x")).collect()} == want


def test_pluggable_token_function(spark):
    import pandas as pd

    def strip_plural(tokens: pd.Series) -> pd.Series:
        return tokens.apply(lambda ts: [t[:-1] if t.endswith("s") and len(t) > 3 else t for t in ts])

    df = spark.createDataFrame([("Movies and actors, great films!",)], "t string")
    assert df.select(normalize_tokens("t", strip_plural).alias("x")).first().x == ["movie", "and", "actor", "great", "film"]


# ------------------------------------------------------------------ bag of words


def test_dense_ids_do_not_depend_on_partitions(spark):
    df = spark.range(0, 5000, 7).select(F.md5(F.col("id").cast("string")).alias("x"))
    want = {x: k for k, x in enumerate(sorted(r.x for r in df.collect()))}
    for parts in (1, 9):
        got = dense_ids(df.repartition(parts), ["x"], "n").collect()
        assert {r.x: r.n for r in got} == want
    assert dense_ids(df.limit(0), ["x"], "n").collect() == []


def test_bag_of_words_bounds_and_edges(spark):
    rows = [(k, ["a", "a", "b"] if k < 6 else ["b", "c"], "x") for k in range(10)] + [(10, [], "x"), (11, None, "x"), (None, ["a"], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, term string")
    bow, terms = bag_of_words(df, "tokens", min_df=5, max_df=0.9, stop_words=["c"])
    assert sorted((r.term, r.documents, r.term_id) for r in terms.collect()) == [("a", 7, 0), ("b", 10, 1)]
    got = {r.doc_id: (r.terms, r.counts) for r in bow.collect()}
    assert got[0] == ([0, 1], [2, 1]) and got[8] == ([1], [1]) and got[10] == ([], []) == got[11] and got[None] == ([0], [1])
    assert bag_of_words(df, "tokens", min_df=0.7, max_df=0.7, stop_words=[])[1].collect() == []
    empty, none = bag_of_words(df.limit(0), "tokens")
    assert empty.collect() == [] and none.collect() == []


def test_a_normal_form_is_taken_once_per_token(spark):
    df = spark.createDataFrame([(1, ["cats", "cat", "the"]), (2, ["cat"])], "doc_id bigint, tokens array<string>")
    bow, terms = bag_of_words(df, "tokens", min_df=1, max_df=10, normal=stem)
    assert [(r.term, r.documents) for r in terms.collect()] == [("cat", 2)]
    assert {r.doc_id: r.counts for r in bow.collect()} == {1: [2], 2: [1]}


def test_terms_are_counted_in_lists_per_document(spark):
    rows = [(k % 40 if k < 80 else None if k < 83 else k, ["a", "b", "a", f"x{k % 3}"] * (1 + k % 2)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>").repartition(3)
    found = document_terms(df, "doc_id", "tokens", ["b"]).collect()
    want = {}
    for k, tokens in rows:
        want.setdefault(k, Counter()).update(x for x in tokens if x != "b")
    assert len(found) == len(want) and {r["_key"]: dict(zip(r.terms, r.counts)) for r in found} == {k: dict(v) for k, v in want.items()}
    bow, terms = bag_of_words(df, "tokens", min_df=1, max_df=100, stop_words=["b"])
    names = {r.term_id: r.term for r in terms.collect()}
    got = bow.collect()
    assert len(got) == 100 and all({names[t]: n for t, n in zip(r.terms, r.counts)} == want[r.doc_id] and r.terms == sorted(r.terms) for r in got)


def test_bag_of_words_query(spark):
    rows = QUERIES["bag_of_words"](spark, SF).collect()
    assert rows and all(r.n_terms >= r.n_distinct_terms >= 0 for r in rows)


# ------------------------------------------------------------------ topics


def toy(spark, topics=4, docs=120, seed=0):
    """Documents over disjoint vocabularies, one topic each."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(docs):
        t = d % topics
        terms = np.unique(rng.integers(10 * t, 10 * t + 10, 12))
        rows.append((d, [int(x) for x in terms], [int(x) for x in rng.integers(1, 4, len(terms))]))
    return spark.createDataFrame([*rows, (docs, [], [])], "doc_id bigint, terms array<bigint>, counts array<bigint>").repartition(5), rows


def dense_fit(rows, size, k, passes, seed):
    """Batch variational Bayes on a dense matrix, document by document."""
    psi = lda.digamma
    x = np.zeros((len(rows), size))
    for d, terms, counts in rows:
        x[d, terms] = counts
    lam = np.stack([lda.start_weights(t, k, seed) for t in range(size)]).T
    for _ in range(passes):
        beta = np.exp(psi(lam) - psi(lam.sum(1, keepdims=True)))
        new = np.full_like(lam, 1 / k)
        for n in x:
            gamma = np.ones(k)
            for _ in range(lda.STEPS):
                theta = np.exp(psi(gamma) - psi(gamma.sum()))
                old, gamma = gamma, 1 / k + theta * (beta @ (n / (theta @ beta + 1e-100)))
                if np.abs(gamma - old).mean() < lda.CHANGE:
                    break
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            new += np.outer(theta, n / (theta @ beta + 1e-100)) * beta
        lam = new
    return lam


def test_documents_of_like_size_are_inferred_together():
    sizes = np.random.default_rng(3).integers(0, 300, 500)
    groups = list(lda._alike(sizes, 50))
    assert sorted(np.concatenate(groups)) == np.flatnonzero(sizes).tolist()
    assert all(len(g) == 1 or len(g) * sizes[g].max() * 50 <= lda.CELLS for g in groups)
    assert all(sizes[g].max() <= 1.25 * sizes[g].min() + 2 for g in groups)


@pytest.mark.parametrize("block", [lda.BLOCK, 60])
def test_each_pass_reads_every_row(spark, monkeypatch, block):
    monkeypatch.setattr(lda, "BLOCK", block)
    bow, rows = toy(spark)
    terms = spark.range(40).withColumnRenamed("id", "term_id")
    for passes in (1, 3):
        model = lda.fit(bow, terms, 4, passes, seed=1)
        got = np.array([r.weights for r in model.weights.orderBy("term_id").collect()]).T
        assert np.allclose(got, dense_fit(rows, 40, 4, passes, 1), rtol=1e-8)
        assert math.isclose(model.totals.sum() - 40, sum(sum(c) for _, _, c in rows), rel_tol=1e-9)


def test_topics_separate_disjoint_vocabularies(spark):
    bow, rows = toy(spark, docs=200)
    terms = spark.range(40).withColumnRenamed("id", "term_id")
    found = lda.transform(bow, lda.fit(bow, terms, 6, 10, seed=3), mass="mass").collect()
    assert all(abs(sum(r.topic_vec) - 1) < 1e-9 for r in found)
    assert next(r.topic_vec for r in found if r.doc_id == 200) == pytest.approx([1 / 6] * 6)
    by_row = {r.doc_id: r for r in found}
    assert all(round(by_row[d].mass) == sum(c) for d, _, c in rows)
    # the topics of two documents overlap if and only if their vocabularies do
    same = np.mean([np.dot(by_row[a].topic_vec, by_row[a + 4].topic_vec) for a in range(60)])
    other = np.mean([np.dot(by_row[a].topic_vec, by_row[a + 1].topic_vec) for a in range(60)])
    assert same > 20 * other


def test_topics_without_any_term_raise(spark):
    bow, _ = toy(spark)
    with pytest.raises(ValueError):
        lda.fit(bow.filter("doc_id = 120"), spark.range(40).withColumnRenamed("id", "term_id"), 3)


def test_digamma():
    assert lda.digamma(np.array([1.0, 0.5, 10.0, 1e-3])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721, -1000.5755719318103], rel=1e-10)


# ------------------------------------------------------------------ k-means under many k


def vectors(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (5, 3))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 0.6, (n, 3))
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id bigint, v array<double>")
    return df.repartition(7), x


def silhouette(x, label):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        inner = d[i][label == label[i]].sum() / max(own - 1, 1)
        outer = min((d[i][label == c].mean() for c in set(label) if c != label[i]), default=np.inf)
        out.append((outer - inner) / max(outer, inner) if own > 1 else 0.0)
    return float(np.mean(out))


def test_all_k_in_the_same_scans_equal_single_fits(spark):
    df, x = vectors(spark)
    ks = [2, 3, 5, 8]
    start = dict(zip(ks, clusters.start_centres(df, "v", ks, 42)))
    together = clusters.score(df, "v", clusters.lloyd(df, "v", start))
    scans = 0
    for k in ks:
        single = clusters.score(df, "v", clusters.lloyd(df, "v", {k: start[k]}))
        assert np.allclose(single.centres[k], together.centres[k], atol=1e-9)
        assert single.scores[k] == pytest.approx(together.scores[k], abs=1e-9)
        centre = start[k].copy()  # the same steps in numpy
        for _ in range(300):
            label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[label == c].mean(0) if (label == c).any() else centre[c] for c in range(k)])
            moved, centre = ((new - centre) ** 2).sum(1).max(), new
            if moved <= 1e-8:
                break
        assert np.allclose(centre, together.centres[k], atol=1e-6)
        label = ((x[:, None] - together.centres[k][None]) ** 2).sum(2).argmin(1)
        assert together.scores[k] == pytest.approx(silhouette(x, label), abs=1e-9)
        assert together.sizes[k].tolist() == np.bincount(label, minlength=k).tolist()
        scans = max(scans, single.scans)
    assert together.scans == scans  # as many as the slowest k needs alone


def test_sweep_finds_the_planted_clusters_and_hands_its_model_on(spark):
    df, x = vectors(spark)
    found = clusters.sweep(df, "v", [3, 5, 9, 2])
    assert best_k(found.silhouettes(spark)).first()["best_k"] == 5
    got = assign_clusters(df.unionByName(spark.createDataFrame([(-1, None)], df.schema)), "v", found.table(spark), 5).collect()
    label = ((x[:, None] - found.centres[5][None]) ** 2).sum(2).argmin(1)
    assert {r.id: r.cluster for r in got} == {-1: None, **{k: int(c) for k, c in enumerate(label)}}
    assert df.repartition(3).count() == 300 and np.allclose(clusters.sweep(df.repartition(3), "v", [5]).centres[5], clusters.sweep(df, "v", [5]).centres[5], atol=1e-9)


def test_every_scan_of_a_sweep_is_spread_over_all_cores(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 50)
    parts, real = [], clusters.start_centres
    monkeypatch.setattr(clusters, "start_centres", lambda data, *a: parts.append(data.rdd.getNumPartitions()) or real(data, *a))
    clusters.sweep(vectors(spark, 800)[0].coalesce(1), "v", [2])
    assert parts[0] >= min(800 // 50, spark.sparkContext.defaultParallelism) > 1


def test_sweep_of_few_and_equal_vectors(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(6)], "id int, v array<double>")
    found = clusters.sweep(same, "v", [2, 3])
    assert sorted(found.sizes[3].tolist()) == [0, 0, 6] and found.scores == {2: None, 3: None}
    with pytest.raises(ValueError):
        k_sweep(same, "v", [6])
    with pytest.raises(ValueError):
        k_sweep(same.limit(0), "v", [0])


def test_chain_from_text_to_clusters(spark):
    words = [["good", "movies", "acting"], ["boring", "plots", "scenes"], ["cheap", "phones", "batteries"]]
    rng = np.random.default_rng(2)
    rows = [(d, " ".join(rng.choice(words[d % 3], 30)) + ".") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clustered, scores, model = topic_clusters(docs, [2, 3, 4], k_topics=3, passes=8)
    best = best_k(scores).first()["best_k"]
    assert model.filter(F.col("k") == best).agg(F.sum("size")).first()[0] == 60
    groups = {}
    for r in clustered.collect():
        groups.setdefault(r.doc_id % 3, set()).add(r.cluster)
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == min(best, 3)


def test_scans_of_few_vectors_use_more_than_one_core(spark, monkeypatch):
    parts, real = [], clusters.start_centres
    monkeypatch.setattr(clusters, "start_centres", lambda data, *a: parts.append(data.rdd.getNumPartitions()) or real(data, *a))
    clusters.sweep(vectors(spark, 800)[0].coalesce(1), "v", [2])
    assert parts[0] >= min(3, spark.sparkContext.defaultParallelism)


def test_chain_spreads_one_file_over_all_cores(spark, tmp_path, monkeypatch):
    from evalspark.operators import topics as chain

    rows = [(d, "good movies acting" if d % 2 else "cheap phones batteries") for d in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    parts, real = [], chain.bag_of_words
    monkeypatch.setattr(chain, "bag_of_words", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or real(df, *a))
    clustered, _, _ = topic_clusters(spark.read.parquet(str(tmp_path / "docs")), [2, 3], k_topics=2, passes=2)
    assert parts[0] >= spark.sparkContext.defaultParallelism and clustered.count() == 40


@pytest.mark.parametrize("size", [1, 2, 7])
def test_weights_of_a_term_are_added_across_batches(size):
    import pyarrow as pa

    ids, x = np.array([0, 0, 0, 2, 3, 3, 9]), np.arange(14.0).reshape(7, 2)
    whole = pa.RecordBatch.from_arrays([pa.array(ids), lda._packed(x)], names=["term_id", "packed"])
    out = pa.Table.from_batches(list(lda._added(2, 0.5)(whole.slice(k, size) for k in range(0, 7, size))))
    want = {t: (x[ids == t].sum(0) + 0.5).tolist() for t in (0, 2, 3, 9)}
    assert dict(zip(out["term_id"].to_pylist(), out["weights"].to_pylist())) == want and out.num_rows == 4
    assert lda._unpacked(out["packed"], 2).tolist() == list(want.values())
    assert pa.Table.from_batches(list(lda._added(2, 0.5)(iter([])))).num_rows == 0


def test_integers_come_back_from_their_bytes():
    from evalspark.operators.packing import ints, joined, packed_ints, split

    for x in ([], [5], [3, 1, 2], [2**40, -5], [2**31 - 1, -(2**31), 7]):
        assert ints(packed_ints(np.array(x, np.int64))).tolist() == x == ints(packed_ints(np.array(x, np.int64), True)).tolist()
    assert [bytes(x) for x in split(joined(b"a", b"", b"xyz"))] == [b"a", b"", b"xyz"]


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in blocks.getAllFiles().mkString(",").split(",") if "/shuffle_" in x}


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    from evalspark.session import discard, materialize

    before = shuffle_files(spark)
    table = materialize(spark.range(1000).repartition(4, "id").groupBy("id").count())
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and table.count() == 1000
    discard(table, spark.range(1))
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table._scratch)


@pytest.mark.parametrize("numbers", [lda.NUMBERS, 48])
def test_a_pass_in_rounds_equals_one_round_and_leaves_one_table(spark, monkeypatch, numbers):
    from evalspark import session

    for name, value in (("BLOCK", 30), ("LEAST", 1), ("EXCHANGE", 0), ("GROUP", 30), ("PIECE", 1), ("NUMBERS", numbers)):
        monkeypatch.setattr(lda, name, value)
    bow, rows = toy(spark)
    bow = lda.numbered(bow)
    dealt = lda.deal(bow, 4)
    assert dealt.rounds > 1 and all(r.n_terms * 4 <= numbers for r in dealt.blocks.collect())
    before = [x for x in session._CREATED if x]
    model = lda.fit(bow, spark.range(40).withColumnRenamed("id", "term_id"), 4, 2, 1, dealt)
    assert len([x for x in session._CREATED if x]) == len(before) + 1
    got = {r.term_id: r.weights for r in model.weights.collect()}
    assert np.allclose(np.array([got[t] for t in range(40)]).T, dense_fit(rows, 40, 4, 2, 1), rtol=1e-8)
    found = {r.doc_id: r for r in lda.transform(bow, model, mass="mass", dealt=dealt).collect()}
    assert len(found) == 121 and all(round(found[d].mass) == sum(c) for d, _, c in rows)


def test_documents_of_a_bag_of_words_are_packed_in_blocks(spark, monkeypatch):
    from evalspark.operators import vocabulary

    for name in ("BLOCK", "ROWS"):
        monkeypatch.setattr(vocabulary, name, 7)
    tokens = {k: [f"x{(k * j) % 11}" for j in range(k % 9)] for k in range(60)}
    df = spark.createDataFrame(list(tokens.items()), "doc_id bigint, tokens array<string>").repartition(2)
    blocks = vocabulary.packed_documents(df, "doc_id", "tokens", (), None, False)
    assert blocks.columns == ["block", "terms", "n", "docs"] and blocks.count() > 5
    bow, terms = bag_of_words(df, "tokens", min_df=1, max_df=100, stop_words=[])
    names = {r.term_id: r.term for r in terms.collect()}
    assert {r.doc_id: {names[t]: n for t, n in zip(r.terms, r.counts)} for r in bow.collect()} == {k: dict(Counter(t)) for k, t in tokens.items()}
    assert {r.term: r.documents for r in terms.collect()} == dict(Counter(x for t in tokens.values() for x in set(t)))
