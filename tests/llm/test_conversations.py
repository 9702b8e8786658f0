"""Prefix trie and structure repair of conversations, SuperMinHash groups: against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evalspark.llm import prefix_trie, structure_repair, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "conv_id bigint, turn bigint, role string, text string, digest string, part int, conv bigint"


def table_of(spark, rows):
    """Conversations with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 3, 4) for r in rows], NAMES)


def some_rows(seed=3, convs=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, turn * int(rng.integers(1, 3)) if c % 9 == 4 else turn, ("user", "assistant", "system", "tool", "")[min(4, int(rng.integers(0, 12)) // 3)], f"t{rng.integers(0, 3)} says.{'' if c % 3 else ' more'}"))
    rows += [(40, None, None, None), (41, 0, "user", None), (41, 0, "user", None), (41, None, "system", "  "), (61, 5, None, "a b\tc!"), (-25, 0, "user", "neg."), (2**62, 1, "user", "big")]
    rows += [(62, k, ("user", "assistant")[k % 2], "same text." if k % 7 else "y " * 3000) for k in range(50)]
    return rows


# ------------------------------------------------------------------ 11: prefix trie


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, key, text))
    for turns in own.values():
        turns.sort(key=lambda t: t[:3])
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20)) if abs(c) < 2**50 else c - c % 20
        built[c] = [(r, t) for _, r, _, t in own.get(base, [])[:h]] + [(r, t) for _, r, _, t in turns[h:]]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for p, cs in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        last = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), children, len(leaf), saved, hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("limit, piece", [(10_000, 8192), (25, 2), (1, 1)])
def test_trie_equals_brute_force_with_and_without_upper_tries(spark, monkeypatch, limit, piece):
    rows = some_rows()
    monkeypatch.setattr(prefix_trie, "BLOCK", 7 if limit < 100 else 100_000)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    got = prefix_trie.trie(table_of(spark, rows + [(None, 1, "user", "lost")]), limit)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=lambda r: (r[1], r[0])) == trie_brute(rows)


def test_trie_of_an_empty_table_and_of_one_very_long_conversation(spark):
    assert prefix_trie.trie(table_of(spark, []).limit(0)).collect() == []
    rows = [(7, k, "user", f"w{k}") for k in range(400)] + [(8, 0, "user", "same")] * 300
    got = prefix_trie.trie(table_of(spark, rows), 50)
    assert sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=lambda r: (r[1], r[0])) == trie_brute(rows)


def test_slots_are_minimal_perfect_and_verified():
    digests = np.random.default_rng(0).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = prefix_trie.SlotTable(digests)
    assert sorted(table.slots) == list(range(5000))
    assert (table.find(digests) == table.slots).all()
    assert (table.find(digests + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.repeat(digests[:3], 2, 0))


# ------------------------------------------------------------------ 12: structure repair


def cheapest(rows):
    """All edits of a few rows (initial, fault), Inserts up to two in a row: the cheapest, ASCII-least audit."""
    best = (10**9, "")
    pattern = re.compile(r"(s?(ua)+)?\Z")

    def go(i, cost, audit, initials):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and pattern.match(initials):
            best = min(best, (cost, audit))
        if not re.match(r"(s?(ua)*u?)\Z", initials):
            return
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", initials)
            if fault not in ("b", "d"):
                go(i + 1, cost + (fault == "t"), audit + "K", initials + (initial or "-"))
                for x in "ua":
                    go(i + 1, cost + 2 + (fault == "t"), audit + "R", initials + x)
        if not audit.endswith("II"):
            for x in "ua":
                go(i, cost + 2, audit + "I", initials + x)

    go(0, 0, "", "")
    return best


def test_lightest_derivations_are_the_cheapest_edits():
    rng = np.random.default_rng(5)
    for _ in range(400):
        rows = [("suat"[int(rng.integers(0, 4))], ["", "", "t", "d", "b"][int(rng.integers(0, 5))]) for _ in range(int(rng.integers(0, 6)))]
        [found] = structure_repair.lightest(rows, 0, True).values()
        assert found == cheapest(rows), rows


def repair_brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        how, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        convs[c] += [] if how == 0 else [((turn is not None, turn or 0), "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for c, found in convs.items():
        found.sort(key=lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in found:
            bare = text.strip(" \t\n\v\f\r")
            kinds.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for (known, t), _, _ in found if known}
        initials = [r[:1] for _, r, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        [(cost, audit)] = structure_repair.lightest(list(zip(initials, kinds)), 0, True).values()
        lines, at = [], 0
        odd = (len(audit) - audit.count("D")) % 2
        for e in audit:
            role, text = (None, "") if e == "I" else found[at][1:]
            at += e != "I"
            if e != "D":
                lines.append(f"{role if e == 'K' else ('user', 'assistant')[(len(lines) - odd) % 2]}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize("block", [512, 4, 1])
def test_repair_equals_brute_force_with_any_blocks(spark, block):
    rows = some_rows(convs=150) + [(None, 1, "user", "Lost."), (None, None, "assistant", "x"), (70, 2, "user", "Twice."), (70, 2, "user", "Twice."), (70, 9, "user", "Twice.")]
    rows += [(500, k // 2, ("user", "assistant", "system")[k % 3], f"Text {k % 11}.") for k in range(90)] + [(501, 3, "user", "Hot.")] * 40
    got = structure_repair.repair(structure_repair.damaged(table_of(spark, rows)), block).collect()
    want = repair_brute(rows)
    assert len(got) == len(want)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for r in got:
        assert tuple(r[n] for n in names) == want[r["conv_id"]], r["conv_id"]


def test_repair_of_an_empty_table_and_of_a_dropped_conversation(spark):
    assert structure_repair.repair(structure_repair.damaged(table_of(spark, []))).collect() == []
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [r] = structure_repair.repair(structure_repair.damaged(table_of(spark, [(c, 0, "user", "Gone.")]))).collect()
    assert tuple(r) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ------------------------------------------------------------------ 13: SuperMinHash


def sets_brute(texts):
    out = []
    for t in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = WORD.findall(words)
        out.append({tuple(words)} if 0 < len(words) <= 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if words else set())
    return out


def near_texts(seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(4, 220))))
        for _ in range(14):  # copies of copies, so that chains are linked and their ends are not
            texts.append(" ".join(base))
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(0, len(base)))] = str(rng.choice(words))
    return [*texts, texts[0].upper(), None, "", " \n", "one", "one", "One two", "x" * 3000, "rep " * 4000, "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("tile", [superminhash.TILE, 3])
def test_superminhash_groups_equal_brute_force(spark, tile):
    texts = near_texts()
    sets = sets_brute(texts)
    rows = [*enumerate(texts), (None, texts[20]), (None, "only null ids"), (5, texts[5]), (5, texts[5]), (6, texts[30])]
    sets += sets_brute([t for _, t in rows[len(texts) :]])
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        old = list(label)
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == old:
            break
    groups = defaultdict(list)
    for (i, _), g in zip(rows, label):
        groups[g] += [] if i is None else [i]
    want = sorted(repr((i, len(s), c, i == c)) for (i, _), s, g in zip(rows, sets, label) for c in [(min(groups[g]) if groups[g] else None) if s else i])
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id bigint, text string, node bigint, key string, n int")
    got = superminhash.near_duplicates(df, tile=tile).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == want


def test_superminhash_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert superminhash.near_duplicates(df).collect() == []


def test_signatures_estimate_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        u = np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))
        a, b = u[:-15], u[15:]
        sig = superminhash.signatures([a, b], 120)
        errors.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(u))
    j = 120 / 150
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < (j * (1 - j) / 120) ** 0.5


def test_a_long_set_has_the_same_signature_in_parts(monkeypatch):
    s = np.unique(np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64))
    one = superminhash.signatures([s], 60)
    monkeypatch.setattr(superminhash, "SLAB", 100)
    assert (superminhash.signatures([s[:5], s, s[:0]], 60)[1] == one[0]).all()


def test_column_of_intersections(monkeypatch):
    monkeypatch.setattr(superminhash, "COLUMNS", 8)
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    got = superminhash.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
