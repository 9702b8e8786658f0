"""Byte-level BPE encoding and decoding by speculation and verification (operator 1).

A text is split into words by the byte-level pattern. For each distinct word of a batch a greedy
longest match proposes tokens. The proposal is the word's BPE encoding exactly when every adjacent
pair of it is *compatible*, that is, when merging the two tokens' bytes gives back the two tokens. All pairs
of a batch are tested at once with numpy; only the words that hold an incompatible pair are
merged rank by rank.

A pair (a, b) is tested along the right edge of a's merge tree and the left edge of b's. Walking back
in time, each (x, y) that stood side by side would have merged across the border if the rank of the
merge (x, y) came before the merge that consumed x, or not after the one that consumed y (of equal merges
the left one goes first).

Null text counts as empty: no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed value: the byte-level word pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FAR = np.int64(1) << 60
#: Pieces of text that the word pattern never joins: a run without white space and one space before it, or
#: white space. This is the pattern cut at white space only, with the white space of the pattern's ``\\s`` spelled out.
SPACE = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
PIECE = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"

CACHE_BYTES = 80 << 20  # of words and pieces remembered by a Python worker in each of two generations, see ``Remembered``
CACHE_CHARS = 64  # longer ones are not remembered
ENTRY = 200  # bytes that an entry takes beside its text and ids
SHORT = 48  # bytes up to which words are proposed and merged together as arrays; longer ones singly


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Remembered:
    """A cache of two generations: when the young one is full it becomes the old one, whose entries are forgotten
    unless they were used meanwhile. So frequent words stay, for all tasks of a worker."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.young, self.old = size, 0, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += ENTRY + len(key) + len(value)
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0


class Bpe:
    """Encoder and decoder of one vocabulary file (the JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        model, chars = data["model"], _byte_chars()
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data.get("normalizer"):
            raise ValueError("expects a byte-level BPE vocabulary without a normalizer")
        if data["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("add_prefix_space and ignore_merges are not supported")
        self.special = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        if any(a[k] for a in data.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in white space are not supported")
        ids = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for t, i in [*ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = t
        self.byte_id = [ids[bytes([b])] for b in range(256)]

        # merges: rank of each pair, and for each token its formation rank and its two parts
        self.formed = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        twice: set[int] = set()
        for rank, m in enumerate(model["merges"]):
            a, b = (ids[bytes(chars[c] for c in t)] for t in (m.split(" ") if isinstance(m, str) else m))
            new = ids[self.bytes[a] + self.bytes[b]]
            self.merge.setdefault((a, b), (rank, new))
            if self.formed[new] >= 0:
                twice.add(new)
            else:
                self.formed[new], self.left[new], self.right[new] = rank, a, b
        keys = np.array([(a << 32) | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]

        # tokens that encode to themselves; only these are proposed
        made = np.flatnonzero(self.formed >= 0)
        good = np.zeros(n, bool)
        good[self.byte_id] = True
        inner = dict(zip(made.tolist(), self.compatible(self.left[made], self.right[made], skip_top=True).tolist()))
        for t in made[np.argsort(self.formed[made])].tolist():
            good[t] = t not in twice and inner[t] and good[self.left[t]] and good[self.right[t]]
        self.longest: dict[bytes, int] = {}
        self.known: dict[bytes, int] = {}
        for i in np.flatnonzero(good).tolist():
            t = self.bytes[i]
            self.known[t] = i
            for k in (2, 3):
                if len(t) >= k:
                    self.longest[t[:k]] = max(self.longest.get(t[:k], 1), len(t))
        # the same tokens as a trie: child of (node, byte) by binary search, token that ends at a node
        nodes: dict[bytes, int] = {b"": 0}
        for t in self.known:
            for k in range(1, len(t) + 1):
                nodes.setdefault(t[:k], len(nodes))
        edges = sorted((nodes[t[:-1]] << 8 | t[-1], k) for t, k in nodes.items() if t)
        self.edge_keys, self.edge_to = np.array(edges, np.int64).T.copy()
        self.token_at = np.full(len(nodes), -1, np.int64)
        for t, i in self.known.items():
            self.token_at[nodes[t]] = i
        self.pair_new = np.array([new for _, new in self.merge.values()], np.int64)[order]
        self.split, self.pieces = regex.compile(PATTERN).findall, re.compile(PIECE).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.cache = Remembered(CACHE_BYTES)

    def compatible(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """For each pair of tokens: does it stay as it is when its bytes are merged?"""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
        x_end, y_end = np.full(len(a), FAR), np.full(len(a), FAR)
        first = skip_top
        while len(at):
            if not first:
                keys = (x << 32) | y
                k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[k] == keys, self.pair_ranks[k], FAR)
                bad = (rank < x_end) & (rank <= y_end) & (rank < FAR)
                ok[at[bad]] = False
            else:
                bad = np.zeros(len(at), bool)
            first = False
            fx, fy = self.formed[x], self.formed[y]
            go = ~bad & ((fx >= 0) | (fy >= 0))
            at, x, y, x_end, y_end, fx, fy = at[go], x[go], y[go], x_end[go], y_end[go], fx[go], fy[go]
            down_x = fx > fy  # the later merge is undone first; of equal ones the right one
            x_end, y_end = np.where(down_x, fx, x_end), np.where(down_x, y_end, fy)
            x, y = np.where(down_x, self.right[x], x), np.where(down_x, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, known, longest = [], 0, len(word), self.known, self.longest
        while at < n:
            most = longest.get(word[at : at + 3]) or min(2, longest.get(word[at : at + 2], 1))
            for size in range(min(most, n - at), 0, -1):
                token = known.get(word[at : at + size])
                if token is not None:
                    break
            out.append(token)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals, with a heap."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merge.get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := self.merge.get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [t for t in ids if t >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (FAR: none) and the token it makes."""
        keys = (a << 32) | b
        k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[k] == keys
        return np.where(hit, self.pair_ranks[k], FAR), self.pair_new[k]

    def propose_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words in step: the words' numbers, in order, and their tokens."""
        word, pos, out = np.arange(len(start)), start.copy(), []
        ids = np.array(self.byte_id)
        while len(word):
            token, size = ids[data[pos]], np.ones(len(word), np.int64)
            at, node, depth = np.arange(len(word)), np.zeros(len(word), np.int64), 0
            while len(at):
                keys = node << 8 | data[pos[at] + depth]
                k = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
                hit = self.edge_keys[k] == keys
                at, node, depth = at[hit], self.edge_to[k[hit]], depth + 1
                ends = self.token_at[node]
                token[at[ends >= 0]], size[at[ends >= 0]] = ends[ends >= 0], depth
                more = pos[at] + depth < end[word[at]]
                at, node = at[more], node[more]
            out.append((word, token))
            pos = pos + size
            go = pos < end[word]
            word, pos = word[go], pos[go]
        words, tokens = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words in step, one merge of each word at a time; ids as ``word_ids`` gives them."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        ids = np.array(self.byte_id)[raw]
        ranks, new = self.rank_of(ids[:, :-1], ids[:, 1:])
        cols = np.arange(wide)
        ranks[cols[None, 1:] >= size[:, None]] = FAR
        out: list = [None] * len(words)
        row = np.arange(len(words))
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            go = np.take_along_axis(ranks, best[:, None], 1)[:, 0] < FAR if ranks.shape[1] else np.zeros(len(row), bool)
            raw, step = ids[~go].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, (r, n) in enumerate(zip(row[~go].tolist(), size[~go].tolist())):
                out[r] = raw[k * step : k * step + 4 * n]
            row, ids, ranks, new, size, best = row[go], ids[go], ranks[go], new[go], size[go] - 1, best[go]
            if not len(row):
                return out
            at = np.arange(len(row))
            ids[at, best] = new[at, best]
            keep = cols[None, : ids.shape[1] - 1]
            ids = np.take_along_axis(ids, keep + (keep > best[:, None]), 1)
            keep = keep[:, : ranks.shape[1] - 1]
            shift = keep + (keep >= best[:, None])
            ranks, new = np.take_along_axis(ranks, shift, 1), np.take_along_axis(new, shift, 1)
            for c in (best - 1, best):  # the pairs beside the new token
                m = (c >= 0) & (c + 1 < size)
                r, t = self.rank_of(ids[at[m], c[m]], ids[at[m], c[m] + 1])
                ranks[at[m], c[m]], new[at[m], c[m]] = r, t
                out_of = (c >= 0) & (c + 1 >= size) & (c < ranks.shape[1])
                ranks[at[out_of], c[out_of]] = FAR

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of distinct words."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.word_ids(words)]

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit integers) of distinct words: propose, test all adjacent pairs at once, merge
        what failed."""
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        end = np.cumsum([len(words[k]) for k in short], dtype=np.int64)
        start = np.concatenate([[0], end[:-1]]).astype(np.int64) if short else end
        data = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        where, tokens = self.propose_all(data, start, end)
        where = np.array(short, np.int64)[where]
        if len(short) < len(words):
            singly = {k: self.propose(w) for k, w in enumerate(words) if len(w) > SHORT}
            where = np.concatenate([where, np.repeat(np.array(list(singly), np.int64), [len(v) for v in singly.values()])])
            tokens = np.concatenate([tokens, np.array([t for v in singly.values() for t in v], np.int64)])
            order = np.argsort(where, kind="stable")
            where, tokens = where[order], tokens[order]
        inside = np.flatnonzero(where[1:] == where[:-1])
        pairs, back = np.unique((tokens[inside] << 32) | tokens[inside + 1], return_inverse=True)
        ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(where[inside[~ok[back]]])
        ends = (4 * np.searchsorted(where, np.arange(len(words) + 1))).tolist()
        flat = tokens.astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        by_size: dict[int, list[int]] = {}
        for k in failed.tolist():
            if len(words[k]) <= SHORT:
                by_size.setdefault(-(-len(words[k]) // 8), []).append(k)
            else:
                out[k] = np.array(self.merged(words[k]), "<u4").tobytes()
        for ks in by_size.values():
            for k, ids in zip(ks, self.merged_all([words[k] for k in ks])):
                out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        parts = [[(p, k % 2) for k, p in enumerate(self.cut(t)) if p] for t in texts]
        split = [[None if special else self.pieces(p) for p, special in ps] for ps in parts]
        cache, here, new = self.cache, {}, {}  # here: ids of all pieces of these texts
        for p in set().union(*(s for ws in split for s in ws if s is not None)):
            ids = cache.get(p)
            if ids is None:
                bare = p[1:] if p[0] == " " else p
                new[p] = [p] if bare.isalpha() else self.split(p)  # letters with a space before them are one word
            else:
                here[p] = ids
        known = {}
        for w in {w for ws in new.values() for w in ws}:
            known[w] = cache.get(w)
        words = [w for w, ids in known.items() if ids is None]
        for w, ids in zip(words, self.word_ids([w.encode() for w in words])):
            known[w] = ids
            if len(w) <= CACHE_CHARS:
                cache.put(w, ids)
        for p, ws in new.items():
            if len(ws) == 1 and ws[0] == p:
                here[p] = known[p]
                continue
            here[p] = ids = b"".join([known[w] for w in ws])
            if len(p) <= CACHE_CHARS:
                cache.put(p, ids)
        get = here.__getitem__
        return [
            b"".join([np.array([self.special[p]], "<u4").tobytes() if ws is None else b"".join(map(get, ws)) for (p, _), ws in zip(ps, sp)])
            for ps, sp in zip(parts, split)
        ]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _bpe(spec: bytes) -> Bpe:
    return Bpe(spec)


def _shared(df: DataFrame, path: str):
    """The vocabulary file, sent to each executor once; its size does not depend on the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, text_col: str, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that hold at most ``size`` bytes of text (or one row), so that a batch of
    long texts needs no more working memory than one of short ones."""
    start = held = 0
    for k, n in enumerate(pc.binary_length(batch.column(text_col)).to_pylist()):
        n = n or 0
        if k > start and (k - start == rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _with(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in cols]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols.values()], names=[*names, *cols])


def _encode_batches(spec, text_col: str, ids_col: str):
    def run(batches):
        bpe = _bpe(spec.value)
        for whole in batches:
            for batch in _slices(whole, text_col):
                found = bpe.encode([t or "" for t in batch.column(text_col).to_pylist()])
                ends = np.cumsum([0, *(len(b) // 4 for b in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield _with(batch, **{ids_col: ids})

    return run


def _decode_batches(spec, ids_col: str, text_col: str):
    def run(batches):
        bpe = _bpe(spec.value)
        for batch in batches:
            col = batch.column(ids_col)
            out = [None if not v.is_valid else bpe.decode(v.values.to_numpy(zero_copy_only=False)) for v in col]
            yield _with(batch, **{text_col: pa.array(out, pa.string())})

    return run


def _schema(df: DataFrame, *cols: str):
    """Schema of ``df`` with columns ("name type") put in the place of any of the same name."""
    names = {c.split()[0] for c in cols}
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names), *cols])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text_col`` (array of int; null text: empty) in ``ids_col``. No shuffle."""
    return df.mapInArrow(_encode_batches(_shared(df, path), text_col, ids_col), _schema(df, f"{ids_col} array<int>"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``text_col`` (null ids: null); special tokens are kept."""
    return df.mapInArrow(_decode_batches(_shared(df, path), ids_col, text_col), _schema(df, f"{text_col} string"))


def encode_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """As ``decode(encode(df))``, in one pass of one Python worker per task: two workers would hold the
    vocabulary twice. No shuffle."""
    spec = _shared(df, path)
    to_ids, to_text = _encode_batches(spec, text_col, ids_col), _decode_batches(spec, ids_col, decoded_col)
    return df.mapInArrow(lambda batches: to_text(to_ids(batches)), _schema(df, f"{ids_col} array<int>", f"{decoded_col} string"))


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of the
    ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8)."""
    spec = _shared(df, path)
    to_ids, to_text = _encode_batches(spec, text_col, "_ids"), _decode_batches(spec, "_ids", "_text")

    def run(batches):
        for batch in to_text(to_ids(batches)):
            ids = [v.values.to_numpy(zero_copy_only=False) for v in batch.column("_ids")]  # views of int32, hashed as they are
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([len(v) for v in ids], pa.int64()),
                    pa.array([hashlib.sha256(v.astype("<i4", copy=False).tobytes()).hexdigest() for v in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("_text").to_pylist()], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
