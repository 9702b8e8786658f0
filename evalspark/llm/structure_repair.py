"""Repair of damaged conversations by lightest derivations (operator 12).

A repaired conversation's role initials are ``(s?(ua)+)?``. Deductions: an item (i, q) says that the first i rows were
dealt with and the automaton of that pattern is in state q. Keep, Rerole and Delete lead to (i + 1, q'), Insert to (i, q');
each adds its cost and puts its initial behind the audit. These functions of (cost, audit) are superior (never
less than their argument) and monotone: of two audits of one item and one cost neither begins the other, as both name i
rows. So Knuth's agenda holds: items are popped in order of (cost, audit), the first pop of an item is its lightest
derivation, and the search ends when the goal is popped. A sound conversation costs as many pops as it has rows.

Rows are dealt by range of (conversation, turn). A conversation inside a range, of at most ``block`` rows, is repaired where it
is. The first and the last of a range and longer ones are cut in blocks: a block's items are derived from each of the four
states, blocks are put together like edges of a hypergraph over their borders (cost, and the order of the audits, which is
that of the first block where they differ), the chosen blocks are derived again and their texts hashed in order. Nobody
holds more than a block of rows, though the audit itself is one string a conversation.

Defined cases: nulls in role, text, and in the damage's key are one space; rows without conversation id are one
conversation with id null. Rows in order of turn (null first), equal turns by role, then by SHA-256 of the text;
repeated rows are rows (the first is no duplicate). An empty table gives no rows. Other columns are not read.
Texts are taken whole, of any length; no text is put into more than one shuffle but for blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, n_partitions

BLOCK = 512
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
#: Automaton of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDS = {0: "u", 1: "u", 2: "a", 3: "u"}  # what Rerole and Insert give
MISSING = {0: 0, 1: 2, 2: 1, 3: 0}  # Inserts that lead to an accepting state
ROLES = {"u": "user", "a": "assistant"}
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
RAW = "part int, pos bigint, turn bigint, role string, text string, th binary, later boolean, same boolean, tail boolean"
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after damage; a dropped row stays as one whose role and text are null."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(one("text"), "[.!?]", "")).when(how != 0, one("text"))
    role = F.when(how == 4, "user").when(how != 0, one("role"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.when(how != 0, F.col("turn")).cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copy"),
    )
    return rows.withColumn("copy", F.explode("copy")).drop("copy")


def faults(text: str, duplicate: bool) -> str:
    """The first fault of a row: b(lank), d(uplicate), t(runcated), or none."""
    bare = text.strip(SPACE)
    return "b" if not bare else "d" if duplicate else "" if bare[-1] in ENDS else "t"


def lightest(rows: list[tuple[str, str]], start: int, goal: bool) -> dict[int, tuple[int, str]]:
    """Lightest derivations over rows (initial, fault) from state ``start``: (cost, audit) of the goal's state, or, without
    ``goal``, of each state reached by the last row's edit."""
    n, done, out = len(rows), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            if not goal or not MISSING[q]:
                out[q] = cost, audit
                if goal:
                    return out
                continue
        else:
            initial, fault = rows[i]
            steps = [(3, "D", i + 1, q)]
            if fault not in ("b", "d"):
                more = int(fault == "t")
                if (q, initial) in STEP:
                    steps.append((more, "K", i + 1, STEP[q, initial]))
                steps.append((2 + more, "R", i + 1, STEP[q, NEEDS[q]]))
            for c, e, j, r in steps:
                if (j, r) not in done:
                    heapq.heappush(agenda, (cost + c, audit + e, j, r))
        r = STEP[q, NEEDS[q]]
        if (i, r) not in done:
            heapq.heappush(agenda, (cost + 2, audit + "I", i, r))
    return out


def repaired(rows: list[tuple[str, str]], audit: str, q: int) -> list[str]:
    """``role:text`` of the rows (role, text) after the edits."""
    out, at = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e == "D":
            continue
        initial = role[:1] if e == "K" else NEEDS[q]
        q = STEP[q, initial]
        out.append(f"{role if e == 'K' else ROLES[initial]}:{text}")
    return out


def counts(rows: list[dict]) -> dict:
    """What adds up over the rows of a conversation, and what its parts need to be put together."""
    kinds = [faults(r["text"], r["dup"]) for r in rows]
    initials = [r["role"][:1] for r in rows]
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    return {
        "kinds": kinds,
        "initials": initials,
        "blank": kinds.count("b"),
        "duplicate": kinds.count("d"),
        "truncated": kinds.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "turns": turns,
    }


def whole(conv: int | None, rows: list[dict]) -> tuple:
    """Result of a conversation held whole."""
    c = counts(rows)
    turns = c["turns"]
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    [(cost, audit)] = lightest(list(zip(c["initials"], c["kinds"])), 0, True).values()
    lines = "\n".join(repaired([(r["role"], r["text"]) for r in rows], audit, 0))
    return conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def _in_ranges(block: int):
    """Sorted rows of a range to results (raw columns null) and, for the conversations at its borders and long ones, the rows themselves."""
    schema = RESULT + ", " + RAW
    no_result = (None,) * (RESULT.count(",") + 1)
    no_raw = (None,) * (RAW.count(",") + 1)

    def raw(part: int, r: dict, tail: bool = False) -> tuple:
        return (r["conv"], *no_result[1:], part, r["pos"], r["turn"], r["role"], r["text"], r["th"], r["later"], r["same"], tail)

    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        pos, first, long, last = 0, True, False, None

        def close() -> list[tuple]:
            rows = [r for r in held if r["role"] is not None]
            if first or long:
                return [raw(part, r) for r in held]
            for r in rows:
                r["dup"] = r["later"] or bool(r["same"])
            return [(*whole(held[0]["conv"], rows), *no_raw)]

        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    if last is not None and r["conv"] != last["conv"]:
                        out += close()
                        held, first, long, pos = [], False, False, 0
                    elif len(held) >= block:
                        out += [raw(part, x) for x in held]
                        held, long = [], True
                    key = (r["turn"], r["th"])
                    r["pos"], pos = pos, pos + 1
                    # of rows that are equal in all columns the first one is no duplicate; before a range's first row nothing is known here
                    r["same"] = None if last is None else r["conv"] == last["conv"] and r["role"] is not None and key == (last["turn"], last["th"])
                    held.append(r)
                    last = r
            if out:
                yield _batch(out, schema)
        if last is not None:
            yield _batch([raw(part, r, r is last) for r in held], schema)

    return run


def _blocks(batches, tails: dict) -> Iterator[tuple[tuple, list[dict]]]:
    """Sorted raw rows as blocks, duplicates told. tails: the last row of the range before, by range."""
    key, held = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for r in batch.slice(k, 256).to_pylist():
                at = (r["conv"], r["part"], r["blk"])
                if at != key and held:
                    yield key, held
                    held = []
                key = at
                same = tails.get(r["part"]) == (r["conv"], r["turn"], r["th"]) if r["same"] is None else r["same"]
                r["dup"] = bool(r["role"] is not None and (r["later"] or same))
                held.append(r)
    if held:
        yield key, held


SUMMARY = "conv bigint, part int, blk bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, min_turn bigint, max_turn bigint, turns bigint, items string"


def _summaries(tails: dict):
    """Blocks to rows of ``SUMMARY``. items: for each start and end the cost and the place of the audit among those of its start."""

    def run(batches):
        for key, held in _blocks(batches, tails):
            rows = [r for r in held if r["role"] is not None]
            c = counts(rows)
            items = []
            for q in range(4):
                found = lightest(list(zip(c["initials"], c["kinds"])), q, False)
                order = sorted(found, key=lambda e: found[e][1])
                items += [f"{q} {e} {found[e][0]} {order.index(e)}" for e in found]
            ends = (c["initials"][0], c["initials"][-1]) if rows else (None, None)
            span = (c["turns"][0], c["turns"][-1]) if c["turns"] else (None, None)
            row = (*key, len(rows), c["blank"], c["duplicate"], c["truncated"], c["illegal"], *ends, *span, len(c["turns"]), ",".join(items))
            yield _batch([row], SUMMARY)

    return run


CHOSEN = "conv bigint, part int, blk bigint, start int, stop int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _put_together(batches):
    """Sorted summaries to rows of ``CHOSEN``: each block's states on the lightest derivation, and on each row the conversation's totals."""

    def solved(blocks: list[dict]) -> list[tuple]:
        state, back = {0: (0, 0)}, []  # state: cost and the place of its audit among the states'
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        turns, low, high, before = 0, None, None, None
        for b in blocks:
            found: dict = {}
            for item in b["items"].split(","):
                q, e, cost, place = map(int, item.split())
                if q in state:
                    new = (state[q][0] + cost, state[q][1], place, q)
                    found[e] = min(found.get(e, new), new)
            order = sorted(found, key=lambda e: found[e][1:3])
            back.append({e: found[e][3] for e in found})
            state = {e: (found[e][0], order.index(e)) for e in found}
            for name in total:
                total[name] += b[name]
            if b["n"]:
                total["illegal"] += before is not None and before + b["first_initial"] not in LEGAL
                before = b["last_initial"]
            if b["turns"]:
                turns += b["turns"] - (b["min_turn"] == high)
                low, high = b["min_turn"] if low is None else low, b["max_turn"]
        q = min(state, key=lambda e: (state[e][0] + 2 * MISSING[e], state[e][1]))
        cost, states = state[q][0] + 2 * MISSING[q], [q]
        for links in reversed(back):
            states.append(links[states[-1]])
        states.reverse()
        gaps = high - low + 1 - turns if turns else 0
        return [(b["conv"], b["part"], b["blk"], s, e, gaps, *total.values(), cost) for b, s, e in zip(blocks, states, states[1:])]

    held: list[dict] = []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and r["conv"] != held[0]["conv"]:
                out += solved(held)
                held = []
            held.append(r)
        if out:
            yield _batch(out, CHOSEN)
    if held:
        yield _batch(solved(held), CHOSEN)


PIECE = "conv bigint, part int, blk bigint, stop int, audit string, kept bigint, lines string"


def _pieces(tails: dict):
    def run(batches):
        for key, held in _blocks(batches, tails):
            rows = [r for r in held if r["role"] is not None]
            c, q, stop = counts(rows), held[0]["start"], held[0]["stop"]
            audit = lightest(list(zip(c["initials"], c["kinds"])), q, False)[stop][1]
            lines = repaired([(r["role"], r["text"]) for r in rows], audit, q)
            yield _batch([(*key, stop, audit, len(lines), "\n".join(lines))], PIECE)

    return run


def _hashed(batches):
    """Sorted pieces to (conv, audit, repaired_sha256); texts are hashed piece by piece."""
    schema = "conv bigint, audit string, repaired_sha256 string"
    conv, state, audits, lines, stop = None, None, [], 0, 0

    def add(text: str, n: int) -> None:
        nonlocal lines
        if n:
            state.update(("\n" if lines else "").encode() + text.encode())
            lines += n

    def close() -> tuple:
        q = stop
        for _ in range(MISSING[stop]):
            add(f"{ROLES[NEEDS[q]]}:", 1)
            q = STEP[q, NEEDS[q]]
        return conv, "".join(audits) + "I" * MISSING[stop], state.hexdigest()

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if state is None or r["conv"] != conv:
                if state is not None:
                    out.append(close())
                conv, state, audits, lines = r["conv"], hashlib.sha256(), [], 0
            audits.append(r["audit"])
            add(r["lines"], r["kept"])
            stop = r["stop"]
        if out:
            yield _batch(out, schema)
    if state is not None:
        yield _batch([close()], schema)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Results (``RESULT``) of the conversations of ``rows`` (conv, turn, role, text; role null: nothing but the conversation's id)."""
    n = n_partitions(rows.sparkSession)
    print_of = F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    rows = rows.withColumn("th", print_of)
    # where a role and text first stand, if they stand at several turns
    seen = rows.filter("role IS NOT NULL").groupBy(F.col("conv").alias("s_conv"), F.col("th").alias("s_th"))
    seen = seen.agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("none")).filter("low < high OR none AND low IS NOT NULL")
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("th") == F.col("s_th")), "left")
    rows = rows.withColumn("later", F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("low"))), F.lit(False)))
    order = ["conv", "turn", "role", "th", "salt"]  # salt: equal rows may go to several ranges
    rows = rows.select("conv", "turn", "role", "text", "th", "later").withColumn("salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt")
    found = cut(rows.mapInArrow(_in_ranges(block), RESULT + ", " + RAW))
    names = [x.split()[0] for x in RESULT.split(", ")]
    results = found.filter("part IS NULL").select(names)

    raw = found.filter("part IS NOT NULL").select(F.col("conv_id").alias("conv"), *[x.split()[0] for x in RAW.split(", ")], F.floor(F.col("pos") / block).alias("blk"))
    ends = sorted((r["part"], (r["conv"], r["turn"], r["th"] and bytes(r["th"]))) for r in raw.filter("tail").select("part", "conv", "turn", "th").collect())  # one row a range
    tails = {p: last for (_, last), (p, _) in zip(ends, ends[1:])}
    at = ["conv", "part", "blk"]
    spread = lambda df, *by: df.repartition(n, *by)
    parts = spread(raw, *at).sortWithinPartitions(*at, "pos").mapInArrow(_summaries(tails), SUMMARY)
    chosen = cut(spread(parts, "conv").sortWithinPartitions(*at).mapInArrow(_put_together, CHOSEN))
    paths = chosen.select(F.col("conv").alias("c_conv"), F.col("part").alias("c_part"), F.col("blk").alias("c_blk"), "start", "stop")
    raw = raw.join(paths, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("part") == F.col("c_part")) & (F.col("blk") == F.col("c_blk")))
    pieces = spread(raw, *at).sortWithinPartitions(*at, "pos").mapInArrow(_pieces(tails), PIECE)
    hashed = spread(pieces, "conv").sortWithinPartitions(*at).mapInArrow(_hashed, "conv bigint, audit string, repaired_sha256 string")
    totals = chosen.drop("part", "blk", "start", "stop").distinct().withColumnRenamed("conv", "conv_id")
    joined = totals.join(hashed, F.col("conv_id").eqNullSafe(F.col("conv")))
    return results.unionByName(joined.select(names))
