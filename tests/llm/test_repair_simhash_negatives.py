"""Conversation repair, SimHash and hard negatives against plain versions."""

import functools
import hashlib
import itertools
import random
import re
import sys

import numpy as np
import pytest
import xxhash
from brute import LOW, hexdigest
from pyspark.sql import functions as F

from earshot.llm import conversation_repair, hard_negatives, queries, simhash
from earshot.llm.scratch import Scratch

CLASHES = ("place", "segment", "mark", "marks", "first", "n", "digest", "dealt", "step", "edit", "fault", "cost", "print", "node", "parent", "a", "b", "gray",
           "block", "set", "no", "id", "i", "j", "vector", "is_anchor", "score", "rank")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- conversations


def plain_repair(turns):
    """Counts, cost, edits and repaired text of one conversation's (turn, role, text)."""
    low = lambda x: (x[0] is not None, x[0] or 0, x[1], hexdigest_md5(x[2]))
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=low)
    seen, faults = set(), []
    for _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state):
        """(cost, edits, rows) from row i on; states: '' nothing, or the last role's initial."""
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        found = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        made = "assistant" if state == "u" else "user"
        if i < len(turns):
            _, role, text = turns[i]
            cut = faults[i] == "truncated"
            steps = [(3, "D", state, ())]
            if faults[i] in ("", "truncated"):
                if role[:1] and role[:1] in legal:
                    steps.append((cut, "K", role[0], (f"{role}:{text}",)))
                steps.append((2 + cut, "R", made[0], (f"{made}:{text}",)))
            found += [(c + x[0], e + x[1], r + x[2]) for c, e, q, r in steps for x in [best(i + 1, q)]]
        return min(found + [(2 + c, "I" + e, (f"{made}:", *r)) for c, e, r in [inserted(i, made[0])] if c < 1000])

    def inserted(i, state):
        """After an inserted row: no row of the other kind is worth inserting twice in a row."""
        done = [(0, "", ())] if i == len(turns) and state == "a" else []
        made = "assistant" if state == "u" else "user"
        legal = "a" if state == "u" else "u"
        if i < len(turns):
            _, role, text = turns[i]
            cut = faults[i] == "truncated"
            steps = [(3, "D", state, ())]
            if faults[i] in ("", "truncated"):
                if role[:1] == legal:
                    steps.append((cut, "K", legal, (f"{role}:{text}",)))
                steps.append((2 + cut, "R", made[0], (f"{made}:{text}",)))
            done += [(c + x[0], e + x[1], r + x[2]) for c, e, q, r in steps for x in [best(i + 1, q)]]
        if state == "u":
            done += [(2 + c, "I" + e, ("assistant:", *r)) for c, e, r in [inserted(i, "a")]]
        return min(done, default=(1000, "", ()))

    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, edits, repaired = best(0, "")
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hexdigest("\n".join(repaired))


def hexdigest_md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("segment", [3, 1 << 12])
def test_repair_is_cheapest_and_least(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    r = random.Random(segment)
    talks = {i: random_turns(r, i % 14 + 1) for i in range(60)} | {None: random_turns(r, 5), -7: [(0, "user", "x" * 300_000), (1, "assistant", "y" * 10 + "?")]}
    table = [(c, *t) for c, ts in talks.items() for t in ts]
    turns = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("extra") for c in CLASHES}).repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in conversation_repair.digests(conversation_repair.repair(turns)).collect()}
    assert set(got) == set(talks)
    for name, own in talks.items():
        assert got[name] == plain_repair(own), (name, own)


def random_turns(r, n):
    out = []
    for i in range(n):
        turn = None if r.random() < 0.1 else r.randrange(n)
        text = r.choice(["Fine.", "So?", "cut off", "", " \t", "no end", "Yes!", "Done. \n", None])
        if text and r.random() < 0.5:
            text = f"{i} {text}"
        out.append((turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    return out


def test_block_tables_match_single_steps():
    known = conversation_repair.tables()
    r = random.Random(1)
    assert len(known.vectors) < 100
    for _ in range(300):
        symbols = [r.randrange(conversation_repair.SYMBOLS) for _ in range(conversation_repair.BLOCK)]
        after = r.randrange(len(known.vectors))
        code, now, added = 0, after, 0
        for s in symbols:
            code = code * conversation_repair.SYMBOLS + s
        for s in reversed(symbols):
            now, more = known.step[now][s]
            added += more
        assert (known.to[after, code], known.add[after, code]) == (now, added)


def test_hot_conversation_is_dealt_over_tasks(spark, monkeypatch):
    """One conversation with most rows: its segments are edited in several tasks, with one state from end to end."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", 50)
    talk = [(i, ("user", "assistant", "assistant", "user", "system")[i * i % 5], f"{i}." if i % 11 else "open") for i in range(600)]
    turns = spark.createDataFrame([(1, *t) for t in talk], "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these tables are tiny
    try:
        edits = conversation_repair.repair(turns)
        assert edits.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    roles = [x.role for x in edits.where("role is not null").orderBy("place", "step").collect()]
    assert re.fullmatch("s?(ua)+", "".join(x[0] for x in roles))
    sys.setrecursionlimit(20_000)
    assert tuple(conversation_repair.digests(edits).first())[1:] == plain_repair(talk)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    names = spark.createDataFrame([(1,), (None,)], "conv_id bigint")
    assert conversation_repair.repair(none).count() == 0
    empty = (0, 0, 0, 0, 0, 0, "", hexdigest(""))
    assert rows(conversation_repair.audit(none, names)) == sorted([(1, *empty), (None, *empty)], key=repr)
    gone = spark.createDataFrame([(5, None, None, None), (5, 2, "user", " "), (5, 9, "tool", None)], none.schema)
    got = rows(conversation_repair.audit(gone, gone))
    assert got == [(5, 6, 3, 0, 0, 2, 9, "DDD", hexdigest(""))]


# --- SimHash


def plain_print(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    ids = sorted({d for d, _ in prints if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, p), (b, q) in itertools.combinations([x for x in prints if x[0] is not None], 2):
        if (p ^ q).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 64)
    r = random.Random(2)
    base = [f"Wört{i}" for i in range(300)]
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, "x" * 5000), (7, " ".join(base)), (None, " ".join(base)), (8, "tie"), (8, "other"), (None, None)]
    for i in range(9, 80):
        texts.append((i, " ".join("new" if r.random() < 0.01 else w for w in base[: r.choice([3, 40, 300])])))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit("extra") for c in CLASHES}).repartition(3)
    for n, distance in ((3, 2), (5, 3), (1, 0)):
        prints = [(d, plain_print(t, n)) for d, t in texts]
        of = plain_components(prints, distance)
        want = sorted(((d, f"{p:016x}", of.get(d), d is None or of[d] == d) for d, p in prints), key=repr)
        assert rows(simhash.near_duplicates(docs, simhash.Rule(n, distance))) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,fanout", [(1, 1), (2, 2), (8, 4)])
def test_index_finds_every_link(spark, monkeypatch, leaf, fanout):
    """Dense balls of fingerprints, spread ones, and both ends of the range."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FANOUT", fanout)
    r = random.Random(leaf)
    values = {0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    for centre in [r.getrandbits(64) for _ in range(6)]:
        for _ in range(40):
            x = centre
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            values.add(x)
    values |= {r.getrandbits(64) for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    table = spark.createDataFrame([(x,) for x in signed], "print bigint")
    found = simhash.links(table, 2, Scratch(spark))
    got = {frozenset((a, b)) for a, b in rows(found)}
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    of = components_of(signed, near)
    assert of == components_of(signed, [tuple(x) for x in got])
    ranks = [r.g for r in table.select(simhash.gray_rank(F.col("print")).alias("g"), "print").orderBy("g").collect()]
    assert len(set(ranks)) == len(signed)


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- hard negatives


def plain_negatives(table):
    usable = [
        (i, v, [int(np.floor(256 * float(np.float32(x)))) for x in e], (lab + 1) % 10 if v is not None and v % 7 == 0 else lab)
        for i, (v, e, lab) in enumerate(table)
        if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, v, q, lab in usable:
        if v is None or v % 100:
            continue
        score = [(sum(x * y for x, y in zip(q, p, strict=False)), w, m == lab) for j, w, p, m in usable if j != i]
        for ps, pid, _ in sorted((s for s in score if s[2]), key=key)[:5]:
            inside = sorted((s for s in score if not s[2] and 30 * ps <= 100 * s[0] <= 90 * ps), key=key)[:10]
            out += [(v, pid, k, nid, ps, ns) for k, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ROW_GROUP", 4 * block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_GROUP", 2)
    r = random.Random(block)
    table = []
    for v in range(0, 700):
        table.append((v, [r.choice([-0.3, -0.1, 0.0, 0.05, 0.1, 0.2, 0.3]) for _ in range(12)], r.randrange(10) if v % 3 else 4))
    table += [(100, table[100][1], 1), (200, None, 1), (300, [0.1, None], 1), (400, [float("nan")] * 12, 1), (500, [float("inf")] * 12, 2), (None, table[7][1], 3),
              (None, table[200][1], 5), (800, [], 4), (900, [0.2, 0.1], 4), (1000, [0.0] * 12, 4), (1100, [0.1] * 12, None), (1200, [-0.3] * 14, 4)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit("extra") for c in CLASHES}).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label)
    assert rows(found) == plain_negatives(table)
    assert hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_hard_negatives_of_large_components(spark, monkeypatch):
    """Scores that doubles can't hold, that 64 bits can't, and one huge row that is nobody's negative."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    r = random.Random(1)
    small = lambda: [r.choice([0.0, 0.00390625, 0.0078125, 0.02, 0.3]) for _ in range(6)]
    table = [(v, [0.0, 1048576.0 if v % 5 else 524288.0, *small()], v % 4) for v in range(1, 402)]
    table += [(100 * v, [0.0, 1e6 * v, *small()], v % 4) for v in range(5, 12)]
    table += [(1301 + v, [x, 1e6, *small()], v % 4) for v, x in enumerate([3e38, -3e38, 1e30, 0.1])] + [(1400, [1e30, 1.0, *small()], 1), (1500, [-1e30, 7.0, *small()], 2)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = plain_negatives(table)
    assert any(x[4] > 2**53 and x[4] % 2 for x in want)
    assert all(abs(x[i]) < 2**63 for x in want for i in (4, 5))
    assert rows(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label)) == want
    beyond = [2**70 + 5, 2**70, 2**63, 2**63 - 1, 0, -(2**63), -(2**63) - 1, -(2**90)]
    cells = [hard_negatives._cells(x) for x in beyond]
    assert cells == sorted(cells, reverse=True) and [hard_negatives._number(*c) for c in cells[:6]] == beyond[:6]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        rows(hard_negatives.mine(spark.createDataFrame([(100, [1e9], 1), (1, [1e30], 1), (2, [5e29], 2)], df.schema), F.col("vec_id") == 100))


def test_damage_covers_every_kind(spark, middle_dir):
    talks = spark.read.parquet(f"{middle_dir}/conversations.parquet")
    before, after = talks.count(), queries.damaged(talks)
    n = F.crc32(F.concat_ws(":", "conv_id", "turn")) % 20
    kinds = {x[0]: x[1] for x in talks.groupBy(n).count().collect()}
    assert after.count() == before - kinds[0] + kinds[3] and after.columns == ["conv_id", "turn", "role", "text"]
