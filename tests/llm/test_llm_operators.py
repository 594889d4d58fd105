"""Each operator against its plain version, on texts that are null, empty, very long, tied or repeated."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from earshot.llm import bpe, bytewords, chat, components, decontamination, licenses, near_dedup, packing, pii, quality_rules, secrets, sharding  # noqa: E402
from earshot.llm.queries import tokenizer_path  # noqa: E402
from earshot.llm.scratch import Scratch  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Columns with names that the operators use themselves.
CLASHES = ("node", "root", "text_key", "h", "bytes", "words", "start", "end", "t", "d", "cuts", "kind", "shard_id", "depth", "gone", "row", "key", "path")
RANDOM = random.Random(5)
VOCABULARY = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
BASE = [RANDOM.choice(VOCABULARY) for _ in range(120)]


def changed(words, *at):
    return " ".join("CHANGED" + str(i) if i in at else w for i, w in enumerate(words))


TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "Two words"), (5, "two WORDS"), (6, "x" * 60_000), (7, " ".join(BASE)), (8, " ".join(BASE)),
    (8, " ".join(BASE)), (None, " ".join(BASE)), (9, changed(BASE, 40)), (10, changed(BASE, 40, 90)), (11, changed(BASE, *range(0, 120, 9))),
    (12, " ".join(BASE[:60])), (13, "a b c"), (14, "A B C"), (15, " ".join(["again and again"] * 5_000)), (16, "ein Wort\nein Wort\n \n \nein Wort\r\n"),
    (17, "🙂 ünïcode Ärger " * 30), (18, "lone"), (19, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(d, t, "en" if (d or 0) % 3 else None, "src") for d, t in TEXTS], SCHEMA)
    return rows.withColumns({c: F.lit("extra") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- helpers


def test_words_of_bytes_match_plain_words():
    import pyarrow as pa

    texts = [t for _, t in TEXTS] + ["", "a", "é é", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001]
    got, hashes = {}, {}
    for part in bytewords.slices(pa.array(texts)):
        found = bytewords.pieces(part, bytewords.SPACE, bytewords.LOWER)
        for text, a, b, h in zip(found.text, found.start, found.end, found.hash, strict=True):
            word = part.data[a:b].tobytes().decode().translate(brute.LOW)
            got.setdefault(part.first + int(text), []).append(word)
            assert hashes.setdefault(word, h) == h
    import re

    want = {i: w for i, t in enumerate(texts) if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOW)))}
    assert got == want and len(set(hashes.values())) == len(hashes)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, 900 + i) for i in range(20)] + [(7, 7), (900, 5), (300, 301)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark))
    got = dict(rows(found, "node", "root"))
    assert {n for n, r in got.items() if r == 100} == set(range(100, 131))
    assert got[900] == 5 and got[5] == 5 and got[301] == 300 and 7 not in got


# --- 1


def test_decontamination(spark, docs, nothing):
    items = [(1, " ".join(BASE[30:45])), (10, " ".join(BASE[100:112])), (2, "two words"), (3, "again"), (4, None), (5, ""), (6, "never seen in any text"),
             (None, "ünïcode ärger"), (1, " ".join(BASE[30:45])), (7, " ".join(VOCABULARY[:60]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontamination.find(docs, benchmark), *columns) == sorted(brute.decontamination(TEXTS, items), key=repr)
    assert decontamination.find(nothing, benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.find(docs, benchmark.limit(0)).collect())
    kept = decontamination.drop_contaminated(docs, benchmark)
    bad = [r[0] for r in brute.decontamination(TEXTS, items) if r[5]]
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d) for d, t in TEXTS if d not in bad)


@pytest.mark.parametrize("shift", range(6))
def test_every_shared_window_is_found(spark, shift):
    """Passages of exactly ten words at any offset, between words of their own."""
    r = random.Random(shift)
    word = lambda: f"v{r.randrange(40)}"  # few words, so hashes tie often
    item = [word() for _ in range(40)]
    texts = [(i, " ".join([word() for _ in range(shift + i)] + item[i : i + 10] + [word() for _ in range(9)])) for i in range(31)]
    got = decontamination.find(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert rows(got.drop("text_key")) == sorted(brute.decontamination(texts, [(1, " ".join(item))]), key=repr)


# --- 2


def test_secrets(spark, nothing):
    r = random.Random(3)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts, true = [], set()
    for i in range(120):
        words = " ".join(r.choice(VOCABULARY).lower() for _ in range(30))
        if i % 3 == 0:
            secret = key(40)
            true.add((i, f'{words} token = "'.__len__()))
            texts.append((i, f'{words} token = "{secret}" {words}'))
        elif i % 3 == 1:
            texts.append((i, f"{words} internationalization-of-words {words} counterrevolutionaries-" + "x" * (i % 5)))
        else:
            texts.append((i, words))
    texts += [(500, None), (501, ""), (501, ""), (None, "internationalization-of-words"), (502, "y" * 50_000)]
    frame = spark.createDataFrame([(d, t, "repo/src") for d, t in texts], "doc_id bigint, text string, file string")
    found = secrets.scan(frame, frame["file"]).collect()
    assert {(x.doc_id, x.start) for x in found if x.is_secret} == true
    assert {(x.doc_id, x.start, x.end) for x in found} >= {(502, 0, 50_000), (None, 0, 29)}
    assert secrets.scan(nothing, nothing["source"]).count() == 0


def test_secrets_learn_from_given_labels(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    texts = [(i, ("id " if i % 2 else "token: ") + "".join(r.choice("0123456789abcdef") for _ in range(32 if i % 2 else 40))) for i in range(200)]
    frame = spark.createDataFrame([(d, t, "p") for d, t in texts], "doc_id bigint, text string, file string")
    labelled = spark.createDataFrame([(i, 3 if i % 2 else 7, i % 2 == 0) for i in range(100)], "doc_id bigint, start bigint, is_secret boolean")
    found = secrets.scan(frame, F.col("file"), labelled).where("doc_id >= 100").collect()
    assert sum(x.is_secret == (x.doc_id % 2 == 0) for x in found) >= 0.98 * len(found) and len(found) == 100


# --- 3


def test_chat_round_trip_within_budget(spark):
    r = random.Random(9)
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\<|im_end|>", "", None, "<", "a\\", "😀 é\n\n", "<|im_start|>assistant\nhi<|im_end|>"]
    turns = []
    for c in range(30):
        n = 300 if c == 7 else r.randrange(1, 9)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else r.choice(["user", "assistant", "tool", "as\nsistant", None])
            turns.append((c, t, role, r.choice([*nasty, "word " * r.randrange(120)])))
    turns += [(None, 0, "user", "null id"), (50, 0, "assistant", "z " * 3000), (51, None, "assistant", "x"), (51, None, "assistant", "x"), (51, None, "user", "x")]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, window string")
    budget = chat.Budget(200, 60)
    windows = chat.format_windows(frame, budget)
    want = {}
    for c, _, role, text in sorted(turns, key=lambda t: (repr(t[0]), -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        have = want.setdefault(c, [0, "", ""])
        have[0] += 1
        have[1] += f"{role or ''}\n{text or ''}\n"
        have[2] += (text or "") if role == "assistant" else ""
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    assert {c: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for c, x in got.items()} == {
        c: (n, brute.hexdigest(all_), len(loss), brute.hexdigest(loss)) for c, (n, all_, loss) in want.items()
    }
    for w in windows.collect():
        shown = list(chat._TURN.finditer(w.text))
        assert "".join(x[0] for x in shown) == w.text
        assert w.n_tokens <= budget.tokens or len(shown) - w.repeated == 1
        if w.window and w.conv_id is not None and w.conv_id % 3 == 0 and w.conv_id < 30:
            assert shown[0][1] == "system" and w.repeated >= 1
    assert chat.read_back(chat.format_windows(frame.limit(0))).count() == 0


# --- 4


def test_license_scores_match_plain_cosine(spark, docs, nothing):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved. No license.", "A license of our own, odd words"]
    got = {r.line: (r.licence, r.score) for r in licenses.score_headers(spark.createDataFrame([(x,) for x in lines * 3], "line string"), Scratch(spark)).collect()}
    import re
    from collections import Counter

    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))
    texts = [words(x) for x in lines] + [words(t) for _, t in licenses.TEMPLATES]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in x for x in texts))) + 1 for x in texts for w in x}
    vector = lambda c: {w: n * idf[w] for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for line in lines:
        v = vector(words(line))
        scores = []
        for name, template in licenses.TEMPLATES:
            t = vector(words(template))
            scores.append((-round(sum(v[w] * t.get(w, 0) for w in v) / norm(v) / norm(t), 6), name))
        best = min(scores)
        if -best[0] >= licenses.LEAST:
            assert got[line][0] == best[1] and got[line][1] == pytest.approx(-best[0], abs=2e-6)
        else:
            assert line not in got
    assert licenses.scan(nothing, nothing["source"]).count() == 0
    assert licenses.scan(docs, docs["source"]).where("found = 'none'").count() == len(TEXTS)


def test_license_inheritance(spark):
    mit, gpl, apache = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
    long = "word " * 200
    files = [
        (1, "a/LICENSE", mit), (2, "a/x.c", "int x;"), (3, "a/b/c/y.c", None), (4, "a/b/c/d/COPYING", gpl), (5, "a/b/c/d/e/f.c", ""), (6, "a/b/own.c", f"{apache}\n{long}"),
        (7, "z/q.c", "none here"), (8, None, "text"), (8, None, "text"), (9, "t/LICENSE", mit), (10, "t/NOTICE", apache), (11, "t/u.c", "x"), (12, "ab/x.c", "x"),
    ]
    frame = spark.createDataFrame([(*f, "e") for f in files], "doc_id bigint, file string, text string, licence string")
    got = {r.doc_id: (r.licence, r.found, r.licence_dir) for r in licenses.scan(frame, frame["file"]).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("MIT", "inherited", "a"), 4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "inherited", "a/b/c/d"),
        6: ("Apache-2.0", "own", None), 7: (None, "none", None), 8: (None, "none", None), 9: ("MIT", "own", None), 10: ("Apache-2.0", "own", None),
        11: ("Apache-2.0", "inherited", "t"), 12: (None, "none", None),
    }


# --- 5


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_encoding_matches_the_library(docs, nothing, tokenizer):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode(docs, tokenizer_path()).collect()}
    for doc, text in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        row = got[doc, brute.hexdigest(raw)]
        assert (row.n_tokens, row.ids, row.decoded_sha256) == (len(ids), raw, brute.hexdigest(tokenizer.decode(ids, skip_special_tokens=False)))
    assert bpe.encode(docs, tokenizer_path()).count() == len(TEXTS)
    assert bpe.encode(nothing, tokenizer_path()).count() == 0


def test_automaton_on_random_texts(tokenizer):
    automaton = bpe.compile_file(tokenizer_path())
    r = random.Random(1)
    pieces = "abcdefgh tion ing the 0123456789.,;'s'll\n\t\r  　\x85éÜ日本語½²Ⅳٱ😀_~"
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["a" * n for n in range(70)] + ["<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "  a", "a  ", " \n b"]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(automaton.encode(text), "<u4").tolist() == ids, text
        assert automaton.decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)


def test_gadgets_on_self_overlapping_merges():
    labels = [b"a", b"b", b"aa", b"aaaa", b"ab", b"aab"]
    merges = [(0, 0, 2), (2, 2, 3), (0, 1, 4), (2, 1, 5)]
    automaton = bpe.Automaton(labels, merges, {}, False)

    def plain(word):
        path = [labels.index(bytes([c])) for c in word]
        for u, v, w in merges:
            i, out = 0, []
            while i < len(path):
                if path[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(path[i])
                    i += 1
            path = out
        return path

    import itertools

    for n in range(1, 10):
        for word in itertools.product(b"ab", repeat=n):
            assert automaton.walk(bytes(word)) == plain(bytes(word)), word


# --- 6

PERSONAL = [
    "", None, "mail a.b@c.de.fg and x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.1.2.3", "4111 1111 1111 1111 and 4111111111111112 and 4111-1111-1111-1111-1",
    "+1 (234) 567-8901 +12 +1234567890123456", "é ü a@b.c 😀 d@e.f.g", "a@b.c_d@e.f g@h.i@j.k", "1 " * 40_000, "a" * 60_000 + "@" + "b" * 60_000, "a@" + "b." * 30_000 + "c",
    "." * 50_000 + "1.1.1.1", "+1" + "(" * 50_000, "9" * 60_000, "4111111111111111 " * 300,
]


def test_base_spans(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)] + [(2, PERSONAL[2], "x")], "doc_id bigint, text string, start string")
    got = {}
    for r in pii.report(frame).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[2]) == 2
    for i, text in enumerate(PERSONAL):
        want = brute.personal_data(text)
        names = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        for row in got[i]:
            assert [row[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], text and text[:60]
            assert row.base_sha256 == brute.hexdigest(names)
            assert set(names.split(",")) <= set(row.spans.split(","))
    assert pii.report(frame.limit(0)).count() == 0


def test_redaction(spark, docs):
    texts = [(1, "mail a@b.cd, call +1 (234) 567-8901.", 36), (2, None, None), (3, "nothing é", 9), (4, "é4111111111111111é1.2.3.4", 25)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(frame).collect()}
    assert got == {1: ("mail [EMAIL], call [PHONE].", 27), 2: (None, None), 3: ("nothing é", 9), 4: ("é[CARD]é[IP]", 12)}
    same = pii.redact(docs)
    assert same.columns == docs.columns and rows(same, "doc_id", "text") == sorted(TEXTS, key=repr)


def test_model_adds_other_forms(spark):
    """Phone numbers without plus and addresses with (at) are held out; numbers that only look similar stay."""
    r = random.Random(2)
    number = lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    word = lambda: r.choice(["lorem", "ipsum", "dolor", "été", "sit", "amet"])
    texts = [(i, f"{word()} call +1 {number()} {word()} or u{i}@mail{i}.example.com {word()}") for i in range(200)]
    texts += [(1000 + i, f"{word()} {r.randrange(10**15, 10**16)} {word()} 999.{r.randrange(300, 999)}.{i}.7 {word()}") for i in range(200)]
    hidden = [(2000 + i, f"{word()} call {number()} {word()} or v{i}(at)mail{i}.example.com {word()}") for i in range(50)]
    found = {x.doc_id: x.spans for x in pii.report(spark.createDataFrame(texts + hidden, "doc_id bigint, text string")).collect()}
    assert sum("phone" in found[2000 + i] for i in range(50)) >= 45 and sum("email" in found[2000 + i] for i in range(50)) >= 45
    base = {i: brute.personal_data(t) for i, t in texts}
    for i, text in texts:
        assert len([x for x in found[i].split(",") if x]) == sum(map(len, base[i].values())), text


def test_all_candidates_are_training_rows(spark, monkeypatch):
    """Every distinct labelled candidate trains or calibrates the model, however many there are."""
    monkeypatch.setattr(pii, "TRAIN_ROWS", 60, raising=False)  # the bound there was
    texts = [(i, f"mail u{i}@mail{i}.example.com or number 999.{i % 90 + 300}.{i}.7") for i in range(300)]
    texts = pii.keyed(spark.createDataFrame(texts + texts, "doc_id bigint, text string"))
    base = pii._matches(texts, pii.PATTERNS, pii.HINTS).where(pii._passes(pii.F.col("kind"), pii.F.col("match")))
    wide = pii._matches(texts, {"ip": pii.WIDE["ip"]}, pii.WIDE_HINTS).withColumn("touches", pii.F.lit(False))
    training = pii._training(base, wide, Scratch(spark))
    sizes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    assert sizes == {1.0: 900, 0.0: wide.count()} and wide.count() > 60  # an address has two other forms
    assert 0.15 < training.where("held_out").count() / training.count() < 0.35


def _labelled(rows, **features):
    """Training rows from ``kind, label, fold`` with fixed features."""
    given = {c: pii.F.lit(0.0) for c in pii.FEATURES} | features
    return rows.withColumn("held_out", pii.F.col("fold") == 0).withColumns({c: v.cast("double") for c, v in given.items()})


def test_cut_points_come_from_all_rows(spark):
    """Features that four rows of 100,000 show are cut, which a sample of rows mostly misses."""
    rare = pii.FEATURES[7:]
    rows = spark.range(100_000, numPartitions=4).selectExpr("id", "'email' kind", f"double(id < {4 * len(rare)}) label", "int(id % 4) fold")
    marks = {c: (pii.F.col("label") == 1) & (pii.F.floor(pii.F.col("id") / 4) == i) for i, c in enumerate(rare)}
    training = _labelled(rows, length=pii.F.pmod(pii.F.xxhash64("id"), pii.F.lit(1 << 30)), **marks)
    model, _ = pii._fit(training, Scratch(spark))
    same = training.withColumn("length", pii.F.lit(float(1 << 29)))  # so that only the rare features tell
    scores = pii._score(model, same).groupBy("label").agg(pii.F.min("score").alias("low"), pii.F.max("score").alias("high"))
    found = {r.label: (r.low, r.high) for r in scores.collect()}
    assert found[1.0][0] > found[0.0][1]


def test_thresholds_come_from_all_candidates(spark):
    """False candidates count against a kind in whichever part of the corpus they are."""
    rows = spark.range(400).selectExpr("'email' kind", "double(id % 8 < 4) label", "int(id % 4) fold", "id % 8 < 4 at")
    mixed = spark.range(400).selectExpr("'ip' kind", "double(id % 4 = 0 or id >= 100) label", "int(id % 4) fold", "true at")
    training = _labelled(rows.union(mixed), has_at=pii.F.col("at"), kind_no=pii.F.col("kind") == "ip").drop("at")
    _, thresholds = pii._fit(training, Scratch(spark))
    assert {r.kind for r in thresholds.collect()} == {"email"}  # 325 of 400 are no 99 percent


@pytest.mark.parametrize("n", [40, 39])
def test_labels_of_all_parts_are_counted(spark, n):
    """Whether there are enough labels is counted in all candidates, not in one part of them."""
    rows = spark.range(2 * n).selectExpr("'email' kind", f"double(id < {n}) label", "int(1 + id % 3) fold", f"id < {n} at")
    assert (pii._fit(_labelled(rows, has_at=pii.F.col("at")).drop("at"), Scratch(spark)) is not None) == (n == 40)


def test_lists_of_numbers_keep_all_their_spans(spark):
    """Bridged neighbours are each added, and a base span takes only what overlaps itself."""
    text = "234-567-8901 345-678-9012 456-789-0123"
    phones = [(0, 12), (13, 25), (26, 38)]
    spans = [(1, "phone", a, b, 0.9) for a, b in phones] + [(1, "card", 8, 29, 0.8)]
    scored = spark.createDataFrame([(*x, 1) for x in spans], "doc_id bigint, kind string, start bigint, end bigint, score double, text_key bigint")
    assert rows(pii._apart(scored), "kind", "start", "end") == [("phone", a, b) for a, b in phones]
    texts = pii.keyed(spark.createDataFrame([(1, text), (2, "tel 234 567 8901 192.168.10.20")], "doc_id bigint, text string"))
    base = pii._matches(texts, pii.PATTERNS, pii.HINTS).where(pii._passes(pii.F.col("kind"), pii.F.col("match")))
    both = base.withColumn("is_base", pii.F.lit(True)).unionByName(pii._matches(texts, pii.WIDE, pii.WIDE_HINTS).withColumn("is_base", pii.F.lit(False)))
    free = both.withColumn("touches", pii._overlaps_base(both)).where("not is_base and not touches")
    assert set(rows(free, "doc_id", "kind", "start", "end")) >= {(1, "phone", a, b) for a, b in phones} | {(2, "phone", 4, 16)}
    assert not [x for x in rows(free, "doc_id", "kind", "end") if x[0] == 2 and x[2] > 17]


# --- 7


def test_packing_is_lossless_and_best_fit(spark, docs, nothing):
    packed = packing.pack(docs, 256, 20_000).cache()
    back = {}
    for r in packing.unpack(packed, 256).collect():
        back.setdefault(r.doc_id, []).append((r.piece, bytes(r.text_bytes)))
    want = {}
    for doc, text in TEXTS:
        want.setdefault(doc, []).append((text or "").encode())
    for doc, texts in want.items():
        if len(texts) == 1:
            assert b"".join(t for _, t in sorted(back[doc])) == texts[0]
    assert sum(len(t) for x in back.values() for _, t in x) == sum(len(t) for x in want.values() for t in x)
    for m in packed.collect():
        assert len(m.ids) == m.n_rows * 256 * 2
        for cut, resets in zip(m.cu_seqlens, m.position_resets, strict=True):
            assert cut[0] == 0 and cut[-1] <= 256 and resets == cut[:-1] and sorted(set(cut)) == cut
            places = packing.position_ids(resets, 256)
            assert all(places[a] == 0 for a in resets) and places.max() < 256
    assert packing.pack(nothing).count() == 0


def test_best_fit_matches_plain():
    r = random.Random(8)
    for _ in range(60):
        lengths, size = [r.randrange(1, 33) for _ in range(r.randrange(60))], 32
        rooms, plain = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = min((x for x in rooms if x >= lengths[i]), default=None)
            if fit is None:
                rooms.append(size - lengths[i])
            else:
                rooms[rooms.index(fit)] -= lengths[i]
            plain.append(i)
        found = packing.best_fit(lengths, size)
        assert sorted(i for row in found for i in row) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in row) for row in found) == sorted(rooms)


# --- 8


def test_quality_counts(spark, docs, nothing):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    found = quality_rules.verdicts(docs, labels)
    want = [(d, *brute.quality_counts(t)) for d, t in TEXTS]
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert all(r.kept == (not r.base_failed) for r in found.collect())  # too few labels for any cutoff
    kept = quality_rules.keep_good(docs, labels)
    good = {w[0] for w in want if not w[-1]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    assert quality_rules.verdicts(nothing, labels).count() == 0 and quality_rules.verdicts(docs, labels.limit(0)).count() == len(TEXTS)


def test_cutoffs_keep_their_promise(spark):
    r = random.Random(6)
    texts, labels = [], []
    for i in range(3000):
        junk = i % 5 == 0
        words = [r.choice(VOCABULARY) + ("###" if junk and r.random() < 0.7 else "") for _ in range(30)]
        texts.append((i, " ".join(words), "en" if i % 2 else "de"))
        if i < 2500:
            labels.append((i, int(not junk), 0))
    texts += [(10_000 + i, "### " * 5 + " ".join(VOCABULARY[i : i + 25]), "rare") for i in range(5)]
    labels += [(10_000 + i, 1, 0) for i in range(5)]
    found = {x.doc_id: x for x in quality_rules.verdicts(
        spark.createDataFrame(texts, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ).collect()}
    fresh = [i for i in range(2500, 3000)]
    assert sum(not found[i].kept for i in fresh if i % 5 == 0) >= 90
    assert sum(not found[i].kept for i in fresh if i % 5) <= 0.05 * 400
    assert all(found[10_000 + i].kept for i in range(5))  # a stratum too small for a cutoff


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (50, 400, 0.15), (10, 10, 0.5)):
        plain = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(plain, rel=1e-9)


# --- 9


@pytest.mark.parametrize("limit", [1 << 30, 40_000, 1_000])
def test_shards_fit_and_split_only_when_needed(docs, nothing, limit):
    found = sharding.assign(docs.unionAll(docs.where("doc_id = 4")).unionAll(docs.where("doc_id = 4")), limit).collect()
    assert len(found) == len(TEXTS) + 2
    sizes = {}
    for r in found:
        sizes.setdefault(r.shard_id, [r.depth, r.shard_rows, r.shard_bytes, 0])[3] += 1
    assert all(n == rows_ for _, rows_, _, n in sizes.values())
    assert all(b <= limit or n == 1 for _, n, b, _ in sizes.values())
    names = [s for s in sizes if "-" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # prefixes of none other
    for depth in {len(s) for s in names if s}:
        for s in {s for s in names if len(s) == depth}:  # its parent was over the limit
            parent = sum(v[2] for k, v in sizes.items() if k.startswith(s[:-1]))
            assert parent > limit
    assert sharding.assign(nothing, limit).count() == 0


def plain_shards(sizes, limit, depth=0, prefix=0):
    """Extendible hashing a bit at a time: {hash: (depth, prefix)} of the distinct hashes with their bytes."""
    if sum(sizes.values()) <= limit or depth == 64:
        return {h: (depth, prefix) for h in sizes}
    out = {}
    for bit in (0, 1):
        half = {h: b for h, b in sizes.items() if (h >> (63 - depth)) & 1 == bit}
        out |= plain_shards(half, limit, depth + 1, 2 * prefix + bit) if half else {}
    return out


@pytest.mark.parametrize("limit", [200, 3_000, 70_000])
def test_shards_match_splitting_bit_by_bit(spark, docs, limit):
    hashed = docs.selectExpr("doc_id", "xxhash64(cast(doc_id as bigint), text) as h", f"coalesce(octet_length(text), 0) + {sharding.ROW_BYTES} as bytes").collect()
    sizes = {}
    for r in hashed:
        sizes[r.h % 2**64] = sizes.get(r.h % 2**64, 0) + r.bytes
    want = plain_shards(sizes, limit)
    names = sorted((repr(r.doc_id), f"{want[r.h % 2**64][1]:0{want[r.h % 2**64][0]}b}" if want[r.h % 2**64][0] else "") for r in hashed)
    assert sorted((repr(r.doc_id), r.shard_id.split("-")[0]) for r in sharding.assign(docs, limit).collect()) == names


def test_shards_deal_equal_rows_into_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SALT_ROWS", 150)
    frame = spark.range(2000).selectExpr("7 as doc_id", "'same text' as text", "id as h")
    limit = 50 * (9 + sharding.ROW_BYTES)
    found = sharding.assign(frame, limit)
    assert found.count() == 2000 and found.where(f"shard_bytes > {limit}").count() == 0 and found.where("shard_rows > 50").count() == 0
    sharding.write(frame, str(tmp_path / "shards"), limit)
    assert rows(spark.read.parquet(str(tmp_path / "shards")).select("h")) == rows(frame.select("h"))


# --- 10


@pytest.mark.parametrize("rule", [(5, 80), (3, 85)])
def test_near_duplicates(docs, nothing, rule):
    found = near_dedup.near_duplicates(docs, near_dedup.Rule(*rule))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(TEXTS, *rule), key=repr)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_random_families(spark):
    """Families whose members lie on both sides of the threshold, with passages that many share."""
    r = random.Random(10)
    shared, texts = [f"s{i}" for i in range(40)], []
    for family in range(12):
        base = [f"f{family}x{r.randrange(300)}" for _ in range(r.choice([12, 60, 150, 400]))]
        for _ in range(20):
            words = [w if r.random() > 0.025 else f"n{r.randrange(10**6)}" for w in base]
            texts.append((len(texts), " ".join(words + (shared if r.random() < 0.5 else []))))
    r.shuffle(texts)
    for rule in ((3, 85), (5, 80)):
        found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), near_dedup.Rule(*rule))
        assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(texts, *rule), key=repr)


@pytest.mark.parametrize("rule", [near_dedup.Rule(3, 85), near_dedup.Rule()])
def test_near_copies_about_the_sketch_size(spark, rule):
    """A pair that differs in one inner word, at every set size from 40 to 80; no other text shares its values."""
    texts = []
    for n in range(40, 81):
        words = [f"s{n}x{i}" for i in range(n + rule.shingle - 1)]
        texts += [(2 * n, " ".join(words)), (2 * n + 1, changed(words, len(words) // 2))]
    want = brute.near_duplicates(texts, rule.shingle, rule.percent)
    assert sum(not kept for *_, kept in want) > 25
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), rule)) == sorted(want, key=repr)


def test_one_document_of_each_group_stays(docs):
    kept = near_dedup.keep_one(docs)
    want = {d for d, _, _, k in brute.near_duplicates(TEXTS, 5, 80) if k}
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want))
