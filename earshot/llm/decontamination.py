"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters and digits (A-Z as a-z; every non-ASCII character counts as a letter). A window is
``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. Of every ``WINDOW - K + 1``
consecutive ``K``-word hashes the smallest is kept as a fingerprint, on both sides. Two equal windows keep the same
one, so every shared window is found by an equality join of fingerprints. Each meeting is then extended word by
word to both sides on the texts themselves, by at most ``WINDOW - K`` words, which is how far a window with this
fingerprint reaches; it counts when the run is as long as a window. Longer passages are the union of such runs.
Items shorter than a window keep all grams of their own length instead, for every such length that occurs.

The benchmark's fingerprints are staged, so Spark knows their size: it broadcasts them only below its threshold,
and otherwise shuffles both sides on the fingerprint, where adaptive execution splits a frequent one.

Null text: no words. Null ids are ids like any other (null items count as hit words, not as items). Repeated rows:
each gets the result of its text. Texts of up to 2**27 words. Only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch, fresh

WINDOW, K = 10, 5
POSITION_BITS = 27
_AT = (1 << POSITION_BITS) - 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    # for ASCII texts lower() changes A-Z only and is much the faster one
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def with_words(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", words(F.col("text")))


def grams(k: int) -> Column:
    """All ``k``-grams as hash * 2**27 + position."""
    made = F.transform(
        F.sequence(F.lit(1), F.size("words") - (k - 1)),
        lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice("words", i, k)), POSITION_BITS + 1), POSITION_BITS) + (i - 1),
    )
    return F.when(F.size("words") >= k, made).otherwise(F.array().cast("array<bigint>"))


def winnow(span: int) -> Column:
    """Positions are the low bits, so of equal hashes the first is kept, in every window alike."""
    if span == 1:
        return F.col("grams")
    low = F.transform(F.sequence(F.lit(1), F.size("grams") - (span - 1)), lambda i: F.array_min(F.slice("grams", i, span)))
    return F.array_distinct(F.when(F.size("grams") >= span, low).otherwise(F.array().cast("array<bigint>")))


def _kept(texts: DataFrame, k: int, span: int) -> DataFrame:
    return texts.withColumn("grams", grams(k)).withColumn("kept", winnow(span))


def _extent(step: int, limit: int) -> Column:
    """Equal words before (-1) or after (+1) the gram, at most ``limit``."""
    length = F.lit(limit)
    for j in range(limit, 0, -1):
        at = lambda w, p: F.get(w, F.col(p) + (j - 1 + F.col("k") if step > 0 else -j))  # noqa: E731, B023
        same = F.coalesce(at("words", "at") == at("item_words", "item_at"), F.lit(False))
        if step < 0:
            same = same & (F.col("at") >= j) & (F.col("item_at") >= j)
        length = F.when(~same, F.lit(j - 1)).otherwise(length)
    return length


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    texts = docs.select("doc_id", F.col("text").cast("string")).withColumn("text_key", key)
    items = benchmark.select("item_id", F.col("text").cast("string")).withColumn("item_key", F.xxhash64("item_id", "text")).distinct()
    items = scratch.stage(with_words(items).where(F.size("words") > 0).drop("text"), "items")
    short = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect()]  # at most WINDOW values
    kinds = [(K, WINDOW - K + 1, WINDOW) if n == WINDOW else (n, 1, n) for n in sorted(set(short) | {WINDOW}, reverse=True)]

    met = []
    for k, span, window in kinds:
        size = F.size("words")
        own = items.where(size >= WINDOW if window == WINDOW else size == window)
        marks = _kept(own, k, span).select("item_id", "item_key", F.explode("kept").alias("f")).select(
            F.shiftright("f", POSITION_BITS).alias("mark"), "item_id", "item_key", F.col("f").bitwiseAND(F.lit(_AT)).alias("item_at")
        )
        marks = scratch.stage(marks, f"marks_{window}")
        rows = _kept(with_words(texts), k, span)
        if window == WINDOW:  # one more, negative, entry for each document carries its length
            entries = F.concat(F.array(-(F.size("words").cast("bigint")) - 1), "kept")
        else:
            entries = F.col("kept")
        rows = rows.select("doc_id", "text_key", F.explode(entries).alias("f")).withColumn(
            "mark", F.when(F.col("f") >= 0, F.shiftright("f", POSITION_BITS))
        )
        found = rows.join(marks, "mark", "left").where("f < 0 or item_key is not null")
        met.append(found.select("doc_id", "text_key", "f", "item_id", "item_key", "item_at", F.lit(k).alias("k"), F.lit(window).alias("window")))
    all_met = met[0]
    for more in met[1:]:
        all_met = all_met.unionByName(more)
    all_met = scratch.stage(all_met, "met")

    lengths = all_met.where("f < 0").select("doc_id", "text_key", (-F.col("f") - 1).alias("n_words"))
    meets = all_met.where("f >= 0").withColumn("at", F.col("f").bitwiseAND(F.lit(_AT)).cast("int")).drop("f").distinct()
    meets = meets.withColumn("item_at", F.col("item_at").cast("int"))
    hit_docs = scratch.stage(meets.select("text_key").distinct(), "hit_docs")
    own = with_words(texts.join(hit_docs, "text_key", "left_semi").distinct()).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "words")
    pairs = meets.join(items.select("item_key", F.col("words").alias("item_words")), "item_key").join(
        own, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))
    )
    equal = F.lit(True)
    for j in range(WINDOW):
        same = F.coalesce(F.get("words", F.col("at") + j) == F.get("item_words", F.col("item_at") + j), F.lit(False))
        equal = equal & ((F.col("k") <= j) | same)
    pairs = pairs.where(equal)
    reach = F.col("window") - F.col("k")
    pairs = pairs.withColumn("before", F.least(_extent(-1, WINDOW - K), reach)).withColumn("after", F.least(_extent(1, WINDOW - K), reach))
    runs = pairs.where(F.col("before") + F.col("k") + F.col("after") >= F.col("window")).select(
        "doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("k") + F.col("after") - 1).alias("last")
    )
    runs = scratch.stage(runs, "runs")
    by = ["doc_id", "text_key"]
    places = runs.select(*by, F.explode(F.sequence("first", "last")).alias("p")).distinct().groupBy(*by).agg(F.count("*").alias("n_hit"))
    item = runs.select(*by, F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    named = item.groupBy(*by).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    hits = scratch.stage(
        places.alias("a").join(named.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key"), "left")
        .select(F.col("a.doc_id").alias("d"), F.col("a.text_key").alias("t"), "n_hit", "n_items", "items"),
        "hits",
    )
    joined = lengths.join(hits, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), zero("n_hit"), zero("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"), "text_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    bad = find(docs, benchmark).where("contaminated").select("text_key").distinct()
    (key,) = fresh(docs, "text_key")
    return docs.withColumn(key, F.xxhash64("doc_id", F.col("text").cast("string"))).join(
        bad.withColumnRenamed("text_key", key), key, "left_anti"
    ).select(*docs.columns)
