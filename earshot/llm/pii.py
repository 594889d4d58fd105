"""Personal data in texts: fixed patterns, plus spans that a calibrated boosted-tree model adds.

Base spans are the leftmost matches of a fixed pattern for each kind that pass its check (parts of an address,
Luhn sum, number of digits). High-recall generators propose further, possibly overlapping, candidates: numbers
without plus sign or with other separators, addresses written with ``(at)``. Gradient-boosted trees see the
format of a candidate and its neighbourhood. They learn from the corpus itself: base spans and forms of them with
changed separators are positive, proposed spans that overlap no base span are negative. Each candidate is scored by trees
fitted without its part of the corpus, and from these scores the lowest one is chosen, for each kind, above which at least
``PRECISION`` of the candidates are positive. The trees that score new spans are fitted on all parts. All base spans stay.
Of the candidates that overlap none and reach the threshold of their kind the best is added, then the best of those
that overlap no added one, until none is left.

Training and calibration both read all distinct candidates of either label, in ``FOLDS`` parts by hash. Cut points of
the trees come from all of them, too (of up to 2**31 different rows of features). With fewer than ``LEAST_ROWS`` of
either label nothing is added. Null text counts as empty, repeated rows each get their spans, null ids are ids like any
other, other columns are not looked at. Positions are code points, ends exclusive. All patterns run in linear time and
constant stack on any text: runs are possessive and start at the beginning of a run.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch, fresh

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that texts with a match pass.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.,:-][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4,6}+(?:[\x20./-]?[0-9]{2,7}+){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])",
}
WIDE_HINTS = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]{4}", "phone": "[0-9]{3}"}
#: Changed forms of base spans that count as positive in training: pattern and replacement.
VARIANTS = {
    "email": ((r"@", "(at)"), (r"@", " [at] ")),
    "ip": (),
    "card": ((r"^([0-9]{4})([0-9]{4})([0-9]{4})", "$1.$2.$3."), (r"^([0-9]{4})([0-9]{4})([0-9]{4})", "$1/$2/$3/")),
    "phone": ((r"^\+[0-9]{1,3} ", ""), (r"^\+[0-9]{1,3} \(([0-9]+)\) ", "$1-")),
}
CONTEXT = 24
LEAST_ROWS, PRECISION, FOLDS, BINS = 40, 0.99, 4, 32
SCORES = tuple(x / 100 for x in range(50, 100, 2))
CONTEXT_WORDS = {
    "email": "(?i)mail|contact|@", "ip": "(?i)\\bip\\b|host|server|addr", "card": "(?i)card|visa|carte|karte|tarjeta|pay",
    "phone": "(?i)tel|phone|call|fax|mobil",
}


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum of 0 modulo 10; of its last 19 digits.

    A loop over the digits keeps plans short: the digits are an expression themselves, which would be repeated for each.
    """
    def weighted(digit: Column, i: Column) -> Column:
        return F.aggregate(  # a loop over one value, so that the value is named
            F.array(F.coalesce(digit.try_cast("int"), F.lit(0))), F.lit(0), lambda _, d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
        )

    back = F.split(F.substring(F.reverse(digits), 1, 19), "")
    return F.aggregate(F.transform(back, weighted), F.lit(0), lambda a, x: a + x) % 10 == 0


def octets(text: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
    return text.rlike(rf"^{part}(?:[.,:-]{part}){{3}}$")


def _passes(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "ip", octets(match))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _matches(texts: DataFrame, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """Every match with its place: ``doc_id, text_key, kind, start, end, match, before, after``."""
    found = None
    for kind, pattern in patterns.items():
        some = texts.where(F.col("text").rlike(hints[kind])).select(
            "doc_id", "text_key", F.regexp_extract_all("text", F.lit(pattern), 0).alias("m"), F.split("text", pattern, -1).alias("g")
        )
        one = some.where(F.size("m") > 0).select(
            "doc_id", "text_key", F.lit(kind).alias("kind"),
            F.explode(F.transform("m", lambda x, i: F.struct(
                i.alias("i"), x.alias("match"), F.length(F.get("g", i)).alias("gap"),
                F.right(F.get("g", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("g", i + 1), F.lit(CONTEXT)).alias("after"),
            ))).alias("s"),
        ).select("doc_id", "text_key", "kind", "s.*")
        found = one if found is None else found.unionByName(one)
    upto = Window.partitionBy("text_key", "doc_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    return found.distinct().withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length("match")).drop("i", "gap")


FEATURES = (
    "kind_no", "length", "n_digits", "n_letters", "n_dots", "n_spaces", "n_dashes", "n_signs", "groups", "longest", "shortest", "luhn_ok",
    "octets_ok", "has_at", "zeros", "before_space", "before_letter", "before_sign", "after_space", "after_letter", "after_sign", "named",
)


def _features(spans: DataFrame) -> DataFrame:
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    count = lambda c: F.length(match) - F.length(F.regexp_replace(match, c, ""))
    runs = F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), 0), lambda x: F.length(x))
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    named = F.lit(False)
    for kind, pattern in CONTEXT_WORDS.items():
        named = named | ((F.col("kind") == kind) & (before.rlike(pattern) | after.rlike(pattern)))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    space, letter, sign = r"^\s$", r"^[\p{L}\p{N}]$", r"^[^\s\p{L}\p{N}]$"
    columns = dict(zip(FEATURES, (
        _order(F.col("kind")), F.length(match), count("[0-9]"), count("[A-Za-z]"), count("[.]"), count(r"\s"), count("-"), count("[^A-Za-z0-9.\\s-]"),
        F.size(runs), F.array_max(runs), F.array_min(runs), F.when(count("[0-9]").between(12, 19), luhn(_digits(match))), octets(match), match.contains("@"),
        match.startswith("0"), last.rlike(space) | (last == ""), last.rlike(letter), last.rlike(sign), first.rlike(space) | (first == ""),
        first.rlike(letter), first.rlike(sign), named,
    ), strict=True))
    return spans.withColumns({k: number(v) for k, v in columns.items()})


def _training(base: DataFrame, wide: DataFrame, scratch: Scratch) -> DataFrame:
    """All distinct labelled candidates with features, their part, and which of them the first part holds out."""
    columns = ["kind", "match", "before", "after"]
    positive = base.select(*columns)
    for kind, forms in VARIANTS.items():
        for pattern, to in forms:
            changed = F.regexp_replace("match", pattern, to)
            positive = positive.union(base.where(F.col("kind") == kind).select("kind", changed.alias("match"), "before", "after"))
    # what looks exactly like a positive form may be one that no pattern knows: it is no evidence against it
    form = {
        "form": F.when(F.col("kind") == "email", F.regexp_replace("match", "[A-Za-z0-9]+", "a")).otherwise(F.regexp_replace("match", "[0-9]", "0")),
        "valid": F.when(F.col("kind") == "card", luhn(_digits(F.col("match")))).when(F.col("kind") == "ip", octets(F.col("match"))).otherwise(True),
    }
    forms = positive.withColumns(form).select("kind", "form", "valid").distinct()
    negative = wide.where("not touches").select(*columns).withColumns(form).join(forms, ["kind", "form", "valid"], "left_anti").select(*columns)
    marked = positive.withColumn("label", F.lit(1.0)).union(negative.withColumn("label", F.lit(0.0))).distinct().withColumn("h", F.xxhash64(*columns))
    described = _features(marked).withColumn("fold", F.pmod(F.shiftright("h", 20), F.lit(FOLDS)).cast("int")).withColumn("held_out", F.col("fold") == 0)
    ordered = described.sortWithinPartitions("h", "label", *columns)  # the same rows give the same model
    return scratch.stage(ordered.select("kind", "label", "fold", "held_out", *FEATURES), "pii_training")


def _score(model, spans: DataFrame) -> DataFrame:
    return model.transform(spans).withColumn("score", vector_to_array("probability")[1])


def _fit(training: DataFrame, scratch: Scratch):
    """The model and its thresholds ``kind, threshold``; none when there are too few labels."""
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if min(counts.get(x, 0) for x in (0.0, 1.0)) < LEAST_ROWS:
        return None
    # rows of equal features are one, which weighs as many
    columns = ["kind", "label", "fold", *FEATURES]
    rows = training.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")).sortWithinPartitions(*columns)
    rows = scratch.stage(rows, "pii_weighted")
    # Spark ML samples rows for its cut points once there are more than the square of the bins
    bins = max(BINS, math.isqrt(rows.count()) + 1)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxBins=bins, maxIter=12, maxDepth=3, stepSize=0.3, seed=7)
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees])
    held = None
    for fold in range(FOLDS):
        part = _score(steps.fit(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold)).select("kind", "label", "weight", "score")
        held = part if held is None else held.unionByName(part)
    tried = held.select("kind", "label", "weight", F.explode(F.array(*[F.when(F.col("score") >= s, F.lit(s)) for s in SCORES])).alias("threshold"))
    precision = F.sum(F.col("label") * F.col("weight")) / F.sum("weight")
    good = tried.where("threshold is not null").groupBy("kind", "threshold").agg(precision.alias("precision"))
    good = scratch.stage(good, "pii_precision")  # kinds times scores
    # the lowest score from which on every higher one is precise as well
    low = good.groupBy("kind").agg(F.max(F.when(F.col("precision") < PRECISION, F.col("threshold"))).alias("bad"))
    chosen = good.join(low, "kind").where("bad is null or threshold > bad").groupBy("kind").agg(F.min("threshold").alias("threshold"))
    return steps.fit(rows), scratch.stage(chosen, "pii_thresholds")


def _islands(spans: DataFrame) -> DataFrame:
    """Numbers the groups of overlapping spans of a text."""
    by = Window.partitionBy("text_key", "doc_id").orderBy("start", "end", "kind")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") < reach, 0).otherwise(1)
    return spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _overlaps_base(spans: DataFrame) -> Column:
    """Whether a span shares a position with a base span of its text."""
    by = Window.partitionBy("text_key", "doc_id")
    upto = lambda order: by.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(F.col("is_base"), F.col("end"))).over(upto(F.col("start")))  # of those that start here or before
    start = F.min(F.when(F.col("is_base"), F.col("start"))).over(upto(F.col("start").desc()))  # of those from here on
    return F.coalesce(end > F.col("start"), F.lit(False)) | F.coalesce(start < F.col("end"), F.lit(False))


def _apart(scored: DataFrame) -> DataFrame:
    """``doc_id, text_key, kind, start, end`` of non-overlapping spans, the best first (ties: by kind, then the earliest)."""
    item = F.struct((-F.col("score")).alias("s"), _order(F.col("kind")).alias("o"), "start", "end", "kind")
    islands = _islands(scored).groupBy("text_key", "doc_id", "island").agg(F.array_sort(F.collect_list(item)).alias("all"))
    met = lambda added, x: F.exists(added, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    added = F.aggregate("all", F.slice("all", 1, 1), lambda a, x: F.when(met(a, x), a).otherwise(F.array_append(a, x)))
    return islands.select("doc_id", "text_key", F.explode(added).alias("s")).select("doc_id", "text_key", "s.kind", "s.start", "s.end")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))


def spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text_key, kind, start, end, is_base``, staged; one set for each distinct text of an id."""
    texts = keyed(docs)
    base = _matches(texts, PATTERNS, HINTS).where(_passes(F.col("kind"), F.col("match")))
    base = scratch.stage(base, "pii_base")
    wide = scratch.stage(_matches(texts, WIDE, WIDE_HINTS), "pii_wide")
    both = base.withColumn("is_base", F.lit(True)).unionByName(wide.withColumn("is_base", F.lit(False)))
    wide = both.withColumn("touches", _overlaps_base(both)).where("not is_base")
    wide = scratch.stage(wide, "pii_candidates")
    columns = ["doc_id", "text_key", "kind", "start", "end"]
    found = base.select(*columns, F.lit(True).alias("is_base"))
    fitted = _fit(_training(base, wide, scratch), scratch)
    if fitted:
        model, thresholds = fitted
        free = _score(model, _features(wide.where("not touches"))).select(*columns, "score").join(thresholds, "kind")
        found = found.unionByName(_apart(free.where("score >= threshold")).withColumn("is_base", F.lit(False)))
    return scratch.stage(found, "pii_spans")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, their digest and all spans, for each row of ``docs``."""
    found = spans(docs, Scratch(docs.sparkSession))
    name = F.concat_ws(":", "kind", "start", "end")
    listed = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda s: s["name"]), ",")
    item = F.struct(_order(F.col("kind")).alias("o"), "start", "end", name.alias("name"))
    each = found.groupBy("text_key", "doc_id").agg(
        *[F.count_if(F.col("is_base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        listed(F.collect_list(F.when(F.col("is_base"), item))).alias("base"), listed(F.collect_list(item)).alias("spans"),
    ).withColumnsRenamed({"text_key": "t", "doc_id": "d"})
    joined = keyed(docs).select("doc_id", "text_key").join(each, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by its kind in brackets; ``n_chars`` follows."""
    found = spans(docs, Scratch(docs.sparkSession))
    merged = _islands(found).groupBy("text_key", "doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(_order(F.col("kind"))).alias("o")
    )
    cuts = merged.groupBy("text_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "o"))).alias("cuts"))
    t, d, c = fresh(docs, "t", "d", "cuts")
    cuts = cuts.select(F.col("text_key").alias(t), F.col("doc_id").alias(d), F.col("cuts").alias(c))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(cuts, (F.xxhash64("doc_id", text) == F.col(t)) & docs["doc_id"].eqNullSafe(F.col(d)), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clean = F.concat(
        F.array_join(F.transform(c, lambda s, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.get(F.col(c), i - 1)["end"] + 1).cast("int"),
                        (s["start"] - F.when(i == 0, 0).otherwise(F.get(F.col(c), i - 1)["end"])).cast("int")),
            F.get(names, (s["o"] - 1).cast("int")),
        )), ""),
        F.substring(F.col("text"), (F.element_at(c, -1)["end"] + 1).cast("int"), F.length("text")),
    )
    (new,) = fresh(joined, "new_text")
    joined = joined.withColumn(new, F.when(F.col(c).isNotNull(), clean))

    def column(name: str) -> Column:
        if name == "text":
            return F.coalesce(F.col(new), docs["text"]).alias(name)
        if name == "n_chars":
            return F.coalesce(F.length(new), docs[name]).cast(docs.schema[name].dataType).alias(name)
        return docs[name]

    return joined.select(*[column(name) for name in docs.columns])
