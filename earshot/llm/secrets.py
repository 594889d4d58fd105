"""Secret scan: patterns propose findings, a random forest removes the false ones.

Candidates are runs of at least ``SHORTEST`` key characters. Five kinds of features describe one: its length and
make-up, how usual its character transitions are (mean log frequency of its byte pairs over all texts), how much of
it is made of dictionary words (words of the corpus that occur ``KNOWN`` times or more), its path, and the words
around it. The forest is trained on labelled findings: those of ``labelled`` if given (doc_id, start, is_secret),
otherwise findings that the text itself settles: a value assigned to a name of a secret, or in a form that issuers
document, is one; a candidate near no such name that reads like words, a path or a number is none. Training takes at most
``TRAIN_ROWS`` distinct candidates of each label, the smallest by hash; counts of pairs and words cover all texts.

Null text: no candidate. Null path counts as ''. Null ids stay. Repeated rows report once for each distinct text of an
id. With fewer than ``LEAST_ROWS`` of either label a candidate counts as secret if it is assigned to such a name or has such a form.
Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.learning.models import fit
from earshot.llm import bytewords
from earshot.llm.scratch import Scratch

SHORTEST, KNOWN, TRAIN_ROWS, LEAST_ROWS = 16, 20, 4_000, 10
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}+={0,2}+" % SHORTEST
# Forms of keys that their issuers document.
FORMS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})$"
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
ASSIGNED = NAMES + r"[A-Za-z0-9_-]*[\"']?\s*(?:=|:|=>|:=)\s*[\"']?$"
AROUND = 48
#: Bits of the set of words that candidates hold; a fixed size, whatever the corpus.
WORD_BITS = 1 << 20
FEATURES = (
    "length", "n_digits", "n_upper", "n_lower", "n_other", "classes", "changes", "transitions", "coverage", "path_depth", "test_path", "named", "assigned",
    "quoted", "hex", "form", "words_around",
)


def _pairs_and_words(wanted: bytes):
    """Counts of byte pairs (kind 0) and of words whose hash is in the set ``wanted`` (kind 1), a row for each slice."""
    bits = np.frombuffer(wanted, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch.column("text")):
                data = part.data
                pairs = np.bincount(data[:-1].astype(np.int64) * 256 + data[1:], minlength=65536) if len(data) > 1 else np.zeros(65536, np.int64)
                which = np.flatnonzero(pairs)
                words = bytewords.pieces(part, NOT_LETTER, bytewords.LOWER).hash
                at = (words % np.uint64(WORD_BITS)).astype(np.int64)
                words, often = np.unique(words[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([0, 1], [len(which), len(words)]), pa.int32()),
                    pa.array(np.concatenate([which, words.view(np.int64)]), pa.int64()), pa.array(np.concatenate([pairs[which], often]), pa.int64()),
                ], ["kind", "key", "n"])

    return run


NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate its runs of three letters and more (kind 1) and its byte pairs (kind 0), as keys."""
    for batch in batches:
        for part in bytewords.slices(batch.column("match")):
            keys = batch.column("key").slice(part.first, part.n).to_numpy(zero_copy_only=False)
            words = bytewords.pieces(part, NOT_LETTER, bytewords.LOWER)
            long = words.end - words.start >= 3
            edge = np.zeros(len(part.data) + 1, bool)
            edge[part.offsets] = True
            at = np.flatnonzero(~edge[1:-1])  # pairs that do not cross candidates
            pairs = part.data[at].astype(np.int64) * 256 + part.data[at + 1]
            text = np.searchsorted(part.offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([keys[words.text[long]], keys[text]]), pa.int64()),
                pa.array(np.repeat([1, 0], [int(long.sum()), len(at)]), pa.int32()),
                pa.array(np.concatenate([words.hash[long].view(np.int64), pairs]), pa.int64()),
                pa.array(np.concatenate([(words.end - words.start)[long], np.ones(len(at), np.int64)]), pa.int64()),
            ], ["key", "kind", "part", "size"])


def candidates(texts: DataFrame) -> DataFrame:
    """``doc_id, path, start, end, match, before, after`` of every candidate; positions are code points."""
    some = texts.where(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", "path", "row_key", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("m"), F.split("text", CANDIDATE, -1).alias("g")
    )
    rows = some.select("doc_id", "path", "row_key", F.explode(F.transform("m", lambda x, i: F.struct(
        i.alias("i"), x.alias("match"), F.length(F.get("g", i)).alias("gap"), F.right(F.get("g", i), F.lit(AROUND)).alias("before"),
        F.left(F.get("g", i + 1), F.lit(AROUND)).alias("after"),
    ))).alias("s")).select("doc_id", "path", "row_key", "s.*").distinct()
    upto = Window.partitionBy("row_key", "doc_id", "path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto).cast("bigint")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("i", "gap")


def _features(found: DataFrame, measured: DataFrame) -> DataFrame:
    match, before, after, path = F.col("match"), F.col("before"), F.col("after"), F.coalesce("path", F.lit(""))
    count = lambda c: F.length(match) - F.length(F.regexp_replace(match, c, ""))
    has = lambda c: match.rlike(c).cast("int")
    switches = F.size(F.regexp_extract_all(match, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), 0))
    near = F.concat_ws(" ", "before", "after")
    around = F.size(F.regexp_extract_all(near, F.lit(r"[\p{L}]{3,}"), 0))
    columns = {
        "length": F.length(match), "n_digits": count("[0-9]"), "n_upper": count("[A-Z]"), "n_lower": count("[a-z]"), "n_other": count("[^A-Za-z0-9]"),
        "classes": has("[0-9]") + has("[A-Z]") + has("[a-z]") + has("[^A-Za-z0-9]"), "changes": switches / F.length(match),
        "path_depth": F.size(F.split(path, "/")), "test_path": path.rlike("(?i)test|example|sample|doc|mock"), "named": near.rlike(NAMES),
        "assigned": before.rlike(ASSIGNED), "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), "hex": match.rlike("^[0-9a-fA-F]+$"), "form": match.rlike(FORMS), "words_around": around,
    }
    joined = found.join(measured, "key", "left")
    return joined.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()} | {
        "transitions": F.coalesce("transitions", F.lit(-20.0)), "coverage": F.coalesce("known", F.lit(0)) / F.length(match),
    })


def scan(docs: DataFrame, path: Column, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, end, score, is_secret`` for every candidate."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint"), path.cast("string").alias("path"), F.col("text").cast("string")).where("text is not null")
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "path", "text"))
    found = scratch.stage(candidates(texts).withColumn("key", F.xxhash64("match", "before", "after", "path")), "secret_candidates")
    distinct = found.select("key", "match").dropDuplicates(["key"])
    parts = scratch.stage(distinct.mapInArrow(_parts, "key bigint, kind int, part bigint, size bigint"), "candidate_parts")
    # which of WORD_BITS places the candidates' words fall on: a set of fixed size
    place = F.col("part").bitwiseAND(F.lit(WORD_BITS - 1))
    wanted = np.zeros(WORD_BITS, bool)
    wanted[[int(r[0]) for r in parts.where("kind = 1").select(place.cast("int")).distinct().collect()]] = True
    packed = np.packbits(wanted, bitorder="little").tobytes()
    counts = texts.select("text").mapInArrow(_pairs_and_words(packed), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = scratch.stage(counts, "corpus_counts")
    total = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    known = counts.where((F.col("kind") == 0) | (F.col("n") >= KNOWN)).withColumnRenamed("key", "part")
    met = parts.join(known, ["kind", "part"], "left")
    measured = met.groupBy("key").agg(
        F.avg(F.when(F.col("kind") == 0, F.log((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(total))))).alias("transitions"),
        F.sum(F.when((F.col("kind") == 1) & F.col("n").isNotNull(), F.col("size")).otherwise(0)).alias("known"),
    )
    described = scratch.stage(_features(found, measured), "secret_features")
    if labelled is not None:
        known_labels = labelled.select("doc_id", "start", F.col("is_secret").cast("double").alias("label")).where("label is not null").distinct()
        marked = described.join(known_labels, ["doc_id", "start"])
    else:
        plain = (F.col("named") == 0) & ((F.col("coverage") > 0.3) | match_is_plain(F.col("match")))
        sure = ((F.col("assigned") == 1) & (F.col("coverage") < 0.5)) | (F.col("form") == 1)
        settled = F.when(sure, 1.0).when(plain, 0.0)
        marked = described.withColumn("label", settled).where("label is not null")
    columns = ["key", "label", *FEATURES]
    of = lambda x: marked.where(F.col("label") == x).select(*columns).distinct().orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS)
    training = scratch.stage(of(1.0).union(of(0.0)), "secret_training")
    sizes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < LEAST_ROWS:
        scored = described.withColumn("score", F.greatest("assigned", "form"))
    else:
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=30, maxDepth=6, seed=11)
        model = fit(Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]), training)
        scored = model.transform(described).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))


def match_is_plain(match: Column) -> Column:
    """Paths, dates, lists of words and plain numbers with separators."""
    return match.rlike("^[0-9/_=+-]+$") | match.rlike("(?i)^(?:[a-z]{2,}[-_/]?)+[0-9]{0,4}$") | match.rlike("^[0-9]{6,}")
