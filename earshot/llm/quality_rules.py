"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Fixed base limits reject a text of too few words or of too many repeated words. Beyond them every rule measures
one share (symbols, capitals, repeated words, repeated lines, stuttered words) and rejects above a cutoff. The
cutoff is chosen per stratum (language) on the labelled documents: walking down a fixed grid, a cutoff is accepted
while the exact binomial test at level ``delta / (strata * rules)`` shows that at most ``risk / rules`` of the good
documents that pass the base limits are rejected. So, with confidence ``1 - delta`` for all strata and rules at
once, no stratum loses more than ``risk`` of its good documents. A stratum with too few labels gets no cutoff and
loses nothing beyond the base limits.

Null text: no words, so the base limits reject it. Null stratum: a stratum of its own. Labels: all are used; a
document with several counts as good if one says so; null labels and null ids say nothing. Repeated rows each get
their verdict. Columns other than id, text and stratum are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import bytewords
from earshot.llm.scratch import Scratch

WINDOW = 8
GRID = tuple(float(x) for x in np.round(np.arange(20, 0, -1) / 20, 2))  # 1.00, 0.95, ... 0.05
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[ord("A") : ord("Z") + 1] = True
LETTERS = CAPITALS.copy()
LETTERS[ord("a") : ord("z") + 1] = True
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_capitals", "n_letters",
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    risk: float = 0.05
    delta: float = 0.05


def _rules() -> dict:
    """Shares between 0 and 1, high for junk."""
    share = lambda a, b: F.coalesce(F.least(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(1.0)), F.lit(0.0))
    return {
        "symbols": share("n_symbols", "n_words"),
        "capitals": share("n_capitals", "n_letters"),
        "repeats": share("n_repeat_words", "n_words"),
        "lines": share("n_dup_lines", "n_lines"),
        "stutter": share("n_stutter", "n_words"),
    }


def _repeated(own: np.ndarray) -> int:
    """Words inside windows that occur twice or more."""
    windows = bytewords.grams(own, WINDOW)
    if len(windows) < 2:
        return 0
    _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(often[which] > 1)
    step = np.zeros(len(own) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def _counts(part: bytewords.Slice) -> np.ndarray:
    """A row of ``COUNTS`` for each text."""
    words = bytewords.pieces(part, bytewords.SPACE)
    lines = bytewords.pieces(part, bytewords.NEWLINE)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_text, line_hash = lines.text[full], lines.hash[full]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[part.offsets[1:]] - total[part.offsets[:-1]]

    data = part.data
    characters = ((data & 0xC0) != 0x80) & ~bytewords.SPACE[data]
    cut, line_cut = bytewords.bounds(words, part.n), np.searchsorted(line_text, np.arange(part.n + 1))
    again = np.zeros((3, part.n), np.int64)  # repeated lines, repeated words, stuttered words
    for i in range(part.n):
        own, seen = words.hash[cut[i] : cut[i + 1]], line_hash[line_cut[i] : line_cut[i + 1]]
        again[:, i] = len(seen) - len(np.unique(seen)), _repeated(own), int((own[1:] == own[:-1]).sum())
    return np.stack([
        np.diff(cut), per_text(characters), per_text(SYMBOLS[data]), again[0], again[1], np.diff(line_cut), again[2],
        per_text(CAPITALS[data]), per_text(LETTERS[data]),
    ])


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id``, ``stratum`` and ``COUNTS`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch.column("text")):
                rows = _counts(part)
                keys = [batch.column(c).slice(part.first, part.n) for c in ("doc_id", "stratum")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(r, pa.int64()) for r in rows)], ["doc_id", "stratum", *COUNTS])

    columns = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("bigint"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id bigint, stratum string, {columns}"
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` hits in ``n`` tries of chance ``p``."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + np.log(p / (1 - p)))]) + n * np.log1p(-p)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def base_failed(limits: Limits):
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def cutoffs(measured: DataFrame, labels: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """``stratum, rule, cutoff`` of the accepted cutoffs: at most strata times rules rows."""
    rules = _rules()
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1")
    rows = measured.where(~base_failed(limits)).join(good, "doc_id").dropDuplicates(["doc_id", "stratum", *COUNTS])
    scored = rows.select("stratum", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), x.alias("x")) for n, x in rules.items()])).alias("s"))
    tests = scored.groupBy("stratum", "s.rule").agg(
        F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("cutoff"), F.count_if(F.col("s.x") > c).alias("lost")) for c in GRID]).alias("g")
    )
    allowed = limits.risk / len(rules)

    def with_tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("lost").to_pylist(), batch.column("n").to_pylist(), strict=True)
            # a share above the limit can't pass, so its long sum needn't be made
            tails = [1.0 if k >= allowed * n else binomial_tail(k, n, allowed) for k, n in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails, pa.float64())], [*batch.schema.names, "tail"])

    tests = scratch.stage(tests, "quality_tests")  # strata times rules rows
    strata = max(1, tests.select("stratum").distinct().count())
    tests = tests.select("stratum", "rule", "n", F.explode("g").alias("g")).select("stratum", "rule", "n", "g.*")
    tests = tests.mapInArrow(with_tail, T.StructType([*tests.schema.fields, T.StructField("tail", T.DoubleType())]))
    tests = tests.withColumn("ok", F.col("tail") <= limits.delta / (strata * len(rules)))
    # fixed sequence: a cutoff counts only if all looser ones passed
    refused = tests.where("not ok").groupBy("stratum", "rule").agg(F.max("cutoff").alias("refused"))
    after = tests.alias("t").join(refused.alias("r"), F.expr("t.stratum <=> r.stratum and t.rule = r.rule"), "left")
    return after.where("t.ok and (r.refused is null or t.cutoff > r.refused)").groupBy("t.stratum", "t.rule").agg(F.min("t.cutoff").alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), stratum: str = "lang") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.stage(measure(docs, stratum), "quality_counts")
    chosen = cutoffs(measured, labels, limits, scratch).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")  # one entry for each rule
    )
    chosen = scratch.stage(chosen, "quality_cutoffs").withColumnRenamed("stratum", "of")
    joined = measured.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
    above = [F.coalesce(x > F.col("cut")[name], F.lit(False)) for name, x in _rules().items()]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    failed = base_failed(limits)
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), rejected.alias("above_cutoff"))


def keep_good(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), stratum: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones. Rows that share an id go only if each of them is rejected."""
    found = verdicts(docs, labels, limits, stratum)
    kept = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["gone"]), "left_anti")
