"""Measures over any table of (label, prediction, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.numbers import flag, ratio, round_half_up
from earshot.operators.joins import one_row
from earshot.operators.ordered import order_log, previous
from earshot.sources.staging import stage


def _by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def _cumulated(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score with running sums from the lowest score up.

    There may be as many distinct scores as rows, so the running sums go over the chunked index.
    """
    log = order_log(_by_score(scored), ["score"])
    with_pos = log.running_sum(F.col("pos"), "pos_upto")
    return type(log)(with_pos, chunk_rows=log.chunk).running_sum(F.col("neg"), "neg_upto")


def binary_metrics(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Accuracy and ROC AUC by rank sums, ties counted half."""
    pos, neg, upto = (F.col(c).cast("double") for c in ("pos", "neg", "neg_upto"))
    wins = F.sum(pos * (upto - neg + neg / 2))
    auc = _cumulated(scored).agg(round_half_up(ratio(wins, F.sum(pos) * F.sum(neg)), digits).alias("auc"))
    right = scored.agg(F.avg(flag(F.col("label") == F.col("prediction"))).alias("accuracy"))
    return right.select(round_half_up(F.col("accuracy"), digits).alias("accuracy"), auc.scalar().alias("auc"))


def roc(scored: DataFrame, digits: int = 6) -> DataFrame:
    """One point per distinct score: rates when everything from that score up counts as positive."""
    table = stage(_cumulated(scored), "roc")
    totals = one_row(table.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    fpr = (totals["n"] - F.col("neg_upto") + F.col("neg")) / totals["n"]
    tpr = (totals["p"] - F.col("pos_upto") + F.col("pos")) / totals["p"]
    return table.select(
        F.col("score").alias("threshold"), round_half_up(fpr, digits).alias("fpr"), round_half_up(tpr, digits).alias("tpr")
    )


def roc_corners(scored: DataFrame, digits: int = 6) -> DataFrame:
    """The points of ``roc`` without those on a straight line between their neighbours, from the origin (null
    threshold: nothing counts as positive) to the lowest score.

    A point goes if the step to it and the step after it add the same positives and negatives. Steps are counts at
    single scores, so one look at the neighbour in the chunked index decides.
    """
    log = order_log(_by_score(scored), ["score"])
    with_pos = log.running_sum(F.col("pos"), "pos_upto")
    both = type(log)(with_pos, chunk_rows=log.chunk).running_sum(F.col("neg"), "neg_upto")
    seen = type(log)(both, chunk_rows=log.chunk).history({"_pos": previous("pos"), "_neg": previous("neg")}, reach=1)
    ends = (F.col("row_index") == 1) | (F.col("row_index") == log.count)
    table = stage(seen.where(ends | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))), "roc_corners")
    totals = one_row(scored.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")))
    rate = lambda all_, upto, own: round_half_up((all_ - F.col(upto) + F.col(own)) / all_, digits)
    points = table.select(
        F.col("score").alias("threshold"), rate(totals["n"], "neg_upto", "neg").alias("fpr"), rate(totals["p"], "pos_upto", "pos").alias("tpr")
    )
    zero = F.lit(0.0)
    return points.unionByName(scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr")))


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def report(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion table."""
    cells = confusion(scored)
    classes = cells.select(F.explode(F.array("label", "prediction")).alias("class"), "label", "prediction", "n").distinct()
    sums = classes.groupBy("class").agg(
        F.sum(F.when((F.col("label") == F.col("class")) & (F.col("prediction") == F.col("class")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("prediction") == F.col("class"), F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("label") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    precision, recall = ratio(F.col("hit") * 1e0, F.col("called")), ratio(F.col("hit") * 1e0, F.col("support"))
    f1 = ratio(F.col("hit") * 2e0, F.col("called") + F.col("support"))
    return sums.select(
        "class",
        round_half_up(F.coalesce(precision, F.lit(0.0)), digits).alias("precision"),
        round_half_up(F.coalesce(recall, F.lit(0.0)), digits).alias("recall"),
        round_half_up(F.coalesce(f1, F.lit(0.0)), digits).alias("f1"),
        "support",
    )
