"""Feature matrices, splits, weights and standardising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.constants import BASIC_SKIP_FEATURES, SKIP_FEATURES
from earshot.functions.numbers import round_signed
from earshot.operators.features import add_length_flags, one_hot, select_available
from earshot.operators.joins import attach, join_on
from earshot.operators.ordered import order_log
from earshot.operators.quality import unpivot_row

GRAIN = 1000


def skip_matrix(features: DataFrame, want: Sequence[str] = SKIP_FEATURES, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """Wanted features that exist, nulls as zero, and the label ``is_skip``."""
    labelled = features.withColumn("label", F.col("is_skip").cast("int"))
    return select_available(labelled, want, [*keep, "label"])


def skip_matrix_basic(plays: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """The notebook's smaller matrix: no history, one-hot platforms and start reasons."""
    hot = plays.transform(one_hot, "platform").transform(one_hot, "reason_start", None, 5)
    numbers = add_length_flags(hot)
    return skip_matrix(numbers, BASIC_SKIP_FEATURES, keep)


def feature_names(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("event_id", "label", "is_test", "fold", "weight")]


def uniform(key: str = "event_id") -> Column:
    """A repeatable number 0..999 from the row's key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % GRAIN


def split(matrix: DataFrame, test: float = 0.2, key: str = "event_id", label: str = "label") -> DataFrame:
    """Adds ``is_test``: the same share of every class, repeatable, without sorting rows.

    Rows are counted per class and hash value; the test part is each class's first values up to
    its share. That table has at most a thousand rows per class.
    """
    drawn = matrix.withColumn("_u", uniform(key))
    counts = drawn.groupBy(label, "_u").agg(F.count("*").alias("_n"))
    by_class = Window.partitionBy(label)
    earlier = by_class.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    chosen = counts.select(label, "_u", (before < F.sum("_n").over(by_class) * test).alias("is_test"))
    # null labels are a class, null keys a value
    return join_on(drawn, F.broadcast(chosen), [label, "_u"]).drop("_u")


def add_folds(train: DataFrame, folds: int = 5, key: str = "event_id", label: str = "label") -> DataFrame:
    """Repeatable stratified fold numbers: the rows of each class, in the order of a hash of their key (another one than
    the split's), are dealt in turn, so a class's counts in two folds differ by at most one.

    The order is a range-sorted dense index, not a window over a class; where a class starts in it is one row a class.
    """
    second = F.conv(F.substring(F.md5(F.col(key).cast("string")), 9, 8), 16, 10).cast("bigint")
    log = order_log(train.withColumn("_v", second), ("_v", key), (label,))
    starts = log.rows.groupBy(label).agg(F.min("row_index").alias("_start"))
    placed = attach(log.rows, starts, (label,), "fold_starts")
    return placed.withColumn("fold", F.pmod(F.col("row_index") - F.col("_start"), F.lit(folds)).cast("int")).drop("_v", "_start", "row_index")


def class_weights(matrix: DataFrame, label: str = "label") -> DataFrame:
    """Count, share and balanced weight n / (classes * n_class) per class."""
    counts = matrix.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return counts.select(
        label,
        "n",
        (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"),
    )


def add_weights(matrix: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``; the weight table has one row per class."""
    return matrix.join(F.broadcast(class_weights(matrix, label).select(label, "weight")), label)


def feature_stats(matrix: DataFrame, names: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Mean and population deviation per feature, one pass."""
    names = list(names or feature_names(matrix))
    row = matrix.agg(*[f(F.col(f"`{c}`")).alias(f"{i}_{k}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    means = unpivot_row(row, {c: F.col(f"{i}_m") for i, c in enumerate(names)}, "feature", "mean")
    spreads = unpivot_row(row, {c: F.col(f"{i}_s") for i, c in enumerate(names)}, "feature", "std")
    return means.join(spreads, "feature").select(
        "feature", round_signed(F.col("mean"), digits).alias("mean"), round_signed(F.col("std"), digits).alias("std")
    )


def assembler(names: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol=output)


def scaling_stages(n_rows: int, n_features: int, source: str = "features", output: str = "scaled") -> list:
    """Zero mean and unit population deviation (Spark's scaler divides by the sample deviation)."""
    correction = (n_rows / (n_rows - 1)) ** 0.5 if n_rows > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol="_standard", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([correction] * n_features), inputCol="_standard", outputCol=output),
    ]


def standardise(matrix: DataFrame, names: Sequence[str] | None = None):
    """The matrix with a ``scaled`` vector, and the fitted pipeline."""
    names = list(names or feature_names(matrix))
    model = Pipeline(stages=[assembler(names), *scaling_stages(matrix.count(), len(names))]).fit(matrix)
    return model.transform(matrix).drop("_standard"), model
