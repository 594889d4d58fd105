"""Skip classifiers: training, validation, importances, scoring and persistence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import fmean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.learning import matrix as M
from earshot.sources import staging

RANDOM_FOREST, LOGISTIC, BOOSTING = "Random Forest", "Logistic Regression", "Gradient Boosting"
NAMES = (RANDOM_FOREST, LOGISTIC, BOOSTING)


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    tree_depth: int = 10
    iterations: int = 1000
    rounds: int = 100
    round_depth: int = 6
    folds: int = 5
    balanced: bool = True
    seed: int = 42


def pipeline(name: str, names: Sequence[str], n_rows: int, settings: Settings = Settings()) -> Pipeline:
    """Assembling, scaling where the model needs it, and the classifier."""
    weight = {"weightCol": "weight"} if settings.balanced else {}
    stages = [M.assembler(names)]
    if name == RANDOM_FOREST:
        stages.append(RandomForestClassifier(
            numTrees=settings.trees, maxDepth=settings.tree_depth, seed=settings.seed, **weight
        ))
    elif name == LOGISTIC:
        stages += M.scaling_stages(n_rows, len(names))
        # weights sum to the row count, so this is an L2 penalty of strength one on the summed loss
        stages.append(LogisticRegression(
            featuresCol="scaled", maxIter=settings.iterations, regParam=1.0 / n_rows, standardization=False, **weight
        ))
    elif name == BOOSTING:
        stages.append(GBTClassifier(
            maxIter=settings.rounds, maxDepth=settings.round_depth, stepSize=0.1, seed=settings.seed
        ))
    else:
        raise ValueError(f"unknown model: {name}")
    return Pipeline(stages=stages)


def fit(stages: Pipeline, rows: DataFrame) -> PipelineModel:
    """The fitted pipeline as it comes back from a file, without training summaries.

    Spark sends a model to the tasks together with its summary, which refers to the session. Once the session has observed a
    table (``DataFrame.observe``) it can't be sent, and every forest and logistic regression would fail to score.
    """
    path = staging.stage_path(rows.sparkSession, "model")
    try:
        stages.fit(rows).write().save(path)
        return PipelineModel.load(path)
    finally:
        staging.remove(rows.sparkSession, path)


def train(name: str, rows: DataFrame, settings: Settings = Settings()) -> PipelineModel:
    """Fit one model on a matrix with ``label``; weights are added here."""
    weighted = M.add_weights(rows)
    return fit(pipeline(name, M.feature_names(rows), rows.count(), settings), weighted)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Class and probability of a skip; works on batch and streaming rows alike."""
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("prediction", F.col("prediction").cast("int")).select(*rows.columns, "prediction", "score")


def accuracy_and_auc(model: PipelineModel, rows: DataFrame) -> tuple[float, float]:
    scored = model.transform(rows)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    return accuracy, BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)


def cross_validate(name: str, rows: DataFrame, settings: Settings = Settings()) -> tuple[float, float]:
    """Mean and deviation of the AUC over repeatable folds.

    The folds are gone through here, since Spark's validator scores the models as they are fitted, with their summaries.
    """
    weighted = staging.stage(M.add_weights(M.add_folds(rows, settings.folds)), "folds")
    stages = pipeline(name, M.feature_names(rows), rows.count(), settings)
    found = []
    for i in range(settings.folds):
        held = weighted.where(F.col("fold") == i)
        if held.isEmpty():
            raise ValueError(f"fold {i} is empty")
        scored = fit(stages, weighted.where(F.col("fold") != i)).transform(held)
        found.append(BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored))
    return fmean(found), pstdev(found)


def evaluation(spark: SparkSession, results: dict[str, tuple]) -> DataFrame:
    """(model, accuracy, auc, cv_auc, cv_std) rows."""
    rows = [(name, *map(float, values)) for name, values in results.items()]
    return spark.createDataFrame(rows, "model string, accuracy double, auc double, cv_auc double, cv_std double")


def model_summary(spark: SparkSession, results: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, accuracy, auc) rows from the test part alone."""
    rows = [(name, float(accuracy), float(auc)) for name, (accuracy, auc) in results.items()]
    return spark.createDataFrame(rows, "model string, accuracy double, auc double")


def best_model(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("model", "auc").alias("name"), F.max("auc").alias("auc"))


def importances(spark: SparkSession, model: PipelineModel, names: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most important features of a tree model."""
    values = [(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    table = spark.createDataFrame(values, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def save_models(models: dict[str, PipelineModel], folder: str) -> dict[str, str]:
    paths = {name: f"{folder}/{name.lower().replace(' ', '_')}" for name in models}
    for name, model in models.items():
        model.write().overwrite().save(paths[name])
    return paths


def load_models(paths: dict[str, str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(path) for name, path in paths.items()}
