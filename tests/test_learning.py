import math

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Observation
from pyspark.sql import functions as F

from earshot.learning import clusters, kmeans, matrix, models, scores

SETTINGS = models.Settings(trees=5, tree_depth=4, iterations=30, rounds=3, round_depth=3, folds=2)


@pytest.fixture(scope="module")
def rows(spark):
    """Label follows x most of the time."""
    df = spark.range(1500).withColumnRenamed("id", "event_id")
    x = (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 20, 6), 16, 10).cast("double") / 16777216).alias("x")
    df = df.select("event_id", x, (F.col("event_id") % 7).cast("double").alias("z"))
    return df.withColumn("label", F.when(F.col("event_id") % 10 == 0, 0).otherwise((F.col("x") > 0.6).cast("int"))).cache()


def test_split_keeps_class_shares(rows):
    out = matrix.split(rows).groupBy("label").agg(F.avg(F.col("is_test").cast("int")).alias("share")).collect()
    assert all(abs(r.share - 0.2) < 0.01 for r in out)
    assert sorted(map(tuple, matrix.split(rows).collect())) == sorted(map(tuple, matrix.split(rows.repartition(3)).collect()))


def test_weights_balance_classes(rows):
    sums = [r.w for r in matrix.add_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()]
    assert sums[0] == pytest.approx(sums[1]) and sum(sums) == pytest.approx(1500)


def test_scaling_uses_population_deviation(rows):
    from pyspark.ml.functions import vector_to_array

    scaled, _ = matrix.standardise(rows, ["x", "z"])
    v = vector_to_array("scaled")
    row = scaled.agg(F.avg(v[0]).alias("m"), F.stddev_pop(v[0]).alias("s"), F.stddev_pop(v[1]).alias("s2")).first()
    assert abs(row.m) < 1e-9 and row.s == pytest.approx(1.0) and row.s2 == pytest.approx(1.0)


@pytest.mark.parametrize("name", models.NAMES)
def test_models_learn_and_are_repeatable(rows, name):
    parts = matrix.split(rows)
    train, test = parts.where(~F.col("is_test")).drop("is_test"), parts.where("is_test").drop("is_test")
    accuracy, auc = models.accuracy_and_auc(models.train(name, train, SETTINGS), test)
    assert auc > 0.85 and accuracy > 0.8


def test_saved_model_scores_the_same(rows, tmp_path):
    model = models.train(models.LOGISTIC, rows, SETTINGS)
    loaded = models.load_models(models.save_models({models.LOGISTIC: model}, str(tmp_path)))[models.LOGISTIC]
    pick = lambda m: models.score(m, rows).orderBy("event_id").collect()
    assert pick(model) == pick(loaded)


def test_cross_validation_and_importances(spark, rows):
    mean, spread = models.cross_validate(models.RANDOM_FOREST, rows, SETTINGS)
    assert mean > 0.85 and spread >= 0
    best = models.importances(spark, models.train(models.RANDOM_FOREST, rows, SETTINGS), ["x", "z"]).first()
    assert best.feature == "x"


@pytest.fixture
def observed(spark):
    """A session that has observed a table: it can't be sent to tasks any more, nor can what refers to it."""
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 3}


@pytest.mark.parametrize("name", models.NAMES)
def test_models_score_in_an_observed_session(observed, rows, name):
    model = models.train(name, rows, SETTINGS)
    assert models.accuracy_and_auc(model, rows)[1] > 0.85
    assert models.score(model, rows).count() == models.score(model, rows).where("score between 0 and 1").count() == 1500


def test_validation_in_an_observed_session(observed, rows):
    """The same figures as Spark's own validator gives over these folds, where that can run."""
    mean, spread = models.cross_validate(models.BOOSTING, rows, SETTINGS)
    weighted = matrix.add_weights(matrix.add_folds(rows, SETTINGS.folds))
    fitted = CrossValidator(
        estimator=models.pipeline(models.BOOSTING, ["x", "z"], 1500, SETTINGS), estimatorParamMaps=[{}],
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"), numFolds=SETTINGS.folds, foldCol="fold",
    ).fit(weighted)
    assert (mean, spread) == pytest.approx((fitted.avgMetrics[0], fitted.stdMetrics[0]), abs=1e-3)
    assert models.cross_validate(models.LOGISTIC, rows, SETTINGS)[0] > 0.8


@pytest.mark.parametrize("folds", [2, 5, 7])
def test_folds_are_stratified(spark, folds):
    rows = [(i, 0 if i % 9 else 1, 1.0) for i in range(500)] + [(None, 1, 1.0), (1000, None, 2.0), (1000, None, 2.0)]
    df = spark.createDataFrame(rows, "event_id bigint, label int, x double")
    found = matrix.add_folds(df, folds)
    assert found.columns == [*df.columns, "fold"] and found.count() == len(rows)
    counts = {}
    for r in found.collect():
        counts.setdefault(r.label, [0] * folds)[r.fold] += 1
    assert all(max(c) - min(c) <= 1 for c in counts.values()) and set(counts) == {0, 1, None}
    assert sorted(map(repr, matrix.add_folds(df.repartition(3), folds).collect())) == sorted(map(repr, found.collect()))
    assert matrix.add_folds(df.limit(0), folds).count() == 0


def test_roc_corners_drop_straight_runs(spark):
    import random

    r = random.Random(6)
    data = [(r.randrange(2), round(r.random(), 2)) for _ in range(400)] + [(1, 2.0 + i) for i in range(6)] + [(0, -1.0 - i) for i in range(6)]
    found = scores.roc_corners(spark.createDataFrame([(y, s, 0) for y, s in data], "label int, score double, prediction int")).collect()
    every = sorted({s for _, s in data}, reverse=True)
    tps, fps = ([sum(1 for y, s in data if s >= t and y == c) for t in every] for c in (1, 0))
    straight = lambda v, i: v[i + 1] - v[i] == v[i] - v[i - 1]
    want = [(t, fps[i] / fps[-1], tps[i] / tps[-1]) for i, t in enumerate(every) if i in (0, len(every) - 1) or not (straight(fps, i) and straight(tps, i))]
    got = sorted(((x.threshold, x.fpr, x.tpr) for x in found if x.threshold is not None), reverse=True)
    assert [g[0] for g in got] == [w[0] for w in want] and len(want) < len(every) - 8
    assert all(g[1:] == pytest.approx(w[1:], abs=1e-6) for g, w in zip(got, want, strict=True))
    assert [tuple(x) for x in found if x.threshold is None] == [(None, 0.0, 0.0)]


def test_auc_and_roc_by_brute_force(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4), (1, 0.8), (0, 0.2)]
    df = spark.createDataFrame([(y, s, int(s > 0.5)) for y, s in data], "label int, score double, prediction int")
    pairs = [(p, n) for y, p in data if y for z, n in data if not z]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    row = scores.binary_metrics(df).first()
    assert row.auc == pytest.approx(auc, abs=1e-6) and row.accuracy == pytest.approx(5 / 7, abs=1e-6)
    points = {r.threshold: (r.fpr, r.tpr) for r in scores.roc(df).collect()}
    assert points[0.9] == (0.25, pytest.approx(1 / 3, abs=1e-6)) and points[0.1] == (1.0, 1.0)
    per_class = {r["class"]: r for r in scores.report(df).collect()}
    assert per_class[1].support == 3 and per_class[1].precision == pytest.approx(2 / 3, abs=1e-6)


def test_two_clear_clusters(spark):
    profile = spark.createDataFrame(
        [(f"t{i}", float(i % 2) * 100 + i * 0.01, float(i % 2) * 50) for i in range(40)], "track_uri string, a double, b double"
    )
    found = clusters.cluster(profile, ["a", "b"], ks=(2, 3), seeds=(42,))
    assert found.k == 2 and found.silhouette > 0.9
    assert found.assigned.groupBy("cluster").count().count() == 2
    points, pca = clusters.pca2(found.scaled)
    assert points.count() == 40 and sum(pca.explainedVariance) == pytest.approx(1.0)
    assert clusters.centroids(spark, found, pca).count() == 2
    assert all(not math.isnan(r.pc1) for r in points.collect())


def blobs(spark, n=600):
    import random

    r = random.Random(3)
    rows = [(f"t{i}", [r.gauss(10 * (i % 3), 1), r.gauss(5 * (i % 3 == 1), 1), r.gauss(0, 1)]) for i in range(n)]
    table = spark.createDataFrame(rows, "track_uri string, x array<double>").repartition(4)
    return table.select("track_uri", array_to_vector("x").alias("scaled"))


def test_shared_scans_fit_as_well_as_single_fits(spark):
    table = blobs(spark).cache()
    fits = kmeans.fit_all(table, (2, 3, 4), (1, 2, 3), "track_uri")
    assert [(f.k, f.seed) for f in fits] == [(k, s) for k in (2, 3, 4) for s in (1, 2, 3)]
    for k in (2, 3, 4):
        alone = min((KMeans(featuresCol="scaled", k=k, seed=s).fit(table) for s in (1, 2, 3)), key=lambda f: f.summary.trainingCost)
        best = min((f for f in fits if f.k == k), key=lambda f: f.inertia)
        assert best.inertia <= alone.summary.trainingCost * 1.001
        assert best.sizes.sum() == 600 and len(best.model.centres) == k
        spread = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(best.model.transform(table))
        assert kmeans.silhouettes(table, [best])[0] == pytest.approx(spread, abs=1e-9)
    again = kmeans.fit_all(table.repartition(2), (3,), (1,), "track_uri")[0]
    assert again.inertia == pytest.approx(next(f for f in fits if (f.k, f.seed) == (3, 1)).inertia, abs=1e-6)


def test_one_scan_moves_all_models(spark, monkeypatch):
    scans = []
    real = kmeans._summed
    monkeypatch.setattr(kmeans, "_summed", lambda rows, models: scans.append(len(models)) or real(rows, models))
    kmeans.fit_all(blobs(spark), (2, 3), (1, 2), "track_uri", steps=20)
    assert scans[0] == 4 and len(scans) <= 3 + 20 + 1 and max(scans) == 4


def test_fewer_points_than_centres(spark):
    same = spark.createDataFrame([(f"t{i}", [float(i % 2), 1.0]) for i in range(9)], "track_uri string, x array<double>")
    table = same.select("track_uri", array_to_vector("x").alias("scaled"))
    for f in kmeans.fit_all(table, (2, 5), (1,), "track_uri"):
        assert f.inertia == pytest.approx(0) and len(f.model.centres) == 2
    assert kmeans.fit_all(table.limit(0), (2,), (1,), "track_uri") == []


def test_saved_centres_assign_the_same(spark, tmp_path):
    table = blobs(spark)
    model = kmeans.fit_all(table, (3,), (1,), "track_uri")[0].model
    model.save(spark, str(tmp_path / "centres"))
    pick = lambda m: sorted(map(tuple, m.transform(table).select("track_uri", "cluster").collect()))
    assert pick(kmeans.Centres.load(spark, str(tmp_path / "centres"))) == pick(model)
