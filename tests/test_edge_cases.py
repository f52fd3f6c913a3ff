"""Degenerate inputs that must have a defined result."""

import numpy as np
from pyspark.sql import functions as F

from scoutml.operators import cluster_metrics as CM
from scoutml.operators import folds, prepare, tuning


def test_silhouette_of_single_and_coincident_clusters(spark):
    one = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)], "id long, x array<double>, cluster int")
    assert abs(CM.silhouette_exact(one).first()[0] - np.mean([8 / 9, 7 / 8, 0])) < 1e-12
    same = spark.createDataFrame([(i, [1.0], i % 2) for i in range(4)], "id long, x array<double>, cluster int")
    assert CM.silhouette_exact(same).first()[0] == 0 and CM.silhouette_squared(same).first()[0] == 0


def test_f_scores_of_perfect_features_and_one_class(spark):
    df = spark.createDataFrame([(float(i), float(i), float(i % 3), 0) for i in range(9)], "y double, a double, b double, c int")
    rows = {r.feature: r.f_score for r in prepare.f_regression_scores(df, ["b", "a"], "y").collect()}
    assert rows["a"] == float("inf") and rows["b"] is not None
    assert all(r.f_score is None for r in prepare.anova_f_scores(df, ["a", "b"], "c").collect())
    assert tuning.top_k(np.array([3.0, np.inf, np.nan]), 1) == [1]


def test_stratified_folds_keep_null_labels(spark):
    df = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("label"))
    out = folds.stratified_kfold(df, "id", "label", 5)
    assert out.count() == 30 and out.where("label is null").select("fold").distinct().count() == 5
