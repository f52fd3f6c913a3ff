"""Order statistics by distinct values, and fold F-scores from one scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutml.operators import anomaly, prepare, ranking, tuning


def test_ranks_of_repeated_values(spark, rng):
    """60 % of the values are equal: their rank is found, and the ranking holds one row of them."""
    a = np.concatenate([np.full(600, 5.0), rng.normal(5, 2, 400)])
    b = np.concatenate([rng.integers(0, 3, 300).astype(float), np.full(700, -1.0)])
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "column string, v double")
    ranks = {"a": [0, 1, 499, 500, 800, 999], "b": [0, 699, 700, 998]}
    want = {(c, k): np.sort(x)[k] for c, x in (("a", a), ("b", b)) for k in ranks[c]}
    assert ranking.values_at(df, ranks, "column") == want
    counted = df.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = ranking.with_cumulative(counted, "n", ["v"], ["column"]).where("column = 'a' and v = 5.0").collect()
    assert [(r.n, r.before) for r in placed] == [(600, int((a < 5).sum()))]


def test_median_and_percentile_of_skewed_columns(spark, rng):
    x = np.concatenate([np.zeros(700), rng.normal(size=301)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert prepare.exact_medians(df, ["x"]).first()["median"] == np.median(x)
    for p in (0.0, 0.1, 0.9, 0.955, 1.0):
        assert np.isclose(anomaly.exact_percentile(df, "x", p), np.percentile(x, 100 * p))
    assert anomaly.exact_percentile(df.where("false"), "x", 0.5) is None


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_fold_scores_equal_scores_of_training_rows(spark, rng, task):
    x = rng.normal(size=(200, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 5]
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 2] > 5) if task == "classification" else x[:, 0] + rng.normal(size=200)
    rows = [(i, *map(float, r), (f"c{v}" if task == "classification" else float(v))) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"row_id long, a double, b double, c double, target {'string' if task == 'classification' else 'double'}")
    prep = tuning.prepare_supervised(df, "target", "row_id")
    assert prep.task == task
    for fold, got in tuning.fold_scores(prep).items():
        want = tuning.f_scores(prep.df.where(F.col("fold") != fold), task)
        assert np.allclose(got, want, rtol=1e-6, equal_nan=True)
        assert tuning.top_k(got, 3) == tuning.top_k(want, 3)
