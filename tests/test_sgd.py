"""SGD and kernel SVR: convergence to the optimum of their objectives, schedules, kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from scoutml.operators.models import registry
from scoutml.operators.models.sgd import LinearSGD, loss_and_slope


def frame(spark, x, y):
    names = [f"f{j}" for j in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names).assign(row_id=np.arange(len(y)), label=y.astype(float))
    return VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(pdf).repartition(4, "row_id")).select("row_id", "features", "label").cache()


def predictions(fitted, df):
    return df.sparkSession.createDataFrame(fitted.predict(df).select("row_id", "prediction").toPandas()).toPandas().sort_values("row_id")["prediction"].to_numpy()


@pytest.mark.parametrize("schedule", ["optimal", "invscaling", "adaptive"])
def test_squared_error_near_least_squares_on_unequal_scales(spark, rng, schedule):
    x = rng.normal(size=(1200, 3)) * [1.0, 1000.0, 0.01] + [0, 5e4, 3]
    y = x @ [2.0, 0.003, 150.0] + rng.normal(size=1200)
    df = frame(spark, x, y)
    fitted = LinearSGD("regression", {"alpha": 1e-5, "learning_rate": schedule}).fit(df)
    rmse = np.sqrt(np.mean((predictions(fitted, df) - y) ** 2))
    a = np.column_stack([x, np.ones(len(x))])
    exact = np.sqrt(np.mean((a @ np.linalg.lstsq(a, y, rcond=None)[0] - y) ** 2))
    assert rmse <= 1.01 * exact


@pytest.mark.parametrize("loss", ["hinge", "log_loss", "modified_huber"])
def test_three_classes(spark, rng, loss):
    centres = np.array([[0, 0], [5, 0], [0, 5]])
    y = np.repeat([0, 1, 2], 200)
    x = centres[y] + rng.normal(size=(600, 2))
    df = frame(spark, x, y)
    fitted = LinearSGD("classification", {"alpha": 1e-4, "loss": loss, "learning_rate": "optimal"}, n_classes=3).fit(df)
    assert np.mean(predictions(fitted, df) == y) > 0.97


def test_slopes_are_derivatives(rng):
    m, y = rng.normal(size=200) * 3, rng.choice([-1.0, 1.0], 200)
    for loss in ("hinge", "log_loss", "modified_huber", "huber", "epsilon_insensitive", "squared_error"):
        up, down = (loss_and_slope(loss, m + h, y, 0.3)[0] for h in (1e-6, -1e-6))
        assert np.allclose((up - down) / 2e-6, loss_and_slope(loss, m, y, 0.3)[1], atol=1e-4)


def test_svr_kernels(spark, rng):
    x = rng.uniform(-3, 3, size=(500, 1))
    y = np.sin(2 * x[:, 0]) + rng.normal(size=500) * 0.05
    df = frame(spark, x, y)
    error = {}
    for kernel in ("rbf", "linear", "poly"):
        fitted = registry.build("svm", "regression", {"C": 10.0, "epsilon": 0.05, "kernel": kernel, "gamma": "scale", "max_iter": 40}).fit(df)
        error[kernel] = np.sqrt(np.mean((predictions(fitted, df) - y) ** 2))
    assert error["rbf"] < 0.2 < error["linear"] and abs(error["poly"] - error["linear"]) > 1e-3
    with pytest.raises(ValueError):
        registry.build("svm", "regression", {"kernel": "sigmoid"}).fit(df)


def test_features_are_made_a_stretch_at_a_time(spark, rng):
    """No task holds the features of more than STRETCH rows, and the rows' sums come once a task."""
    from scoutml.operators.models import sgd

    most = sgd.STRETCH

    class Bounded(sgd.LinearSGD):
        def features(self, data):
            def phi(x):
                if len(x) > most:
                    raise ValueError("too many rows at once")
                return np.column_stack([x, x * x])

            return phi

    x = rng.normal(size=(5 * most, 1))
    df = frame(spark, x, 3 * x[:, 0] + x[:, 0] ** 2)
    fitted = Bounded("regression", {"max_iter": 10, "alpha": 1e-6}).fit(df.coalesce(1))
    assert np.allclose(fitted.info["coef"][0], [3, 1], atol=0.1)
