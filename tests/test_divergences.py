"""One check per divergence decision of SURVEY §4.4 that has a runtime surface."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scoutml.operators import cluster_metrics as CM
from scoutml.operators.profile import detect_task
from scoutml.operators.tuning import prepare_supervised, tune
from scoutml.plans.supervised import resolve_model_name


def test_d1_rmse_is_minimised(spark, rng):
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"row_id": np.arange(300), "a": x, "b": rng.normal(size=300), "target": 3 * x + rng.normal(size=300)})
    prep = prepare_supervised(spark.createDataFrame(pdf), "target", "row_id")
    rec, trials = tune(prep, "ridge regression", 3)
    assert rec["score"] == round(min(t["score"] for t in trials), 6)


def test_d3_string_target_is_classification(spark):
    df = spark.createDataFrame([(str(i),) for i in range(40)], "target string")
    assert detect_task(df) == "classification"
    df = spark.createDataFrame([(float(i),) for i in range(40)], "target double")
    assert detect_task(df) == "regression"


def test_d5_zero_is_a_value():
    import pyspark.sql.functions as F2  # noqa: F401

    # composite must keep sil = 0.0 and db = 0.0 (not replace them by -1 / 10)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(0.0, 0.0, 0.0)], "s double, d double, c double").select(
        CM.composite(F.col("s"), F.col("d"), F.col("c")).alias("v")).first()
    assert row["v"] == 0.0


def test_d14_name_resolution():
    assert resolve_model_name("gbm") == "gradient boosting" and resolve_model_name("") is None  # alias table first
    assert resolve_model_name("Bayesian Ridge") == "bayesian ridge"  # exact key wins (D2)
