from pyspark.sql import functions as F

from scoutml.operators import route as R


def _one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_unsupervised_router(spark):
    assert _one(spark, "Please CLUSTER my customers", lambda c: R.needs_unsupervised(c, True))
    assert not _one(spark, "predict churn", lambda c: R.needs_unsupervised(c, True))
    assert _one(spark, "predict churn", lambda c: R.needs_unsupervised(c, False))


def test_prompt_models(spark):
    got = _one(spark, "compare lasso and gbm please", lambda c: R.prompt_models(c, F.lit("regression")))
    assert got == ["Gradient Boosting", "Lasso Regression"]
    # classification drops the regression-only name
    got = _one(spark, "compare lasso and gbm please", lambda c: R.prompt_models(c, F.lit("classification")))
    assert got == ["Gradient Boosting"]
    for task in ("classification", "regression"):
        assert _one(spark, "use bagging", lambda c: R.prompt_models(c, F.lit(task))) == ["Bagging"]
    assert _one(spark, "try all of them", lambda c: R.prompt_models(c, F.lit("classification"))) == R.CLASSIFICATION_MODELS[:5]
    assert _one(spark, "hello", lambda c: R.prompt_models(c, F.lit("classification"))) == R.DEFAULT_MODELS
    # whole words only, accented letters count as letters
    assert _one(spark, "éet", lambda c: R.prompt_models(c, F.lit("classification"))) == R.DEFAULT_MODELS


def test_prompt_algos(spark):
    assert _one(spark, "run dbscan", R.prompt_algos) == ["DBSCAN"]
    assert _one(spark, "find outlier rows", R.prompt_algos) == R.ANOMALY_ALGOS
    assert _one(spark, "segment users", R.prompt_algos) == R.CLUSTER_ALGOS
    assert _one(spark, "hmm", R.prompt_algos) == R.DEFAULT_ALGOS


def test_resolution(spark):
    assert _one(spark, " Random Forest ", R.resolve_model) == "random forest"
    assert _one(spark, "gbm", R.resolve_model) == "lightgbm"  # substring rule (D14)
    assert _one(spark, "", R.resolve_model) is None
    assert _one(spark, "LOF", R.resolve_algo) == "lof"
    assert _one(spark, "zzz", R.resolve_algo) is None
