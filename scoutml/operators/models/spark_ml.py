"""Spark ML estimators behind the model protocol (M1, M9, M11 classification, M12–M16, M19)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as RG
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import dot, lit_array, to_array, to_vector
from scoutml.operators.models.base import FEATURES, LABEL, Fitted, Learner


def _subset(v) -> str:
    return {"sqrt": "sqrt", "log2": "log2", None: "all", "None": "all"}.get(v, "all")


def _wrap(model, has_prob: bool) -> Fitted:
    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        keep = [c for c in df.columns] + ["prediction"]
        if has_prob and "probability" in out.columns:
            return out.select(*keep, vector_to_array("probability").alias("probability"))
        return out.select(*keep)

    return Fitted(model, predict, has_prob)


class SparkEstimator(Learner):
    """Subclasses return a configured Spark ML estimator from ``estimator()``."""

    def estimator(self):  # pragma: no cover - interface
        raise NotImplementedError

    def fit(self, train: DataFrame) -> Fitted:
        est = self.estimator().setFeaturesCol(FEATURES).setLabelCol(LABEL)
        return _wrap(est.fit(train), self.has_probability)


class RandomForest(SparkEstimator):
    """M1: min_samples_split has no Spark equivalent and is recorded only."""

    name = "random forest"
    has_probability = True

    def estimator(self):
        p = self.params
        kw = dict(
            numTrees=int(p.get("n_estimators", 100)), maxDepth=min(int(p.get("max_depth", 10)), 30),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(p.get("max_features", "sqrt")), seed=self.seed,
        )
        if self.task == "classification":
            return C.RandomForestClassifier(**kw)
        self.has_probability = False
        return RG.RandomForestRegressor(**kw)


class DecisionTree(SparkEstimator):
    """M9: impurity gini/entropy, or variance for both regression criteria."""

    name = "decision tree"
    has_probability = True

    def estimator(self):
        p = self.params
        kw = dict(maxDepth=min(int(p.get("max_depth", 5)), 30), minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=self.seed)
        if self.task == "classification":
            return C.DecisionTreeClassifier(impurity=p.get("criterion", "gini") if p.get("criterion") in ("gini", "entropy") else "gini", **kw)
        self.has_probability = False
        return RG.DecisionTreeRegressor(impurity="variance", **kw)


class LogisticRegression(SparkEstimator):
    """regParam = 1/(C n), elasticNetParam from the penalty, no standardisation."""

    name = "logistic regression"
    has_probability = True

    def fit(self, train: DataFrame) -> Fitted:
        p = self.params
        n = train.count()
        penalty = p.get("penalty", "l2")
        mix = {"l2": 0.0, "l1": 1.0}.get(penalty, float(p.get("l1_ratio", 0.5)))
        est = C.LogisticRegression(
            regParam=1.0 / (float(p.get("C", 1.0)) * n), elasticNetParam=mix, standardization=False,
            maxIter=int(p.get("max_iter", 1000)), featuresCol=FEATURES, labelCol=LABEL,
        )
        return _wrap(est.fit(train), True)


class LinearFamily(Learner):
    """M13–M16, M19 through ``LinearRegression`` with sklearn's objectives:
    ridge regParam = alpha/n * sd_pop(y) (normal solver); lasso regParam = alpha;
    elastic net l1 = alpha r, l2 = alpha (1-r) sd_samp(y); huber loss with epsilon."""

    def __init__(self, task, params=None, n_classes=2, seed=42, kind="linear regression"):
        super().__init__(task, params, n_classes, seed)
        self.kind = kind
        self.name = kind

    def fit(self, train: DataFrame) -> Fitted:
        p = self.params
        kw = dict(featuresCol=FEATURES, labelCol=LABEL, standardization=False)
        if self.kind == "linear regression":
            est = RG.LinearRegression(regParam=0.0, solver="normal", **kw)
        elif self.kind == "ridge regression":
            n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first()
            est = RG.LinearRegression(regParam=float(p.get("alpha", 1.0)) / n * (sd or 1.0), elasticNetParam=0.0, solver="normal", **kw)
        elif self.kind == "lasso regression":
            est = RG.LinearRegression(regParam=float(p.get("alpha", 1.0)), elasticNetParam=1.0, maxIter=int(p.get("max_iter", 5000)), **kw)
        elif self.kind == "elastic net":
            alpha, r = float(p.get("alpha", 1.0)), float(p.get("l1_ratio", 0.5))
            sd = train.agg(F.stddev_pop(LABEL)).first()[0] or 1.0
            l1, l2 = alpha * r, alpha * (1 - r) * sd
            tot = l1 + l2
            est = RG.LinearRegression(regParam=tot, elasticNetParam=(l1 / tot) if tot > 0 else 0.0, maxIter=int(p.get("max_iter", 5000)), **kw)
        elif self.kind == "huber":
            est = RG.LinearRegression(loss="huber", epsilon=max(float(p.get("epsilon", 1.35)), 1.0 + 1e-9),
                                      regParam=float(p.get("alpha", 1e-4)) / max(train.count(), 1), elasticNetParam=0.0,
                                      maxIter=int(p.get("max_iter", 500)), **kw)
        else:
            raise ValueError(self.kind)
        return _wrap(est.fit(train), False)


def random_fourier(train: DataFrame, gamma, d_out: int = 64, seed: int = 42):
    """Rahimi & Recht features for the rbf kernel: sqrt(2/D) cos(W x + b).
    gamma "scale" = 1/(d var(X)), "auto" = 1/d."""
    arr = to_array(FEATURES)
    d = train.select(F.size(arr)).first()[0]
    if gamma in ("scale", None):
        var = train.select(F.explode(arr).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        g = 1.0 / (d * var)
    elif gamma == "auto":
        g = 1.0 / d
    else:
        g = float(gamma)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * g), size=(d_out, d))
    b = rng.uniform(0, 2 * math.pi, size=d_out)
    scale = math.sqrt(2.0 / d_out)
    feats = F.array(*[F.lit(scale) * F.cos(dot(arr, lit_array(w[j])) + F.lit(float(b[j]))) for j in range(d_out)])
    return lambda df: df.withColumn(FEATURES, to_vector(feats))


class SVM(Learner):
    """M11 classification: LinearSVC (one-vs-rest above two classes); the rbf
    kernel through random Fourier features, poly through degree-2 expansion.
    C maps to regParam = 1/(C n)."""

    name = "svm"

    def fit(self, train: DataFrame) -> Fitted:
        from pyspark.ml.feature import PolynomialExpansion

        p = self.params
        kernel = p.get("kernel", "rbf")
        if kernel == "rbf":
            tf = random_fourier(train, p.get("gamma", "scale"), seed=self.seed)
        elif kernel == "poly":
            pe = PolynomialExpansion(degree=3, inputCol=FEATURES, outputCol="_poly")
            tf = lambda df: pe.transform(df).drop(FEATURES).withColumnRenamed("_poly", FEATURES)
        else:
            tf = lambda df: df
        tr = tf(train).cache()
        n = tr.count()
        svc = C.LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * n), maxIter=100, standardization=False, featuresCol=FEATURES, labelCol=LABEL)
        est = svc if self.n_classes <= 2 else C.OneVsRest(classifier=svc, parallelism=4, featuresCol=FEATURES, labelCol=LABEL)
        model = est.fit(tr)

        def predict(df: DataFrame) -> DataFrame:
            tmp = tf(df.withColumnRenamed(FEATURES, "_f0").withColumn(FEATURES, F.col("_f0")))
            out = model.transform(tmp).drop(FEATURES).withColumnRenamed("_f0", FEATURES)
            return out.select(*df.columns, "prediction")

        return Fitted(model, predict, False)
