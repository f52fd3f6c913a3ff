"""Models fitted from one aggregation pass (k x d or d x d statistics on the
driver) and scored by JVM expressions: Gaussian naive Bayes (M20), linear
discriminant analysis (M21), Bayesian ridge (M18), and exact kNN (M10)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import lit_array, to_array
from scoutml.operators import neighbors as NB
from scoutml.operators.models.base import (
    FEATURES, LABEL, Fitted, Learner, argmax_code, class_stats, full_probability, gram, linear_scores,
    overall_stats, softmax,
)


class GaussianNB(Learner):
    """Log n_k/n - 1/2 sum[ln(2 pi v) + (x-m)^2/v], v = var_pop + eps * max var."""

    name = "naive bayes"
    has_probability = True

    def fit(self, train: DataFrame) -> Fitted:
        smoothing = float(self.params.get("var_smoothing", 1e-9))
        stats = class_stats(train)
        n_all, _, var_all = overall_stats(train)
        eps = smoothing * float(np.max(var_all * (n_all - 1) / n_all)) if n_all > 1 else 0.0
        classes, terms = [], []
        x = to_array(FEATURES)
        for label, n_k, mean, var_s in stats:
            var = var_s * (n_k - 1) / n_k if n_k > 1 else np.zeros_like(mean)
            var = var + eps
            prior = math.log(n_k / n_all)
            const = prior - 0.5 * float(np.sum(np.log(2 * np.pi * var)))
            quad = F.aggregate(
                F.zip_with(F.zip_with(x, lit_array(mean), lambda a, b: a - b), lit_array(var), lambda dlt, v: dlt * dlt / v),
                F.lit(0.0),
                lambda acc, v: acc + v,
            )
            classes.append(float(label))
            terms.append(F.lit(const) - 0.5 * quad)
        scores = F.array(*terms)
        k = self.n_classes

        def predict(df: DataFrame) -> DataFrame:
            return df.withColumn("_jll", scores).select(
                "*", argmax_code(F.col("_jll"), classes).alias("prediction"),
                full_probability(softmax(F.col("_jll")), classes, k).alias("probability"),
            ).drop("_jll")

        return Fitted(stats, predict, True)


class LDA(Learner):
    """Linear discriminants with the pooled within-class covariance S_w/(n-K)."""

    name = "lda"
    has_probability = True

    def fit(self, train: DataFrame) -> Fitted:
        stats = class_stats(train)
        d = len(stats[0][2])
        n, _, g, *_ = gram(train, d)
        means = np.array([s[2] for s in stats])
        counts = np.array([s[1] for s in stats], dtype=float)
        sw = g - sum(counts[i] * np.outer(means[i], means[i]) for i in range(len(stats)))
        k = len(stats)
        cov = sw / max(n - k, 1)
        prec = np.linalg.pinv(cov)
        w = means @ prec
        b = -0.5 * np.einsum("ij,ij->i", w, means) + np.log(counts / n)
        classes = [float(s[0]) for s in stats]
        scores = linear_scores(to_array(FEATURES), w, b)
        kk = self.n_classes

        def predict(df: DataFrame) -> DataFrame:
            return df.withColumn("_s", scores).select(
                "*", argmax_code(F.col("_s"), classes).alias("prediction"),
                full_probability(softmax(F.col("_s")), classes, kk).alias("probability"),
            ).drop("_s")

        return Fitted((w, b), predict, True)


class BayesianRidge(Learner):
    """M18 (D2: a real Bayesian ridge): evidence maximisation on d x d statistics."""

    name = "bayesian ridge"

    def fit(self, train: DataFrame) -> Fitted:
        p = self.params
        a1, a2 = float(p.get("alpha_1", 1e-6)), float(p.get("alpha_2", 1e-6))
        l1, l2 = float(p.get("lambda_1", 1e-6)), float(p.get("lambda_2", 1e-6))
        d = train.select(F.size(to_array(FEATURES))).first()[0]
        n, sx, g, xy, sy, syy = gram(train, d, with_label=True)
        xm, ym = sx / n, sy / n
        xtx = g - n * np.outer(xm, xm)
        xty = xy - n * xm * ym
        yty = syy - n * ym * ym
        eig, vec = np.linalg.eigh(xtx)
        eig = np.clip(eig, 0, None)
        alpha = 1.0 / (yty / n + np.finfo(float).eps)
        lam = 1.0
        coef_old = None
        proj = vec.T @ xty
        for _ in range(300):
            coef = vec @ (proj / (eig + lam / alpha))
            rss = yty - 2 * coef @ xty + coef @ xtx @ coef
            gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
            lam = (gamma + 2 * l1) / (float(coef @ coef) + 2 * l2)
            alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
            if coef_old is not None and np.sum(np.abs(coef_old - coef)) < 1e-3:
                break
            coef_old = coef
        coef = vec @ (proj / (eig + lam / alpha))
        intercept = float(ym - xm @ coef)
        from scoutml.functions.vectors import dot

        pred = dot(to_array(FEATURES), lit_array(coef)) + F.lit(intercept)
        return Fitted((coef, intercept), lambda df: df.withColumn("prediction", pred))


class KNN(Learner):
    """Exact k nearest training rows (blocked pairs), vote or average."""

    name = "knn"
    has_probability = True

    def fit(self, train: DataFrame) -> Fitted:
        k = int(self.params.get("n_neighbors", 5))
        weights = self.params.get("weights", "uniform")
        metric = "manhattan" if self.params.get("metric") == "manhattan" else "euclidean"
        refs = train.select(F.col("row_id").alias("rid"), to_array(FEATURES).alias("rx"), F.col(LABEL))
        task = self.task
        n_classes = self.n_classes

        def predict(df: DataFrame) -> DataFrame:
            q = df.select(F.col("row_id").alias("lid"), to_array(FEATURES).alias("lx"))
            nn = NB.knn(q, refs, k, metric=metric, payload=LABEL)
            if task == "classification":
                pred = NB.vote(nn, LABEL, weights)
                shares = NB.class_shares(nn, LABEL, weights)
                prob = shares.groupBy("lid").agg(
                    F.array(*[F.sum(F.when(F.col(LABEL) == c, F.col("p")).otherwise(0.0)) for c in range(n_classes)]).alias("probability")
                )
                pred = pred.join(prob, "lid")
            else:
                pred = NB.average(nn, LABEL, weights)
            return df.join(pred.withColumnRenamed("lid", "row_id"), "row_id")

        return Fitted(refs, predict, task == "classification")
