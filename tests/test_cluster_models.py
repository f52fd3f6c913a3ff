import numpy as np
import pytest
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import points_df
from scoutml.operators import cluster as CL
from scoutml.operators.models import registry


def _blobs(rng):
    return np.vstack([rng.normal(0, 0.3, (50, 2)), rng.normal(5, 0.3, (50, 2))])


def _pure(labels):
    a, b = labels[:50], labels[50:]
    return len(set(a)) == 1 and len(set(b)) == 1 and a[0] != b[0]


def test_kmeans_blobs(spark, rng):
    lab = CL.kmeans(points_df(spark, _blobs(rng)), 2, n_init=2).toPandas().sort_values("id")["cluster"].to_numpy()
    assert _pure(lab)


def test_dbscan_two_blobs_and_noise(spark, rng):
    x = np.vstack([_blobs(rng), [[20.0, 20.0]]])
    lab = CL.dbscan(points_df(spark, x), 1.0, 4).toPandas().sort_values("id")["cluster"].to_numpy()
    assert _pure(lab[:100]) and lab[100] == -1
    assert lab[0] == 0  # clusters numbered by their smallest core id


def test_dbscan_repeated_points_match_row_level(spark, rng):
    # one position repeated across a third of the rows, plus two spread groups
    x = np.vstack([np.repeat([[0.3, -0.2]], 40, axis=0), rng.normal(0, 0.4, (40, 2)), rng.normal(5, 0.4, (40, 2)),
                   [[20.0, 20.0]]])
    p = points_df(spark, x)
    got = CL.dbscan(p, 0.5, 5).toPandas().sort_values("id")["cluster"].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = d <= 0.5
    core = nb.sum(1) >= 5
    # brute-force reference: components of core rows, numbered by smallest core id
    comp = -np.ones(len(x), dtype=int)
    for i in np.nonzero(core)[0]:
        if comp[i] >= 0:
            continue
        stack, comp[i] = [i], i
        while stack:
            j = stack.pop()
            for t in np.nonzero(nb[j] & core)[0]:
                if comp[t] < 0:
                    comp[t] = i
                    stack.append(t)
    roots = sorted(set(comp[core]))
    exp = np.array([roots.index(c) if c >= 0 else -1 for c in comp])
    for i in np.nonzero(~core)[0]:
        adj = [exp[t] for t in np.nonzero(nb[i] & core)[0]]
        exp[i] = min(adj) if adj else -1
    assert (got == exp).all()
    cnt = CL.neighbor_counts(p, 0.5).toPandas().sort_values("id")["n_neighbors"].to_numpy()
    assert (cnt == nb.sum(1)).all()


@pytest.mark.parametrize("cov", ["diag", "spherical", "tied"])
def test_gmm_em_likelihood_non_decreasing(spark, rng, cov):
    lab, hist = CL.gmm_em(points_df(spark, _blobs(rng)), 2, cov, max_iter=15)
    assert all(b >= a - 1e-9 for a, b in zip(hist, hist[1:]))
    assert _pure(lab.toPandas().sort_values("id")["cluster"].to_numpy())


def _xy(spark, x, y):
    pdf = pd.DataFrame({"row_id": np.arange(len(y)), "a": x[:, 0], "b": x[:, 1], "label": y.astype(float)})
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))


def test_gaussian_nb_matches_numpy(spark, rng):
    x = _blobs(rng)
    x[:, 1] += rng.normal(size=100)
    y = np.array([0] * 50 + [1] * 50)
    df = _xy(spark, x, y)
    pred = registry.build("naive bayes", "classification", {"var_smoothing": 1e-9}, 2).fit(df).predict(df)
    got = pred.toPandas().sort_values("row_id")["prediction"].to_numpy()
    eps = 1e-9 * x.var(axis=0).max()
    jll = []
    for k in (0, 1):
        m, v = x[y == k].mean(0), x[y == k].var(0) + eps
        jll.append(np.log(0.5) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * ((x - m) ** 2 / v).sum(1))
    assert (got == np.argmax(np.array(jll), axis=0)).all()


def test_ridge_one_feature_closed_form(spark, rng):
    x = rng.normal(size=(200, 1))
    y = 3 * x[:, 0] + rng.normal(size=200)
    pdf = pd.DataFrame({"row_id": np.arange(200), "a": x[:, 0], "label": y})
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame(pdf))
    m = registry.build("ridge regression", "regression", {"alpha": 10.0}).fit(df).model
    w = np.cov(x[:, 0], y, bias=True)[0, 1] / (x[:, 0].var() + 10.0 / 200)
    assert abs(m.coefficients[0] - w) < 1e-6


def test_adaboost_and_sgd_learn_separable(spark, rng):
    x = _blobs(rng)
    y = np.array([0] * 50 + [1] * 50)
    df = _xy(spark, x, y)
    for key, params in (("adaboost", {"n_estimators": 5}), ("sgd", {"loss": "hinge", "alpha": 1e-4})):
        pred = registry.build(key, "classification", params, 2).fit(df).predict(df).toPandas()
        assert (pred.sort_values("row_id")["prediction"].to_numpy() == y).mean() > 0.95


def test_bayesian_ridge_recovers_slope(spark, rng):
    x = rng.normal(size=(300, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=300)
    df = _xy(spark, x, y)
    coef, _ = registry.build("bayesian ridge", "regression", {}).fit(df).model
    assert np.allclose(coef, [2, -1], atol=0.05)


def test_run_automl_end_to_end(spark):
    from scoutml.plans.fixtures import customer_xy
    from scoutml.plans.supervised import run_automl

    res = run_automl(customer_xy(spark, "/root/testdata/sf0.001"), ["Naive Bayes", "LDA", "nonsense"], key_col="row_id", n_trials=1)
    lb = res["leaderboard"].toPandas().sort_values("position")
    assert res["task"] == "classification"
    assert lb["name"].tolist()[-1] == "nonsense" and lb["score"].isna().tolist()[-1]
    assert res["ensemble"]["voting"] == "soft"


def test_mixture_queries_run_to_tolerance(spark, monkeypatch):
    from scoutml.plans import q_cluster

    asked = []
    monkeypatch.setattr(q_cluster, "_points", lambda spark, sf: points_df(spark, np.zeros((2, 2))))
    monkeypatch.setattr(q_cluster.CL, "gmm_em", lambda pts, k, cov, max_iter=200: (asked.append(max_iter), (pts.selectExpr("id", "0 cluster"), []))[1])
    for cov in ("diag", "spherical", "tied"):
        q_cluster.QUERIES[f"gmm_{cov}"](spark, "")
    assert asked == [200] * 3


def test_soft_vote_of_any_classes(spark):
    from scoutml.operators import ensemble as EN

    rows = [(1, 12, 0.9), (1, 3, 0.1), (1, 12, 0.4), (1, 3, 0.6), (2, -5, 0.5), (2, 40, 0.5), (2, 40, 0.5), (2, -5, 0.5)]
    out = EN.soft_vote_of_shares(spark.createDataFrame(rows, "row_id long, cls int, p double"), 2).collect()
    assert {r.row_id: r.prediction for r in out} == {1: 12, 2: -5}


def test_sgd_goes_on_after_40_rounds(spark, rng):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from scoutml.operators.models.base import FEATURES, LABEL
    from scoutml.operators.models.registry import build

    a = rng.normal(size=200)
    x = np.c_[a, a + 0.1 * rng.normal(size=200)]
    y = 5 * x[:, 0] - 5 * x[:, 1]
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], f"x array<double>, {LABEL} double")
    df = df.select(array_to_vector("x").alias(FEATURES), LABEL).coalesce(1)
    error = {}
    for rounds in (40, 250):
        fit = build("sgd", "regression", {"loss": "squared_error", "alpha": 0.0, "max_iter": rounds}).fit(df)
        error[rounds] = fit.predict(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col(LABEL)) ** 2))).first()[0]
    assert error[250] < 0.5 * error[40]


def test_kmeans_keeps_no_table_in_memory(spark, rng):
    from scoutml.operators import cluster

    spark.catalog.clearCache()
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 50])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = {r.id: r.cluster for r in cluster.kmeans(points, 2, n_init=2).collect()}
    assert len({found[i] for i in range(30)}) == len({found[i] for i in range(30, 60)}) == 1 and found[0] != found[59]
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
