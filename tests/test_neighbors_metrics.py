import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import points_df
from scoutml.operators import anomaly as AN
from scoutml.operators import cluster_metrics as CM
from scoutml.operators import neighbors as NB


def _brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def test_knn_blocked_matches_brute_force(spark, rng):
    x = rng.normal(size=(120, 4))
    p = points_df(spark, x)
    q = p.select(F.col("id").alias("lid"), F.col("x").alias("lx"))
    r = p.select(F.col("id").alias("rid"), F.col("x").alias("rx"))
    got = NB.knn(q, r, 5, exclude_self=True).toPandas()
    d = _brute(x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        exp = list(np.lexsort((np.arange(len(x)), d[i]))[:5])
        rows = got[got.lid == i].sort_values("nn_rank")
        assert rows.rid.tolist() == exp


def test_radius_pairs(spark, rng):
    x = rng.normal(size=(80, 3))
    got = NB.radius_pairs(points_df(spark, x), 1.0).toPandas()
    d = _brute(x)
    assert len(got) == int((d <= 1.0).sum())


@pytest.mark.parametrize("share", [1.0, 0.0])  # grid path forced / block engine forced
def test_knn_grid_skewed_density_duplicates_and_manhattan(spark, rng, monkeypatch, share):
    monkeypatch.setattr(NB, "GRID_MAX_PAIR_SHARE", share)
    monkeypatch.setattr(NB, "SALT_ROWS", 7)  # several salts per repeated position
    # a dense blob holding a third of the rows (with exact duplicates), spread
    # rows and far outliers: the grid settles them at different levels
    x = np.vstack([rng.normal(0, 0.01, (50, 6)), np.repeat(rng.normal(0, 0.01, (1, 6)), 10, axis=0),
                   rng.normal(0, 3, (80, 6)), rng.normal(0, 50, (10, 6))])
    p = points_df(spark, x)
    q = p.select(F.col("id").alias("lid"), F.col("x").alias("lx"))
    r = p.select(F.col("id").alias("rid"), F.col("x").alias("rx"))
    for metric, d in (("euclidean", _brute(x)), ("manhattan", np.abs(x[:, None, :] - x[None, :, :]).sum(-1))):
        got = NB.knn(q, r, 7, metric=metric, exclude_self=True).toPandas()
        np.fill_diagonal(d, np.inf)
        assert len(got) == 7 * len(x)
        for i in range(len(x)):
            exp = list(np.lexsort((np.arange(len(x)), d[i]))[:7])
            rows = got[got.lid == i].sort_values("nn_rank")
            assert rows.rid.tolist() == exp and rows.nn_rank.tolist() == list(range(1, 8))
            assert np.allclose(rows.dist.to_numpy(), d[i, exp])


@pytest.mark.parametrize("share", [1.0, 0.0])
def test_knn_disjoint_queries_payload_and_k_above_refs(spark, rng, monkeypatch, share):
    monkeypatch.setattr(NB, "GRID_MAX_PAIR_SHARE", share)
    qx, rx = rng.normal(0, 1, (40, 3)), np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(8, 1, (5, 3))])
    q = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(qx)], "lid long, lx array<double>")
    r = spark.createDataFrame([(100 + j, [float(v) for v in row], j % 3) for j, row in enumerate(rx)],
                              "rid long, rx array<double>, label int")
    d = np.sqrt(((qx[:, None, :] - rx[None, :, :]) ** 2).sum(-1))
    for k in (4, 50):
        got = NB.knn(q, r, k, payload="label").toPandas()
        kk = min(k, len(rx))
        assert len(got) == kk * len(qx)
        for i in range(len(qx)):
            exp = list(np.lexsort((np.arange(len(rx)), d[i]))[:kk])
            rows = got[got.lid == i].sort_values("nn_rank")
            assert rows.rid.tolist() == [100 + j for j in exp]
            assert rows.label.tolist() == [j % 3 for j in exp]


@pytest.mark.parametrize("share", [1.0, 0.0])
def test_radius_pairs_high_dim(spark, rng, monkeypatch, share):
    monkeypatch.setattr(NB, "GRID_MAX_PAIR_SHARE", share)
    x = np.vstack([rng.normal(0, 0.3, (60, 10)), rng.normal(2, 0.3, (60, 10))])
    got = NB.radius_pairs(points_df(spark, x), 1.2).toPandas()
    d = _brute(x)
    exp = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 1.2))}
    assert set(zip(got.lid.astype(int), got.rid.astype(int))) == exp and len(got) == len(exp)


def test_silhouettes_and_indices(spark, rng):
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (40, 3)), rng.normal([0, 5, 0], 1, (20, 3))])
    lab = np.array([0] * 40 + [1] * 40 + [2] * 20)
    lab[5] = -1
    p = points_df(spark, x, lab)
    keep = lab != -1
    xv, lv = x[keep], lab[keep]
    d = _brute(xv)
    s = []
    for i in range(len(xv)):
        own = lv == lv[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lv == k].mean() for k in set(lv) if k != lv[i])
        s.append((b - a) / max(a, b))
    assert abs(CM.silhouette_exact(p).first()[0] - np.mean(s)) < 1e-9
    d2 = d ** 2
    s2 = []
    for i in range(len(xv)):
        own = lv == lv[i]
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lv == k].mean() for k in set(lv) if k != lv[i])
        s2.append((b - a) / max(a, b))
    assert abs(CM.silhouette_squared(p).first()[0] - np.mean(s2)) < 1e-9
    cen = np.array([xv[lv == k].mean(0) for k in range(3)])
    sk = np.array([np.linalg.norm(xv[lv == k] - cen[k], axis=1).mean() for k in range(3)])
    cd = _brute(cen)
    np.fill_diagonal(cd, np.inf)
    db = np.mean([max((sk[k] + sk[j]) / cd[k, j] for j in range(3) if j != k) for k in range(3)])
    assert abs(CM.davies_bouldin(p).first()[0] - db) < 1e-9
    g = xv.mean(0)
    ch = (sum((lv == k).sum() * ((cen[k] - g) ** 2).sum() for k in range(3)) / 2) / (
        sum(((xv[lv == k] - cen[k]) ** 2).sum() for k in range(3)) / (len(xv) - 3))
    assert abs(CM.calinski_harabasz(p).first()[0] - ch) < 1e-6 * ch


def test_score_guard(spark, rng):
    x = rng.normal(size=(30, 2))
    p = points_df(spark, x, np.zeros(30, dtype=int))
    r = CM.score(p).first()
    assert r["silhouette"] is None and r["n_clusters_found"] == 1 and r["n_noise_points"] == 0


def test_lof_matches_numpy(spark, rng):
    x = rng.normal(size=(60, 2))
    k = 5
    got = AN.lof_scores(points_df(spark, x), k).toPandas().set_index("id")["lof"]
    d = _brute(x)
    np.fill_diagonal(d, np.inf)
    nn = np.array([np.lexsort((np.arange(len(x)), d[i]))[:k] for i in range(len(x))])
    kd = np.array([d[i, nn[i][-1]] for i in range(len(x))])
    lrd = np.array([1 / (np.mean([max(kd[o], d[i, o]) for o in nn[i]]) + 1e-10) for i in range(len(x))])
    lof = np.array([lrd[nn[i]].mean() / lrd[i] for i in range(len(x))])
    assert np.allclose(got.sort_index().to_numpy(), lof, rtol=1e-9)


def test_exact_percentile(spark, rng):
    v = rng.normal(size=57)
    df = spark.createDataFrame([(float(a),) for a in v], "s double")
    for p in (0.0, 0.1, 0.5, 0.93, 1.0):
        assert abs(AN.exact_percentile(df, "s", p) - np.percentile(v, 100 * p)) < 1e-12


def test_isolation_forest_finds_planted_outlier(spark, rng):
    x = np.vstack([rng.normal(size=(200, 3)), [[9.0, 9.0, 9.0]]])
    s = AN.isolation_forest(points_df(spark, x), n_estimators=50, max_samples=64).toPandas()
    assert s.sort_values("score", ascending=False).iloc[0]["id"] == 200
