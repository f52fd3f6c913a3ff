"""The block engine: products choose the pairs, exact distances decide; its results are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import points_df
from scoutml.operators import anomaly as AN
from scoutml.operators import cluster as CL
from scoutml.operators import cluster_metrics as CM
from scoutml.operators import neighbors as NB
from scoutml.plans import q_models


def _brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def test_products_bound_the_distances(rng):
    x = 1e4 + rng.normal(size=(50, 8))
    for low, key, slack in NB.rough_distances(x[:20], x):
        assert (np.abs(key - _brute(x)[low : low + len(key)] ** 2) <= slack[:, None]).all()


def test_blocks_grow_with_the_rows_up_to_a_bound():
    """Rows are copied to sixteen blocks, not to one for every 2,048 rows."""
    assert NB.block_rows_of(100, 64) == NB.DEFAULT_BLOCK_ROWS
    assert -(-500_000 // NB.block_rows_of(500_000, 64)) == NB.BLOCKS
    assert NB.block_rows_of(10**9, 64) * 64 <= NB.BLOCK_VALUES


def test_refs_at_one_position_are_cut_before_they_are_measured(rng):
    x = np.vstack([np.zeros((5_000, 3)), rng.normal(size=(20, 3))])
    ids = rng.permutation(len(x))
    assert len(NB._lowest_refs(x, ids, 4)) == 5 + 20
    assert len(NB._lowest_refs(x, np.r_[np.zeros(5_000, np.int64), 1:21], 4)) == 4 + 20


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_over_many_blocks(spark, rng, monkeypatch, metric):
    monkeypatch.setattr(NB, "GRID_MAX_PAIR_SHARE", 0.0)
    monkeypatch.setattr(NB, "DEFAULT_BLOCK_ROWS", 16)
    monkeypatch.setattr(NB, "_CHUNK", 64)
    x = np.vstack([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(2, 5)), 15, axis=0)]) + 1e3
    p = points_df(spark, x)
    q, r = p.select(F.col("id").alias("lid"), F.col("x").alias("lx")), p.select(F.col("id").alias("rid"), F.col("x").alias("rx"))
    got = NB.knn(q, r, 4, metric=metric, exclude_self=True).toPandas()
    d = _brute(x) if metric == "euclidean" else np.abs(x[:, None] - x[None]).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert got[got.lid == i].sort_values("nn_rank").rid.tolist() == list(np.lexsort((np.arange(len(x)), d[i]))[:4])


@pytest.mark.parametrize("share", [1.0, 0.0])
def test_radius_sums_and_dbscan_write_no_pairs(spark, rng, monkeypatch, share):
    monkeypatch.setattr(NB, "GRID_MAX_PAIR_SHARE", share)
    monkeypatch.setattr(NB, "DEFAULT_BLOCK_ROWS", 16)
    monkeypatch.setattr(NB, "radius_pairs", lambda *a, **k: pytest.fail("the pairs themselves were asked for"))
    x = np.vstack([rng.normal(0, 0.3, (40, 4)), rng.normal(3, 0.3, (40, 4)), rng.normal(0, 4, (10, 4))])
    x[38:40] = x[0]
    d = _brute(x)
    deg = (d <= 0.7).sum(1)
    got = CL.neighbor_counts(points_df(spark, x), 0.7).toPandas().set_index("id")["n_neighbors"].sort_index()
    assert got.tolist() == deg.tolist()
    core = deg >= 4
    comp = np.arange(len(x))
    for _ in x:
        for i in np.flatnonzero(core):
            comp[i] = comp[(d[i] <= 0.7) & core].min()
    number = {c: n for n, c in enumerate(sorted(set(comp[core])))}
    exp = [number[comp[i]] if core[i] else min([number[comp[j]] for j in np.flatnonzero((d[i] <= 0.7) & core)], default=-1) for i in range(len(x))]
    assert CL.dbscan(points_df(spark, x), 0.7, 4).orderBy("id").toPandas().cluster.tolist() == exp


def test_silhouette_of_near_rows_far_from_the_origin(spark, rng, monkeypatch):
    monkeypatch.setattr(NB, "DEFAULT_BLOCK_ROWS", 16)
    x = 1e5 + np.vstack([rng.normal(0, 1e-4, (30, 3)), rng.normal(1, 1e-4, (30, 3))])
    x[5:9] = x[4]
    lab = np.arange(60) % 4
    d = _brute(x)
    s = []
    for i in range(60):
        a = d[i, lab == lab[i]].sum() / 14
        b = min(d[i, lab == k].mean() for k in range(4) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(CM.silhouette_exact(points_df(spark, x, lab)).first()[0] - np.mean(s)) < 1e-9


def test_lof_is_computed_once(spark, rng, monkeypatch):
    calls = []
    knn = NB.knn
    monkeypatch.setattr(NB, "knn", lambda *a, **k: calls.append(1) or knn(*a, **k))
    scores = AN.lof_scores(points_df(spark, rng.normal(size=(60, 12))), 5)
    plan = AN.contamination_cut(scores, "lof", 0.1)._jdf.queryExecution().toString()
    assert len(calls) == 1 and "InPandas" not in plan and "Join" not in plan


def test_votes_search_neighbours_once(spark, rng, monkeypatch):
    e = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(rng.normal(size=(60, 4)))],
                              "row_id long, x array<double>, label int")
    monkeypatch.setattr(q_models, "embedding_vectors", lambda *_: e)
    calls = []
    knn = NB.knn
    monkeypatch.setattr(NB, "knn", lambda *a, **k: calls.append(a[2]) or knn(*a, **k))
    assert q_models.vote_hard(spark, "").count() == q_models.vote_soft(spark, "").count() == 60
    assert calls == [7, 7]
