"""Boosting and extra trees grown from histograms: exact first trees, penalties, classes, thresholds, votes."""

import numpy as np
import pytest

from scoutml.operators.models import histogram, registry
from scoutml.operators.models.histogram import Boosting, ExtraTrees, Tree
from tests.test_sgd import frame


def blobs(rng, n=150):
    centres = np.array([[0, 0], [4, 0], [0, 4]])
    y = np.repeat([0, 1, 2], n)
    return centres[y] + rng.normal(size=(3 * n, 2)) * 0.8, y


def scored(fitted, df):
    return fitted.predict(df).toPandas().sort_values("row_id")


def test_one_split_is_the_best_of_all(spark, rng):
    """One round of depth 1 on few values: split and leaves equal an exhaustive search, with penalties."""
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = 3.0 * (x[:, 1] > 6) + rng.normal(size=200)
    df = frame(spark, x, y)
    for alpha, lam in ((0.0, 0.0), (5.0, 20.0)):
        fitted = Boosting("regression", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1, "reg_alpha": alpha, "reg_lambda": lam}).fit(df)
        g = y.mean() - y
        score = lambda m: max(abs(g[m].sum()) - alpha, 0) ** 2 / (m.sum() + lam)
        best = max(((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1]), key=lambda t: t[0])
        tree = fitted.model[0][0]
        assert (tree.feature[0], tree.cut[0]) == best[1:]
        left = x[:, best[1]] <= best[2]
        for node, mask in ((tree.left[0], left), (tree.left[0] + 1, ~left)):
            want = -np.sign(g[mask].sum()) * max(abs(g[mask].sum()) - alpha, 0) / (mask.sum() + lam)
            assert np.isclose(tree.value[node][0], want)
        assert np.allclose(scored(fitted, df)["prediction"], y.mean() + tree.values_of(x)[:, 0])


@pytest.mark.parametrize("flavour", ["xgboost", "lightgbm", "catboost", "gradient boosting"])
def test_three_classes_with_probabilities(spark, rng, flavour):
    x, y = blobs(rng)
    df = frame(spark, x, y)
    params = {"n_estimators": 8, "iterations": 8, "learning_rate": 0.3, "max_depth": 2, "depth": 2, "subsample": 0.8, "num_leaves": 3}
    learner = registry.build(flavour, "classification", params, n_classes=3)
    assert learner.has_probability  # known before it is fitted: votes ask for it
    out = scored(learner.fit(df), df)
    p = np.stack(out["probability"])
    assert p.shape == (450, 3) and np.allclose(p.sum(axis=1), 1)
    assert np.mean(out["prediction"] == y) > 0.93 and (p.argmax(axis=1) == out["prediction"]).all()


def test_levels_in_several_jobs_and_stored_margins_change_nothing(spark, rng, monkeypatch):
    x, y = blobs(rng, 60)
    df = frame(spark, x, (y > 0).astype(float))
    fit = lambda: scored(Boosting("classification", {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.5}).fit(df), df)
    whole = np.stack(fit()["probability"])
    monkeypatch.setattr(histogram, "LIMIT", 300)
    monkeypatch.setattr(histogram, "KEEP", 2)
    assert np.allclose(np.stack(fit()["probability"]), whole)


def test_stronger_penalties_shrink(spark, rng):
    x = rng.normal(size=(300, 2))
    df = frame(spark, x, x[:, 0] * 5)
    spread = [scored(Boosting("regression", {"n_estimators": 3, "reg_alpha": a, "l2_leaf_reg": lam}).fit(df), df)["prediction"].std()
              for a, lam in ((0.0, 1.0), (0.0, 500.0), (200.0, 1.0))]
    assert spread[1] < 0.8 * spread[0] and spread[2] < 0.8 * spread[0]


def test_random_thresholds(spark, rng):
    x, y = blobs(rng)
    df = frame(spark, x, y)
    fitted = ExtraTrees("classification", {"n_estimators": 12, "max_depth": 4, "max_features": "sqrt"}, n_classes=3).fit(df)
    cuts = set()
    for tree in fitted.model:
        inside = {0: np.ones(len(x), bool)}
        for node, left in enumerate(tree.left):
            if left < 0:
                continue
            f, at = tree.feature[node], tree.cut[node]
            mine = x[inside[node], f]
            assert mine.min() <= at < mine.max()  # between the node's bounds, both sides hold rows
            inside[left], inside[left + 1] = inside[node] & (x[:, f] <= at), inside[node] & (x[:, f] > at)
            cuts.add(at)
        for node, left in enumerate(tree.left):
            if left < 0:
                assert np.allclose(tree.value[node], np.bincount(y[inside[node]], minlength=3) / inside[node].sum())
    assert not cuts & set(x.ravel())  # drawn, not taken from the values
    out = scored(fitted, df)
    assert np.mean(out["prediction"] == y) > 0.93
    reg = ExtraTrees("regression", {"n_estimators": 10, "max_depth": 5}).fit(frame(spark, x, x[:, 0] * 2 + x[:, 1]))
    got = scored(reg, df)["prediction"]
    assert np.corrcoef(got, x[:, 0] * 2 + x[:, 1])[0, 1] > 0.95


def test_constant_and_single_class_input(spark):
    x = np.ones((20, 2))
    for make in (Boosting, ExtraTrees):
        assert np.allclose(scored(make("regression", {"n_estimators": 2}).fit(frame(spark, x, np.full(20, 7.0))), frame(spark, x, np.zeros(20)))["prediction"], 7.0)
        assert (scored(make("classification", {"n_estimators": 2}).fit(frame(spark, x, np.zeros(20))), frame(spark, x, np.zeros(20)))["prediction"] == 0).all()


def test_rows_find_their_leaves():
    tree = Tree(1)
    left = tree.split(0, 1, 2.0)
    deeper = tree.split(left + 1, 0, 5.0)
    assert tree.nodes_of(np.array([[0, 2.0], [5.0, 3.0], [6.0, 3.0]])).tolist() == [left, deeper, deeper + 1]


def test_rows_between_the_same_cuts_are_one_cell(spark, rng):
    """A block holds a point a cell, on the rows' side of every cut, and a cell's sums are those of its rows."""
    x, y = rng.normal(size=(600, 2)), rng.integers(0, 3, 600).astype(float)
    cuts = [np.array([-0.5, 0.5]), np.array([0.0])]
    data = histogram._gathered(histogram._training(frame(spark, x, y)), cuts, np.zeros(3))
    cells = sum(len(points) for b in data.toArrow().to_batches() for points, *_ in histogram._blocks(b))
    assert cells <= (3 * 2 + 2) * histogram.tasks_of(data) < 600
    x[0, 0] = np.nan
    points, of = histogram._cells(x, cuts)
    assert all(((points[of, j] > c) == (x[:, j] > c)).all() for j in range(2) for c in cuts[j])
    assert (histogram._codes(points, cuts)[of] == histogram._codes(x, cuts)).all()
    margin = rng.normal(size=(len(points), 3))
    g, h = Boosting("classification", {}, 3)._gradients(margin, of, y)
    p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    for c in range(len(points)):
        own = of == c
        assert np.allclose(g[c], (p[c] - (y[own, None] == np.arange(3))).sum(axis=0))
        assert np.allclose(h[c], own.sum() * p[c] * (1 - p[c]))


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_sides_of_all_nodes_at_once_are_those_of_each(rng, task):
    y, group = rng.integers(0, 3, 200).astype(float), rng.integers(0, 4, 200)
    trees = ExtraTrees(task, {}, 3)
    want = np.stack([trees._stats(y[group == g], np.ones((1, (group == g).sum()), bool), 3)[0] for g in range(4)])
    assert np.allclose(trees._grouped(group, y, 4, 3), want)
