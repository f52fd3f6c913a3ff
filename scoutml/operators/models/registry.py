"""Model registry: search spaces (fixed values from the reference) and builders."""

from __future__ import annotations

import math
import random

from scoutml.operators.models.base import Learner
from scoutml.operators.models.closed_form import KNN, LDA, BayesianRidge, GaussianNB
from scoutml.operators.models.histogram import Boosting, ExtraTrees
from scoutml.operators.models.iterative import AdaBoost, Bagging
from scoutml.operators.models.sgd import KernelSVR, LinearSGD
from scoutml.operators.models.spark_ml import SVM, DecisionTree, LinearFamily, LogisticRegression, RandomForest

# ---------------------------------------------------------------------------
# Hyper-parameter search spaces of the reference, per model.
# ("int", lo, hi) | ("float", lo, hi) | ("log", lo, hi) | ("cat", [choices]) | ("fixed", v)
# ---------------------------------------------------------------------------
_MAXF = ("cat", ["sqrt", "log2", None])
SPACES = {
    "random forest": {"n_estimators": ("int", 50, 400), "max_depth": ("int", 3, 25), "min_samples_split": ("int", 2, 10),
                      "min_samples_leaf": ("int", 1, 8), "max_features": _MAXF},
    "xgboost": {"n_estimators": ("int", 50, 400), "learning_rate": ("float", 0.01, 0.3), "max_depth": ("int", 3, 12),
                "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0),
                "reg_alpha": ("log", 1e-5, 1.0), "reg_lambda": ("log", 1e-5, 1.0)},
    "lightgbm": {"n_estimators": ("int", 50, 400), "learning_rate": ("float", 0.01, 0.3), "max_depth": ("int", 3, 12),
                 "num_leaves": ("int", 20, 150), "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0)},
    "catboost": {"iterations": ("int", 50, 400), "learning_rate": ("float", 0.01, 0.3), "depth": ("int", 3, 10),
                 "l2_leaf_reg": ("float", 1.0, 10.0)},
    "gradient boosting": {"n_estimators": ("int", 50, 300), "learning_rate": ("float", 0.01, 0.3), "max_depth": ("int", 2, 8),
                          "subsample": ("float", 0.5, 1.0), "max_features": _MAXF},
    "adaboost": {"n_estimators": ("int", 50, 300), "learning_rate": ("float", 0.01, 2.0)},
    "extra trees": {"n_estimators": ("int", 50, 400), "max_depth": ("int", 3, 25), "min_samples_split": ("int", 2, 10),
                    "max_features": _MAXF},
    "bagging": {"n_estimators": ("int", 10, 100), "max_samples": ("float", 0.5, 1.0), "max_features": ("float", 0.5, 1.0)},
    "decision tree": {"max_depth": ("int", 2, 20), "min_samples_split": ("int", 2, 20), "min_samples_leaf": ("int", 1, 10),
                      "criterion": {"classification": ("cat", ["gini", "entropy"]),
                                    "regression": ("cat", ["squared_error", "friedman_mse"])}},
    "knn": {"n_neighbors": ("int", 1, 30), "weights": ("cat", ["uniform", "distance"]),
            "metric": ("cat", ["euclidean", "manhattan", "minkowski"])},
    "svm": {"C": ("log", 0.01, 100.0), "kernel": ("cat", ["rbf", "linear", "poly"]),
            "gamma": {"classification": ("cat", ["scale", "auto"]), "regression": ("fixed", "scale")},
            "epsilon": {"classification": None, "regression": ("float", 0.01, 1.0)}},
    "logistic regression": {"penalty": ("cat", ["l1", "l2", "elasticnet"]), "l1_ratio": ("float", 0.0, 1.0),
                            "C": ("log", 0.01, 100.0), "max_iter": ("fixed", 1000)},
    "linear regression": {},
    "ridge regression": {"alpha": ("log", 0.01, 100.0)},
    "lasso regression": {"alpha": ("log", 1e-4, 10.0), "max_iter": ("fixed", 5000)},
    "elastic net": {"alpha": ("log", 1e-4, 10.0), "l1_ratio": ("float", 0.0, 1.0), "max_iter": ("fixed", 5000)},
    "sgd": {"alpha": ("log", 1e-5, 1.0), "learning_rate": ("cat", ["optimal", "invscaling", "adaptive"]),
            "loss": {"classification": ("cat", ["hinge", "log_loss", "modified_huber"]),
                     "regression": ("cat", ["squared_error", "huber", "epsilon_insensitive"])},
            "max_iter": ("fixed", 1000)},
    "bayesian ridge": {"alpha_1": ("log", 1e-7, 1e-4), "alpha_2": ("log", 1e-7, 1e-4),
                       "lambda_1": ("log", 1e-7, 1e-4), "lambda_2": ("log", 1e-7, 1e-4)},
    "huber": {"epsilon": ("float", 1.01, 2.0), "alpha": ("log", 1e-5, 1.0), "max_iter": ("fixed", 500)},
    "naive bayes": {"var_smoothing": ("log", 1e-11, 1e-7)},
    "lda": {},
}
SPACES["k-nearest neighbors"] = SPACES["knn"]
# ---------------------------------------------------------------------------


def _draw(rng: random.Random, spec):
    kind = spec[0]
    if kind == "int":
        return rng.randint(spec[1], spec[2])
    if kind == "float":
        return rng.uniform(spec[1], spec[2])
    if kind == "log":
        return math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
    if kind == "cat":
        return rng.choice(spec[1])
    return spec[1]


def sample_params(key: str, task: str, n_trials: int, seed: int = 42) -> list[dict]:
    """C6 (re-aimed): ``n_trials`` independent seeded random draws from the space."""
    space = SPACES.get(key, {})
    rng = random.Random(f"{seed}:{key}:{task}")
    out = []
    for _ in range(max(1, n_trials)):
        p = {}
        for name, spec in space.items():
            if isinstance(spec, dict):
                spec = spec.get(task)
            if spec is None:
                continue
            p[name] = _draw(rng, spec)
        out.append(p)
    if not space:
        out = [{}]
    return out


def lower_params(key: str, task: str) -> dict:
    """A fixed point of the space: every range at its lower end, first choice of
    every category (the cheapest member of the family)."""
    out = {}
    for name, spec in SPACES.get(key, {}).items():
        if isinstance(spec, dict):
            spec = spec.get(task)
        if spec is None:
            continue
        out[name] = spec[1][0] if spec[0] == "cat" else spec[1]
    return out


def build(key: str, task: str, params: dict, n_classes: int = 2, seed: int = 42) -> Learner | None:
    """Learner for a registry key, or None when the model does not serve the task."""
    cls = task == "classification"
    if key == "random forest":
        return RandomForest(task, params, n_classes, seed)
    if key in ("xgboost", "lightgbm", "catboost", "gradient boosting"):
        return Boosting(task, params, n_classes, seed, flavour=key)
    if key == "adaboost":
        return AdaBoost(task, params, n_classes, seed)
    if key == "extra trees":
        return ExtraTrees(task, params, n_classes, seed)
    if key == "bagging":
        return Bagging(task, params, n_classes, seed)
    if key == "decision tree":
        return DecisionTree(task, params, n_classes, seed)
    if key in ("knn", "k-nearest neighbors"):
        return KNN(task, params, n_classes, seed)
    if key == "svm":
        if cls:
            return SVM(task, params, n_classes, seed)
        return KernelSVR(task, params, n_classes, seed)
    if key == "logistic regression":
        return LogisticRegression(task, params, n_classes, seed) if cls else None
    if key in ("linear regression", "ridge regression", "lasso regression", "elastic net", "huber"):
        return None if cls else LinearFamily(task, params, n_classes, seed, kind=key)
    if key == "sgd":
        return LinearSGD(task, params, n_classes, seed)
    if key == "bayesian ridge":
        return None if cls else BayesianRidge(task, params, n_classes, seed)
    if key == "naive bayes":
        return GaussianNB(task, params, n_classes, seed) if cls else None
    if key == "lda":
        return LDA(task, params, n_classes, seed) if cls else None
    return None
