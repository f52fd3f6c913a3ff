"""Prompt routing and model/algorithm name resolution.

Everything is a per-row expression over a prompts table: the fixed word lists
below compile to literal patterns, so routing needs no join and no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.functions.scalar import normalize, split_trimmed

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists for the same routing result)
# ---------------------------------------------------------------------------
UNSUPERVISED_KEYWORDS = [
    "cluster", "clustering", "group", "segment", "unsupervised", "pattern", "anomaly",
    "outlier", "find groups", "pca", "dimensionality", "explore", "discover", "no label",
]

MODEL_NAMES = [
    "Random Forest", "XGBoost", "LightGBM", "CatBoost", "Gradient Boosting", "AdaBoost",
    "Extra Trees", "Bagging", "Decision Tree", "KNN", "SVM", "Logistic Regression",
    "Linear Regression", "Ridge Regression", "Lasso Regression", "Elastic Net", "SGD",
    "Bayesian Ridge", "Huber", "Naive Bayes", "LDA",
]

MODEL_ALIASES = [
    ("l1 regression", "Lasso Regression"), ("lasso", "Lasso Regression"),
    ("l2 regression", "Ridge Regression"), ("ridge", "Ridge Regression"),
    ("elastic net", "Elastic Net"), ("elasticnet", "Elastic Net"),
    ("gbm", "Gradient Boosting"), ("gradient boosting", "Gradient Boosting"),
    ("ada", "AdaBoost"), ("adaboost", "AdaBoost"),
    ("et", "Extra Trees"), ("extra trees", "Extra Trees"),
    ("knn", "KNN"), ("k nearest neighbors", "KNN"),
    ("lgbm", "LightGBM"), ("lightgbm", "LightGBM"),
    ("cat", "CatBoost"), ("catboost", "CatBoost"),
    ("nb", "Naive Bayes"), ("naive bayes", "Naive Bayes"),
    ("dt", "Decision Tree"), ("decision tree", "Decision Tree"),
    ("linear discriminant", "LDA"), ("lda", "LDA"),
    ("bayesian", "Bayesian Ridge"), ("bayesian ridge", "Bayesian Ridge"),
    ("huber regression", "Huber"),
    ("stochastic gradient", "SGD"), ("sgd", "SGD"),
]

CLASSIFICATION_MODELS = [
    "Random Forest", "XGBoost", "LightGBM", "CatBoost", "Gradient Boosting", "AdaBoost",
    "Extra Trees", "Decision Tree", "KNN", "SVM", "Logistic Regression", "Naive Bayes", "LDA", "SGD",
    "Bagging",  # serves both tasks (D17); last, so that the first five stay
]
REGRESSION_MODELS = [
    "Random Forest", "XGBoost", "LightGBM", "CatBoost", "Gradient Boosting", "AdaBoost",
    "Extra Trees", "Decision Tree", "KNN", "SVM", "Linear Regression", "Ridge Regression",
    "Lasso Regression", "Elastic Net", "SGD", "Bayesian Ridge", "Huber",
    "Bagging",
]
DEFAULT_MODELS = ["Random Forest", "XGBoost", "LightGBM", "Gradient Boosting", "SVM"]
ALL_MODELS_WORDS = ["all", "best"]

ALGO_NAMES = ["K-Means", "DBSCAN", "Agglomerative", "Gaussian Mixture", "Isolation Forest", "Local Outlier Factor"]
ALGO_ALIASES = [
    ("kmeans", "K-Means"), ("k means", "K-Means"),
    ("density", "DBSCAN"), ("dbscan", "DBSCAN"),
    ("hierarchical", "Agglomerative"), ("agglomerative", "Agglomerative"),
    ("gmm", "Gaussian Mixture"), ("gaussian", "Gaussian Mixture"),
    ("lof", "Local Outlier Factor"), ("local outlier", "Local Outlier Factor"),
]
CLUSTER_WORDS = ["cluster", "group", "segment"]
CLUSTER_ALGOS = ["K-Means", "DBSCAN", "Agglomerative", "Gaussian Mixture"]
ANOMALY_WORDS = ["anomaly", "outlier"]
ANOMALY_ALGOS = ["Isolation Forest", "Local Outlier Factor"]
ALL_ALGOS_WORDS = ["all", "try everything"]
DEFAULT_ALGOS = ["K-Means", "DBSCAN", "Agglomerative"]

# registry keys in registry order, with the task they serve
MODEL_REGISTRY = [
    ("random forest", "both"), ("xgboost", "both"), ("lightgbm", "both"), ("catboost", "both"),
    ("gradient boosting", "both"), ("adaboost", "both"), ("extra trees", "both"), ("bagging", "both"),
    ("decision tree", "both"), ("knn", "both"), ("k-nearest neighbors", "both"), ("svm", "both"),
    ("logistic regression", "classification"), ("linear regression", "regression"),
    ("ridge regression", "regression"), ("lasso regression", "regression"), ("elastic net", "regression"),
    ("sgd", "both"), ("bayesian ridge", "regression"), ("huber", "regression"),
    ("naive bayes", "classification"), ("lda", "classification"),
]
CLASSIFICATION_ONLY = ["logistic regression", "naive bayes", "lda", "linear discriminant"]
REGRESSION_ONLY = ["linear regression", "ridge regression", "lasso regression", "elastic net", "bayesian ridge", "huber"]

ALGO_REGISTRY = [
    ("k-means", "kmeans"), ("kmeans", "kmeans"), ("dbscan", "dbscan"),
    ("agglomerative", "agglomerative"), ("hierarchical", "agglomerative"),
    ("gaussian mixture", "gmm"), ("gmm", "gmm"),
    ("isolation forest", "isolation_forest"), ("anomaly detection", "isolation_forest"),
    ("local outlier factor", "lof"), ("lof", "lof"),
]
# ---------------------------------------------------------------------------


WORD_EDGE = "[^\\p{L}\\p{N}_]"


def word_pattern(phrase: str) -> str:
    """Whole-word pattern for a literal phrase.

    Word characters are Unicode letters, digits and ``_``; ``\\b`` is avoided
    because engines disagree on whether accented letters are word characters.
    """
    escaped = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in phrase)
    return f"(^|{WORD_EDGE}){escaped}($|{WORD_EDGE})"


def _any_word(text: Column, words: list[str]) -> Column:
    return F.lit(False) if not words else text.rlike("|".join(f"({word_pattern(w)})" for w in words))


def needs_unsupervised(prompt: Column, has_target: Column | bool) -> Column:
    """Any keyword as a substring of the lower-cased prompt, or no target column."""
    text = F.lower(prompt)
    hit = F.exists(F.array(*[F.lit(k) for k in UNSUPERVISED_KEYWORDS]), lambda k: text.contains(k))
    tgt = F.lit(has_target) if isinstance(has_target, bool) else has_target
    return hit | ~tgt


def _ordered_names(text: Column, aliases: list[tuple[str, str]], names: list[str]) -> Column:
    """Names whose alias (or own lower-cased name) occurs as a whole word, in list order."""
    canon = [(n.lower(), n) for n in names]
    hits = []
    for n in names:
        pats = [a for a, m in aliases + canon if m == n]
        hits.append(F.when(_any_word(text, pats), F.lit(n)))
    return F.array_compact(F.array(*hits))


def _lits(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def prompt_models(prompt: Column, task: Column) -> Column:
    """The rule form of the model choice; returns ``array<string>``.

    Explicit names (after aliasing) win and are filtered to the task; else
    "all"/"best" picks the first five of the task list; else the default five.
    """
    text = F.lower(prompt)
    named = _ordered_names(text, MODEL_ALIASES, MODEL_NAMES)
    allowed = F.when(task == "regression", _lits(REGRESSION_MODELS)).otherwise(_lits(CLASSIFICATION_MODELS))
    named_ok = F.filter(named, lambda m: F.array_contains(allowed, m))
    top5 = F.slice(allowed, 1, 5)
    return (
        F.when(F.size(named_ok) > 0, named_ok)
        .when(_any_word(text, ALL_MODELS_WORDS), top5)
        .otherwise(_lits(DEFAULT_MODELS))
    )


def prompt_algos(prompt: Column) -> Column:
    """Explicit algorithm names, else "all", else group rules, else default."""
    text = F.lower(prompt)
    named = _ordered_names(text, ALGO_ALIASES, ALGO_NAMES)
    grouped = F.array_compact(
        F.array(
            *[F.when(_any_word(text, CLUSTER_WORDS), F.lit(a)) for a in CLUSTER_ALGOS],
            *[F.when(_any_word(text, ANOMALY_WORDS), F.lit(a)) for a in ANOMALY_ALGOS],
        )
    )
    return (
        F.when(F.size(named) > 0, named)
        .when(_any_word(text, ALL_ALGOS_WORDS), _lits(ALGO_NAMES))
        .when(F.size(grouped) > 0, grouped)
        .otherwise(_lits(DEFAULT_ALGOS))
    )


def _resolve(name: Column, keys: list[str]) -> Column:
    """Exact key, else the first key (registry order) with ``key in n or n in key``."""
    n = normalize(name)
    arr = _lits(keys)
    exact = F.try_element_at(F.filter(arr, lambda k: k == n), F.lit(1))
    partial = F.try_element_at(F.filter(arr, lambda k: (F.instr(n, k) > 0) | (F.instr(k, n) > 0)), F.lit(1))
    return F.when(n == "", F.lit(None).cast("string")).otherwise(F.coalesce(exact, partial))


def resolve_model(name: Column) -> Column:
    """P9 for models; unmatched names resolve to themselves (D14: empty -> null)."""
    n = normalize(name)
    return F.when(n == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(_resolve(name, [k for k, _ in MODEL_REGISTRY]), n)
    )


def resolve_algo(name: Column) -> Column:
    """P9 for algorithms: the runner key, or null when nothing matches."""
    key = _resolve(name, [k for k, _ in ALGO_REGISTRY])
    runners = F.create_map(*[x for k, r in ALGO_REGISTRY for x in (F.lit(k), F.lit(r))])
    return F.try_element_at(runners, key)


def compatible(resolved: Column, task: Column) -> Column:
    """P10: the substring test the trainer applies before tuning a model."""
    cls_hit = F.exists(_lits(CLASSIFICATION_ONLY), lambda x: resolved.contains(x))
    reg_hit = F.exists(_lits(REGRESSION_ONLY), lambda x: resolved.contains(x))
    return ~(((task == "regression") & cls_hit) | ((task == "classification") & reg_hit))


def explode_list(df: DataFrame, col: str, sep: str = ",", pos: str = "pos", item: str = "item") -> DataFrame:
    """Split, strip, drop empty, one row per item with its 0-based position."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(split_trimmed(col, sep)).alias(pos, item))
