"""The model protocol shared by Spark ML wrappers and hand-made learners.

``Learner.fit(train)`` takes a DataFrame with ``row_id``, a vector column
``features`` and a double ``label`` and returns a ``Fitted`` whose
``predict(df)`` adds ``prediction`` (double) and, when the model has class
probabilities, ``probability`` (array<double>, one entry per class code).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import to_array, to_vector

FEATURES = "features"
LABEL = "label"


@dataclass
class Fitted:
    model: object
    predict_fn: object
    has_probability: bool = False
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_fn(df)


class Learner:
    """A model family with fixed hyper-parameters."""

    name = "learner"
    has_probability = False

    def __init__(self, task: str, params: dict | None = None, n_classes: int = 2, seed: int = 42):
        self.task = task
        self.params = dict(params or {})
        self.n_classes = n_classes
        self.seed = seed

    def fit(self, train: DataFrame) -> Fitted:  # pragma: no cover - interface
        raise NotImplementedError


#: numbers that the tasks of a round send to the driver without a stage that adds them up
DIRECT = 100_000


def tasks_of(data: DataFrame) -> int:
    """Tasks of a scan of a checkpointed table."""
    return data.rdd.getNumPartitions()


def added(vectors: DataFrame, numbers: int, how: str = "sum") -> np.ndarray:
    """The sum (or least and largest: the maximum) of the rows' arrays ``v``, one a task, of ``numbers`` numbers in all.
    Where these are few the driver adds them in the order of the tasks, else Spark does."""
    if numbers <= DIRECT:
        found = [np.array(r.v) for r in vectors.collect()]  # at most DIRECT numbers
        return (np.sum if how == "sum" else np.max)(found, axis=0)
    add = Summarizer.sum if how == "sum" else Summarizer.max
    return np.array(vectors.agg(add(to_vector("v")).alias("v")).first()["v"].toArray())


def class_stats(df: DataFrame) -> list:
    """Per class: count, mean vector, sample variance vector (one aggregation)."""
    s = Summarizer.metrics("count", "mean", "variance")
    rows = df.groupBy(LABEL).agg(s.summary(F.col(FEATURES)).alias("s")).orderBy(LABEL).collect()
    return [(r[LABEL], r["s"]["count"], np.array(r["s"]["mean"].toArray()), np.array(r["s"]["variance"].toArray())) for r in rows]


def overall_stats(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    s = Summarizer.metrics("count", "mean", "variance")
    r = df.agg(s.summary(F.col(FEATURES)).alias("s")).first()["s"]
    return r["count"], np.array(r["mean"].toArray()), np.array(r["variance"].toArray())


def gram(df: DataFrame, d: int, with_label: bool = False) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None, float | None, float | None]:
    """n, sum x, sum x x^T (and sum x y, sum y, sum y^2) in one pass: d(d+1)/2 sums."""
    x = to_array(FEATURES)
    a = df.select(x.alias("x"), F.col(LABEL).alias("y"))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    aggs += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    if with_label:
        aggs += [F.sum(F.col("x")[i] * F.col("y")).alias(f"xy{i}") for i in range(d)]
        aggs += [F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    r = a.agg(*aggs).first()
    n = r["n"]
    s = np.array([r[f"s{i}"] or 0.0 for i in range(d)])
    g = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    if with_label:
        xy = np.array([r[f"xy{i}"] or 0.0 for i in range(d)])
        return n, s, g, xy, r["sy"], r["syy"]
    return n, s, g, None, None, None


def linear_scores(x: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """array of per-class scores w_k . x + b_k, as one expression per class."""
    from scoutml.functions.vectors import dot, lit_array

    return F.array(*[dot(x, lit_array(weights[k])) + F.lit(float(bias[k])) for k in range(len(bias))])


def argmax_code(scores: Column, classes: list[float]) -> Column:
    """Index of the first maximum (lowest class on ties) mapped to its class code."""
    idx = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.lit(float(c)) for c in classes]), idx.cast("int"))


def softmax(scores: Column) -> Column:
    mx = F.array_max(scores)
    ex = F.transform(scores, lambda s: F.exp(s - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.transform(ex, lambda v: v / tot)


def full_probability(prob: Column, classes: list[float], n_classes: int) -> Column:
    """Spread per-seen-class probabilities over all class codes 0..K-1."""
    pos = {int(c): i for i, c in enumerate(classes)}
    return F.array(*[prob[pos[k]] if k in pos else F.lit(0.0) for k in range(n_classes)])
