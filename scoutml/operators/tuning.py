"""Leak-free cross-validated tuning.

The prepared table (row id, base feature vector, label, fold) is checkpointed
once.  Interaction expansion is a row-wise transform, so it is applied once;
the F-score selection is fitted on the training folds only.  Trials are seeded
random draws from the model's space; folds of a trial run as concurrent Spark
jobs from driver threads.
"""

from __future__ import annotations

import json
import math
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler, VectorSlicer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutml.functions.vectors import to_array, to_vector
from scoutml.operators import folds as FO
from scoutml.operators import prepare as PR
from scoutml.operators.models import registry
from scoutml.operators.models.base import FEATURES, LABEL
from scoutml.operators.profile import detect_task
from scoutml.session import cut


#: least rows of a partition that is made for the learners
SPREAD = 20_000


@dataclass
class Prepared:
    df: DataFrame          # row_id, base (vector), label, fold
    task: str
    n_classes: int
    feature_names: list
    shape: tuple
    k_select: int
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)
    scores: dict | None = None   # fold -> F-scores of the rows outside it


def prepare_supervised(df: DataFrame, target: str = "target", key_col: str | None = None,
                       n_folds: int = 5, k_frac: float = 0.3) -> Prepared:
    """Encode, impute, assemble, add folds (D9: encoder and medians see all rows)."""
    task = detect_task(df, target)
    shape = (df.count(), len(df.columns))
    data = df.where(F.col(target).isNotNull())
    if key_col is None:
        key_col = "row_id"
        data = cut(data.withColumn(key_col, F.monotonically_increasing_id()))
    feats = [c for c in data.columns if c not in (target, key_col)]
    conv = []
    for f in data.schema.fields:
        if f.name not in feats:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            conv.append(F.unix_timestamp(PR.q(f.name).cast("timestamp")).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            conv.append(PR.q(f.name).cast("int").alias(f.name))
        else:
            conv.append(PR.q(f.name))
    data = data.select(F.col(key_col).alias("row_id"), PR.q(target).alias("_y"), *conv)
    strings = PR.string_columns(data, exclude=("row_id", "_y"))
    data = PR.label_encode(data, strings)
    data = PR.impute_median(data, feats)
    if task == "classification":
        codes = PR.label_codes(data.select(F.col("_y").cast("string").alias("_y")), ["_y"])
        data = PR.label_encode(data.withColumn("_y", F.col("_y").cast("string")), ["_y"], codes)
        n_classes = codes.count()
    else:
        n_classes = 0
    asm = VectorAssembler(inputCols=feats, outputCol="base", handleInvalid="keep")
    data = asm.transform(data.select("row_id", F.col("_y").cast("double").alias(LABEL),
                                     *[F.coalesce(PR.q(c).cast("double"), F.lit(0.0)).alias(c) for c in feats]))
    data = data.select("row_id", "base", LABEL)
    if task == "classification":
        data = FO.stratified_kfold(data, "row_id", LABEL, n_folds)
    else:
        data = FO.kfold(data, "row_id", n_folds)
    d = len(feats)
    pe = PolynomialExpansion(degree=2, inputCol="base", outputCol="_poly")
    sl = VectorSlicer(inputCol="_poly", outputCol="inter", indices=PR.expansion_slice(d))
    data = sl.transform(pe.transform(data)).drop("_poly")
    data = _spread(cut(data), shape[0])
    k = PR.k_for_width(d, k_frac)
    return Prepared(data, task, int(n_classes), feats, shape, k)


def _spread(data: DataFrame, rows: int) -> DataFrame:
    """The learners read the table many times: a long one in few partitions is dealt to more, up to the cluster's cores."""
    spark = data.sparkSession
    parts = min(rows // SPREAD, spark.sparkContext.defaultParallelism)
    return cut(data.repartition(parts)) if parts > 1 and parts > data.rdd.getNumPartitions() else data


def f_scores(train: DataFrame, task: str, col: str = "inter") -> np.ndarray:
    """ANOVA F (classification) or F-regression per feature of a vector column."""
    if task == "classification":
        s = Summarizer.metrics("count", "mean", "variance")
        rows = train.groupBy(LABEL).agg(s.summary(F.col(col)).alias("s")).collect()
        n_k = np.array([r["s"]["count"] for r in rows], dtype=float)
        m_k = np.array([r["s"]["mean"].toArray() for r in rows])
        v_k = np.array([r["s"]["variance"].toArray() for r in rows])
        n, k = n_k.sum(), len(rows)
        m = (n_k[:, None] * m_k).sum(0) / n
        ssb = (n_k[:, None] * (m_k - m) ** 2).sum(0)
        ssw = ((n_k[:, None] - 1) * np.nan_to_num(v_k)).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = (ssb / max(k - 1, 1)) / (ssw / max(n - k, 1))
        f[(ssw == 0) & (ssb > 0)] = np.inf
        return f
    arr = to_array(col)
    d = train.select(F.size(arr)).first()[0]
    a = train.select(arr.alias("x"), F.col(LABEL).alias("y"))
    r = a.agg(*[F.corr(F.col("x")[j], "y").alias(f"r{j}") for j in range(d)], F.count(F.lit(1)).alias("n")).first()
    out = []
    for j in range(d):
        rj = r[f"r{j}"]
        if rj is not None and abs(rj) >= 1:  # a perfect feature comes first
            out.append(np.inf)
            continue
        out.append(np.nan if rj is None or math.isnan(rj) else rj * rj / (1 - rj * rj) * (r["n"] - 2))
    return np.array(out)


def top_k(scores: np.ndarray, k: int) -> list[int]:
    """Highest F first, NaN last, lower index on ties."""
    key = np.where(np.isnan(scores), -np.inf, scores)
    order = sorted(range(len(key)), key=lambda j: (-key[j], j))
    return sorted(order[:k])


def _class_scores(parts: list[tuple[float, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """ANOVA F from moments (class, rows, means, sample variances); a class may come in several parts."""
    classes = sorted({p[0] for p in parts}, key=str)
    n_k, m_k, ssw = [], [], 0.0
    for c in classes:
        own = [p for p in parts if p[0] == c]
        n = np.array([p[1] for p in own], dtype=float)
        means = np.array([p[2] for p in own])
        mean = (n[:, None] * means).sum(0) / n.sum()
        ssw = ssw + sum((k - 1) * np.nan_to_num(p[3]) for k, p in zip(n, own)) + (n[:, None] * (means - mean) ** 2).sum(0)
        n_k.append(n.sum())
        m_k.append(mean)
    n_k, m_k = np.array(n_k), np.array(m_k)
    n, k = n_k.sum(), len(classes)
    total = (n_k[:, None] * m_k).sum(0) / n
    ssb = (n_k[:, None] * (m_k - total) ** 2).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (ssb / max(k - 1, 1)) / (ssw / max(n - k, 1))
    f[(ssw == 0) & (ssb > 0)] = np.inf
    return f


def _correlation_scores(n: float, s: np.ndarray, d: int) -> np.ndarray:
    """F of a linear fit on each of d features from sums of (x, y, x x, x y, y y), standardised over all rows."""
    sx, sy, sxx, sxy, syy = s[:d], s[d], s[d + 1 : 2 * d + 1], s[2 * d + 1 : 3 * d + 1], s[3 * d + 1]
    vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    flat = (vx <= 1e-12 * n) | (vy <= 1e-12 * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(flat, np.nan, cov * cov / (vx * vy))
        f = r2 / (1 - r2) * (n - 2)
    f[r2 >= 1 - 1e-14] = np.inf
    return f


def fold_scores(prep: Prepared, col: str = "inter") -> dict[int, np.ndarray]:
    """F-scores of the training rows of every fold, from moments per fold (and class) of one scan: a fold's training
    rows are all parts but its own."""
    if prep.task == "classification":
        s = Summarizer.metrics("count", "mean", "variance")
        rows = prep.df.groupBy("fold", LABEL).agg(s.summary(F.col(col)).alias("s")).collect()  # folds x classes
        parts = [(r["fold"], (r[LABEL], r["s"]["count"], r["s"]["mean"].toArray(), r["s"]["variance"].toArray())) for r in rows]
        return {f: _class_scores([p for g, p in parts if g != f]) for f in {g for g, _ in parts}}
    both = F.concat(to_array(col), F.array(LABEL))
    whole = prep.df.agg(Summarizer.metrics("mean", "std").summary(to_vector(both)).alias("s")).first()["s"]
    mean, std = whole["mean"].toArray(), whole["std"].toArray()
    std = np.where(std > 0, std, 1.0)
    d = len(mean) - 1

    def sums(batches):
        for b in batches:
            for fold in np.unique(b["fold"]):
                z = (np.stack([np.asarray(v) for v in b.loc[b["fold"] == fold, "z"]]) - mean) / std
                x, y = z[:, :d], z[:, d]
                yield pd.DataFrame({"fold": [int(fold)], "s": [np.concatenate([[len(z)], x.sum(0), [y.sum()], (x * x).sum(0), y @ x, [y @ y]]).tolist()]})

    per = prep.df.select("fold", both.alias("z")).mapInPandas(sums, "fold int, s array<double>")
    got = {r["fold"]: np.array(r["s"].toArray()) for r in per.groupBy("fold").agg(Summarizer.sum(to_vector("s")).alias("s")).collect()}
    total = sum(got.values())
    return {f: _correlation_scores((total - own)[0], (total - own)[1:], d) for f, own in got.items()}


def fold_split(prep: Prepared, fold: int) -> tuple[DataFrame, DataFrame]:
    with prep.lock:
        if prep.scores is None:
            prep.scores = fold_scores(prep)
    train = prep.df.where(F.col("fold") != fold)
    test = prep.df.where(F.col("fold") == fold)
    scores = prep.scores.get(fold)
    idx = top_k(f_scores(train, prep.task) if scores is None else scores, prep.k_select)  # a fold without rows has all others
    sl = VectorSlicer(inputCol="inter", outputCol=FEATURES, indices=idx)
    return sl.transform(train), sl.transform(test)


def fold_metric(pred: DataFrame, task: str) -> float:
    if task == "classification":
        return pred.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
    return pred.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(LABEL), 2)))).first()[0]


def cross_validate(prep: Prepared, key: str, params: dict, n_folds: int = 5, parallelism: int = 5) -> list[float]:
    def one(f: int) -> float:
        train, test = fold_split(prep, f)
        # iterative solvers rescan the training fold every round: keep it in memory
        # while this fold is fitted (lineage stays, so a lost executor recomputes it)
        train = train.cache()
        try:
            learner = registry.build(key, prep.task, params, max(prep.n_classes, 2))
            fitted = learner.fit(train)
            return float(fold_metric(fitted.predict(test), prep.task))
        finally:
            train.unpersist()

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(one, range(n_folds)))


def tune(prep: Prepared, key: str, n_trials: int, seed: int = 42, n_folds: int = 5) -> tuple[dict, list[dict]]:
    """Random search; returns (model record, trial rows).  A failed trial has a
    null score and its error (C7); null never wins (D1: RMSE is minimised)."""
    trials = []
    for t, params in enumerate(registry.sample_params(key, prep.task, n_trials, seed)):
        try:
            per_fold = cross_validate(prep, key, params, n_folds)
            score, err = float(np.mean(per_fold)), None
        except Exception as exc:  # the reference keeps going after a failed trial
            per_fold, score, err = [], None, f"{type(exc).__name__}: {str(exc)[:200]}"
        trials.append({"model": key, "trial": t, "params": json.dumps(params, default=str), "fold_scores": per_fold,
                       "score": score, "error": err})
    valid = [x for x in trials if x["score"] is not None]
    if not valid:
        return {"score": None, "best_params": {}, "n_trials": n_trials, "error": trials[0]["error"] if trials else "no trials"}, trials
    better = max if prep.task == "classification" else min
    best = better(valid, key=lambda x: x["score"])
    return {"score": round(best["score"], 6), "best_params": json.loads(best["params"]), "n_trials": n_trials, "error": None}, trials
