"""Voting ensembles (A1–A4) over a long predictions table ``(row_id, member, ...)``."""

from __future__ import annotations

import functools
import operator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoutml.operators.models import registry
from scoutml.operators.models.base import FEATURES, LABEL


def soft_vote(preds: DataFrame) -> DataFrame:
    """A1: argmax of the mean class probability; tie -> lowest class.
    ``preds``: (row_id, member, probability array)."""
    long = preds.select("row_id", F.posexplode("probability").alias("cls", "p"))
    avg = long.groupBy("row_id", "cls").agg(F.avg("p").alias("p"))
    w = Window.partitionBy("row_id").orderBy(F.col("p").desc(), F.col("cls"))
    return avg.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "row_id", F.col("cls").cast("double").alias("prediction"))


def soft_vote_of_shares(shares: DataFrame, members: int) -> DataFrame:
    """A1 with one row (row_id, cls, p) per member and class it gives a share; a class not given has none.
    The classes are those of the data."""
    avg = shares.groupBy("row_id", "cls").agg((F.sum("p") / members).alias("p"))
    w = Window.partitionBy("row_id").orderBy(F.col("p").desc(), F.col("cls"))
    return avg.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("row_id", F.col("cls").alias("prediction"))


def hard_vote(preds: DataFrame) -> DataFrame:
    """A2: majority class; tie -> lowest class.  ``preds``: (row_id, member, prediction)."""
    cnt = preds.groupBy("row_id", "prediction").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("row_id").orderBy(F.col("n").desc(), F.col("prediction"))
    return cnt.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("row_id", "prediction")


def average(preds: DataFrame) -> DataFrame:
    """A3: mean prediction per row."""
    return preds.groupBy("row_id").agg(F.avg("prediction").alias("prediction"))


def soft_vote_accuracy(rows: DataFrame, members: list[str], n_classes: int) -> float:
    """Share of rows whose label is the soft vote (A1) of their ``row_id``; ``members`` are columns of class probabilities.
    As ``soft_vote`` and a join with the labels give it (rows of one id vote together, a null id has no vote), but with
    one sum and one count a class and row instead of a row for each member and class."""
    sums, given, labels = [], [], []
    for c in range(n_classes):
        shares = [F.get(F.col(m), F.lit(c)) for m in members]
        sums.append(F.sum(functools.reduce(operator.add, [F.coalesce(p, F.lit(0.0)) for p in shares])))
        given.append(F.sum(functools.reduce(operator.add, [p.isNotNull().cast("int") for p in shares])))
        labels.append(F.sum((F.col(LABEL) == c).cast("long")))
    votes = rows.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(
        F.array(*[F.when(n > 0, s / n) for s, n in zip(sums, given)]).alias("p"),
        F.array(*labels).alias("of_class"), F.count(LABEL).alias("n"))
    hits = F.get("of_class", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    scored = votes.where(F.array_max("p").isNotNull()).agg(F.sum(hits).alias("hits"), F.sum("n").alias("n")).first()
    return scored["hits"] / scored["n"]


def ensemble_cv(prep, top: list[dict], n_folds: int = 5) -> dict:
    """A4: refit the top (<= 3) tuned models per fold and score the vote.
    Soft voting when every member has probabilities (D16), else hard."""
    from scoutml.operators import tuning

    members = [(m["key"], m["best_params"]) for m in top]
    if len(members) < 2:
        return {}
    cls = prep.task == "classification"
    soft = cls and all(getattr(registry.build(k, prep.task, p, max(prep.n_classes, 2)), "has_probability", False)
                       for k, p in members)

    def one(f: int) -> float:
        train, test = tuning.fold_split(prep, f)
        train = train.cache()  # scanned by every member
        try:
            return score(train, test)
        finally:
            train.unpersist()

    def score(train: DataFrame, test: DataFrame) -> float:
        if soft:
            rows, names = test.select("row_id", LABEL, FEATURES), []
            for i, (key, params) in enumerate(members):
                fitted = registry.build(key, prep.task, params, max(prep.n_classes, 2)).fit(train)
                keep = rows.columns
                names.append(f"_member{i}")
                rows = fitted.predict(rows).select(*keep, F.col("probability").alias(names[-1]))
            return float(soft_vote_accuracy(rows, names, max(prep.n_classes, 2)))
        parts = []
        for i, (key, params) in enumerate(members):
            learner = registry.build(key, prep.task, params, max(prep.n_classes, 2))
            pred = learner.fit(train).predict(test)
            parts.append(pred.select("row_id", F.lit(i).alias("member"), "prediction"))
        allp = parts[0]
        for p in parts[1:]:
            allp = allp.unionByName(p)
        voted = hard_vote(allp) if cls else average(allp)
        scored = voted.join(test.select("row_id", LABEL), "row_id")
        return float(tuning.fold_metric(scored, prep.task))

    with ThreadPoolExecutor(max_workers=n_folds) as pool:
        per_fold = list(pool.map(one, range(n_folds)))
    return {
        "models_used": [m["name"] for m in top],
        "cv_score": round(float(np.mean(per_fold)), 6),
        "metric": "Accuracy" if cls else "RMSE",
        "voting": ("soft" if soft else "hard") if cls else "averaging",
    }
