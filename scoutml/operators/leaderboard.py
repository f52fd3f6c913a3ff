"""Leaderboards and result tables (A5–A13, A16) over small per-model tables.

A leaderboard has one row per requested model, so its windows are tiny.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutml.functions.scalar import drop_keys

# Rank labels of the leaderboard and the anomaly-algorithm names
MEDALS = ["🥇", "🥈", "🥉"]
ANOMALY_NAMES = ["isolation forest", "local outlier factor", "lof", "anomaly detection"]
HIDDEN_PARAMS = ["anomalies_found", "outliers_found"]

RECORD_SCHEMA = "name string, score double, best_params map<string,string>, n_trials int, error string, submit_order int"


def _str(v) -> str | None:
    if v is None:
        return "None"
    return json.dumps(v) if isinstance(v, (dict, list)) else str(v)


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    rows = [
        (r["name"], r.get("score"), {k: _str(v) for k, v in (r.get("best_params") or {}).items()},
         r.get("n_trials"), r.get("error"), i)
        for i, r in enumerate(records)
    ]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def order(records: DataFrame, higher_is_better: bool, score: str = "score") -> DataFrame:
    """A5: valid first by score (desc for accuracy/silhouette, asc for RMSE), failed
    last, submit order breaks ties; adds 1-based ``position``."""
    s = F.col(score).desc_nulls_last() if higher_is_better else F.col(score).asc_nulls_last()
    w = Window.orderBy(s, F.col("submit_order"))
    return records.withColumn("position", F.row_number().over(w))


def best(records: DataFrame, higher_is_better: bool, score: str = "score") -> DataFrame:
    """The first valid row; ("", null) when none is valid."""
    lb = order(records.where(F.col(score).isNotNull()), higher_is_better, score).where(F.col("position") == 1)
    picked = lb.select(F.col("name").alias("best_model"), F.col(score).alias("best_score"), F.lit(0).alias("_p"))
    default = records.sparkSession.createDataFrame([("", None, 1)], "best_model string, best_score double, _p int")
    return picked.unionByName(default).orderBy("_p").limit(1).drop("_p")


def top_k(records: DataFrame, higher_is_better: bool, k: int = 3, score: str = "score") -> DataFrame:
    """The first k valid rows."""
    return order(records.where(F.col(score).isNotNull()), higher_is_better, score).where(F.col("position") <= k)


def rank_label(position: Column) -> Column:
    """Medals for the first three, then ``#n``."""
    medal = F.array(*[F.lit(m) for m in MEDALS])
    return F.when(position <= 3, F.element_at(medal, position.cast("int"))).otherwise(F.format_string("#%d", position))


def comparison(records: DataFrame, higher_is_better: bool, digits: int = 4) -> DataFrame:
    """A8 + A16: valid rows in leaderboard order with rank label and rounded score."""
    lb = order(records.where(F.col("score").isNotNull()), higher_is_better)
    return lb.select("position", rank_label(F.col("position")).alias("rank_label"), "name",
                     F.round("score", digits).alias("score"), "n_trials")


def _type_of(v: Column) -> Column:
    return (
        F.when(v.isNull() | (v == "None"), F.lit("NoneType"))
        .when(v.rlike("^-?[0-9]+$"), F.lit("int"))
        .when(v.rlike("^-?[0-9]*\\.[0-9]+([eE][-+]?[0-9]+)?$|^-?[0-9]+([eE][-+]?[0-9]+)$"), F.lit("float"))
        .when(v.isin("True", "False"), F.lit("bool"))
        .otherwise(F.lit("str"))
    )


def param_table(records: DataFrame) -> DataFrame:
    """A11 + F9: one row per (model, parameter) without the count-only keys."""
    kept = records.select("name", F.explode(drop_keys("best_params", HIDDEN_PARAMS)).alias("parameter", "best_value"))
    return kept.withColumn("type", _type_of(F.col("best_value")))


def is_anomaly_algo(name: Column) -> Column:
    """Membership in the four anomaly-detector names."""
    return F.lower(name).isin(ANOMALY_NAMES)
