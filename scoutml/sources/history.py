"""Experiment history as a parquet table in the shared folder.

The table is append-only; ids continue from the stored maximum.  Reads merge
schemas by column name, so rows written before the ``mode`` column existed
read back as supervised (D13).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutml.functions.scalar import json_or_default
from scoutml.operators.ranking import with_rank

COLUMNS = ["id", "timestamp", "user_prompt", "mode", "task", "selected_models", "results", "insight",
           "dataset_shape", "best_model", "best_score"]
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()),
    T.StructField("user_prompt", T.StringType()), T.StructField("mode", T.StringType()),
    T.StructField("task", T.StringType()), T.StructField("selected_models", T.StringType()),
    T.StructField("results", T.StringType()), T.StructField("insight", T.StringType()),
    T.StructField("dataset_shape", T.StringType()), T.StructField("best_model", T.StringType()),
    T.StructField("best_score", T.DoubleType()),
])
MODEL_SCHEMA = "array<struct<name:string,score:double,n_trials:int,error:string>>"
RESULTS_SCHEMA = f"struct<task:string,models:{MODEL_SCHEMA},clustering:array<struct<name:string,silhouette:double>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> DataFrame:
    """S6 base: all rows, schemas merged by name; missing ``mode`` -> supervised."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    df = spark.read.option("mergeSchema", True).parquet(path)
    if "mode" not in df.columns:
        df = df.withColumn("mode", F.lit(None).cast("string"))
    df = df.withColumn("mode", F.coalesce(F.col("mode"), F.lit("supervised")))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(SCHEMA[c].dataType).alias(c) for c in COLUMNS])


def best_from_results(results: Column, mode: Column) -> tuple[Column, Column]:
    """A6 inside a row: max accuracy / min RMSE / max silhouette, first on ties;
    ("", null) when nothing is valid."""
    r = F.from_json(results, RESULTS_SCHEMA)
    task = r["task"]
    models = F.filter(r["models"], lambda m: m["score"].isNotNull())
    clus = F.filter(r["clustering"], lambda c: c["silhouette"].isNotNull())
    # key = score (negated for RMSE) then earlier position wins
    sup = F.transform(models, lambda m, i: F.struct(
        F.when(task == "classification", m["score"]).otherwise(-m["score"]).alias("k"), (-i).alias("o"), m["name"].alias("n"),
        m["score"].alias("s")))
    uns = F.transform(clus, lambda c, i: F.struct(c["silhouette"].alias("k"), (-i).alias("o"), c["name"].alias("n"),
                                                  c["silhouette"].alias("s")))
    cand = F.when(mode == "supervised", sup).otherwise(uns)
    top = F.array_max(cand)
    return F.coalesce(top["n"], F.lit("")), top["s"]


def append(spark: SparkSession, path: str, experiments: DataFrame, order_cols: list[str],
           now: _dt.datetime | None = None, with_mode: bool = True) -> DataFrame:
    """Add rows; id = stored max + position (order_cols fix the order within
    the batch); timestamp 'yyyy-MM-dd HH:mm:ss'; best model computed from results.
    ``experiments``: user_prompt, mode, task, selected_models (json), results (json),
    insight, dataset_shape."""
    start = read(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    stamp = (now or _dt.datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    # batch positions from the skew-safe ranking (no single-partition window)
    best_name, best_score = best_from_results(F.col("results"), F.col("mode"))
    rows = with_rank(experiments, order_cols, name="batch_pos").select(
        (F.lit(start) + F.col("batch_pos") + 1).cast("long").alias("id"), F.lit(stamp).alias("timestamp"),
        "user_prompt", "mode", F.when(F.col("mode") == "unsupervised", F.lit("unsupervised")).otherwise(F.col("task")).alias("task"),
        "selected_models", "results", "insight", "dataset_shape", best_name.alias("best_model"), best_score.alias("best_score"))
    if not with_mode:
        rows = rows.drop("mode")
    rows.write.mode("append").parquet(path)
    return read(spark, path)


def all_newest_first(spark: SparkSession, path: str) -> DataFrame:
    """``ORDER BY id DESC`` with tolerant JSON decode of the list column."""
    df = read(spark, path)
    models = json_or_default("selected_models", "array<string>", F.array().cast("array<string>"))
    return df.withColumn("selected", models).orderBy(F.col("id").desc())


def by_id(spark: SparkSession, path: str, exp_id: int) -> DataFrame:
    """Point lookup (pushed down to the parquet scan); empty when absent."""
    return read(spark, path).where(F.col("id") == exp_id)


def clear(spark: SparkSession, path: str) -> DataFrame:
    """Overwrite with an empty table of the same schema."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return read(spark, path)


def summary(df: DataFrame) -> DataFrame:
    """Total, supervised, unsupervised, classification."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("mode"), F.lit("supervised")) == "supervised").alias("supervised"),
        F.count_if(F.col("mode") == "unsupervised").alias("unsupervised"),
        F.count_if(F.col("task") == "classification").alias("classification"),
    )


def explode_models(df: DataFrame) -> DataFrame:
    """A10: one row per scored model (supervised) or clustering (unsupervised)."""
    r = F.from_json("results", RESULTS_SCHEMA)
    sup = df.where(F.col("mode") == "supervised").select(
        "id", F.posexplode(r["models"]).alias("pos", "m")).where(F.col("m.score").isNotNull()).select(
        "id", "pos", F.col("m.name").alias("name"), F.col("m.score").alias("score"))
    uns = df.where(F.col("mode") == "unsupervised").select(
        "id", F.posexplode(r["clustering"]).alias("pos", "m")).where(F.col("m.silhouette").isNotNull()).select(
        "id", "pos", F.col("m.name").alias("name"), F.col("m.silhouette").alias("score"))
    return sup.unionByName(uns)
