"""Inputs for the registered queries, read from the driver's parquet tables.

These only pick columns and shape rows; every job's work runs in the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.functions.vectors import float_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` has no nulls; FIXTURES fixes this rule to make some."""
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("value", F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")))


def user_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` serve as free-text prompts."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, x array<double>, label)`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), float_array("embedding").alias("x"), F.col("label")
    )


def customer_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification slice: target = market segment, two numeric features."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").cast("double").alias("nationkey"),
        F.col("c_mktsegment").alias("target"),
    )


def orders_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression slice: target = order total; one string and one numeric feature."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("double").alias("custkey"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("target"),
    )


def lineitem_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger slice: return flag (3 classes) or price from four numerics."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )
