"""Dataset profile and task detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASS_LIMIT = 15  # fewer distinct target values than this -> classification


def null_profile(df: DataFrame) -> DataFrame:
    """One pass; ``(column, position, n_rows, n_nulls)`` per column."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"_z{i}") for i, c in enumerate(df.columns)
    ]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', {i}, _z{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(
        f"stack({len(df.columns)}, {pairs}) as (column, position, n_nulls)", "_n as n_rows"
    ).select("column", F.col("position").cast("int"), F.col("n_rows").cast("long"), F.col("n_nulls").cast("long"))


def shape(df: DataFrame) -> DataFrame:
    """``[rows, cols]`` as a one-row table (the target counts as a column)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("int")
    )


def is_string_type(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def target_cardinality(df: DataFrame, target: str) -> DataFrame:
    """Distinct non-null count of the target and the task it implies.

    String targets are classification whatever their cardinality (D3, D15).
    """
    is_str = is_string_type(df, target)
    return df.agg(F.count_distinct(F.col(target)).cast("long").alias("n_distinct")).select(
        F.lit(target).alias("target"),
        F.lit(is_str).alias("is_string"),
        "n_distinct",
        F.when(F.lit(is_str) | (F.col("n_distinct") < CLASS_LIMIT), F.lit("classification"))
        .otherwise(F.lit("regression"))
        .alias("task"),
    )


def detect_task(df: DataFrame, target: str = "target") -> str:
    """P4/P5 on the driver: raises if the target column is absent.

    A cheap HyperLogLog pass decides high-cardinality targets; only a small
    estimate pays for the exact distinct count.
    """
    if target not in df.columns:
        raise ValueError(f"no column named {target!r}")
    if is_string_type(df, target):
        return "classification"
    approx = df.agg(F.approx_count_distinct(target, 0.01)).first()[0]
    if approx >= 4 * CLASS_LIMIT:
        return "regression"
    exact = df.agg(F.count_distinct(F.col(target))).first()[0]
    return "classification" if exact < CLASS_LIMIT else "regression"
