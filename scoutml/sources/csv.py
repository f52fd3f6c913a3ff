"""CSV dataset source/sink and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from scoutml.session import work_path


def scan_csv(spark: SparkSession, path: str, infer_schema: bool = True, schema: StructType | None = None) -> DataFrame:
    """Header row; inferred types unless an explicit schema is given (preferred at scale:
    inference costs an extra pass over the files)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer_schema)
    return reader.csv(path)


def write_csv(df: DataFrame, name: str, path: str | None = None) -> str:
    """(over)write a dataset as CSV with a header; returns the folder."""
    path = path or work_path(df.sparkSession, name)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def preview(df: DataFrame, order_col: str, n: int = 10) -> DataFrame:
    """S3: the first n rows by an explicit key (files have no stable row order)."""
    return df.orderBy(order_col).limit(n)
