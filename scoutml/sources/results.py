"""Result sink (S4): run results as JSON files without the per-row arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.session import work_path

WIDE_FIELDS = ["pca_coords", "best_labels", "labels"]


def write_results(results: DataFrame, name: str = "results", path: str | None = None) -> str:
    """Write one JSON object per run; top-level wide arrays are dropped by
    projection before anything is serialised."""
    keep = [c for c in results.columns if c not in WIDE_FIELDS]
    path = path or work_path(results.sparkSession, name)
    results.select(*keep).write.mode("overwrite").json(path)
    return path


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


__all__ = ["write_results", "read_results", "F"]
