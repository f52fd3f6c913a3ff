"""Vector arithmetic as JVM higher-order expressions on ``array<double>`` columns.

These stay inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sqdist(a: str | Column, b: str | Column) -> Column:
    """Squared euclidean distance of two equal-length arrays."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def dist(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(sqdist(a, b))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def columns_to_array(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def to_array(col: str | Column) -> Column:
    """ML vector -> array<double>."""
    return vector_to_array(_c(col))


def to_vector(col: str | Column) -> Column:
    """array<double> -> ML dense vector."""
    return array_to_vector(_c(col))


def float_array(col: str | Column) -> Column:
    """array<float> (e.g. embeddings) -> array<double>."""
    return F.transform(_c(col), lambda x: x.cast("double"))
