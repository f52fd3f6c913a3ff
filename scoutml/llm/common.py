"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.session import work_path

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) only, null texts as empty; other columns cannot clash."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def packed(df: DataFrame, name: str = "__row") -> DataFrame:
    """All columns in one struct, so that names made beside it clash with none; ``select("__row.*")`` gives them back."""
    return df.select(F.struct("*").alias(name))


def map_batches(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once per task and returns batch -> iterable of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
        finish = getattr(step, "finish", None)
        if finish:
            yield from finish()

    return df.mapInArrow(run, schema)


def list_array(parts: list[bytes], dtype: str, kind: pa.DataType) -> pa.Array:
    """A list column from one packed byte string per row."""
    width = np.dtype(dtype).itemsize
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    values = np.frombuffer(b"".join(parts), dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    """The vocabulary ``name`` without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, "llm-table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tidy_shuffles(fn: Callable) -> Callable:
    """Spark removes the shuffle files of each execution inside ``fn(df, ...)`` when it ends, not when the driver's garbage is collected."""

    @functools.wraps(fn)
    def run(df: DataFrame, *args, **kwargs):
        conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            return fn(df, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run
