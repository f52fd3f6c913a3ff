"""Exact, skew-safe row ranking (a DataFrame ``zipWithIndex``).

A global ``row_number()`` window or one partitioned by a low-cardinality key
puts a whole group in one task.  Here the rows are range-partitioned on
(group, order) keys so a hot group spans many partitions; each partition
numbers its rows with ``monotonically_increasing_id`` after a local sort; a
tiny (partition, group) count table gives each partition its offset.  The
numbered table is checkpointed so the partition/position pairs are stable.

Used by label encoding (T2), contiguous and stratified folds (C1, C2) and the
exact order statistics behind median imputation (T4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutml.session import cut, shuffle_partitions

_POS_MASK = (1 << 33) - 1


def _sort_key(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_rank(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of the row within its group by ``order_by``.

    Ties in ``order_by`` receive distinct consecutive ranks (like ``row_number``);
    pass a unique key last for a deterministic result.
    """
    reserved = {"_mid", "_pid", "_pos", "_off", "_first", "_n"}
    if name in reserved or reserved & set(df.columns):
        raise ValueError(f"column names {sorted(reserved)} are reserved by with_rank")
    spark = df.sparkSession
    n_parts = num_partitions or shuffle_partitions(spark)
    keys = [F.col(g) for g in partition_by] + [_sort_key(c) for c in order_by]
    numbered = (
        df.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    numbered = cut(numbered)
    numbered = numbered.withColumn("_pid", F.shiftrightunsigned("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_POS_MASK))
    )
    stats = numbered.groupBy("_pid", *partition_by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    w = Window.partitionBy(*partition_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # stats has at most (partitions x groups) rows; AQE broadcasts it at run time
    cond = [numbered["_pid"] == stats["_pid"]] + [
        numbered[g].eqNullSafe(stats[g]) for g in partition_by
    ]
    joined = numbered.join(stats, cond, "inner").select(
        numbered["*"], stats["_off"], stats["_first"]
    )
    return joined.withColumn(
        name, (F.col("_off") + F.col("_pos") - F.col("_first")).cast("long")
    ).drop("_mid", "_pid", "_pos", "_off", "_first")


def with_cumulative(df: DataFrame, weight: str, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Add ``name`` = the sum of ``weight`` over the rows that come before, within the group by ``order_by``.

    With one row per distinct value and its count as weight this gives exact order statistics in which a value that
    most rows share is still one row: no task sorts its copies.
    """
    keys = [F.col(c) for c in (*partition_by, *order_by)]
    numbered = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    numbered = cut(numbered.withColumn("_mid", F.monotonically_increasing_id())).withColumn("_pid", F.shiftrightunsigned("_mid", 33))
    parts = numbered.groupBy("_pid", *partition_by).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*partition_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    inside = Window.partitionBy("_pid", *partition_by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = [numbered["_pid"] == parts["_pid"]] + [numbered[g].eqNullSafe(parts[g]) for g in partition_by]
    joined = numbered.join(parts, same).select(numbered["*"], parts["_off"])
    return joined.withColumn(name, (F.col(name) + F.col("_off")).cast("long")).drop("_mid", "_pid", "_off")


def values_at(values: DataFrame, ranks: dict[str | None, Sequence[int]], group: str | None = None) -> dict[tuple, float]:
    """{(group, rank): value} of the 0-based ranks asked for each group of ``values`` (v and, if named, the group)."""
    by = [group] if group else []
    counted = values.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("_n"))
    placed = with_cumulative(counted, "_n", ["v"], by, "_before")
    holds = F.lit(False)
    for g, asked in ranks.items():
        for k in asked:
            here = (F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k)
            holds = holds | (here & (F.col(group) == g) if group else here)
    found = {}
    for r in placed.where(holds).collect():  # at most one row for each rank asked
        g = r[group] if group else None
        for k in ranks[g]:
            if r["_before"] <= k < r["_before"] + r["_n"]:
                found[g, k] = r["v"]
    return found
