"""Operator 10: sharding by weighted rendezvous hashing, with DataFrame functions only.

Every shard draws a number in (0, 1) from the hash of (record key, shard); the
shard with the least -ln(u) / weight takes the record.  The draw of a shard
depends on nothing else, so one more shard only takes records into itself, a
share of its weight.  A record's shard follows from its key and the shard list
alone: no state, no order of rows.

Slots number the rows of a shard without gaps.  They are counted in two levels:
rows are dealt by (shard, hash range of the key), numbered there, and shifted by
the sizes of the ranges before; no task holds a whole shard.

Edge cases: a null key is a key of its own; rows with one key share its shard
(each has a slot); null texts have size 8 and the checksum of nothing; an empty
table gives no rows; other columns of the input are ignored by ``place`` and
kept by ``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 4096


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) with 52 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit("shard"), F.lit(shard)), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: list[float]) -> Column:
    """Index of the shard that wins the key; ties go to the smaller index."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("shards need positive weights")
    if len(weights) == 1:
        return F.lit(0)
    bids = [F.struct((-F.log(_draw(key, i)) / F.lit(float(w))).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*bids))["shard"]


def assign_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; nothing is shuffled."""
    return docs.withColumn(out, shard_of(F.col(key), weights))


def with_slots(rows: DataFrame, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... in each shard, ordered by the key's hash and the key."""
    names = rows.columns
    if {"__order", "__range", "__local", "__before"} & set(names):
        raise ValueError("columns __order, __range, __local and __before are reserved")
    ranged = rows.withColumn("__order", F.xxhash64(F.col(key), F.lit("slot")))
    ranged = ranged.withColumn("__range", F.shiftrightunsigned(F.col("__order"), 64 - RANGES.bit_length() + 1).cast("int"))
    sizes = ranged.groupBy(shard, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(shard, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = W.partitionBy(shard, "__range").orderBy("__order", key)
    counted = ranged.withColumn("__local", F.row_number().over(local) - 1)
    return counted.join(sizes, [shard, "__range"]).select(
        *names, (F.col("__local") + F.col("__before")).cast("long").alias("slot")
    )


def place(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's size, checksum, shard, slot, and shard when there is one shard more; equal weights."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col(key), [1.0] * shards).cast("int").alias("shard"),
        shard_of(F.col(key), [1.0] * (shards + 1)).cast("int").alias("grown_shard"),
    )
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
