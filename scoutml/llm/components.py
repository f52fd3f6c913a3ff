"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.llm.common import map_batches, stored

#: links that a task contracts at once
PART = 1_000_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the given links alone, roots left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class _Contract:
    """Gathers the links of a task up to PART and gives back their stars."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def __call__(self, batch: pa.RecordBatch):
        self.parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        self.size += batch.num_rows
        if self.size >= PART:
            yield from self.finish()

    def finish(self):
        if self.size:
            u, v = local_stars(*(np.concatenate(side) for side in zip(*self.parts)))
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    return stored(map_batches(edges, _Contract, "u long, v long"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``links`` (a, b), which is a written table.

    Every task first contracts the links it reads, without a shuffle.  Up to PART
    links that are left are contracted by one more task, as many as any task takes;
    of more, star contractions over all links follow, each written to the shared
    folder, until all components are stars or the links left are as few.
    """
    edges = _contracted(links.select("a", "b").where("a <> b"))
    while True:
        if edges.count() <= PART:
            edges = _contracted(edges.coalesce(1))
            break
        uses = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        uses = uses.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        if not uses.where("leaf > 1 or (leaf = 1 and root = 1)").agg(F.count(F.lit(1))).first()[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _contracted(stored(small.unionByName(low.select("u", F.col("m").alias("v")))))
    roots = edges.select(F.col("v").alias("node")).distinct()
    roots = roots.withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
