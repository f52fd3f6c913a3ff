"""Operator 9: exact top-k inner products by no-random-access aggregation.

Rows are dealt into blocks by the hash of their id, queries likewise; every
(query block, row block) pair is one task.  A block keeps one sorted list of
values per component.  Lists are read from the top where a query's component is
positive and from the bottom where it is negative, all to the same depth.  What
has been read gives each row a lower bound (the rest at the list's far end) and
an upper bound (the rest at the value the list has reached); bounds of all rows
and queries of the pair come from products of the matrices of read and unread
entries.  Reading stops for a query when no more than a few rows can still
reach its k-th lower bound, and at the latest when the lists end; the rows left
get their final scores.  Each pair sends on at most k rows a query, and the best
k of all blocks are taken at last (score, then smaller id).

Equal vectors of a block are one row with their smallest ids, repeated ids
included, so copies of one vector do not crowd the bounds.  Final scores are
64-bit integers; bounds leave room for what floating point may be off.  The work is queries times rows, as the
exact question asks; memory is bounded by the block sizes.

Edge cases: vectors that are null or hold null or non-finite components take no
part; missing components of shorter vectors count as 0; several rows with a
query's own id are all its own and are left out; other repeated rows count each;
repeated query rows are asked once; fewer than k candidates are all returned; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_BLOCK, QUERY_BLOCK = 8192, 2048
DEPTHS = (0.4, 0.7, 0.85)
_OUT = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows with null or non-finite parts are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(fine).select(
        F.col(key).alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _slack(x: np.ndarray, queries: np.ndarray) -> float:
    """What bounds in floating point may be off; raises where a score could pass 64 bits."""
    largest = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if largest >= 2.0**63:
        raise OverflowError("inner products may pass 64 bits")
    return 0.0 if largest < 2.0**52 else largest * 2.0**-48


class _Lists:
    """The sorted lists of a block: ranks of every entry and values by rank."""

    def __init__(self, x: np.ndarray):
        x = x.astype(float)
        order = np.argsort(-x, axis=0, kind="stable")
        self.x, self.n = x, len(x)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)
        self.values = np.take_along_axis(x, order, axis=0)

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows x queries) after ``depth`` entries of every list."""
        q = q.astype(float)
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        top, bottom = self.rank < depth, self.rank >= self.n - depth
        high, low = self.values[0], self.values[-1]
        head, foot = self.values[depth - 1], self.values[self.n - depth]
        read = np.where(top, self.x, 0) @ up + np.where(bottom, self.x, 0) @ down
        not_top, not_bottom = (~top).astype(float), (~bottom).astype(float)
        upper = read + not_top @ (head[:, None] * up) + not_bottom @ (foot[:, None] * down)
        lower = read + not_top @ (low[:, None] * up) + not_bottom @ (high[:, None] * down)
        return lower, upper


def block_top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, k: int) -> list[tuple]:
    """(query id, row id, score) of the k best rows of the block for each query, own rows left out."""
    order = np.argsort(r_ids, kind="stable")
    rows, r_ids = rows[order], r_ids[order]
    x, back = np.unique(rows, axis=0, return_inverse=True)
    back = back.ravel()
    by = np.argsort(back, kind="stable")
    limits = np.append(np.searchsorted(back[by], np.arange(len(x))), len(by))
    # a query leaves out its own id, however often it stands there
    most = int(np.unique(r_ids, return_counts=True)[1].max())
    ids = [r_ids[by[a : min(b, a + k + most)]].tolist() for a, b in zip(limits[:-1], limits[1:])]
    slack = _slack(x, queries)
    lists, out = _Lists(x), []
    waiting = np.arange(len(queries))
    alive = np.ones((len(x), len(queries)), dtype=bool)
    place = min(k + 1, len(x))  # one of them may be the query's own vector
    for share in DEPTHS:
        depth = int(share * len(x))
        if not len(waiting) or depth < 1:
            break
        lower, upper = lists.bounds(queries[waiting], depth)
        bar = np.partition(lower, len(x) - place, axis=0)[len(x) - place]
        alive[:, waiting] &= upper >= bar - slack
        waiting = waiting[alive[:, waiting].sum(axis=0) > 4 * (k + 1)]
    for j, own in enumerate(q_ids.tolist()):
        left = np.flatnonzero(alive[:, j])
        scores = x[left] @ queries[j]
        if len(left) > k + 1:
            bar = np.partition(scores, len(left) - (k + 1))[len(left) - (k + 1)]
            left, scores = left[scores >= bar], scores[scores >= bar]
        found = [(-s, i) for r, s in zip(left.tolist(), scores.tolist()) for i in ids[r] if i != own]
        out += [(own, i, -s) for s, i in sorted(found)[:k]]
    return out


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs are (vec_id, v) from ``whole_vectors``."""
    queries = queries.dropDuplicates(["vec_id"])
    n, m = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = queries.count()
    n_rows, n_queries = -(-max(n, 1) // row_block), -(-max(asked, 1) // query_block)
    block = lambda parts: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select("vec_id", "v", block(n_queries).alias("qb"), every(n_rows).alias("rb"))
    right = df.select("vec_id", "v", block(n_rows).alias("rb"), every(n_queries).alias("qb"))

    def pair(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = block_top(_matrix(q.v, m), q.vec_id.to_numpy(), _matrix(r.v, m), r.vec_id.to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(pair, _OUT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
