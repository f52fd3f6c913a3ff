"""Exact pairwise work: kNN and radius neighbours on a pruning grid, and
per-cluster distance sums (exact silhouette) in bounded blocks.

kNN and radius search project rows on their top principal axes and compare a
row only with rows in neighbouring grid cells (an equi-join on cell keys); the
projection never lengthens a distance, so the pruning drops no true answer.

Where the grid cannot prune, and for the all-pairs sums, rows of each side are hashed
on their id into blocks; each (left block, right block) cell is one
``cogroup().applyInPandas`` call that goes through the cell a few rows at a time
and emits only what the caller needs (top-k per row, sums or minima within a
radius, per-cluster sums).  A matrix product gives all squared distances of the
cell with a known error; the pairs it cannot rule out are measured exactly.
Blocks grow with the rows up to ``BLOCK_VALUES`` numbers, so memory per task is
bounded, rows are copied sixteen times until then, and the pairs are never shuffled.
The work is still |L| x |R| products: that is what an exact answer costs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutml.operators.graph import contract
from scoutml.session import cut

DEFAULT_BLOCK_ROWS = 2048
BLOCK_VALUES = 1 << 21  # numbers of a block at most
BLOCKS = 16  # blocks of a side, while they are neither too small nor too large
_CHUNK = 1 << 20  # pairs of a cell looked at together


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.values])


def distances(left: np.ndarray, right: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Exact distance matrix, computed in chunks of rows (sum of squared
    differences, not the expanded dot-product form, so ties stay ties)."""
    m, n = left.shape[0], right.shape[0]
    out = np.empty((m, n))
    if m == 0 or n == 0:
        return out
    d = left.shape[1]
    step = max(1, 4_000_000 // max(1, n * d))
    for i in range(0, m, step):
        diff = left[i : i + step, None, :] - right[None, :, :]
        if metric == "manhattan":
            out[i : i + step] = np.abs(diff).sum(axis=-1)
        else:
            out[i : i + step] = np.sqrt((diff * diff).sum(axis=-1))
    return out


def pair_distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Exact distance of every row of ``x`` to the same row of ``y`` (the numbers of ``distances``)."""
    out = np.empty(len(x))
    step = max(1, 4_000_000 // max(1, x.shape[1]))
    for i in range(0, len(x), step):
        diff = x[i : i + step] - y[i : i + step]
        out[i : i + step] = np.abs(diff).sum(-1) if metric == "manhattan" else np.sqrt((diff * diff).sum(-1))
    return out


def rough_distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean"):
    """The cell of ``x`` and ``y`` in chunks of rows: (first row, keys, slack).

    Keys are squared distances from one matrix product (manhattan: the distances), off by at most the row's ``slack``.
    The keys' memory is used again for the next chunk."""
    step = max(1, _CHUNK // max(1, len(y)))
    if metric == "manhattan":
        for i in range(0, len(x), step):
            part = distances(x[i : i + step], y, metric)
            yield i, part, np.zeros(len(part))
        return
    middle = y.mean(axis=0)
    if not np.isfinite(middle).all():
        middle = np.zeros(y.shape[1])
    x, y = x - middle, y - middle
    nx, ny = (x * x).sum(-1), (y * y).sum(-1)
    slack = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(nx) + np.sqrt(ny.max())) ** 2
    held = np.empty((min(step, len(x)), len(y)))
    y2 = np.ascontiguousarray(-2.0 * y.T)
    for i in range(0, len(x), step):
        part = np.matmul(x[i : i + step], y2, out=held[: len(x[i : i + step])])
        part += nx[i : i + step, None]
        part += ny
        yield i, part, slack[i : i + step]


def block_rows_of(n: int, d: int) -> int:
    """Rows of a block: a sixteenth of ``n``, between ``DEFAULT_BLOCK_ROWS`` and ``BLOCK_VALUES`` numbers."""
    return max(1, min(max(DEFAULT_BLOCK_ROWS, math.ceil(n / BLOCKS)), max(1, BLOCK_VALUES // max(d, 1))))


def _width(df: DataFrame, col: str) -> int:
    row = df.select(F.size(col).alias("d")).first()
    return 0 if row is None else row["d"]


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int | None = None,
    left_id: str = "lid",
    right_id: str = "rid",
) -> DataFrame:
    """Apply ``kernel(left_block, right_block)`` to every pair of blocks."""
    n_left = left.count()
    n_right = right.count()
    size = block_rows or block_rows_of(max(n_left, n_right), _width(right, "rx"))
    b_left = max(1, math.ceil(n_left / size))
    b_right = max(1, math.ceil(n_right / size))
    lrep = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(b_left)).cast("int")).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(b_right - 1)))
    )
    rrep = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(b_right)).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(b_left - 1)))
    )

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(",")})
        return kernel(lp, rp)

    return _cogrouped(lrep, rrep, ("_lb", "_rb"), b_left * b_right, run, schema)


def _cogrouped(left: DataFrame, right: DataFrame, keys: tuple[str, str], cells: int, run, schema: str) -> DataFrame:
    """Cogroup by cell over about as many partitions as cells: a cell is long work on few bytes."""
    parts = max(1, min(cells, 4096))
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInPandas(run, schema)


def block_pairs_once(rows: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """``run`` over every two blocks of ``rows`` (with ``block``) once, a block with itself included."""
    left = rows.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    right = rows.toDF(*rows.columns).withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block"))))
    return _cogrouped(left, right, ("i", "j"), blocks * (blocks + 1) // 2, run, schema)


# ------------------------------------------------------------- grid pruning
GRID_DIMS = 3


def _dist_expr(a: str, b: str, metric: str, d: int) -> Column:
    """Exact distance of two array columns of ``d`` numbers as one JVM expression; the terms are added in order."""
    term = (lambda x, y: F.abs(x - y)) if metric == "manhattan" else (lambda x, y: (x - y) * (x - y))
    if d <= 16:  # plain arithmetic compiles, functions of arrays do not
        total = F.lit(0.0)
        for j in range(d):
            total = total + term(F.get(a, F.lit(j)), F.get(b, F.lit(j)))
    else:
        total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)
    return total if metric == "manhattan" else F.sqrt(total)


def grid_axes(df: DataFrame, col: str, m: int = GRID_DIMS) -> np.ndarray:
    """Orthonormal axes (d x m) for the grid: the top-m principal axes of ``col``.

    A projection on unit axes never lengthens a euclidean or manhattan distance,
    so two rows within distance r differ by at most r on every axis, whatever
    the axes are; the axes only decide how much the grid prunes.  One pass:
    every Arrow batch adds its row count, sums and Gram matrix in numpy, Spark
    sums the batch vectors, and the driver solves one d x d eigenproblem."""
    from pyspark.ml.stat import Summarizer

    first = df.select(F.size(col).alias("d")).first()
    if first is None:
        return np.zeros((0, 0))
    d = int(first["d"])
    if d <= m:
        return np.eye(d)

    def gram(batches):
        for b in batches:
            if len(b) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b[col].values])
            yield pd.DataFrame({"st": [np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]).tolist()]})

    st = df.select(col).mapInPandas(gram, "st array<double>")
    tot = np.array(st.agg(Summarizer.sum(array_to_vector("st")).alias("t")).first()["t"].toArray())
    n, sums, g = tot[0], tot[1:1 + d], tot[1 + d:].reshape(d, d)
    cov = (g - np.outer(sums, sums) / n) / max(n - 1.0, 1.0)
    vals, vecs = np.linalg.eigh(cov)
    return vecs[:, np.argsort(-vals, kind="stable")[:m]]


def _project(df: DataFrame, col: str, axes: np.ndarray, prefix: str) -> DataFrame:
    xs = F.transform(col, lambda v: v.cast("double"))
    return df.select("*", *[
        F.aggregate(F.zip_with(xs, F.array(*[F.lit(float(a)) for a in axes[:, j]]), lambda u, v: u * v),
                    F.lit(0.0), lambda s, v: s + v).alias(f"{prefix}{j}")
        for j in range(axes.shape[1])
    ])


def _cells(df: DataFrame, prefix: str, m: int, side: float, spread: bool) -> DataFrame:
    """Grid cell of every row (``g0..g{m-1}``); ``spread`` repeats each row for
    its 3^m neighbouring cells (the probe side of the equi-join)."""
    keys = [F.floor(F.col(f"{prefix}{j}") / F.lit(side)).cast("long") for j in range(m)]
    if not spread:
        return df.select("*", *[k.alias(f"g{j}") for j, k in enumerate(keys)])
    offs = [[(i // 3 ** j) % 3 - 1 for j in range(m)] for i in range(3 ** m)]
    off = F.explode(F.array(*[F.array(*[F.lit(o) for o in row]) for row in offs])).alias("_off")
    return df.select("*", *[k.alias(f"_c{j}") for j, k in enumerate(keys)]).select("*", off).select(
        "*", *[(F.col(f"_c{j}") + F.col("_off")[j]).alias(f"g{j}") for j in range(m)]
    ).drop("_off", *[f"_c{j}" for j in range(m)])


def _candidates(q: DataFrame, r: DataFrame, m: int, side: float, metric: str, d: int) -> DataFrame:
    """All (query, ref) pairs in neighbouring cells with their exact distance."""
    keys = [f"g{j}" for j in range(m)]
    qc = _cells(q, "_qp", m, side, spread=True).drop(*[f"_qp{j}" for j in range(m)])
    rc = _cells(r, "_rp", m, side, spread=False).drop(*[f"_rp{j}" for j in range(m)])
    return qc.join(rc, keys).drop(*keys).withColumn("dist", _dist_expr("lx", "rx", metric, d)).drop("lx", "rx")


def _spans(q: DataFrame, r: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Per axis: (max - min) of the projected refs and of refs and queries
    together, plus a rounding tolerance for the projected coordinates."""
    rows = []
    for src, p in ((q, "_qp"), (r, "_rp")):
        rows.append(src.agg(*[F.min(f"{p}{j}").alias(f"lo{j}") for j in range(m)],
                            *[F.max(f"{p}{j}").alias(f"hi{j}") for j in range(m)]).first())
    qa, ra = rows
    ref_span = np.array([(ra[f"hi{j}"] or 0.0) - (ra[f"lo{j}"] or 0.0) for j in range(m)])
    lo = np.array([min(v for v in (qa[f"lo{j}"], ra[f"lo{j}"], 0.0) if v is not None) for j in range(m)])
    hi = np.array([max(v for v in (qa[f"hi{j}"], ra[f"hi{j}"], 0.0) if v is not None) for j in range(m)])
    tol = 1e-9 * (1.0 + float(np.max(np.maximum(np.abs(lo), np.abs(hi)))))
    return ref_span, hi - lo, tol


def _lowest_refs(y: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Rows (in id order) that can be among the k nearest: at each position the k + 1 lowest ids, k rows each."""
    order = np.argsort(rids, kind="stable")
    place = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.dtype.itemsize * y.shape[1]))).ravel(), return_inverse=True)[1]
    if place.max(initial=-1) + 1 == len(y):
        return order
    t = pd.DataFrame({"p": place[order], "r": rids[order]})
    copies = t.groupby(["p", "r"]).cumcount()
    ids = (copies == 0).groupby(t["p"]).cumsum()  # distinct ids of the position so far
    return order[((copies < k) & (ids <= k + 1)).to_numpy()]


def _knn_blocked(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    payload: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """kNN over all (query block, ref block) pairs in numpy (used when the grid
    cannot prune, e.g. isotropic high-dimensional rows).  In a cell the k-th key of
    the first refs bounds a query's k-th distance; the refs below it are measured."""
    pay_type = dict(refs.dtypes)[payload] if payload else None
    schema = "lid long, rid long, dist double" + (f", payload {pay_type}" if payload else "")

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        lx, rx = _matrix(lp["lx"]), _matrix(rp["rx"])
        lids = lp["lid"].to_numpy(np.int64)
        rids = rp["rid"].to_numpy(np.int64)
        able = _lowest_refs(rx, rids, k)
        rx, rids = rx[able], rids[able]
        shared = exclude_self and np.isin(lids, rids).any()
        found = []
        for low, key, slack in rough_distances(lx, rx, metric):
            if shared:
                key[lids[low : low + len(key), None] == rids[None, :]] = np.inf
            first = key[:, : max(DEFAULT_BLOCK_ROWS, 4 * k)]
            if first.shape[1] > k:
                limit = np.partition(first, k - 1, axis=1)[:, k - 1] + 2 * slack
                i, j = np.nonzero(~(key > limit[:, None]))
            else:
                i, j = (t.ravel() for t in np.indices(key.shape))
            i += low
            if shared:
                other = lids[i] != rids[j]
                i, j = i[other], j[other]
            dist = pair_distances(lx[i], rx[j], metric) if len(i) <= _CHUNK else np.concatenate(
                [pair_distances(lx[i[s : s + _CHUNK]], rx[j[s : s + _CHUNK]], metric) for s in range(0, len(i), _CHUNK)])
            order = np.lexsort((j, dist, i))  # refs stand in id order
            i, j, dist = i[order], j[order], dist[order]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            keep = (rank < k) & np.isfinite(dist)
            found.append((i[keep], j[keep], dist[keep]))
        i, j, dist = (np.concatenate(t) for t in zip(*found))
        out = pd.DataFrame({"lid": lids[i], "rid": rids[j], "dist": dist})
        if payload:
            out["payload"] = rp[payload].to_numpy()[able][j]
        return out

    cols = ["rid", "rx"] + ([payload] if payload else [])
    part = block_pairs(queries.select("lid", "lx"), refs.select(*cols), kernel, schema, block_rows)
    w = Window.partitionBy("lid").orderBy("dist", "rid")
    out = part.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)
    if payload:
        out = out.withColumnRenamed("payload", payload)
    return out


def _within(lx: np.ndarray, rx: np.ndarray, eps: float, metric: str):
    """Index pairs of the rows within ``eps`` with their distances, a chunk of rows at a time."""
    bound = eps if metric == "manhattan" else eps * eps if eps >= 0 else -np.inf
    for low, key, slack in rough_distances(lx, rx, metric):
        i, j = np.nonzero(~(key > (bound + slack)[:, None] * (1 + 1e-12)))
        for s in range(0, len(i), _CHUNK):
            a, b = i[s : s + _CHUNK] + low, j[s : s + _CHUNK]
            dist = pair_distances(lx[a], rx[b], metric)
            keep = dist <= eps
            yield a[keep], b[keep], dist[keep]


def _radius_blocked(
    left: DataFrame, right: DataFrame, eps: float, metric: str = "euclidean", block_rows: int | None = None
) -> DataFrame:
    """Radius pairs over all block pairs in numpy (used when the grid cannot prune)."""

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        lids, rids = lp["lid"].to_numpy(np.int64), rp["rid"].to_numpy(np.int64)
        parts = [(lids[i], rids[j], d) for i, j, d in _within(_matrix(lp["lx"]), _matrix(rp["rx"]), eps, metric)]
        i, j, d = (np.concatenate(t) for t in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pd.DataFrame({"lid": i, "rid": j, "dist": d})

    return block_pairs(left.select("lid", "lx"), right.select("rid", "rx"), kernel, "lid long, rid long, dist double",
                       block_rows)


def _radius_blocked_values(left: DataFrame, right: DataFrame, eps: float, metric: str, how: str) -> DataFrame:
    """(lid, value): the sum or minimum of ``value`` over the right rows within ``eps``; no pair leaves its cell."""

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        value = rp["value"].to_numpy(np.int64)
        got = np.full(len(lp), 0 if how == "sum" else np.iinfo(np.int64).max)
        seen = np.zeros(len(lp), bool)
        for i, j, _ in _within(_matrix(lp["lx"]), _matrix(rp["rx"]), eps, metric):
            (np.add if how == "sum" else np.minimum).at(got, i, value[j])
            seen[i] = True
        return pd.DataFrame({"lid": lp["lid"].to_numpy(np.int64)[seen], "value": got[seen]})

    found = block_pairs(left.select("lid", "lx"), right.select("rid", "rx", "value"), kernel, "lid long, value long")
    return found.groupBy("lid").agg(getattr(F, how)("value").alias("value"))


def _radius_blocked_stars(points: DataFrame, eps: float, metric: str) -> DataFrame:
    """(lid, rid): edges with the connected components of the pairs within ``eps``; each cell sends a forest."""

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        held, size = [(np.zeros(0, np.int64),) * 2], 0
        if len(lp) and len(rp):
            lids, rids = lp["lid"].to_numpy(np.int64), rp["lid"].to_numpy(np.int64)
            for i, j, _ in _within(_matrix(lp["lx"]), _matrix(rp["lx"]), eps, metric):
                held.append((lids[i], rids[j]))
                size += len(i)
                if size > 4 * _CHUNK:
                    held, size = [contract(*(np.concatenate(t) for t in zip(*held)))], 0
        u, v = contract(*(np.concatenate(t) for t in zip(*held)))
        return pd.DataFrame({"lid": u, "rid": v})

    n = points.count()
    blocks = max(1, math.ceil(n / block_rows_of(n, _width(points, "lx"))))
    rows = points.select("lid", "lx", F.pmod(F.xxhash64("lid"), F.lit(blocks)).cast("int").alias("block"))
    return block_pairs_once(rows, blocks, run, "lid long, rid long")


GRID_MAX_PAIR_SHARE = 0.1  # the JVM pair filter costs ~10x a numpy block kernel per pair
PILOT_QUERIES = 64
CROWD = 12  # candidates for each of a query's k neighbours that a first level may have on average


def _candidate_count(q: DataFrame, r: DataFrame, m: int, side: float) -> int:
    """Exact number of (query, ref) pairs the grid would compare at ``side``,
    from per-cell counts (aggregated map-side; no pair is formed)."""
    keys = [f"g{j}" for j in range(m)]
    rc = _cells(r.select(*[f"_rp{j}" for j in range(m)]), "_rp", m, side, spread=False).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rn"))
    qc = _cells(q.select(*[f"_qp{j}" for j in range(m)]), "_qp", m, side, spread=True).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_qn"))
    got = qc.join(rc, keys).agg(F.sum(F.col("_qn") * F.col("_rn")).alias("n")).first()["n"]
    return int(got or 0)


def _grid_prunes(q: DataFrame, r: DataFrame, m: int, side: float, n_q: int, n_r: int) -> bool:
    return _candidate_count(q, r, m, side) <= GRID_MAX_PAIR_SHARE * n_q * n_r


SALT_ROWS = 100_000


def _positions(refs: DataFrame, keep: int, n_refs: int) -> DataFrame:
    """Distinct ref positions ``(rx, _refs)`` with the ``keep`` lowest-id refs
    of each position (ties in distance go to the lower id, so no other ref at
    that position can ever be among a query's k nearest).  The cut is taken in
    two window stages, first per (position, id-hash salt) and then per position
    over at most salts x keep rows, so a position holding a third of the rows
    is spread over many tasks."""
    salts = max(1, n_refs // SALT_ROWS)
    first = (refs.withColumn("_salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
             .withColumn("_r", F.row_number().over(Window.partitionBy("rx", "_salt").orderBy("rid")))
             .where(F.col("_r") <= keep).drop("_salt", "_r"))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("rx").orderBy("rid"))).where(F.col("_r") <= keep)
    cols = [c for c in refs.columns if c != "rx"]
    return kept.groupBy("rx").agg(F.collect_list(F.struct(*cols)).alias("_refs"))


def _pilot_kth(pilot: list, refs: DataFrame, k: int, metric: str, exclude_self: bool) -> list[float]:
    """The k-th distances of a few queries to the refs of all positions (rx, _refs); each batch sends k a query."""
    if not pilot:
        return []
    lids = np.array([p["lid"] for p in pilot], dtype=object)
    lx = np.stack([np.asarray(p["lx"], dtype=np.float64) for p in pilot])

    def near(batches):
        for b in batches:
            if not len(b):
                continue
            rx = _matrix(b["rx"])
            at = np.repeat(np.arange(len(b)), [len(v) for v in b["rids"]])
            rids = np.array([i for v in b["rids"] for i in v], dtype=object)
            dist = distances(lx, rx, metric)[:, at]
            if exclude_self:
                dist[lids[:, None] == rids[None, :]] = np.inf
            dist = np.sort(np.partition(dist, k - 1, axis=1)[:, :k] if dist.shape[1] > k else dist, axis=1)
            i, j = np.nonzero(np.isfinite(dist))
            yield pd.DataFrame({"i": i.astype(np.int32), "d": dist[i, j]})

    found = refs.select("rx", F.transform("_refs", lambda v: v["rid"]).alias("rids")).mapInPandas(near, "i int, d double")
    w = Window.partitionBy("i").orderBy("d")
    return [v["d"] for v in found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k).select("d").collect()]


# --------------------------------------------------------------------------- kNN
def knn(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    payload: str | None = None,
) -> DataFrame:
    """Exact k nearest refs of every query: ``(lid, rid, dist, nn_rank[, payload])``.

    ``queries``: ``(lid, lx)``; ``refs``: ``(rid, rx[, payload])``.  Ties in
    distance go to the lower ref id; ``exclude_self`` drops rid == lid.

    Refs are first reduced to distinct positions carrying their k (+1 with
    ``exclude_self``) lowest ids, so repeated points cost one comparison.
    Rows are placed on a grid over the top principal axes and each query is
    compared only with refs in its 3^m neighbouring cells (an equi-join, then
    the exact distance as a JVM expression).  A query is settled when it has k
    candidates and its k-th distance is within the cell side: every ref that
    close must lie in a neighbouring cell, ties included.  Unsettled queries go
    to the next level with a cell side four times larger, so dense regions are
    settled with small cells and sparse ones with large; at the last level the
    cell spans the whole data and every remaining query is settled against all
    refs.  Each level's results and leftover queries are checkpointed.

    The first side is the 90th, 50th or 10th percentile of the k-th distances of about
    64 sampled pilot queries, found by one scan of the refs: the largest with few enough
    candidates (the sample only steers the side; the result is exact for any side).  When the exact candidate count at that side (from per-cell counts)
    exceeds a tenth of all pairs, the grid cannot prune (e.g. isotropic
    high-dimensional rows) and the numpy block engine compares all pairs.
    """
    spark = queries.sparkSession
    pay_cols = [payload] if payload else []
    axes = grid_axes(refs, "rx")
    m = axes.shape[1]
    n_refs = refs.count()
    if m == 0 or n_refs == 0:
        schema = "lid long, rid long, dist double" + (f", {payload} {dict(refs.dtypes)[payload]}" if payload else "")
        return spark.createDataFrame([], schema + ", nn_rank int")
    q = cut(_project(queries.select("lid", "lx"), "lx", axes, "_qp"))
    r = cut(_project(_positions(refs.select("rid", "rx", *pay_cols), k + (1 if exclude_self else 0), n_refs),
                     "rx", axes, "_rp"))
    n_q = q.count()
    ref_span, span, tol = _spans(q, r, m)
    top = float(span.max()) + 2 * tol
    w = Window.partitionBy("lid").orderBy("dist", "rid")

    def ranked_at(pend: DataFrame, side: float) -> DataFrame:
        cand = _candidates(pend, r, m, side, metric, axes.shape[0]).select("lid", "dist", F.explode("_refs").alias("_e"))
        cand = cand.select("lid", "dist", "_e.rid", *[f"_e.{c}" for c in pay_cols])
        if exclude_self:
            cand = cand.where(F.col("lid") != F.col("rid"))
        return cand.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)

    def settle(pending: DataFrame, side: float) -> DataFrame:
        """The level loop: settled rows of every level until all are settled."""
        parts = []
        while True:
            last = side >= top
            ranked = cut(ranked_at(pending, side))
            if last:
                parts.append(ranked)
                break
            settled = (ranked.groupBy("lid").agg(F.count(F.lit(1)).alias("_c"), F.max("dist").alias("_dk"))
                       .where((F.col("_c") == k) & (F.col("_dk") + F.lit(tol) <= F.lit(side))).select("lid"))
            parts.append(ranked.join(settled, "lid", "left_semi"))
            pending = cut(pending.join(settled, "lid", "left_anti"))
            if pending.isEmpty():
                break
            side = min(side * 4.0, top)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    floor = top / 4.0 ** 12
    vol = float(np.prod(np.maximum(ref_span, tol)))
    side = max(min(top, (vol * k / n_refs) ** (1.0 / m)), floor)  # uniform-density guess
    # pilot: the k-th distances of ~64 sampled queries, one scan of the refs
    pilot = q.select("lid", "lx").sample(fraction=min(1.0, PILOT_QUERIES / max(n_q, 1)), seed=11).limit(4 * PILOT_QUERIES).collect()
    kths = _pilot_kth(pilot, r, k, metric, exclude_self)
    # a side that settles most queries at once, if its cells are not crowded (dense regions), else a smaller one
    for share in (90, 50, 10) if kths else ():
        side = max(min(top, float(np.percentile(kths, share)) + 2 * tol), floor)
        if _candidate_count(q, r, m, side) <= CROWD * k * n_q:
            break
    if not _grid_prunes(q, r, m, side, n_q, n_refs):
        blocked = _knn_blocked(q.select("lid", "lx"), refs.select("rid", "rx", *pay_cols), k, metric, exclude_self,
                               payload)
        return cut(blocked.select("lid", "rid", "dist", *pay_cols, F.col("nn_rank").cast("int").alias("nn_rank")))
    out = settle(q, side)
    return out.select("lid", "rid", "dist", *pay_cols, F.col("nn_rank").cast("int").alias("nn_rank"))


def _radius_sides(points: DataFrame, eps: float, *values: str) -> tuple[DataFrame, DataFrame, int, float, bool] | None:
    """Both sides on the grid, its axes and side, and whether it prunes; None without rows."""
    left = points.select(F.col("id").alias("lid"), F.col("x").alias("lx"))
    right = points.select(F.col("id").alias("rid"), F.col("x").alias("rx"), *values)
    axes = grid_axes(right, "rx")
    m = axes.shape[1]
    if m == 0:
        return None
    q = cut(_project(left, "lx", axes, "_qp"))
    r = cut(_project(right, "rx", axes, "_rp"))
    _, _, tol = _spans(q, r, m)
    side = max(float(eps), 0.0) + tol
    n = r.count()
    return q, r, m, side, _grid_prunes(q, r, m, side, n, n)


def radius_pairs(points: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """All ordered pairs (lid, rid) with distance <= eps, self pairs included.

    One grid level with cell side eps over the top principal axes: every pair
    within eps lies in neighbouring cells, so the equi-join on cells followed by
    the exact distance filter is complete and exact.  When the exact candidate
    count exceeds a tenth of all pairs the numpy block engine is used instead."""
    sides = _radius_sides(points, eps)
    if sides is None:
        return points.sparkSession.createDataFrame([], "lid long, rid long, dist double")
    q, r, m, side, prunes = sides
    if not prunes:
        return _radius_blocked(q, r, eps, metric)
    return _candidates(q, r, m, side, metric, _width(r, "rx")).where(F.col("dist") <= F.lit(float(eps))).select("lid", "rid", "dist")


def radius_values(points: DataFrame, eps: float, how: str, of: Column, asked: Column | None = None, metric: str = "euclidean") -> DataFrame:
    """(id, value): the ``sum`` or ``min`` of the whole number ``of`` over the rows of ``points`` (id, x, ...) within eps
    of each row, itself included; null numbers stay out and rows without ``asked`` are not looked up."""
    placed = points.select("id", "x", of.cast("long").alias("value"), (F.lit(True) if asked is None else asked).alias("asked"))
    sides = _radius_sides(placed, eps, "value", "asked")
    if sides is None:
        return points.sparkSession.createDataFrame([], "id long, value long")
    q, r, m, side, prunes = sides
    q = q if asked is None else q.join(r.where("asked").select(F.col("rid").alias("lid")), "lid", "left_semi")
    r = r.drop("asked").where(F.col("value").isNotNull())
    if prunes:
        near = _candidates(q, r, m, side, metric, _width(r, "rx")).where(F.col("dist") <= F.lit(float(eps)))
        got = near.groupBy("lid").agg(getattr(F, how)("value").alias("value"))
    else:
        got = _radius_blocked_values(q, r, eps, metric, how)
    return got.withColumnRenamed("lid", "id")


def radius_edges(points: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """(lid, rid): pairs within eps that leave the same connected components as all of them."""
    sides = _radius_sides(points, eps)
    if sides is None:
        return points.sparkSession.createDataFrame([], "lid long, rid long")
    q, r, m, side, prunes = sides
    if not prunes:
        return _radius_blocked_stars(q, eps, metric)
    return _candidates(q, r, m, side, metric, _width(r, "rx")).where(F.col("dist") <= F.lit(float(eps))).select("lid", "rid")


def cluster_distance_sums(points: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Per (row, cluster): sum of distances to that cluster's rows and their count
    (self excluded).  ``points``: ``(id, x, cluster)``.  Every two blocks meet once and
    send the sums of both; products that cancel (near rows) are measured exactly."""

    def starts(labels: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({"lid": [], "cluster": [], "sum_dist": [], "n": []})
        own = lp["i"].iat[0] == lp["j"].iat[0]
        lp, rp = lp.sort_values("cluster"), rp.sort_values("cluster")
        lx, rx = _matrix(lp["x"]), _matrix(rp["x"])
        lids, rids = lp["id"].to_numpy(np.int64), rp["id"].to_numpy(np.int64)
        lc, rc = lp["cluster"].to_numpy(), rp["cluster"].to_numpy()
        ls, rs = starts(lc), starts(rc)
        rows = np.zeros((len(lx), len(rs)))
        less = np.zeros((len(lx), len(rs)), np.int64)
        cols = np.zeros((len(ls), len(rx)))
        group = np.cumsum(np.bincount(ls, minlength=len(lx))) - 1  # cluster of every left row
        of = np.cumsum(np.bincount(rs, minlength=len(rx))) - 1
        for low, key, slack in rough_distances(lx, rx):
            near = np.flatnonzero(~(key.min(axis=1) > 1e9 * slack))
            i, j = np.nonzero(~(key[near] > 1e9 * slack[near, None]))
            i = near[i]
            np.sqrt(np.maximum(key, 0.0, out=key), out=key)
            for s in range(0, len(i), _CHUNK):
                a, b = i[s : s + _CHUNK], j[s : s + _CHUNK]
                key[a, b] = pair_distances(lx[a + low], rx[b])
            if own:
                a, b = np.nonzero(lids[low : low + len(key), None] == rids[None, :])
                key[a, b] = 0.0
                np.add.at(less, (a + low, of[b]), 1)
            rows[low : low + len(key)] = np.add.reduceat(key, rs, axis=1)
            if not own:
                here = group[low : low + len(key)]
                np.add.at(cols, here[starts(here)], np.add.reduceat(key, starts(here), axis=0))
        size = np.diff(np.append(rs, len(rx)))
        out = [pd.DataFrame({"lid": np.repeat(lids, len(rs)), "cluster": np.tile(rc[rs], len(lx)), "sum_dist": rows.ravel(), "n": (size - less).ravel()})]
        if not own:
            size = np.diff(np.append(ls, len(lx)))
            out.append(pd.DataFrame({"lid": np.tile(rids, len(ls)), "cluster": np.repeat(lc[ls], len(rx)), "sum_dist": cols.ravel(), "n": np.repeat(size, len(rx))}))
        return pd.concat(out, ignore_index=True)

    n = points.count()
    blocks = max(1, math.ceil(n / (block_rows or block_rows_of(n, _width(points, "x")))))
    rows = points.select("id", "x", "cluster", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    part = block_pairs_once(rows, blocks, run, "lid long, cluster int, sum_dist double, n long")
    return part.groupBy("lid", "cluster").agg(F.sum("sum_dist").alias("sum_dist"), F.sum("n").alias("n"))


# ------------------------------------------------------------------ kNN prediction
def vote(neigh: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """Class vote of the neighbours: uniform counts or 1/distance weights (zero
    distances, if any, vote alone); tie -> lowest class.  -> ``(lid, prediction)``."""
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("lid"))
    if weights == "distance":
        wgt = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        wgt = F.lit(1.0)
    scored = neigh.withColumn("_w", wgt).groupBy("lid", label).agg(F.sum("_w").alias("_s"))
    w = Window.partitionBy("lid").orderBy(F.col("_s").desc(), F.col(label))
    return (
        scored.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") == 1)
        .select("lid", F.col(label).cast("double").alias("prediction"))
    )


def class_shares(neigh: DataFrame, label: str, weights: str = "uniform") -> DataFrame:
    """Neighbour class shares (the kNN ``predict_proba``) under the same weights as ``vote``: ``(lid, label, p)``."""
    tot = F.sum("_c").over(Window.partitionBy("lid"))
    count = F.count(F.lit(1))
    if weights == "distance":
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("lid"))
        near = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
        neigh, count = neigh.withColumn("_w", near), F.sum("_w")
    return (
        neigh.groupBy("lid", label).agg(count.alias("_c"))
        .withColumn("p", F.col("_c") / tot)
        .drop("_c")
    )


def average(neigh: DataFrame, target: str, weights: str = "uniform") -> DataFrame:
    """kNN regression: (weighted) mean of the neighbours' targets."""
    if weights == "distance":
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("lid"))
        wgt = F.when(zero == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        wgt = F.lit(1.0)
    n = neigh.withColumn("_w", wgt)
    return n.groupBy("lid").agg((F.sum(F.col("_w") * F.col(target)) / F.sum("_w")).alias("prediction"))
