"""Trees grown level by level from sums that Spark adds up (M2-M5 boosting, M7 extra trees).

A level is one job or a few: every task sums its rows by (tree, node, feature,
bin) with numpy, the tasks' vectors are added up, the driver picks the splits.
Such a vector has at most ``LIMIT`` numbers; levels with more nodes take several
jobs, so driver traffic is bounded whatever the depth.  Rows are never moved.

Boosting reads the rows as blocks.  Rows of a block between the same cuts in all
features lie in one cell: no tree can tell them apart, so margins, nodes and
gradients are found once a cell, and a row only adds its weight and its label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import to_array
from scoutml.operators.models.base import FEATURES, LABEL, Fitted, Learner, added, tasks_of
from scoutml.session import cut

LIMIT = 1_000_000
BINS = 64
#: rounds after which the cells' margins are written again
KEEP = 25
#: numbers that a block of rows holds at most
BLOCK = 2_000_000


class Tree:
    """Nodes in order of making; ``left`` is the first of two children, -1 at a leaf."""

    def __init__(self, width: int):
        self.feature, self.cut, self.left = [-1], [0.0], [-1]
        self.value = [np.zeros(width)]

    def split(self, node: int, feature: int, at: float) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, at, len(self.left)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(-1)
            self.value.append(np.zeros_like(self.value[0]))
        return self.left[node]

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; a row goes left where its feature is at most the cut."""
        feature, at, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        x = np.ascontiguousarray(x)
        node, flat, row = np.zeros(len(x), np.int64), x.ravel(), np.arange(len(x)) * x.shape[1]
        while True:
            inner = left[node] >= 0
            if not inner.any():
                return node
            f = np.maximum(feature[node], 0)
            node = np.where(inner, left[node] + (flat[row + f] > at[node]), node)

    def values_of(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(x)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y and seed of a batch of rows."""
    if batch.num_rows:
        x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
        yield x, batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """x and margins of the cells, then the cell, y and seed of the rows, of each block of a batch."""
    for i in range(batch.num_rows):
        of, y, seed = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int32), (3, np.float64), (4, np.int64)))
        cells = int(of.max()) + 1
        x, m = (batch.column(c)[i].values.to_numpy().reshape(cells, -1) for c in (0, 1))
        yield x, m, of, y, seed


def totals(data: DataFrame, sums: Callable[..., np.ndarray], numbers: int, how: str = "sum", read: Callable = _rows) -> np.ndarray:
    """The sum (or least and largest: the maximum) over all batches of the vectors ``sums(*rows)``; ``numbers``: of all tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for part in read(b):
                v = sums(*part)
                total = v if total is None else (total + v if how == "sum" else np.maximum(total, v))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return added(data.mapInArrow(run, "v array<double>"), numbers, how)


def _training(train: DataFrame) -> DataFrame:
    seed = F.xxhash64("row_id") if "row_id" in train.columns else F.xxhash64(to_array(FEATURES))
    return cut(train.select(to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"), seed.alias("seed")))


def quantile_cuts(data: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 ascending cuts of each feature, at its quantiles; the largest value is none."""
    d = data.select(F.size("x")).first()[0]
    names = [f"f{j}" for j in range(d)]
    wide = data.select(*[F.col("x")[j].alias(c) for j, c in enumerate(names)])
    found = wide.approxQuantile(names, [i / bins for i in range(1, bins)], 0.001)
    top = wide.agg(*[F.max(c).alias(c) for c in names]).first()
    return [np.array(sorted(v for v in set(q) if v < top[c])) for q, c in zip(found, names)]


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


def _cells(x: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One point for each cell that has rows, and the cell of each row.  The point stands at the cuts that end its cell,
    beyond the last cut at infinity, so that it falls on the same side of every cut as the rows."""
    code = _codes(x, cuts)
    code[np.isnan(x)] = -1  # goes left at every cut, though it is counted in the last bin
    size, key = 1, np.zeros(len(x), np.int64)
    for j, c in enumerate(cuts):  # pairs of codes are numbered anew once the numbers could run over
        if size > 2**62 // (len(c) + 2):
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key, size = key * (len(c) + 2) + code[:, j] + 1, size * (len(c) + 2)
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    ends = [np.concatenate([c, [np.inf, np.nan]]) for c in cuts]  # the last is that of -1
    return np.stack([e[code[first, j]] for j, e in enumerate(ends)], axis=1), of.astype(np.int32)


def _gathered(data: DataFrame, cuts: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """The rows as blocks: (x, m) of cells, with margins ``base``, and (of, y, seed) of rows as bytes."""

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, seed = (np.concatenate(side) for side in zip(*parts))
        points, of = _cells(x, cuts)
        lists = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (points, np.tile(base, (len(points), 1)))]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([v.tobytes()], pa.binary()) for v in (of, y.astype(np.float64), seed))], names=["x", "m", "of", "y", "seed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for rows in _rows(b):
                parts.append(rows)
                held += len(rows[1]) * (rows[0].shape[1] + len(base) + 3)
            if held >= BLOCK:
                yield block(parts)
                parts, held = [], 0
        if parts:
            yield block(parts)

    return cut(data.mapInArrow(run, "x array<double>, m array<double>, of binary, y binary, seed binary"))


def _drawn(seed: np.ndarray, salt: int, share: float) -> np.ndarray:
    """Rows of a sample of ``share`` of all, the same wherever they lie."""
    z = seed.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) < share * 2.0**64


def _features_per_split(rule, d: int) -> int:
    return {"sqrt": max(1, int(math.sqrt(d))), "log2": max(1, int(math.log2(d)))}.get(rule, d)


# ------------------------------------------------------------------ boosting
def soft_threshold(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


class Boosting(Learner):
    """M2-M5: second-order gradient boosting.  Binary: logistic loss; more classes: softmax with one tree a class and round;
    regression: squared loss.  Leaves are -T(G) / (H + lambda) with T the soft threshold of reg_alpha; ``reg_lambda`` and
    catboost's ``l2_leaf_reg`` are lambda.  ``num_leaves`` takes the best splits of a level first."""

    name = "gradient boosting"

    def __init__(self, task, params=None, n_classes=2, seed=42, flavour="gradient boosting"):
        super().__init__(task, params, n_classes, seed)
        self.flavour = flavour
        self.has_probability = task == "classification"

    def _gradients(self, margin: np.ndarray, of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and second derivatives of the rows (of, y) of each cell, all of whose rows have its margin."""
        cells, width = margin.shape
        rows = np.bincount(of, minlength=cells)[:, None].astype(float)
        if width > 1:
            own = np.bincount(of * np.int64(width) + y.astype(np.int64), minlength=cells * width).reshape(cells, width)
        else:
            own = np.bincount(of, weights=y, minlength=cells)[:, None]
        if self.task != "classification":
            return rows * margin - own, rows
        p = self._probabilities(margin)[:, -width:]
        return rows * p - own, rows * np.maximum(p * (1 - p), 1e-16)

    @staticmethod
    def _probabilities(margin: np.ndarray) -> np.ndarray:
        if margin.shape[1] == 1:
            margin = np.concatenate([np.zeros_like(margin), margin], axis=1)
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, train: DataFrame) -> Fitted:
        p, cls = self.params, self.task == "classification"
        rounds = int(p.get("n_estimators", p.get("iterations", 100)))
        depth, rate = int(p.get("max_depth", p.get("depth", 3))), float(p.get("learning_rate", 0.1))
        xgb = self.flavour == "xgboost"
        alpha = float(p.get("reg_alpha", 0.0))
        lam = float(p.get("reg_lambda", p.get("l2_leaf_reg", 1.0 if xgb else 3.0 if self.flavour == "catboost" else 0.0)))
        least = 1.0 if xgb else 1e-3  # least sum of second derivatives in a child
        leaves = int(p.get("num_leaves", 0)) or 2**depth
        share, columns = float(p.get("subsample", 1.0)), float(p.get("colsample_bytree", 1.0))
        data = _training(train)
        cuts = quantile_cuts(data)
        d, bins = len(cuts), 1 + max((len(c) for c in cuts), default=0)
        width = self.n_classes if cls and self.n_classes > 2 else 1
        base = self._base(data, cls, width)
        data = _gathered(data, cuts, base)
        tasks = tasks_of(data)
        rng = np.random.default_rng(self.seed)
        forest: list[list[Tree]] = []
        fresh: list[list[Tree]] = []  # rounds that the stored margins do not hold
        for t in range(rounds):
            trees = [Tree(1) for _ in range(width)]
            usable = np.sort(rng.choice(d, max(1, int(columns * d)), replace=False))
            open_ = [(k, 0) for k in range(width)]
            size = [1] * width
            for level in range(depth):
                if not open_:
                    break
                found = self._level(data, tasks, fresh, trees, open_, cuts, bins, t, share)
                picks = []
                for (k, node), hist in zip(open_, found):
                    own = usable
                    if p.get("max_features") in ("sqrt", "log2"):
                        own = np.sort(rng.choice(usable, min(len(usable), _features_per_split(p["max_features"], d)), replace=False))
                    best = self._best(hist, own, cuts, alpha, lam, least)
                    if level == 0:
                        trees[k].value[0][:] = rate * self._leaf(hist[:, own[0]].sum(axis=1), alpha, lam)
                    if best:
                        picks.append((best[0], k, node, best))
                open_ = []
                for _, k, node, (_, feature, bin_, left, right) in sorted(picks, key=lambda x: (-x[0], x[1], x[2])):
                    if size[k] >= leaves:
                        continue
                    child = trees[k].split(node, int(feature), float(cuts[feature][bin_]))
                    for c, sums in ((child, left), (child + 1, right)):
                        trees[k].value[c][:] = rate * self._leaf(sums, alpha, lam)
                        open_.append((k, c))
                    size[k] += 1
            forest.append(trees)
            fresh.append(trees)
            if len(fresh) == KEEP:
                data, fresh = self._stored_margins(data, fresh), []
        return Fitted(forest, self._predictor(forest, base, cls), self.has_probability, {"base": base})

    def _base(self, data: DataFrame, cls: bool, width: int) -> np.ndarray:
        if not cls:
            return np.array([data.agg(F.avg("y")).first()[0] or 0.0])
        counts = np.zeros(max(self.n_classes, 2))
        for r in data.groupBy("y").count().collect():  # one row a class
            counts[int(r.y)] = r["count"]
        prior = np.log(np.maximum(counts, 1e-9) / counts.sum())
        return prior if width > 1 else np.array([prior[1] - prior[0]])

    @staticmethod
    def _leaf(sums: np.ndarray, alpha: float, lam: float) -> float:
        g, h = sums
        return float(-soft_threshold(g, alpha) / (h + lam)) if h + lam > 0 else 0.0

    @staticmethod
    def _best(hist: np.ndarray, usable: np.ndarray, cuts: list[np.ndarray], alpha: float, lam: float, least: float):
        """(gain, feature, bin, left sums, right sums) of the best split of a node's (2, features, bins) sums, or None."""
        total = hist[:, usable[0]].sum(axis=1)
        left = hist.cumsum(axis=2)[:, :, :-1]
        right = total[:, None, None] - left
        score = lambda s: soft_threshold(s[0], alpha) ** 2 / np.maximum(s[1] + lam, 1e-12)
        gain = 0.5 * (score(left) + score(right) - score(total))
        real = np.arange(left.shape[2])[None, :] < np.array([len(c) for c in cuts])[:, None]
        fits = real & (left[1] >= least) & (right[1] >= least) & np.isin(np.arange(len(cuts)), usable)[:, None]
        gain = np.where(fits, gain, -np.inf)
        if not gain.size or gain.max() <= 1e-12:
            return None
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        return gain[f, b], f, b, left[:, f, b], right[:, f, b]

    def _level(self, data, tasks, fresh, trees, open_, cuts, bins, salt, share) -> list[np.ndarray]:
        """(2, features, bins) sums of gradients and second derivatives of each open node."""
        d = len(cuts)
        step = max(1, LIMIT // (2 * d * bins))
        out: list[np.ndarray] = []
        for low in range(0, len(open_), step):
            some = open_[low : low + step]

            def sums(x, m, of, y, seed, some=some):
                m = m + sum((np.concatenate([t.values_of(x) for t in r], axis=1) for r in fresh), np.zeros_like(m))
                if share < 1:
                    drawn = _drawn(seed, salt, share)
                    of, y = of[drawn], y[drawn]
                g, h = self._gradients(m, of, y)
                code = _codes(x, cuts) + np.arange(d) * bins
                total = np.zeros((len(some), 2, d * bins))
                where = {k: trees[k].nodes_of(x) for k in {k for k, _ in some}}
                for i, (k, node) in enumerate(some):
                    mine = np.flatnonzero(where[k] == node)
                    spots = code[mine].ravel()
                    for s, v in enumerate((g, h)):
                        total[i, s] = np.bincount(spots, weights=np.repeat(v[mine, k], d), minlength=d * bins)
                return total.ravel()

            out += list(totals(data, sums, tasks * len(some) * 2 * d * bins, read=_blocks).reshape(len(some), 2, d, bins))
        return out

    @staticmethod
    def _stored_margins(data: DataFrame, fresh: list[list[Tree]]) -> DataFrame:
        def run(batches):
            for b in batches:
                for i, (x, m, *_) in enumerate(_blocks(b)):
                    m = m + sum(np.concatenate([t.values_of(x) for t in r], axis=1) for r in fresh)
                    one = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), pa.array([m.ravel()], pa.list_(pa.float64())), *one.columns[2:]], names=b.schema.names)

        return cut(data.mapInArrow(run, data.schema))

    def _predictor(self, forest: list[list[Tree]], base: np.ndarray, cls: bool):
        def margins(x: np.ndarray) -> np.ndarray:
            return base + sum((np.concatenate([t.values_of(x) for t in r], axis=1) for r in forest), np.zeros((len(x), len(base))))

        return _scored(lambda x: self._probabilities(margins(x)) if cls else margins(x), cls)


def _scored(values: Callable[[np.ndarray], np.ndarray], cls: bool):
    """``predict`` of a function from rows to class probabilities or one value."""

    def predict(df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<double>")
        def of(rows: pd.Series) -> pd.Series:
            return pd.Series(list(values(np.stack([np.asarray(r, dtype=np.float64) for r in rows]))))

        out = df.withColumn("probability", of(to_array(FEATURES)))
        if not cls:
            return out.withColumn("prediction", F.col("probability")[0]).drop("probability")
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", best.cast("double"))

    return predict


# ------------------------------------------------------------------ extra trees
class ExtraTrees(Learner):
    """M7: extremely randomised trees.  All rows grow every tree; a node draws some features and, of each, one threshold
    between the least and largest value in the node, and takes the best of these by Gini or variance."""

    name = "extra trees"

    def __init__(self, task, params=None, n_classes=2, seed=42):
        super().__init__(task, params, n_classes, seed)
        self.has_probability = task == "classification"

    def fit(self, train: DataFrame) -> Fitted:
        p, cls = self.params, self.task == "classification"
        count, depth = int(p.get("n_estimators", 100)), int(p.get("max_depth", 10))
        least = int(p.get("min_samples_split", 2))
        data = _training(train)
        d = data.select(F.size("x")).first()[0]
        width = max(self.n_classes, 2) if cls else 2  # class counts, or rows and sum of y
        per = _features_per_split(p.get("max_features", "sqrt" if cls else None), d)
        rng = np.random.default_rng(self.seed)
        trees = [Tree(width) for _ in range(count)]
        tasks = tasks_of(data)
        whole = totals(data, lambda x, y, seed: self._stats(y, np.ones((1, len(y)), bool), width).ravel(), tasks * max(width, 3))
        for tree in trees:
            tree.value[0] = whole[:width]
        open_ = [(t, 0, float(whole[:width].sum() if cls else whole[0])) for t in range(count)]
        for _ in range(depth):
            open_ = [(t, n) for t, n, rows in open_ if rows >= least and self._impure(trees[t].value[n])]
            if not open_:
                break
            chosen = [np.sort(rng.choice(d, min(per, d), replace=False)) for _ in open_]
            low, high = self._bounds(data, tasks, trees, open_, chosen)
            at = low + (high - low) * rng.random(low.shape)
            sums = self._sides(data, tasks, trees, open_, chosen, at, width)
            grown = []
            for (t, node), features, cut_, some, lo, hi in zip(open_, chosen, at, sums, low, high):
                scores = [self._score(s, whole_) if h > l else -np.inf for s, whole_, l, h in zip(some, [some[0].sum(axis=0)] * len(some), lo, hi)]
                best = int(np.argmax(scores))
                if not np.isfinite(scores[best]):
                    continue
                child = trees[t].split(node, int(features[best]), float(cut_[best]))
                for c, side in ((child, some[best][0]), (child + 1, some[best][1])):
                    trees[t].value[c] = side[:width]
                    grown.append((t, c, float(side[:width].sum() if cls else side[0])))
            open_ = grown
        for tree in trees:
            tree.value = [v / max(v.sum(), 1e-12) if cls else np.array([v[1] / max(v[0], 1e-12)]) for v in tree.value]
        return Fitted(trees, _scored(lambda x: sum(t.values_of(x) for t in trees) / count, cls), self.has_probability)

    def _stats(self, y: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
        """Of every mask its class counts, or rows, sum and sum of squares of y."""
        parts = (y[:, None] == np.arange(width)).astype(float) if self.task == "classification" else np.stack([np.ones_like(y), y, y * y], axis=1)
        return mask.astype(float) @ parts

    def _grouped(self, group: np.ndarray, y: np.ndarray, groups: int, k: int) -> np.ndarray:
        """The same of each group of rows: (groups, k)."""
        if self.task == "classification":
            known = (y >= 0) & (y < k) & (y == np.floor(y))
            return np.bincount(group[known] * k + y[known].astype(np.int64), minlength=groups * k).reshape(groups, k)
        return np.stack([np.bincount(group, weights=w, minlength=groups) for w in (None, y, y * y)], axis=1)

    def _impure(self, value: np.ndarray) -> bool:
        return self.task != "classification" or np.count_nonzero(value) > 1

    def _score(self, sides: np.ndarray, whole: np.ndarray) -> float:
        """What a split takes off the impurity; -inf if a side is empty."""
        if self.task == "classification":
            rows = sides.sum(axis=1)
            return -np.inf if (rows == 0).any() else float((sides**2 / rows[:, None]).sum())
        rows = sides[:, 0]
        return -np.inf if (rows == 0).any() else float((sides[:, 1] ** 2 / rows).sum())

    def _chunks(self, open_: list, numbers: int) -> Iterator[slice]:
        step = max(1, LIMIT // numbers)
        for low in range(0, len(open_), step):
            yield slice(low, low + step)

    def _bounds(self, data, tasks, trees, open_, chosen) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value in each open node of its drawn features."""
        found, per = [], len(chosen[0])
        for part in self._chunks(open_, 2 * per):
            some, own = open_[part], chosen[part]

            def ends(x, y, seed, some=some, own=own):
                out = np.full((len(some), 2, per), -np.inf)
                where = {t: trees[t].nodes_of(x) for t in {t for t, _ in some}}
                for i, ((t, node), features) in enumerate(zip(some, own)):
                    mine = x[where[t] == node][:, features]
                    if len(mine):
                        out[i] = -mine.min(axis=0), mine.max(axis=0)
                return np.maximum(out, -1e300).ravel()

            found.append(totals(data, ends, tasks * len(some) * 2 * per, "max").reshape(len(some), 2, per))
        found = np.concatenate(found)
        return -found[:, 0], found[:, 1]

    def _sides(self, data, tasks, trees, open_, chosen, at, width) -> np.ndarray:
        """(nodes, drawn features, 2 sides, statistics) for the thresholds ``at``."""
        found, per, k = [], len(chosen[0]), width if self.task == "classification" else 3
        for part in self._chunks(open_, 2 * per * k):
            some, drawn_, limits = open_[part], np.array(chosen[part]), at[part]

            def sums(x, y, seed, some=some, drawn_=drawn_, limits=limits):
                out = np.zeros((len(some), per, 2, k))
                first = 0
                while first < len(some):  # the nodes of a tree stand together
                    t = some[first][0]
                    last = first + sum(u == t for u, _ in some[first:])
                    place = np.full(len(trees[t].left), -1)
                    place[[node for _, node in some[first:last]]] = np.arange(first, last)
                    at_node = place[trees[t].nodes_of(x)]
                    mine = np.flatnonzero(at_node >= 0)
                    at_node, yt = at_node[mine], y[mine]
                    for j in range(per):
                        side = 2 * (at_node - first) + (x[mine, drawn_[at_node, j]] > limits[at_node, j])
                        out[first:last, j] = self._grouped(side, yt, 2 * (last - first), k).reshape(-1, 2, k)
                    first = last
                return out.ravel()

            found.append(totals(data, sums, tasks * len(some) * per * 2 * k).reshape(len(some), per, 2, k))
        return np.concatenate(found)
