"""Linear models by stochastic gradient descent with averaged state (M17), and kernel SVR.

One round is one Spark job: every task walks its rows once in mini-batches from
the common weights and gives back the mean of its later weights, its row count
and the objective of the weights it started from; Spark adds these up (rows as
weights) and the driver keeps one (classes x features) matrix.  Features and a
regression target are standardised inside, so unequal scales do not matter; the
penalty acts on standardised weights.

Rounds end by the objective: after ``PATIENCE`` rounds without a gain of ``tol``
(the "adaptive" schedule divides its step by 5 then and ends when it is small),
or after ``max_iter`` rounds.  The weights with the lowest objective are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import dot, lit_array, to_array
from scoutml.operators.models.base import FEATURES, LABEL, Fitted, Learner, added, argmax_code, tasks_of
from scoutml.session import cut

BATCH, PATIENCE, TOL = 32, 5, 1e-4
#: rows whose features are made at once: whole batches that stay in the processor's cache
STRETCH = 16 * BATCH
#: share of the last step that the next goes on with, so that features that nearly depend on each other are told apart
MOMENTUM = 0.9
#: random features of the rbf kernel; most monomials of the cubic kernel
FOURIER, MONOMIALS = 256, 5000
#: bound on a loss's second derivative, for the largest stable step
_CURVATURE = {"log_loss": 0.25, "modified_huber": 2.0}

Features = Callable[[np.ndarray], np.ndarray]


def loss_and_slope(loss: str, m: np.ndarray, y: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of margins (or predictions) ``m`` and its derivative by ``m``; y is -1 or 1 for classes."""
    z = y * m
    if loss == "hinge":
        return np.maximum(0, 1 - z), np.where(z < 1, -y, 0.0)
    if loss == "log_loss":
        return np.logaddexp(0, -z), -y / (1 + np.exp(np.minimum(z, 500)))
    if loss == "modified_huber":
        return np.where(z >= -1, np.maximum(0, 1 - z) ** 2, -4 * z), np.where(z >= 1, 0.0, np.where(z >= -1, -2 * y * (1 - z), -4 * y))
    r = m - y
    if loss == "huber":
        near = np.abs(r) <= eps
        return np.where(near, r * r / 2, eps * np.abs(r) - eps * eps / 2), np.where(near, r, eps * np.sign(r))
    if loss == "epsilon_insensitive":
        return np.maximum(0, np.abs(r) - eps), np.where(np.abs(r) <= eps, 0.0, np.sign(r))
    return r * r / 2, r


class Schedule:
    """Step sizes by the number of steps: ``optimal`` 1 / (alpha (t0 + t)), ``invscaling`` eta0 / t^0.25, ``adaptive`` a constant
    that is divided by 5 where the objective stalls; none above ``largest``, the step at which a batch stays stable."""

    def __init__(self, kind: str, alpha: float, loss: str, largest: float):
        self.kind, self.alpha, self.largest = kind, alpha, largest
        self.constant = largest
        alpha = self.alpha = max(alpha, 1e-12)
        typical = math.sqrt(1.0 / math.sqrt(alpha))
        slope = float(loss_and_slope(loss, np.array(-typical), np.array(1.0), 0.1)[1])
        self.t0 = max(1.0, abs(slope)) / (typical * alpha)

    def steps(self, t: np.ndarray) -> np.ndarray:
        if self.kind == "optimal":
            eta = 1.0 / (self.alpha * (self.t0 + t))
        elif self.kind == "invscaling":
            eta = self.largest / np.power(np.maximum(t, 1.0), 0.25)
        else:
            eta = np.full(len(t), self.constant)
        return np.minimum(eta, self.largest)

    def stalled(self) -> bool:
        """Whether the objective's stall ends the run."""
        if self.kind != "adaptive" or self.constant < 2e-3 * self.largest:
            return True
        self.constant /= 5
        return False


def _arrays(batch: pa.RecordBatch, phi: Features | None) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
    return (phi(x) if phi else x), batch.column(1).to_numpy()


def _summed(data: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], numbers: int) -> np.ndarray:
    """The sum over tasks of the vector that ``run`` gives; ``numbers``: of all tasks'."""

    def rows(batches):
        for v in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64()))], names=["v"])

    return added(data.mapInArrow(rows, "v array<double>"), numbers)


def moments(data: DataFrame, phi: Features | None, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and standard deviations of (features..., target), by sums."""

    def run(batches):
        total = None
        for b in batches:
            x, y = _arrays(b, None) if b.num_rows else ((), ())
            for low in range(0, len(x), STRETCH):
                part = x[low : low + STRETCH]
                z = np.column_stack([phi(part) if phi else part, y[low : low + STRETCH]])
                v = np.concatenate([[len(z)], z.sum(0), (z * z).sum(0)])
                total = v if total is None else total + v
        if total is not None:
            yield total

    total = _summed(data, run, tasks_of(data) * (2 * width + 3))
    n, k = total[0], (len(total) - 1) // 2
    mean = total[1 : 1 + k] / n
    sd = np.sqrt(np.maximum(total[1 + k :] / n - mean * mean, 0))
    return n, mean, np.where(sd > 1e-9 * np.maximum(1.0, np.abs(mean)), sd, 1.0)


class LinearSGD(Learner):
    """mean loss + alpha / 2 |w|^2.  More than two classes: one margin each against the rest, in the same pass."""

    name = "sgd"

    def features(self, data: DataFrame) -> Features | None:
        """A map of rows to other features; None: as they are."""
        return None

    def penalty(self, n: float) -> float:
        return float(self.params.get("alpha", 1e-4))

    def fit(self, train: DataFrame) -> Fitted:
        p, cls = self.params, self.task == "classification"
        loss = p.get("loss", "hinge" if cls else "squared_error")
        data = cut(train.select(to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y")))
        phi = self.features(data)
        raw = data.select(F.size("x")).first()[0]
        width = phi(np.zeros((1, raw))).shape[1] if phi else raw
        tasks = tasks_of(data)
        n, mean, sd = moments(data, phi, width)
        alpha = self.penalty(n)
        shift, scale = (0.0, 1.0) if cls else (mean[-1], sd[-1])
        eps = float(p.get("epsilon", 0.1)) / scale
        mean, sd = mean[:-1], sd[:-1]
        d, k = len(mean), self.n_classes if cls and self.n_classes > 2 else 1
        codes = np.arange(k) if k > 1 else np.array([1])
        largest = 1.0 / (_CURVATURE.get(loss, 1.0) * (d + 1) + alpha)
        schedule = Schedule(p.get("learning_rate", "optimal" if cls else "invscaling"), alpha, loss, largest)
        w, best, low, waited, steps = np.zeros((k, d + 1)), None, math.inf, 0, 0.0

        def standard(x: np.ndarray) -> np.ndarray:
            out = np.ones((len(x), d + 1))
            np.subtract(phi(x) if phi else x, mean, out=out[:, :d])
            out[:, :d] /= sd
            return out

        def walk(start: np.ndarray, done: float):
            def run(batches):
                now, mean_w, move, kept, rows, cost, t = start.copy(), np.zeros_like(start), np.zeros_like(start), 0, 0, 0.0, done
                for b in batches:
                    if not b.num_rows:
                        continue
                    whole, label = _arrays(b, None)
                    label = np.where(label[:, None] == codes, 1.0, -1.0) if cls else ((label - shift) / scale)[:, None]
                    rows += len(whole)
                    etas = schedule.steps(t + np.arange(-(-len(whole) // BATCH)))
                    for at in range(0, len(whole), STRETCH):
                        x, y = standard(whole[at : at + STRETCH]), label[at : at + STRETCH]
                        cost += loss_and_slope(loss, x @ start.T, y, eps)[0].sum()
                        for low_, eta in zip(range(0, len(x), BATCH), etas[at // BATCH :]):
                            xb, yb = x[low_ : low_ + BATCH], y[low_ : low_ + BATCH]
                            ahead = now + MOMENTUM * move
                            slope = loss_and_slope(loss, xb @ ahead.T, yb, eps)[1].T @ xb / len(xb)
                            slope[:, :d] += alpha * ahead[:, :d]
                            move = MOMENTUM * move - eta * slope
                            now = now + move
                            mean_w += now
                            kept += 1
                    t += len(etas)
                if rows:
                    # with few steps in a task the last weights are ahead of their mean
                    last = now if kept < 20 else mean_w / kept
                    yield np.concatenate([[rows, cost, rows * (t - done)], (last * rows).ravel()])

            return run

        for _ in range(max(1, int(p.get("max_iter", 1000)))):
            total = _summed(data, walk(w, steps), tasks * (3 + w.size))
            value = total[1] / total[0] + alpha / 2 * float((w[:, :d] ** 2).sum())
            if value < low - TOL * max(abs(low), 1e-12) if math.isfinite(low) else True:
                waited = 0
            else:
                waited += 1
            if value < low:
                best, low = w, value
            if waited >= PATIENCE:
                if schedule.stalled():
                    break
                waited, w = 0, best
                continue
            w = total[3:].reshape(k, d + 1) / total[0]
            steps += total[2] / total[0]
        w = best if best is not None else w
        coef = w[:, :d] / sd * scale
        bias = (w[:, d] - (w[:, :d] * (mean / sd)).sum(axis=1)) * scale + shift
        info = {"objective": low, "coef": coef, "bias": bias}
        return Fitted(w, self._predictor(coef, bias, phi, cls, k), info=info)

    @staticmethod
    def _predictor(coef, bias, phi, cls, k):
        def predict(df: DataFrame) -> DataFrame:
            x = to_array(FEATURES)
            if phi is None:
                margins = F.array(*[dot(x, lit_array(coef[c])) + F.lit(float(bias[c])) for c in range(k)])
            else:
                @F.pandas_udf("array<double>")
                def margins_of(rows: pd.Series) -> pd.Series:
                    z = phi(np.stack([np.asarray(r, dtype=np.float64) for r in rows]))
                    return pd.Series(list(z @ coef.T + bias))

                margins = margins_of(x)
            out = df.withColumn("_margins", margins)
            m = F.col("_margins")
            if not cls:
                pred = m[0]
            elif k == 1:
                pred = F.when(m[0] > 0, F.lit(1.0)).otherwise(F.lit(0.0))
            else:
                pred = argmax_code(m, list(range(k)))
            return out.withColumn("prediction", pred.cast("double")).drop("_margins")

        return predict


class KernelSVR(LinearSGD):
    """M11 regression: C sum of the epsilon-insensitive loss + |w|^2 / 2, so alpha = 1 / (C n).  The rbf kernel is ``FOURIER``
    random cosines, the cubic kernel its monomials; ``gamma`` "scale" is 1 / (d var(x)), "auto" 1 / d."""

    name = "svm"

    def __init__(self, task, params=None, n_classes=2, seed=42):
        super().__init__(task, {"learning_rate": "adaptive", **(params or {}), "loss": "epsilon_insensitive"}, n_classes, seed)

    def penalty(self, n: float) -> float:
        return 1.0 / (float(self.params.get("C", 1.0)) * n)

    def features(self, data: DataFrame) -> Features | None:
        kernel = self.params.get("kernel", "rbf")
        if kernel == "linear":
            return None
        d = data.select(F.size("x")).first()[0]
        if kernel == "poly":
            if math.comb(d + 2, 3) > MONOMIALS:
                raise ValueError(f"the cubic kernel of {d} features has more than {MONOMIALS} monomials")
            places = np.array(list(itertools.combinations_with_replacement(range(d), 3)))
            return lambda x: x[:, places].prod(axis=2)
        if kernel != "rbf":
            raise ValueError(f"no such kernel: {kernel}")
        gamma = self.params.get("gamma", "scale")
        if gamma == "scale":
            var = data.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
            gamma = 1.0 / (d * var)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, math.sqrt(2 * (1.0 / d if gamma == "auto" else float(gamma))), size=(d, FOURIER))
        b = rng.uniform(0, 2 * math.pi, size=FOURIER)

        def cosines(x: np.ndarray) -> np.ndarray:
            z = x @ w
            z += b
            np.cos(z, out=z)
            z *= math.sqrt(2.0 / FOURIER)
            return z

        return cosines
