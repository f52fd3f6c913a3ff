"""Round-by-round learners built from Spark aggregations: AdaBoost with binned
stumps (M6) and bagging of decision trees (M8).  Each round is one aggregation job;
the driver keeps only k x d numbers."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutml.functions.vectors import lit_array, to_array
from scoutml.operators.models.base import FEATURES, LABEL, Fitted, Learner, argmax_code
from scoutml.session import cut


# ------------------------------------------------------------------ AdaBoost
def _bins(train: DataFrame, d: int, n_bins: int = 32) -> list[list[float]]:
    arr = train.select(*[to_array(FEATURES)[j].alias(f"f{j}") for j in range(d)])
    probs = [i / n_bins for i in range(1, n_bins)]
    qs = arr.approxQuantile([f"f{j}" for j in range(d)], probs, 0.001)
    return [sorted(set(q)) for q in qs]


def _stump_expr(x: Column, feat: int, thr: float, left, right) -> Column:
    return F.when(x[feat] <= F.lit(thr), F.lit(left)).otherwise(F.lit(right))


class AdaBoost(Learner):
    """M6.  Classification: SAMME, err = sum w[miss]/sum w, alpha = rate*(ln((1-err)/err)
    + ln(K-1)), w *= exp(alpha [miss]); stops at err = 0 or err >= 1 - 1/K.
    Regression: AdaBoost.R2 (linear loss) with weighted-median prediction.
    The base learner is a one-split tree on quantile bins, found from one
    grouped weighted count per round."""

    name = "adaboost"

    def fit(self, train: DataFrame) -> Fitted:
        p = self.params
        rounds = int(p.get("n_estimators", 50))
        rate = float(p.get("learning_rate", 1.0))
        x = to_array(FEATURES)
        d = train.select(F.size(x)).first()[0]
        bins = _bins(train, d)
        cls = self.task == "classification"
        k = max(self.n_classes, 2)
        base = train.select(x.alias("x"), F.col(LABEL).alias("y"))
        def bin_of(j: int) -> Column:
            if not bins[j]:
                return F.lit(0)
            xj = F.col("x")[j]
            return F.aggregate(lit_array(bins[j]), F.lit(0), lambda a, b: a + (xj > b).cast("int"))

        bin_cols = [bin_of(j) for j in range(d)]
        base = cut(base.withColumn("b", F.array(*bin_cols)).withColumn("w", F.lit(1.0)))
        stumps: list[tuple] = []
        cur = base
        for t in range(rounds):
            long = cur.select("y", "w", F.posexplode("b").alias("j", "bin"))
            if cls:
                agg = long.groupBy("j", "bin", "y").agg(F.sum("w").alias("sw")).collect()
                best = self._best_cls_split(agg, bins, k)
            else:
                agg = long.groupBy("j", "bin").agg(
                    F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"),
                    F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy")).collect()
                best = self._best_reg_split(agg, bins)
            if best is None:
                break
            feat, thr, left, right = best[:4]
            pred = _stump_expr(F.col("x"), feat, thr, left, right)
            if cls:
                miss = (pred != F.col("y")).cast("double")
                err = best[4]  # from the same grouped weights: no extra pass
                if err <= 0:
                    stumps.append((feat, thr, left, right, 1.0))
                    break
                if err >= 1 - 1.0 / k:
                    if not stumps:
                        raise ValueError("base learner worse than chance")
                    break
                a = rate * (math.log((1 - err) / err) + math.log(k - 1))
                stumps.append((feat, thr, left, right, a))
                # new total (relative to 1) = (1 - err) + err * e^a: normalise without a pass
                cur = cur.withColumn("w", F.col("w") * F.exp(F.lit(a) * miss) / F.lit((1 - err) + err * math.exp(a)))
                if (t + 1) % 25 == 0:
                    cur = cut(cur)
                continue
            else:
                ae = F.abs(pred - F.col("y"))
                mx = cur.agg(F.max(ae)).first()[0] or 0.0
                if mx == 0:
                    stumps.append((feat, thr, left, right, 1.0))
                    break
                lin = ae / F.lit(mx)
                err = cur.agg((F.sum(F.col("w") * lin) / F.sum("w")).alias("e")).first()["e"]
                if err >= 0.5:
                    if not stumps:
                        stumps.append((feat, thr, left, right, 1.0))
                    break
                beta = err / (1 - err)
                a = rate * math.log(1 / beta) if beta > 0 else 1.0
                stumps.append((feat, thr, left, right, a))
                if beta <= 0:
                    break
                nxt = cur.withColumn("w", F.col("w") * F.pow(F.lit(beta), F.lit(rate) * (1 - lin)))
            norm = nxt.agg(F.sum("w")).first()[0]
            cur = nxt.withColumn("w", F.col("w") / F.lit(norm))
            if (t + 1) % 10 == 0:
                cur = cut(cur)
        return Fitted(stumps, self._predictor(stumps, cls, k))

    @staticmethod
    def _best_cls_split(rows, bins, k):
        best, best_imp = None, None
        by_feat: dict[int, dict[int, np.ndarray]] = {}
        for r in rows:
            by_feat.setdefault(r["j"], {}).setdefault(r["bin"], np.zeros(k))[int(r["y"])] += r["sw"]
        for j, per_bin in by_feat.items():
            nb = len(bins[j])
            mat = np.zeros((nb + 1, k))
            for b, v in per_bin.items():
                mat[b] = v
            cum = np.cumsum(mat, axis=0)
            tot = cum[-1]
            for b in range(nb):
                lft, rgt = cum[b], tot - cum[b]
                wl, wr = lft.sum(), rgt.sum()
                if wl <= 0 or wr <= 0:
                    continue
                imp = wl * (1 - ((lft / wl) ** 2).sum()) + wr * (1 - ((rgt / wr) ** 2).sum())
                if best_imp is None or imp < best_imp - 1e-12:
                    best_imp = imp
                    cl, cr = int(np.argmax(lft)), int(np.argmax(rgt))
                    err = ((wl - lft[cl]) + (wr - rgt[cr])) / (wl + wr)
                    best = (j, float(bins[j][b]), float(cl), float(cr), float(err))
        if best is None and by_feat:
            tot = sum(v for per in by_feat[min(by_feat)].values() for v in [per])
            c = int(np.argmax(tot))
            best = (0, float("inf"), float(c), float(c), float(1 - tot[c] / tot.sum()))
        return best

    @staticmethod
    def _best_reg_split(rows, bins):
        best, best_sse = None, None
        by_feat: dict[int, dict[int, np.ndarray]] = {}
        for r in rows:
            by_feat.setdefault(r["j"], {})[r["bin"]] = np.array([r["sw"], r["swy"], r["swyy"]])
        for j, per_bin in by_feat.items():
            nb = len(bins[j])
            mat = np.zeros((nb + 1, 3))
            for b, v in per_bin.items():
                mat[b] = v
            cum = np.cumsum(mat, axis=0)
            tot = cum[-1]
            for b in range(nb):
                lft, rgt = cum[b], tot - cum[b]
                if lft[0] <= 0 or rgt[0] <= 0:
                    continue
                sse = (lft[2] - lft[1] ** 2 / lft[0]) + (rgt[2] - rgt[1] ** 2 / rgt[0])
                if best_sse is None or sse < best_sse - 1e-12:
                    best_sse = sse
                    best = (j, float(bins[j][b]), float(lft[1] / lft[0]), float(rgt[1] / rgt[0]))
        if best is None and by_feat:
            tot = sum(by_feat[min(by_feat)].values())
            m = float(tot[1] / tot[0])
            best = (0, float("inf"), m, m)
        return best

    @staticmethod
    def _predictor(stumps, cls, k):
        def predict(df: DataFrame) -> DataFrame:
            x = to_array(FEATURES)
            if cls:
                votes = F.array(*[
                    sum((F.when(_stump_expr(x, f, t, l, r) == F.lit(float(c)), F.lit(a)).otherwise(F.lit(0.0))
                         for f, t, l, r, a in stumps), F.lit(0.0))
                    for c in range(k)
                ])
                return df.withColumn("prediction", argmax_code(votes, list(range(k))))
            preds = F.array(*[F.struct(_stump_expr(x, f, t, l, r).alias("p"), F.lit(a).alias("a")) for f, t, l, r, a in stumps])
            srt = F.array_sort(preds)
            total = float(sum(s[4] for s in stumps))
            cums = F.transform(srt, lambda s, i: F.aggregate(F.slice(srt, 1, i + 1), F.lit(0.0), lambda acc, e: acc + e["a"]))
            idx = F.array_position(F.transform(cums, lambda c: c >= F.lit(0.5 * total)), True)
            return df.withColumn("prediction", F.element_at(srt, idx.cast("int"))["p"])

        return predict


# ------------------------------------------------------------------ bagging
class Bagging(Learner):
    """M8: each member is a decision tree on a bootstrap sample of max_samples
    rows and a random max_features share of the columns; members are fitted in
    parallel driver threads; vote (ties -> lowest class) or mean."""

    name = "bagging"

    def fit(self, train: DataFrame) -> Fitted:
        p = self.params
        m = int(p.get("n_estimators", 10))
        frac = float(p.get("max_samples", 1.0))
        feat_frac = float(p.get("max_features", 1.0))
        d = train.select(F.size(to_array(FEATURES))).first()[0]
        rng = np.random.default_rng(self.seed)
        subsets = [sorted(rng.choice(d, size=max(1, int(feat_frac * d)), replace=False).tolist()) for _ in range(m)]
        cls = self.task == "classification"

        def one(i):
            sl = VectorSlicer(inputCol=FEATURES, outputCol=f"_s{i}", indices=subsets[i])
            sample = sl.transform(train.sample(withReplacement=True, fraction=frac, seed=self.seed + i))
            est = (DecisionTreeClassifier if cls else DecisionTreeRegressor)(
                featuresCol=f"_s{i}", labelCol=LABEL, predictionCol=f"_p{i}", seed=self.seed + i, maxDepth=30)
            if cls:
                est = est.setProbabilityCol(f"_pr{i}").setRawPredictionCol(f"_r{i}")
            return sl, est.fit(sample)

        with ThreadPoolExecutor(max_workers=4) as pool:
            members = list(pool.map(one, range(m)))
        k = self.n_classes

        def predict(df: DataFrame) -> DataFrame:
            out = df
            for i, (sl, model) in enumerate(members):
                out = model.transform(sl.transform(out))
                drop = [f"_s{i}"] + ([f"_pr{i}", f"_r{i}"] if cls else [])
                out = out.drop(*drop)
            preds = [F.col(f"_p{i}") for i in range(m)]
            if cls:
                votes = F.array(*[sum(((p_ == F.lit(float(c))).cast("double") for p_ in preds), F.lit(0.0)) for c in range(k)])
                res = argmax_code(votes, list(range(k)))
            else:
                res = sum(preds, F.lit(0.0)) / F.lit(float(m))
            return out.withColumn("prediction", res).drop(*[f"_p{i}" for i in range(m)])

        return Fitted(members, predict)
