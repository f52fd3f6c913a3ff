"""Cross-validation folds and fold metrics.

Unshuffled folds follow row order, as the reference's splitter does.  The row
order comes from the skew-safe ranking, so no global single-partition window
is used even for one huge class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutml.operators.ranking import with_rank


def _block_fold(r: Column, n: Column, k: int) -> Column:
    """Fold of 0-based position r among n rows cut into k contiguous blocks;
    the first n % k blocks hold one extra row."""
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    return F.when(r < big, F.floor(r / (q + 1))).otherwise(m + F.floor((r - big) / q)).cast("int")


def kfold(df: DataFrame, order_col: str, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Contiguous, unshuffled k folds by ``order_col`` (KFold)."""
    ranked = with_rank(df, [order_col], name="_r")
    n = ranked.agg(F.count(F.lit(1))).first()[0]
    return ranked.withColumn(fold_col, _block_fold(F.col("_r"), F.lit(n), k)).drop("_r")


def hash_fold(df: DataFrame, key_col: str, k: int = 5, fold_col: str = "fold", seed: int = 42) -> DataFrame:
    """Shuffled folds at scale: a hash of the key, no sort at all."""
    return df.withColumn(fold_col, F.pmod(F.xxhash64(F.col(key_col), F.lit(seed)), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, order_col: str, label_col: str, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Unshuffled stratified folds (StratifiedKFold allocation).

    Classes are taken in sorted order; in the sorted label sequence fold i owns
    positions i, i+k, i+2k, ...; class c (positions [s_c, s_c+n_c)) therefore
    gives fold i  #{p in [s_c, s_c+n_c): p = i mod k}  rows, and the rows of the
    class go to the folds in row order, fold 0 first.
    """
    ranked = with_rank(df, [order_col], [label_col], name="_r")
    sizes = ranked.groupBy(label_col).agg((F.max("_r") + 1).alias("_n"))
    # one row per class: a tiny window
    w = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(w), F.lit(0)))

    def share(i: int) -> Column:
        a, b = F.col("_s"), F.col("_s") + F.col("_n")
        return F.floor((b - 1 - i) / k) - F.floor((a - 1 - i) / k)

    cum = []
    total = F.lit(0)
    for i in range(k):
        total = total + share(i)
        cum.append(total.alias(f"_c{i}"))
    sizes = sizes.select(label_col, *cum)
    sizes = sizes.withColumnRenamed(label_col, "_label")  # a null label is a class of its own
    joined = ranked.join(sizes, ranked[label_col].eqNullSafe(sizes["_label"])).drop("_label")
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(F.col("_r") < F.col(f"_c{i}"), F.lit(i)).otherwise(fold)
    return joined.withColumn(fold_col, fold.cast("int")).drop("_r", *[f"_c{i}" for i in range(k)])


# C4 / C5 / C9 -------------------------------------------------------------------
def fold_accuracy(pred: DataFrame, fold_col: str = "fold", label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    return pred.groupBy(fold_col).agg(
        F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("metric")
    )


def fold_rmse(pred: DataFrame, fold_col: str = "fold", label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    return pred.groupBy(fold_col).agg(
        F.sqrt(F.avg(F.pow(F.col(pred_col) - F.col(label_col), 2))).alias("metric")
    )


def cv_mean(per_fold: DataFrame, digits: int = 6) -> DataFrame:
    """Per-fold metric, then the plain mean over folds, rounded."""
    return per_fold.agg(F.round(F.avg("metric"), digits).alias("cv_score"), F.count(F.lit(1)).alias("n_folds"))
