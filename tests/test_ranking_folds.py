import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoutml.operators import folds, prepare
from scoutml.operators.ranking import with_rank


def _frame(spark, rng, n=600):
    # one group holds a third of all rows (skew)
    g = np.where(rng.random(n) < 1 / 3, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "g": g, "v": v})), g, v


def test_rank_global_and_grouped(spark, rng):
    df, g, v = _frame(spark, rng)
    got = with_rank(df, ["v", "id"], name="r").toPandas().sort_values("id")
    assert (got["r"].to_numpy() == pd.Series(v).rank(method="first").to_numpy() - 1).all()
    got = with_rank(df, ["id"], ["g"], name="r").toPandas().sort_values("id")
    exp = pd.DataFrame({"g": g}).groupby("g").cumcount().to_numpy()
    assert (got["r"].to_numpy() == exp).all()


def test_rank_independent_of_partitions(spark, rng):
    df, _, _ = _frame(spark, rng)
    a = with_rank(df, ["id"], ["g"], name="r", num_partitions=3).toPandas().sort_values("id")["r"].to_numpy()
    b = with_rank(df.repartition(11), ["id"], ["g"], name="r", num_partitions=17).toPandas().sort_values("id")["r"].to_numpy()
    assert (a == b).all()


def test_kfold_contiguous(spark):
    df = spark.range(23).withColumnRenamed("id", "row_id")
    got = folds.kfold(df, "row_id", 5).toPandas().sort_values("row_id")["fold"].tolist()
    assert got == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_stratified_allocation(spark, rng):
    y = rng.choice([0, 1, 2], 103, p=[0.6, 0.3, 0.1])
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(y)), "y": y}))
    got = folds.stratified_kfold(df, "row_id", "y", 5).toPandas().sort_values("row_id")
    # rule: in sorted label order fold i owns positions i, i+5, ...; class rows fill folds in row order
    srt = np.sort(y)
    alloc = np.array([np.bincount(srt[i::5], minlength=3) for i in range(5)])
    exp = np.empty(len(y), dtype=int)
    for c in range(3):
        exp[y == c] = np.repeat(np.arange(5), alloc[:, c])
    assert (got["fold"].to_numpy() == exp).all()
    # folds partition the rows
    assert got["fold"].between(0, 4).all() and len(got) == len(y)


def test_label_codes_bijection(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    out = prepare.label_encode(df, ["s"]).toPandas()["s"].tolist()
    # sorted distinct: a, b, c, nan
    assert sorted(set(out)) == [0, 1, 2, 3]
    assert out == [1, 0, 3, 2, 0]


def test_exact_median(spark, rng):
    v = rng.normal(size=101).tolist() + [None] * 5
    w = rng.integers(0, 10, size=106).astype(float).tolist()
    df = spark.createDataFrame(list(zip(v, w)), "a double, b double")
    med = {r["column"]: r["median"] for r in prepare.exact_medians(df, ["a", "b"]).collect()}
    assert abs(med["a"] - np.median([x for x in v if x is not None])) < 1e-12
    assert abs(med["b"] - np.median(w)) < 1e-12
    filled = prepare.impute_median(df, ["a"]).where(F.col("a").isNull()).count()
    assert filled == 0


def test_expansion_slice_matches_spark(spark):
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler

    df = spark.createDataFrame([(2.0, 3.0, 5.0, 7.0)], "a double, b double, c double, d double")
    v = VectorAssembler(inputCols=list("abcd"), outputCol="v").transform(df)
    ex = PolynomialExpansion(degree=2, inputCol="v", outputCol="p").transform(v).first()["p"].toArray()
    got = [ex[i] for i in prepare.expansion_slice(4)]
    x = [2.0, 3.0, 5.0, 7.0]
    assert got == x + [x[i] * x[j] for i in range(4) for j in range(i + 1, 4)]


def test_anova_and_fregression(spark, rng):
    n = 200
    y = rng.integers(0, 3, n)
    x1 = y + rng.normal(size=n)
    x2 = rng.normal(size=n)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "y": y, "t": 2 * x1 + rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    sc = prepare.anova_f_scores(df, ["x1", "x2"], "y").toPandas().sort_values("position")
    for j, c in enumerate(["x1", "x2"]):
        groups = [pdf.loc[pdf.y == k, c] for k in range(3)]
        m = pdf[c].mean()
        ssb = sum(len(gg) * (gg.mean() - m) ** 2 for gg in groups)
        ssw = sum(((gg - gg.mean()) ** 2).sum() for gg in groups)
        assert abs(sc["f_score"].iloc[j] - (ssb / 2) / (ssw / (n - 3))) < 1e-6
    assert sc.loc[sc.feature == "x1", "selected"].iloc[0]
    fr = prepare.f_regression_scores(df, ["x1", "x2"], "t").toPandas().sort_values("position")
    r = np.corrcoef(pdf.x1, pdf.t)[0, 1]
    assert abs(fr["f_score"].iloc[0] - r * r / (1 - r * r) * (n - 2)) < 1e-6 * fr["f_score"].iloc[0]


def test_covariance_narrow_and_wide(spark, rng):
    for d in (3, 12):
        x = rng.normal(size=(150, d)) @ rng.normal(size=(d, d))
        cols = [f"c{j}" for j in range(d)]
        df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
        cov, mean, n = prepare.covariance_matrix(df, cols)
        assert n == 150 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False), atol=1e-8)
        _, ratios = prepare.pca_components(cov, 2)
        ev = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
        assert np.allclose(ratios, ev[:2] / ev.sum())


def test_soft_vote_accuracy_is_that_of_votes_joined_with_labels(spark):
    """Repeated ids vote together, null ids not at all, ties go to the lowest class, short vectors have no share."""
    from scoutml.operators import ensemble

    rows = [(1, 0.0, [0.6, 0.4], [0.4, 0.6]), (1, 1.0, [0.1, 0.9], [0.2, 0.8]), (2, 1.0, [0.5, 0.5], [0.5, 0.5]),
            (3, 0.0, [0.9, 0.1], [0.2, 0.8]), (None, 1.0, [0.0, 1.0], [0.0, 1.0]), (4, 0.0, [0.3], [0.2, 0.8])]
    df = spark.createDataFrame(rows, "row_id long, label double, a array<double>, b array<double>")
    preds = df.select("row_id", F.lit(0).alias("member"), F.col("a").alias("probability")).unionByName(
        df.select("row_id", F.lit(1).alias("member"), F.col("b").alias("probability")))
    joined = ensemble.soft_vote(preds).join(df.select("row_id", "label"), "row_id")
    want = joined.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert ensemble.soft_vote_accuracy(df, ["a", "b"], 2) == pytest.approx(want) == pytest.approx(2 / 5)


def test_long_tables_in_few_partitions_are_dealt_to_more(spark, monkeypatch):
    from scoutml.operators import tuning

    monkeypatch.setattr(tuning, "SPREAD", 20)
    df = spark.range(60).coalesce(1)
    out = tuning._spread(df, 60)
    assert out.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism) and out.count() == 60
    assert tuning._spread(df, 30).rdd.getNumPartitions() == 1
