"""Registered queries: models, CV, tuning, voting, leaderboards (M*, C3–C9, A1–A8, A11, A12, A16)."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.operators import ensemble as EN
from scoutml.operators import folds as FO
from scoutml.operators import leaderboard as LB
from scoutml.operators import neighbors as NB
from scoutml.operators import prepare as PR
from scoutml.operators import tuning as TU
from scoutml.operators.models import registry
from scoutml.operators.models.base import FEATURES, LABEL
from scoutml.plans.fixtures import customer_xy, embedding_vectors, table
from scoutml.plans.supervised import run_automl

R6 = 6


# ---------------------------------------------------------------- fixtures
def _cls_raw(spark, sf) -> DataFrame:
    """customer: features (acctbal, nationkey), label = segment code."""
    c = PR.label_encode(customer_xy(spark, sf), ["target"])
    asm = VectorAssembler(inputCols=["acctbal", "nationkey"], outputCol=FEATURES)
    return asm.transform(c.select("row_id", "acctbal", "nationkey", F.col("target").cast("double").alias(LABEL)))


def _reg_raw(spark, sf) -> DataFrame:
    """lineitem: price from quantity (one feature); the key columns form the row id."""
    li = table(spark, sf, "lineitem")
    rid = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    asm = VectorAssembler(inputCols=["l_quantity"], outputCol=FEATURES)
    return asm.transform(li.select(rid.alias("row_id"), "l_quantity", F.col("l_extendedprice").alias(LABEL)))


def _part_reg(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("row_id"), "p_size", "p_brand", "p_type", F.col("p_retailprice").alias("target"))


def _doc_bin(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("row_id"), "lang", "source", "n_chars", "toxic", F.col("quality").alias("target"))


# ---------------------------------------------------------------- S models
def model_gnb(spark, sf):
    """M20 fitted on all rows, scored on all rows."""
    df = _cls_raw(spark, sf)
    fit = registry.build("naive bayes", "classification", {"var_smoothing": 1e-9}, 5).fit(df)
    return fit.predict(df).select("row_id", F.col("prediction").cast("int").alias("prediction"))


def model_lda(spark, sf):
    """M21 fitted on all rows, scored on all rows."""
    df = _cls_raw(spark, sf)
    fit = registry.build("lda", "classification", {}, 5).fit(df)
    return fit.predict(df).select("row_id", F.col("prediction").cast("int").alias("prediction"))


def _emb_knn(spark, sf, k):
    e = embedding_vectors(spark, sf)
    q = e.select(F.col("row_id").alias("lid"), F.col("x").alias("lx"))
    r = e.select(F.col("row_id").alias("rid"), F.col("x").alias("rx"), "label")
    return NB.knn(q, r, k, exclude_self=True, payload="label")


def model_knn(spark, sf):
    """Leave-one-out 5-NN vote over the embeddings (tie -> lowest class)."""
    return NB.vote(_emb_knn(spark, sf, 5), "label").select(
        F.col("lid").alias("row_id"), F.col("prediction").cast("int").alias("prediction"))


def _linear(kind: str, params: dict):
    def q(spark, sf):
        df = _reg_raw(spark, sf)
        fit = registry.build(kind, "regression", params).fit(df)
        m = fit.model
        return spark.createDataFrame(
            [(kind, round(float(m.coefficients[0]), 4), round(float(m.intercept), 2))],
            "model string, slope double, intercept double")
    q.__doc__ = f"M13–M15: {kind} on one feature (closed form in the oracle)."
    return q


# ---------------------------------------------------------------- voting (S)
def vote_hard(spark, sf):
    """A2: majority of three LOO kNN members (k = 3, 5, 7) on the embeddings."""
    parts = []
    near = _emb_knn(spark, sf, 7)  # the members' neighbours are its first k
    for i, k in enumerate([3, 5, 7]):
        p = NB.vote(near.where(F.col("nn_rank") <= k), "label").select(F.col("lid").alias("row_id"), F.lit(i).alias("member"), "prediction")
        parts.append(p)
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return EN.hard_vote(allp).select("row_id", F.col("prediction").cast("int").alias("prediction"))


def vote_soft(spark, sf):
    """A1: mean of the members' neighbour class shares, argmax, tie -> lowest class."""
    members = [3, 5, 7]
    near = _emb_knn(spark, sf, max(members))  # the members' neighbours are its first k
    parts = [NB.class_shares(near.where(F.col("nn_rank") <= k), "label").select(
        F.col("lid").alias("row_id"), F.col("label").alias("cls"), "p") for k in members]
    shares = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return EN.soft_vote_of_shares(shares, len(members)).select("row_id", F.col("prediction").cast("int").alias("prediction"))


def vote_average(spark, sf):
    """A3: mean of linear, ridge and lasso predictions on lineitem."""
    df = _reg_raw(spark, sf)
    parts = []
    for i, (kind, params) in enumerate([("linear regression", {}), ("ridge regression", {"alpha": 10.0}),
                                        ("lasso regression", {"alpha": 1.0})]):
        fit = registry.build(kind, "regression", params).fit(df)
        parts.append(fit.predict(df).select("row_id", F.lit(i).alias("member"), "prediction"))
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return EN.average(allp).agg(F.round(F.avg("prediction"), 2).alias("mean_prediction"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- leaderboards
def _in_sample_records(spark, sf) -> DataFrame:
    """Per-model accuracies that SQL can reproduce: GNB, LDA in sample; 5-NN leave-one-out."""
    df = _cls_raw(spark, sf)
    recs = []
    for name, key in [("Naive Bayes", "naive bayes"), ("LDA", "lda")]:
        fit = registry.build(key, "classification", {}, 5).fit(df)
        acc = fit.predict(df).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
        recs.append({"name": name, "score": round(acc, 6), "best_params": {}, "n_trials": 1})
    e = df.select("row_id", PR.q(FEATURES))
    from scoutml.functions.vectors import to_array
    q = e.select(F.col("row_id").alias("lid"), to_array(FEATURES).alias("lx"))
    r = df.select(F.col("row_id").alias("rid"), to_array(FEATURES).alias("rx"), LABEL)
    pred = NB.vote(NB.knn(q, r, 5, exclude_self=True, payload=LABEL), LABEL)
    acc = pred.join(df.select(F.col("row_id").alias("lid"), LABEL), "lid").agg(
        F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
    recs.append({"name": "KNN", "score": round(acc, 6), "best_params": {"n_neighbors": 5, "weights": "uniform"}, "n_trials": 1})
    return LB.records_frame(spark, recs)


def leaderboard_rank(spark, sf):
    """A5 + A8 + A16: ranked comparison table with medals."""
    return LB.comparison(_in_sample_records(spark, sf), True)


def _with_folds(pred: DataFrame) -> DataFrame:
    return FO.kfold(pred.select("row_id", "prediction", LABEL), "row_id")


def metric_accuracy(spark, sf):
    """C4 + C9: accuracy of the naive Bayes predictions in each fold, and their mean."""
    df = _cls_raw(spark, sf)
    fit = registry.build("naive bayes", "classification", {"var_smoothing": 1e-9}, 5).fit(df)
    return _metric_rows(FO.fold_accuracy(_with_folds(fit.predict(df))))


def metric_rmse(spark, sf):
    """C5 + C9: RMSE of the linear predictions of part prices by size in each fold, and their mean."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias(LABEL))
    df = VectorAssembler(inputCols=["x"], outputCol=FEATURES).transform(p)
    fit = registry.build("linear regression", "regression", {}).fit(df)
    return _metric_rows(FO.fold_rmse(_with_folds(fit.predict(df))))


def _metric_rows(per_fold: DataFrame) -> DataFrame:
    """(fold, metric), with the mean over folds as fold -1."""
    mean = FO.cv_mean(per_fold).select(F.lit(-1).alias("fold"), F.col("cv_score").alias("metric"))
    return per_fold.select("fold", F.round("metric", 6).alias("metric")).unionByName(mean)


def best_model(spark, sf):
    """First valid by score, submit order on ties."""
    return LB.best(_in_sample_records(spark, sf), True)


def top3_models(spark, sf):
    """A7."""
    return LB.top_k(_in_sample_records(spark, sf), True, 3).select("position", "name", F.round("score", 6).alias("score"))


def leaderboard_cls(spark, sf, n_trials: int = 2):
    """Flagship (minimum slice): customer segment from balance and nation through
    label encoding, median fill, interactions, ANOVA selection, stratified
    5-fold CV of naive Bayes, logistic regression and a decision tree, ranked."""
    res = run_automl(customer_xy(spark, sf), ["Naive Bayes", "Logistic Regression", "Decision Tree"],
                     key_col="row_id", n_trials=n_trials, with_ensemble=False)
    return res["leaderboard"].select("position", "name", F.round("score", 6).alias("score"), "n_trials", "error")


def leaderboard_reg(spark, sf, n_trials: int = 2):
    """Regression leaderboard on part prices (RMSE ascending, D1)."""
    res = run_automl(_part_reg(spark, sf), ["Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree"],
                     key_col="row_id", n_trials=n_trials, with_ensemble=False)
    return res["leaderboard"].select("position", "name", F.round("score", 6).alias("score"), "n_trials", "error")


def ensemble_cv(spark, sf):
    """A4: top-3 voting ensemble of a small run, 5-fold CV."""
    res = run_automl(customer_xy(spark, sf), ["Naive Bayes", "LDA", "Decision Tree"], key_col="row_id", n_trials=1)
    e = res.get("ensemble", {})
    return spark.createDataFrame([(json.dumps(e.get("models_used", [])), e.get("cv_score"), e.get("metric"), e.get("voting"))],
                                 "models_used string, cv_score double, metric string, voting string")


def param_table(spark, sf):
    """Best parameters of a tuned run as (model, parameter, value, type)."""
    res = run_automl(customer_xy(spark, sf), ["Decision Tree", "KNN"], key_col="row_id", n_trials=2, with_ensemble=False)
    return LB.param_table(res["leaderboard"])


def split_anomaly_algos(spark, sf):
    """Prompt-chosen algorithms split into anomaly detectors and clusterers."""
    from scoutml.operators import route as R
    from scoutml.plans.fixtures import user_prompts

    p = user_prompts(spark, sf).select("conv_id", "turn", F.explode(R.prompt_algos(F.col("text"))).alias("algo"))
    return p.select("conv_id", "turn", "algo", LB.is_anomaly_algo(F.col("algo")).alias("is_anomaly"))


# ---------------------------------------------------------------- CV / tuning (R)
def cv_pipeline(spark, sf):
    """Per fold, the features selected on the training folds and the fold accuracy."""
    prep = TU.prepare_supervised(customer_xy(spark, sf), "target", "row_id")
    rows = []
    for f in range(5):
        train, test = TU.fold_split(prep, f)
        fit = registry.build("naive bayes", prep.task, {}, prep.n_classes).fit(train)
        acc = TU.fold_metric(fit.predict(test), prep.task)
        idx = TU.top_k(TU.f_scores(train, prep.task), prep.k_select)
        rows.append((f, json.dumps(idx), round(float(acc), 6), test.count()))
    return spark.createDataFrame(rows, "fold int, selected string, accuracy double, n_test long")


def tune_random_search(spark, sf):
    """Seeded random search, one row per (trial, fold)."""
    prep = TU.prepare_supervised(customer_xy(spark, sf), "target", "row_id")
    _, trials = TU.tune(prep, "decision tree", 3)
    rows = [(t["trial"], t["params"], i, float(s)) for t in trials for i, s in enumerate(t["fold_scores"])]
    return spark.createDataFrame(rows, "trial int, params string, fold int, metric double")


def trial_errors(spark, sf):
    """A model whose trials fail keeps a null score and its error, listed last."""
    res = run_automl(customer_xy(spark, sf), ["Naive Bayes", "not a model"], key_col="row_id", n_trials=1, with_ensemble=False)
    return res["leaderboard"].select("position", "name", F.col("score").isNull().alias("failed"), "error")


def _model_query(key: str, task: str, fixture):
    def q(spark, sf):
        prep = TU.prepare_supervised(fixture(spark, sf), "target", "row_id")
        params = registry.lower_params(key, prep.task)
        per_fold = TU.cross_validate(prep, key, params)
        return spark.createDataFrame([(key, json.dumps(params, default=str), i, float(s)) for i, s in enumerate(per_fold)],
                                     "model string, params string, fold int, metric double")
    q.__doc__ = f"{key}: the low end of its search space, 5-fold CV metric per fold."
    return q


def _cust(spark, sf):
    return customer_xy(spark, sf)


_MODEL_FIXTURES = {
    "random_forest": ("random forest", _cust), "xgboost": ("xgboost", _doc_bin), "lightgbm": ("lightgbm", _doc_bin),
    "catboost": ("catboost", _doc_bin), "gradient_boosting": ("gradient boosting", _part_reg),
    "adaboost": ("adaboost", _cust), "extra_trees": ("extra trees", _cust), "bagging": ("bagging", _cust),
    "decision_tree": ("decision tree", _cust), "knn_cv": ("knn", _cust), "svm": ("svm", _doc_bin),
    "svr": ("svm", _part_reg), "logistic_regression": ("logistic regression", _cust),
    "elastic_net": ("elastic net", _part_reg), "sgd_classifier": ("sgd", _cust), "sgd_regressor": ("sgd", _part_reg),
    "bayesian_ridge": ("bayesian ridge", _part_reg), "huber": ("huber", _part_reg), "naive_bayes_cv": ("naive bayes", _cust),
    "xgboost_multiclass": ("xgboost", _cust), "xgboost_reg": ("xgboost", _part_reg), "gradient_boosting_cls": ("gradient boosting", _doc_bin),
    "extra_trees_reg": ("extra trees", _part_reg), "bagging_reg": ("bagging", _part_reg),
    "lda_cv": ("lda", _cust), "random_forest_reg": ("random forest", _part_reg), "knn_reg": ("knn", _part_reg),
}

QUERIES = {
    "model_gnb": model_gnb, "model_lda": model_lda, "model_knn": model_knn,
    "model_linear_regression": _linear("linear regression", {}),
    "model_ridge_regression": _linear("ridge regression", {"alpha": 10.0}),
    "model_lasso_regression": _linear("lasso regression", {"alpha": 1.0}),
    "vote_hard": vote_hard, "vote_soft": vote_soft, "vote_average": vote_average,
    "metric_accuracy": metric_accuracy, "metric_rmse": metric_rmse,
    "leaderboard_rank": leaderboard_rank, "best_model": best_model, "top3_models": top3_models,
    "leaderboard_cls": leaderboard_cls, "leaderboard_reg": leaderboard_reg, "ensemble_cv": ensemble_cv,
    "param_table": param_table, "split_anomaly_algos": split_anomaly_algos, "cv_pipeline": cv_pipeline,
    "tune_random_search": tune_random_search, "trial_errors": trial_errors,
}
for _name, (_key, _fx) in _MODEL_FIXTURES.items():
    QUERIES[f"model_{_name}"] = _model_query(_key, "", _fx)


# ---------------------------------------------------------------- oracles
_CLS = """d AS (SELECT c_custkey AS row_id, c_acctbal AS x0, CAST(c_nationkey AS DOUBLE) AS x1,
                 dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS y FROM customer)"""

_GNB = f"""WITH {_CLS},
e AS (SELECT 1e-9 * greatest(var_pop(x0), var_pop(x1)) AS eps, count(*) AS n FROM d),
s AS (SELECT y, count(*) AS nk, avg(x0) AS m0, avg(x1) AS m1, var_pop(x0) AS v0, var_pop(x1) AS v1 FROM d GROUP BY y),
j AS (SELECT d.row_id, s.y, ln(s.nk / e.n) - 0.5 * (ln(2*pi()*(v0+eps)) + ln(2*pi()*(v1+eps)))
             - 0.5 * ((x0-m0)*(x0-m0)/(v0+eps) + (x1-m1)*(x1-m1)/(v1+eps)) AS jll FROM d, s, e)
SELECT row_id, CAST(y AS INTEGER) AS prediction FROM (
  SELECT row_id, y, row_number() OVER (PARTITION BY row_id ORDER BY jll DESC, y) AS r FROM j) WHERE r = 1"""

_LDA = f"""WITH {_CLS},
s AS (SELECT y, count(*) AS nk, avg(x0) AS m0, avg(x1) AS m1 FROM d GROUP BY y),
w AS (SELECT sum((x0-m0)*(x0-m0)) AS a, sum((x0-m0)*(x1-m1)) AS b, sum((x1-m1)*(x1-m1)) AS c,
             count(*) AS n, (SELECT count(*) FROM s) AS k FROM d JOIN s USING (y)),
p AS (SELECT a/(n-k) AS a, b/(n-k) AS b, c/(n-k) AS c, n FROM w),
inv AS (SELECT c/(a*c-b*b) AS p00, -b/(a*c-b*b) AS p01, a/(a*c-b*b) AS p11, n FROM p),
coef AS (SELECT y, p00*m0 + p01*m1 AS w0, p01*m0 + p11*m1 AS w1,
                -0.5*(m0*(p00*m0 + p01*m1) + m1*(p01*m0 + p11*m1)) + ln(nk / n) AS b0 FROM s, inv),
j AS (SELECT d.row_id, coef.y, x0*w0 + x1*w1 + b0 AS sc FROM d, coef)
SELECT row_id, CAST(y AS INTEGER) AS prediction FROM (
  SELECT row_id, y, row_number() OVER (PARTITION BY row_id ORDER BY sc DESC, y) AS r FROM j) WHERE r = 1"""


def _knn_sql(k: int) -> str:
    return f"""(SELECT a.vec_id AS lid, b.vec_id AS rid, b.label,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS nn
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def _vote_sql(k: int) -> str:
    return f"""(SELECT lid, label AS prediction FROM (
      SELECT lid, label, row_number() OVER (PARTITION BY lid ORDER BY count(*) DESC, label) AS r
      FROM {_knn_sql(k)} WHERE nn <= {k} GROUP BY lid, label) WHERE r = 1)"""


_KNN_ALL = f"""(SELECT lid, rid, label, nn FROM {_knn_sql(7)} WHERE nn <= 7)"""

_LIN = """(SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)"""


def _lin_sql(kind: str, slope: str) -> str:
    return f"""WITH s AS (SELECT covar_pop(x, y) AS cxy, var_pop(x) AS vx, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM {_LIN}),
w AS (SELECT {slope} AS w, mx, my FROM s)
SELECT '{kind}' AS model, round(w, 4) AS slope, round(my - w*mx, 2) AS intercept FROM w"""


_LB_SELECT = """SELECT CAST(row_number() OVER (ORDER BY score DESC, submit_order) AS INTEGER) AS position,
  CASE WHEN row_number() OVER (ORDER BY score DESC, submit_order) = 1 THEN '🥇'
       WHEN row_number() OVER (ORDER BY score DESC, submit_order) = 2 THEN '🥈'
       WHEN row_number() OVER (ORDER BY score DESC, submit_order) = 3 THEN '🥉'
       ELSE '#' || CAST(row_number() OVER (ORDER BY score DESC, submit_order) AS VARCHAR) END AS rank_label,
  name, round(score, 4) AS score, n_trials FROM rec"""


def _records_cte() -> str:
    gnb = _GNB.split(f"WITH {_CLS},", 1)[1]
    lda = _LDA.split(f"WITH {_CLS},", 1)[1]
    return f"""WITH {_CLS},
gnb AS (WITH {gnb.strip()}),
lda AS (WITH {lda.strip()}),
knn AS (SELECT a.row_id AS lid, b.row_id AS rid, b.y,
               row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt((a.x0-b.x0)*(a.x0-b.x0) + (a.x1-b.x1)*(a.x1-b.x1)), b.row_id) AS nn
        FROM d a JOIN d b ON a.row_id <> b.row_id),
kv AS (SELECT lid, y AS prediction FROM (
         SELECT lid, y, row_number() OVER (PARTITION BY lid ORDER BY count(*) DESC, y) AS r FROM knn WHERE nn <= 5 GROUP BY lid, y)
       WHERE r = 1),
rec AS (
  SELECT 'Naive Bayes' AS name, round(avg(CAST(g.prediction = d.y AS DOUBLE)), 6) AS score, 0 AS submit_order, 1 AS n_trials
    FROM gnb g JOIN d USING (row_id)
  UNION ALL SELECT 'LDA', round(avg(CAST(l.prediction = d.y AS DOUBLE)), 6), 1, 1 FROM lda l JOIN d USING (row_id)
  UNION ALL SELECT 'KNN', round(avg(CAST(k.prediction = d.y AS DOUBLE)), 6), 2, 1 FROM kv k JOIN d ON d.row_id = k.lid)
"""


ORACLE = {
    "model_gnb": _GNB,
    "model_lda": _LDA,
    "model_knn": f"SELECT lid AS row_id, CAST(prediction AS INTEGER) AS prediction FROM {_vote_sql(5)}",
    "model_linear_regression": _lin_sql("linear regression", "cxy / vx"),
    "model_ridge_regression": _lin_sql("ridge regression", "cxy / (vx + 10.0 / n)"),
    "model_lasso_regression": _lin_sql("lasso regression", "sign(cxy) * greatest(abs(cxy) - 1.0, 0) / vx"),
    "vote_hard": f"""WITH nn AS {_KNN_ALL},
v AS (SELECT lid, k, label FROM (
        SELECT lid, k, label, row_number() OVER (PARTITION BY lid, k ORDER BY count(*) DESC, label) AS r
        FROM nn, (VALUES (3), (5), (7)) t(k) WHERE nn <= k GROUP BY lid, k, label) WHERE r = 1)
SELECT lid AS row_id, CAST(label AS INTEGER) AS prediction FROM (
  SELECT lid, label, row_number() OVER (PARTITION BY lid ORDER BY count(*) DESC, label) AS r FROM v GROUP BY lid, label) WHERE r = 1""",
    "vote_soft": f"""WITH nn AS {_KNN_ALL},
sh AS (SELECT lid, k, label, count(*) / k AS p FROM nn, (VALUES (3), (5), (7)) t(k) WHERE nn <= k GROUP BY lid, k, label),
avgp AS (SELECT lid, label, sum(p) / 3 AS p FROM sh GROUP BY lid, label)
SELECT lid AS row_id, CAST(label AS INTEGER) AS prediction FROM (
  SELECT lid, label, row_number() OVER (PARTITION BY lid ORDER BY p DESC, label) AS r FROM avgp) WHERE r = 1""",
    "vote_average": f"""WITH s AS (SELECT covar_pop(x, y) AS cxy, var_pop(x) AS vx, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM {_LIN}),
w AS (SELECT cxy / vx AS w1, cxy / (vx + 10.0 / n) AS w2, sign(cxy) * greatest(abs(cxy) - 1.0, 0) / vx AS w3, mx, my, n FROM s),
p AS (SELECT ((my + w1*(x-mx)) + (my + w2*(x-mx)) + (my + w3*(x-mx))) / 3 AS pred FROM {_LIN}, w)
SELECT round(avg(pred), 2) AS mean_prediction, count(*) AS n_rows FROM p""",
    "leaderboard_rank": _records_cte() + _LB_SELECT,
    "best_model": _records_cte() + "SELECT name AS best_model, score AS best_score FROM rec ORDER BY score DESC, submit_order LIMIT 1",
    "top3_models": _records_cte() + """SELECT CAST(row_number() OVER (ORDER BY score DESC, submit_order) AS INTEGER) AS position,
        name, round(score, 6) AS score FROM rec QUALIFY position <= 3""",
}


def _split_anomaly_sql() -> str:
    from scoutml.plans.q_route import _PROMPT_ALGOS

    names = ", ".join(f"'{n}'" for n in LB.ANOMALY_NAMES)
    return f"SELECT conv_id, turn, algo, lower(algo) IN ({names}) AS is_anomaly FROM ({_PROMPT_ALGOS})"


ORACLE["split_anomaly_algos"] = _split_anomaly_sql()



_BLOCK_FOLD = """CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
       ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END"""

ORACLE["metric_accuracy"] = f"""WITH {_CLS},
gnb AS (WITH {_GNB.split(f"WITH {_CLS},", 1)[1].strip()}),
p AS (SELECT CAST(g.prediction = d.y AS DOUBLE) AS hit, row_number() OVER (ORDER BY d.row_id) - 1 AS r, count(*) OVER () AS n FROM gnb g JOIN d USING (row_id)),
f AS (SELECT CAST({_BLOCK_FOLD} AS INTEGER) AS fold, avg(hit) AS metric FROM p GROUP BY 1)
SELECT fold, round(metric, 6) AS metric FROM f UNION ALL SELECT -1, round(avg(metric), 6) FROM f"""

ORACLE["metric_rmse"] = f"""WITH w AS (SELECT covar_pop(p_size, p_retailprice) / var_pop(p_size) AS w, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part),
p AS (SELECT my + w * (p_size - mx) - p_retailprice AS e, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part, w),
f AS (SELECT CAST({_BLOCK_FOLD} AS INTEGER) AS fold, sqrt(avg(e * e)) AS metric FROM p GROUP BY 1)
SELECT fold, round(metric, 6) AS metric FROM f UNION ALL SELECT -1, round(avg(metric), 6) FROM f"""

ORACLE["trial_errors"] = """SELECT CAST(position AS INTEGER) AS position, name, failed, error
FROM (VALUES (1, 'Naive Bayes', false, NULL), (2, 'not a model', true, 'no such model: not a model')) t(position, name, failed, error)
WHERE (SELECT count(DISTINCT c_mktsegment) FROM customer) > 1"""
