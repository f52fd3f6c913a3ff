"""Registered queries: experiment history, result sink, report.

Each user prompt of ``conversations`` becomes one experiment: routed (P6),
its models or algorithms chosen (P7/P8), and scored where the customer slice
has a score for the model (naive Bayes, LDA, kNN accuracies).  Tables are
written under the shared checkpoint folder; the clock is fixed for the checks.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.operators import route as R
from scoutml.plans.fixtures import customer_xy, user_prompts
from scoutml.plans.q_models import _in_sample_records
from scoutml.session import work_path
from scoutml.sources import history as H
from scoutml.sources import report as RP
from scoutml.sources import results as RS

CLOCK = _dt.datetime(2024, 1, 1, 0, 0, 0)


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment per user prompt (see module docstring)."""
    recs = {r["name"]: r["score"] for r in _in_sample_records(spark, sf).collect()}  # one row per model
    scores = F.create_map(*[x for k, v in recs.items() for x in (F.lit(k), F.lit(v))])
    shape = customer_xy(spark, sf)
    n_rows = shape.count()
    p = user_prompts(spark, sf)
    unsup = R.needs_unsupervised(F.col("text"), True)
    chosen = F.when(unsup, R.prompt_algos(F.col("text"))).otherwise(R.prompt_models(F.col("text"), F.lit("classification")))
    models = F.transform(chosen, lambda m: F.struct(m.alias("name"), F.try_element_at(scores, m).alias("score"),
                                                    F.lit(1).alias("n_trials"), F.lit(None).cast("string").alias("error")))
    clus = F.transform(chosen, lambda m: F.struct(m.alias("name"), F.lit(None).cast("double").alias("silhouette")))
    mode = F.when(unsup, F.lit("unsupervised")).otherwise(F.lit("supervised"))
    task = F.when(unsup, F.lit("unsupervised")).otherwise(F.lit("classification"))
    results = F.to_json(F.struct(task.alias("task"), F.when(~unsup, models).alias("models"), F.when(unsup, clus).alias("clustering")))
    return p.select(
        "conv_id", "turn", F.col("text").alias("user_prompt"), mode.alias("mode"), task.alias("task"),
        F.to_json(chosen).alias("selected_models"), results.alias("results"), F.lit("").alias("insight"),
        F.lit(f"[{n_rows}, {len(shape.columns)}]").alias("dataset_shape"))


def _fresh(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    path = work_path(spark, "history")
    return path, H.append(spark, path, experiments(spark, sf), ["conv_id", "turn"], now=CLOCK)


def history_append(spark, sf):
    """Ids, timestamp and best model of the appended rows."""
    _, df = _fresh(spark, sf)
    return df.select("id", "timestamp", "mode", "task", "best_model", F.round("best_score", 6).alias("best_score"))


def history_all(spark, sf):
    """Newest first, list column decoded tolerantly."""
    path, _ = _fresh(spark, sf)
    return H.all_newest_first(spark, path).select("id", "mode", "task", F.size("selected").alias("n_selected"))


def history_by_id(spark, sf):
    """Point lookup of id 3."""
    path, _ = _fresh(spark, sf)
    return H.by_id(spark, path, 3).select("id", "mode", "task", "best_model")


def history_clear(spark, sf):
    """After clearing, the table reads back empty with its schema."""
    path, _ = _fresh(spark, sf)
    return H.clear(spark, path).select("id", "mode")


def history_migrate(spark, sf):
    """First-turn rows written before the mode column existed read back as supervised."""
    path = work_path(spark, "history")
    ex = experiments(spark, sf)
    H.append(spark, path, ex.where(F.col("turn") == 0), ["conv_id", "turn"], now=CLOCK, with_mode=False)
    df = H.append(spark, path, ex.where(F.col("turn") > 0), ["conv_id", "turn"], now=CLOCK)
    return df.select("id", "mode")


def history_summary(spark, sf):
    """A9."""
    _, df = _fresh(spark, sf)
    return H.summary(df)


def history_explode(spark, sf):
    """A10: scored models of each experiment."""
    _, df = _fresh(spark, sf)
    return H.explode_models(df).select("id", "pos", "name", F.round("score", 6).alias("score"))


def result_json_roundtrip(spark, sf):
    """Results written as JSON (wide arrays projected away), read back."""
    _, df = _fresh(spark, sf)
    parsed = df.select("id", F.from_json("results", H.RESULTS_SCHEMA).alias("r"))
    flat = parsed.select("id", F.col("r.task").alias("task"), F.col("r.models").alias("models"),
                         F.col("r.clustering").alias("clustering"), F.lit(None).cast("array<double>").alias("pca_coords"))
    path = RS.write_results(flat, "results")
    back = RS.read_results(spark, path, f"id long, task string, models {H.MODEL_SCHEMA}, clustering array<struct<name:string,silhouette:double>>")
    return back.select("id", "task", F.size(F.coalesce("models", F.array())).alias("n_models"),
                       F.size(F.coalesce("clustering", F.array())).alias("n_algos"))


def report_lines(spark, sf):
    """S10 + F4/F6: report rows per experiment."""
    _, df = _fresh(spark, sf)
    return RP.report_lines(df)


QUERIES = {
    "history_append": history_append, "history_all": history_all, "history_by_id": history_by_id,
    "history_clear": history_clear, "history_migrate": history_migrate, "history_summary": history_summary,
    "history_explode": history_explode, "result_json_roundtrip": result_json_roundtrip, "report_lines": report_lines,
}


# ---------------------------------------------------------------- oracles
def _oracle_base() -> str:
    from scoutml.plans.q_models import _records_cte
    from scoutml.plans.q_route import _KW, _PROMPT_ALGOS, _PROMPT_MODELS

    rec = _records_cte().strip()
    assert rec.startswith("WITH ")
    return f"""{rec},
pm AS ({_PROMPT_MODELS}),
pa AS ({_PROMPT_ALGOS}),
p AS (SELECT conv_id, turn, text, ({_KW}) AS unsup,
             CAST(row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS id
      FROM conversations WHERE role = 'user'),
sel AS (SELECT p.id, p.unsup, pm.pos, pm.model AS name, rec.score FROM p JOIN pm USING (conv_id, turn)
          LEFT JOIN rec ON rec.name = pm.model WHERE NOT p.unsup AND pm.task = 'classification'
        UNION ALL
        SELECT p.id, p.unsup, pa.pos, pa.algo, NULL FROM p JOIN pa USING (conv_id, turn) WHERE p.unsup),
best AS (SELECT id, name AS best_model, score AS best_score FROM (
           SELECT id, name, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS r
           FROM sel WHERE score IS NOT NULL) WHERE r = 1),
h AS (SELECT p.id, '2024-01-01 00:00:00' AS timestamp, CASE WHEN unsup THEN 'unsupervised' ELSE 'supervised' END AS mode,
             CASE WHEN unsup THEN 'unsupervised' ELSE 'classification' END AS task,
             coalesce(best.best_model, '') AS best_model, best.best_score,
             (SELECT count(*) FROM sel WHERE sel.id = p.id) AS n_selected, p.turn
      FROM p LEFT JOIN best USING (id))
"""


def _oracle() -> dict:
    base = _oracle_base()
    return {
        "history_append": base + "SELECT id, timestamp, mode, task, best_model, round(best_score, 6) AS best_score FROM h",
        "history_all": base + "SELECT id, mode, task, CAST(n_selected AS INTEGER) AS n_selected FROM h",
        "history_by_id": base + "SELECT id, mode, task, best_model FROM h WHERE id = 3",
        "history_clear": base + "SELECT id, mode FROM h WHERE false",
        "history_migrate": base + """SELECT CAST(row_number() OVER (ORDER BY turn > 0, id) AS BIGINT) AS id,
            CASE WHEN turn = 0 THEN 'supervised' ELSE mode END AS mode FROM h""",
        "history_summary": base + """SELECT count(*) AS total, count(*) FILTER (WHERE mode = 'supervised') AS supervised,
            count(*) FILTER (WHERE mode = 'unsupervised') AS unsupervised,
            count(*) FILTER (WHERE task = 'classification') AS classification FROM h""",
        "history_explode": base + """SELECT id, CAST(pos AS INTEGER) AS pos, name, round(score, 6) AS score
            FROM sel WHERE score IS NOT NULL""",
        "result_json_roundtrip": base + """SELECT id, task, CAST(CASE WHEN mode = 'supervised' THEN n_selected ELSE 0 END AS INTEGER) AS n_models,
            CAST(CASE WHEN mode = 'unsupervised' THEN n_selected ELSE 0 END AS INTEGER) AS n_algos FROM h""",
    }


ORACLE = _oracle()


def _report_sql() -> str:
    return _oracle_base() + f""", shape AS (SELECT '[' || CAST(count(*) AS VARCHAR) || ', 4]' AS s FROM customer),
run AS (
  SELECT h.id, v.n AS line_no, 'run' AS section, CASE v.n WHEN 0 THEN 'prompt' WHEN 1 THEN 'mode' WHEN 2 THEN 'shape' ELSE 'recorded' END AS label,
    CASE v.n WHEN 0 THEN p.text WHEN 1 THEN h.mode WHEN 2 THEN shape.s ELSE h.timestamp END AS value
  FROM h JOIN p USING (id), shape, (SELECT unnest(range(4)) AS n) v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, pos) AS rank FROM sel),
ranking AS (
  SELECT id, 3 + rank AS line_no, 'ranking' AS section, CAST(rank AS VARCHAR) || '. ' || name AS label,
    coalesce('accuracy ' || printf('%.4f', score) || ', trials 1', 'failed') AS value FROM ranked)
SELECT id, CAST(line_no AS INTEGER) AS line_no, section, regexp_replace(label, '[^\\x{{0000}}-\\x{{00FF}}]', '?', 'g') AS label,
  regexp_replace(value, '[^\\x{{0000}}-\\x{{00FF}}]', '?', 'g') AS value
FROM (SELECT * FROM run UNION ALL SELECT * FROM ranking)"""


ORACLE["report_lines"] = _report_sql()
