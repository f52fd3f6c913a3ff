"""Registered queries: routing prompts to a mode, models and algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutml.operators import route as R
from scoutml.plans.fixtures import table, user_prompts

TASKS = ["classification", "regression"]
_TOKEN_SPLIT = "[ \\t\\n\\r]+"
_EDGE_PUNCT = "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$"


def route_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts against a dataset that has a target column."""
    p = user_prompts(spark, sf)
    return p.select("conv_id", "turn", R.needs_unsupervised(F.col("text"), True).alias("unsupervised"))


def _with_tasks(p: DataFrame) -> DataFrame:
    # two literal tasks: each prompt is routed once per task (a 2x expansion, not a join)
    return p.withColumn("task", F.explode(F.array(*[F.lit(t) for t in TASKS])))


def prompt_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models named by each prompt, per task, in list order."""
    p = _with_tasks(user_prompts(spark, sf))
    return p.select("conv_id", "turn", "task", F.posexplode(R.prompt_models(F.col("text"), F.col("task"))).alias("pos", "model"))


def prompt_algos(spark: SparkSession, sf: str) -> DataFrame:
    """Algorithms named by each prompt."""
    p = user_prompts(spark, sf)
    return p.select("conv_id", "turn", F.posexplode(R.prompt_algos(F.col("text"))).alias("pos", "algo"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = user_prompts(spark, sf)
    words = p.select(F.explode(F.split(F.lower("text"), _TOKEN_SPLIT)).alias("w"))
    return words.select(F.regexp_replace("w", _EDGE_PUNCT, "").alias("token")).where(F.col("token") != "").distinct()


def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct prompt word resolved as a model and as an algorithm name."""
    t = _tokens(spark, sf)
    return t.select("token", R.resolve_model(F.col("token")).alias("model_key"), R.resolve_algo(F.col("token")).alias("algo_runner"))


def compatible_models(spark: SparkSession, sf: str) -> DataFrame:
    """P10: resolved registry models and whether each task may train them."""
    keys = [k for k, _ in R.MODEL_REGISTRY]
    t = _tokens(spark, sf).select("token", R.resolve_model(F.col("token")).alias("model_key"))
    t = t.where(F.col("model_key").isin(keys))
    t = _with_tasks(t)
    return t.select("token", "model_key", "task", R.compatible(F.col("model_key"), F.col("task")).alias("compatible"))


def split_model_list(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated list -> stripped, non-empty items, over all turns."""
    cv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return R.explode_list(cv, "text")


QUERIES = {
    "route_prompts": route_prompts, "prompt_models": prompt_models, "prompt_algos": prompt_algos,
    "resolve_names": resolve_names, "compatible_models": compatible_models, "split_model_list": split_model_list,
}


# ----------------------------------------------------------------------------- oracles
def _q(s: str) -> str:
    return s.replace("'", "''")


def _pat(words: list[str]) -> str:
    return "|".join(f"({R.word_pattern(w)})" for w in words)


def _names_values(aliases, names) -> str:
    rows = []
    for i, n in enumerate(names):
        pats = [a for a, m in aliases + [(x.lower(), x) for x in names] if m == n]
        rows.append(f"({i}, '{_q(n)}', '{_q(_pat(pats))}')")
    return "VALUES " + ", ".join(rows)


def _list_values(task: str, names: list[str]) -> str:
    return ", ".join(f"('{task}', {i}, '{_q(n)}')" for i, n in enumerate(names))


_PROMPTS = "(SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')"

_PROMPT_MODELS = f"""
WITH p AS (SELECT conv_id, turn, t, task FROM {_PROMPTS}, (VALUES ('classification'), ('regression')) v(task)),
names AS (SELECT * FROM ({_names_values(R.MODEL_ALIASES, R.MODEL_NAMES)}) x(ord, name, pat)),
allowed AS (SELECT * FROM (VALUES {_list_values('classification', R.CLASSIFICATION_MODELS)},
                                  {_list_values('regression', R.REGRESSION_MODELS)}) a(task, ord, name)),
defaults AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(R.DEFAULT_MODELS))}) d(ord, name)),
named AS (SELECT p.conv_id, p.turn, p.task, n.ord, n.name FROM p JOIN names n ON regexp_matches(p.t, n.pat)
          JOIN allowed a ON a.task = p.task AND a.name = n.name),
has_named AS (SELECT DISTINCT conv_id, turn, task FROM named),
rest AS (SELECT p.* FROM p ANTI JOIN has_named h USING (conv_id, turn, task)),
top5 AS (SELECT r.conv_id, r.turn, r.task, a.ord, a.name FROM rest r JOIN allowed a ON a.task = r.task
         WHERE regexp_matches(r.t, '{_q(_pat(R.ALL_MODELS_WORDS))}') AND a.ord < 5),
dflt AS (SELECT r.conv_id, r.turn, r.task, d.ord, d.name FROM rest r, defaults d
         WHERE NOT regexp_matches(r.t, '{_q(_pat(R.ALL_MODELS_WORDS))}')),
alls AS (SELECT * FROM named UNION ALL SELECT * FROM top5 UNION ALL SELECT * FROM dflt)
SELECT conv_id, turn, task, CAST(row_number() OVER (PARTITION BY conv_id, turn, task ORDER BY ord) - 1 AS INTEGER) AS pos,
       name AS model FROM alls"""


def _algo_groups() -> str:
    rows = [f"({i}, '{a}', '{_q(_pat(R.CLUSTER_WORDS))}')" for i, a in enumerate(R.CLUSTER_ALGOS)]
    rows += [f"({i + len(R.CLUSTER_ALGOS)}, '{a}', '{_q(_pat(R.ANOMALY_WORDS))}')" for i, a in enumerate(R.ANOMALY_ALGOS)]
    return "VALUES " + ", ".join(rows)


_PROMPT_ALGOS = f"""
WITH p AS (SELECT conv_id, turn, t FROM {_PROMPTS}),
names AS (SELECT * FROM ({_names_values(R.ALGO_ALIASES, R.ALGO_NAMES)}) x(ord, name, pat)),
groups AS (SELECT * FROM ({_algo_groups()}) g(ord, name, pat)),
alln AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(R.ALGO_NAMES))}) a(ord, name)),
dflt AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(R.DEFAULT_ALGOS))}) d(ord, name)),
named AS (SELECT p.conv_id, p.turn, n.ord, n.name FROM p JOIN names n ON regexp_matches(p.t, n.pat)),
r1 AS (SELECT p.* FROM p ANTI JOIN (SELECT DISTINCT conv_id, turn FROM named) h USING (conv_id, turn)),
everything AS (SELECT r1.conv_id, r1.turn, a.ord, a.name FROM r1, alln a
               WHERE regexp_matches(r1.t, '{_q(_pat(R.ALL_ALGOS_WORDS))}')),
r2 AS (SELECT * FROM r1 WHERE NOT regexp_matches(r1.t, '{_q(_pat(R.ALL_ALGOS_WORDS))}')),
grouped AS (SELECT r2.conv_id, r2.turn, g.ord, g.name FROM r2 JOIN groups g ON regexp_matches(r2.t, g.pat)),
r3 AS (SELECT r2.* FROM r2 ANTI JOIN (SELECT DISTINCT conv_id, turn FROM grouped) h USING (conv_id, turn)),
fallback AS (SELECT r3.conv_id, r3.turn, d.ord, d.name FROM r3, dflt d),
alls AS (SELECT * FROM named UNION ALL SELECT * FROM everything UNION ALL SELECT * FROM grouped UNION ALL SELECT * FROM fallback)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) - 1 AS INTEGER) AS pos, name AS algo
FROM alls"""

_TOKENS = f"""(SELECT DISTINCT token FROM (
    SELECT regexp_replace(w, '{_q(_EDGE_PUNCT)}', '', 'g') AS token
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS w FROM conversations WHERE role = 'user'))
  WHERE token <> '')"""

_REG = "VALUES " + ", ".join(f"({i}, '{k}')" for i, (k, _) in enumerate(R.MODEL_REGISTRY))
_ALG = "VALUES " + ", ".join(f"({i}, '{k}', '{r}')" for i, (k, r) in enumerate(R.ALGO_REGISTRY))

_RESOLVE = f"""
WITH tok AS {_TOKENS},
reg AS (SELECT * FROM ({_REG}) r(ord, key)),
alg AS (SELECT * FROM ({_ALG}) a(ord, key, runner)),
m AS (SELECT token, coalesce(min(CASE WHEN key = token THEN ord END),
                             min(CASE WHEN contains(token, key) OR contains(key, token) THEN ord END)) AS o
      FROM tok, reg GROUP BY token),
a AS (SELECT token, coalesce(min(CASE WHEN key = token THEN ord END),
                             min(CASE WHEN contains(token, key) OR contains(key, token) THEN ord END)) AS o
      FROM tok, alg GROUP BY token)
SELECT m.token, coalesce(reg.key, m.token) AS model_key, alg.runner AS algo_runner
FROM m LEFT JOIN reg ON reg.ord = m.o JOIN a USING (token) LEFT JOIN alg ON alg.ord = a.o"""

_CLS_ONLY = " OR ".join(f"contains(model_key, '{x}')" for x in R.CLASSIFICATION_ONLY)
_REG_ONLY = " OR ".join(f"contains(model_key, '{x}')" for x in R.REGRESSION_ONLY)

_COMPATIBLE = f"""
WITH r AS ({_RESOLVE}),
k AS (SELECT token, model_key FROM r WHERE model_key IN (SELECT key FROM ({_REG}) x(ord, key)))
SELECT token, model_key, task,
       NOT ((task = 'regression' AND ({_CLS_ONLY})) OR (task = 'classification' AND ({_REG_ONLY}))) AS compatible
FROM k, (VALUES ('classification'), ('regression')) v(task)"""

_SPLIT = r"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','),
              lambda s: regexp_replace(s, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda s: s <> '') AS items
           FROM conversations)
SELECT conv_id, turn, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS pos, unnest(items) AS item FROM l"""

_KW = " OR ".join(f"contains(lower(text), '{k}')" for k in R.UNSUPERVISED_KEYWORDS)

ORACLE = {
    "route_prompts": f"SELECT conv_id, turn, ({_KW}) AS unsupervised FROM conversations WHERE role = 'user'",
    "prompt_models": _PROMPT_MODELS,
    "prompt_algos": _PROMPT_ALGOS,
    "resolve_names": _RESOLVE,
    "compatible_models": _COMPATIBLE,
    "split_model_list": _SPLIT,
}
